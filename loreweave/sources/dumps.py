"""Refresh of dumps: feeds, links, checksums and the download itself. Control plane, on the driver; `fetch` is given by the caller."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

Fetch = Callable[[str], Iterator[bytes]]


def feed_link(xml: Column) -> Column:
    """The first link inside the first item's description."""
    return F.regexp_extract(F.xpath_string(xml, F.lit("//item[1]/description")), '<a[^>]+href="([^"]+)"', 1)


def feed_date(xml: Column) -> Column:
    return F.nullif(F.xpath_string(xml, F.lit("//pubDate")), F.lit(""))


def is_new(published: Column, last: Column) -> Column:
    """A feed date other than the last recorded one; nothing recorded counts as an empty date."""
    return F.coalesce(last, F.lit("")) != published


def checksum_for(lines: DataFrame, name: Column) -> DataFrame:
    """The first token of the first line that contains the name, from lines(line_no, value)."""
    hit = lines.filter(F.contains("value", name)).orderBy("line_no").limit(1)
    return hit.select(F.split(F.trim("value"), "\\s+")[0].alias("checksum"))


def md5_matches(path: str, expected: str) -> bool:
    """Reads the file in pieces; a wrong file is removed."""
    digest = hashlib.md5()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    if digest.hexdigest() != expected:
        os.remove(path)
        return False
    return True


def download(url: str, folder: str, fetch: Fetch) -> str:
    """Writes beside the target under a partial name, then renames it."""
    url = url.replace("http://", "https://")
    target = os.path.join(folder, url.rsplit("/", 1)[-1])
    with open(f"{target}.partial_download", "wb") as f:
        for piece in fetch(url):
            f.write(piece)
    os.replace(f"{target}.partial_download", target)
    return target


def feed_of(fetch: Fetch, url: str) -> tuple[str | None, str | None]:
    """(publication date, first link of the first item) of a feed."""
    xml = b"".join(fetch(url)).decode("utf-8", "ignore")
    date = re.search(r"<pubDate>\s*(.*?)\s*</pubDate>", xml, re.DOTALL)
    item = re.search(r"<item>.*?<description>(.*?)</description>", xml, re.DOTALL)
    inner = item[1].replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&").replace("<![CDATA[", "") if item else ""
    link = re.search(r'<a[^>]+href="([^"]+)"', inner)
    return (date[1] or None) if date else None, link[1] if link else None


def checksum_in(text: str, name: str) -> str | None:
    """The checksum of a file of just that name, from lines of checksum and name."""
    return next((p[0] for p in map(str.split, text.splitlines()) if len(p) > 1 and p[1].lstrip("*") == name), None)


def refresh(feeds: list[tuple[str, str]], md5_url: str, folder: str, last_date: str | None, fetch: Fetch) -> str | None:
    """Downloads what the feeds [(feed url, part)] link to if their date is new; the new date once all files are right, else None."""
    links, date = [], None
    for url, _ in feeds:
        date, link = feed_of(fetch, url)
        if date is None or link is None or date == (last_date or ""):
            return None
        links.append(link)
    sums = b"".join(fetch(md5_url)).decode("utf-8", "ignore")
    for link in links:
        path = download(link, folder, fetch)
        good = checksum_in(sums, os.path.basename(path))
        if good is None:
            os.remove(path)
        if good is None or not md5_matches(path, good):
            return None
    return date
