"""Pages of a dump: split, parse, filter, clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import iso_timestamp, safe_name, strip_markup

#: What a page is told by (fixed values of the dump format). Lazy bodies: a nested alternation can exhaust the JVM's stack on long texts.
TITLE, PAGE_ID, BODY, STAMP = r"(?s)<title>(.*?)</title>", r"(?s)<title>.*?<id>(\d+)</id>", r"(?s)<id>\d+</id>.*?<text[^>]*>(.*?)</text>", r"<timestamp>([^<]+)</timestamp>"
WIKILINK = r"\[\[[^\]]+\]\]"


def split_pages(df: DataFrame, xml: str = "xml") -> DataFrame:
    """A row per page of each XML text; other columns stay."""
    return df.withColumn("page", F.explode(F.regexp_extract_all(xml, F.lit("(?s)<page>(.*?)</page>"), F.lit(1)))).drop(xml)


def parse_pages(df: DataFrame, page: str = "page", source: Column | None = None) -> DataFrame:
    """name, pid, content, last_modified_date, source and the three flags; pages without title, id or text go.

    Titles and raw texts stay encoded, as the flags are judged on them; title is the decoded name.
    """
    p = F.col(page)
    text = F.regexp_extract(p, BODY, 1)
    out = df.select(
        F.regexp_extract(p, TITLE, 1).alias("name"), F.expr(f"try_cast(nullif(regexp_extract({page}, '{PAGE_ID}', 1), '') AS INT)".replace("\\", "\\\\")).alias("pid"), text.alias("content"),
        iso_timestamp(F.nullif(F.regexp_extract(p, STAMP, 1), F.lit(""))).alias("last_modified_date"), (source if source is not None else F.lit(None).cast("string")).alias("source"),
        F.contains(p, F.lit("<ns>0</ns>")).alias("is_namespace_0"), (p.rlike(r"<redirect[ \t\n\r]") | text.rlike(r"(?is)^[ \t\n\r]*#REDIRECT")).alias("is_redirect"), text.rlike(WIKILINK).alias("has_wikilinks"),
    )
    decoded = F.col("name")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(a), F.lit(b))
    return out.filter("name <> '' and content <> '' and pid is not null").withColumn("title", decoded)


def articles(pages: DataFrame) -> DataFrame:
    """Articles proper: namespace 0, no redirect, with a link. Cheap predicates before any join."""
    return pages.filter("is_namespace_0 and not is_redirect and has_wikilinks")


def clean(pages: DataFrame) -> DataFrame:
    return pages.withColumn("content", strip_markup(F.col("content")))


def debug_pages(df: DataFrame, folder: str, page: str = "page") -> None:
    """Raw pages as text files, in a folder per sanitised title."""
    df.select(F.col(page).alias("value"), safe_name(F.regexp_extract(page, TITLE, 1)).alias("title")).write.mode("append").partitionBy("title").text(folder)
