"""A refresh that is broken off after each of its steps."""

import datetime as dt
import hashlib
import itertools
import os

import pytest

from loreweave import schemas
from loreweave.operators import history as hs
from loreweave.sources.refresh import DumpRefresh, checksum_url

NAMES = ["enwiki-20240101-pages-multistream.xml.bz2", "enwiki-20240101-pages-multistream-index.txt.bz2"]


class Site:
    """Feeds, files and checksums; what was fetched is noted, and a fetch can fail."""

    def __init__(self, date="Mon, 01 Jan 2024"):
        self.date, self.fetched, self.fail, self.wrong = date, [], None, ()

    def __call__(self, url):
        self.fetched.append(url)
        if self.fail and self.fail in url:
            raise OSError(url)
        if url.startswith("feed"):
            name = NAMES[url == "feed-index"]
            return iter([f'<rss><channel><item><title>x</title><pubDate>{self.date}</pubDate><description>&lt;a href="http://download.wikimedia.org/enwiki/{name}"&gt;</description></item></channel></rss>'.encode()])
        if url.endswith("md5sums.txt"):
            sums = [f"{'0' * 32}  {n}-rss.xml" for n in NAMES]  # names that begin alike
            return iter(["\n".join(sums + [f"{hashlib.md5(b'bad' if n in self.wrong else n.encode()).hexdigest()}  {n}" for n in NAMES]).encode()])
        return iter([os.path.basename(url).encode()])


@pytest.fixture
def parts(spark, tmp_path):
    clock = (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k) for k in itertools.count())
    history = hs.RunHistory(spark, str(tmp_path / "h"), lambda: next(clock))
    site = Site()
    return history, site, lambda: DumpRefresh(history, str(tmp_path / "d"), site), tmp_path / "d"


def test_a_new_dump_is_recorded_once(parts):
    history, site, refresh, folder = parts
    assert checksum_url(NAMES[0], "https://s") == "https://s/enwiki/20240101/enwiki-20240101-md5sums.txt"
    assert refresh().check("enwiki", "feed-content", "feed-index") == site.date
    assert sorted(os.listdir(folder)) == sorted(NAMES)
    (row,) = history.read().collect()
    assert row["status"] == schemas.DUMP_LINK_UPDATED and row["service_name"] == "cronjob-enwiki" and row["run_id"] is None and refresh().known_date("enwiki") == site.date
    assert all(u.startswith(("https://dumps.wikimedia.org", "feed")) for u in site.fetched)
    site.fetched.clear()
    assert refresh().check("enwiki", "feed-content", "feed-index") is None and site.fetched == ["feed-index"]
    assert refresh().known_date("frwiki") is None


@pytest.mark.parametrize("broken", ["feed-content", NAMES[0], NAMES[1], "md5sums", "record"])
def test_broken_off_and_taken_up(parts, broken, monkeypatch):
    history, site, refresh, folder = parts
    append = hs.RunHistory.append
    if broken == "record":
        monkeypatch.setattr(hs.RunHistory, "append", lambda *a, **k: (_ for _ in ()).throw(OSError("record")))
    else:
        site.fail = broken
    with pytest.raises(OSError):
        refresh().check("enwiki", "feed-content", "feed-index")
    assert history.read().count() == 0
    done = {n for n in NAMES if (folder / n).exists()}
    site.fail = None
    monkeypatch.setattr(hs.RunHistory, "append", append)
    site.fetched.clear()
    assert refresh().check("enwiki", "feed-content", "feed-index") == site.date
    assert not [u for u in site.fetched if os.path.basename(u) in done]  # what was downloaded is not fetched again
    assert history.read().count() == 1 and refresh().state("enwiki") is None


def test_a_wrong_file_is_fetched_again(parts):
    history, site, refresh, folder = parts
    site.wrong = (NAMES[1],)
    assert refresh().check("enwiki", "feed-content", "feed-index") is None and history.read().count() == 0
    assert (folder / NAMES[0]).exists() and not (folder / NAMES[1]).exists()
    site.wrong = ()
    assert refresh().check("enwiki", "feed-content", "feed-index") == site.date


def test_a_recorded_date_whose_state_stayed(parts):
    history, site, refresh, folder = parts
    r = refresh()
    r._save("enwiki", {"date": site.date, "links": [], "downloaded": [], "verified": []})
    history.append(None, "cronjob-enwiki", schemas.DUMP_LINK_UPDATED, {"dump_date": site.date})
    assert r.check("enwiki", "feed-content", "feed-index") is None and r.state("enwiki") is None
    site.date = "Tue"
    assert r.check("enwiki", "feed-content", "feed-index") == "Tue" and r.known_date("enwiki") == "Tue"
