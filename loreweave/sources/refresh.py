"""Refresh of dumps as recorded steps: found, downloaded, verified, recorded. A check that was broken off goes on at the step it had reached."""

from __future__ import annotations

import json
import os
import uuid

from .. import schemas
from ..operators import history as hs
from .dumps import Fetch, checksum_in, download, feed_of, md5_matches

#: Where dumps and their checksums stand, and the host that feeds name for it (fixed values).
SITE, FEED_HOST = "https://dumps.wikimedia.org", "http://download.wikimedia.org"


def checksum_url(name: str, site: str = SITE) -> str:
    """The list of checksums beside a dump file, whose name begins with its wiki and date."""
    wiki, date = name.split("-")[:2]
    return f"{site}/{wiki}/{date}/{wiki}-{date}-md5sums.txt"


class DumpRefresh:
    """Looks for new dumps of a wiki and brings them into a folder. `fetch` is given by the caller.

    What a check has found and done is in a small file of the folder. A file counts as downloaded once it has its name, as verified once its
    checksum was right; a wrong one is removed and fetched again by the next check. The history row
    that makes a date known comes last, once every file is verified.
    """

    def __init__(self, history: hs.RunHistory, folder: str, fetch: Fetch, site: str = SITE):
        self.history, self.folder, self.fetch, self.site = history, folder, fetch, site

    def _path(self, key: str) -> str:
        return os.path.join(self.folder, f".refresh-{key}.json")

    def state(self, key: str) -> dict | None:
        """date, links, and the names downloaded and verified, of a check that has not ended."""
        try:
            with open(self._path(key)) as f:
                return json.load(f)
        except (FileNotFoundError, ValueError):
            return None

    def _save(self, key: str, state: dict) -> None:
        os.makedirs(self.folder, exist_ok=True)
        draft = f"{self._path(key)}.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            json.dump(state, f)
        os.replace(draft, self._path(key))

    def _forget(self, key: str) -> None:
        if os.path.exists(self._path(key)):
            os.remove(self._path(key))

    def known_date(self, key: str) -> str | None:
        row = hs.latest_dump_date(self.history.read(), f"cronjob-{key}").first()
        return row[0] if row else None

    def check(self, key: str, content_url: str, index_url: str) -> str | None:
        """Takes a new dump through all steps; its date once it is recorded, None if there is none or a step has failed."""
        date, index_link = feed_of(self.fetch, index_url)
        if date is None or date == (self.known_date(key) or ""):
            self._forget(key)
            return None
        state = self.state(key)
        if state is None or state["date"] != date:
            _, content_link = feed_of(self.fetch, content_url)
            if content_link is None or index_link is None:
                return None
            state = {"date": date, "links": [x.replace(FEED_HOST, self.site) for x in (content_link, index_link)], "downloaded": [], "verified": []}
            self._save(key, state)
        for link in state["links"]:
            name = link.rsplit("/", 1)[-1]
            path = os.path.join(self.folder, name)
            if name in state["verified"]:
                continue
            if name not in state["downloaded"] or not os.path.exists(path):
                download(link, self.folder, self.fetch)
                state["downloaded"] = sorted({*state["downloaded"], name})
                self._save(key, state)
            good = checksum_in(b"".join(self.fetch(checksum_url(name, self.site))).decode("utf-8", "ignore"), name)
            if good is None:
                os.remove(path)
            if good is None or not md5_matches(path, good):
                state["downloaded"].remove(name)
                self._save(key, state)
                return None
            state["verified"].append(name)
            self._save(key, state)
        self.history.append(None, f"cronjob-{key}", schemas.DUMP_LINK_UPDATED, {"dump_date": date})
        self._forget(key)
        return date
