"""Plain text of wiki markup by one pass with a stack of what is open.

Templates, tables and references go, links keep the words that are read, comments and tags go, nowiki text stays as it
is. All of them nest to any depth. What is opened and never closed is kept as text, and so is a mark that closes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

#: Marks that open or close something, or stand for themselves.
MARKS = re.compile(r"<!--|<nowiki\s*>|<nowiki\s*/>|<ref(?:\s[^<>]*)?/>|<ref(?:\s[^<>]*)?>|</ref\s*>|<[^<>]+>|\{\{|\}\}|\{\||\|\}|\[\[|\]\]|\[(?:https?|ftp)://[^\s\]]+|\]|\||'{2,5}", re.IGNORECASE)
#: Links that show a thing of their own instead of words (fixed values: namespaces of files and categories).
HIDDEN = re.compile(r"(?:File|Image|Category|Fichier|Catégorie):", re.IGNORECASE)
#: XML entities and what they stand for; one level is decoded.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#91;", "["), ("&#93;", "]"), ("&#123;", "{"), ("&#125;", "}"), ("&#61;", "="), ("&nbsp;", " "), ("&amp;", "&"))
_ENTITY = re.compile("|".join(re.escape(name) for name, _ in ENTITIES))
_CHAR = dict(ENTITIES)
TEMPLATE, TABLE, REF, LINK, URL = range(5)
#: Bytes of texts that are held as Python strings at once; a longer text is alone.
PIECE = 1 << 20
_OPENS = {"{{": TEMPLATE, "{|": TABLE, "[[": LINK}
_CLOSES = {"}}": TEMPLATE, "|}": TABLE, "]]": LINK, "]": URL}
_REF = re.compile(r"<ref(?:\s[^<>]*)?(?<!/)>")


class _Open:
    """Something open: its kind, how its opening reads if it is never closed, its parts, and before which part its first bar stands."""

    __slots__ = ("kind", "opening", "parts", "bar")

    def __init__(self, kind: int, opening: str):
        self.kind, self.opening, self.parts, self.bar = kind, opening, [], None

    def as_text(self) -> list:
        """What it reads as if it is never closed."""
        return [self.opening, *self.parts] if self.bar is None else [self.opening, *self.parts[: self.bar], "|", *self.parts[self.bar :]]

    def words(self) -> list:
        """What is read of a closed link: what follows its first bar, or all; nothing of a file or category."""
        if self.parts and isinstance(self.parts[0], str) and HIDDEN.match(self.parts[0].lstrip()):
            return []
        return self.parts if self.bar is None else self.parts[self.bar :]


def _joined(parts: list) -> str:
    """Strings of nested lists, in order."""
    out, todo = [], [iter(parts)]
    while todo:
        for p in todo[-1]:
            if isinstance(p, list):
                todo.append(iter(p))
                break
            out.append(p)
        else:
            todo.pop()
    return "".join(out)


def _heading(line: str) -> str:
    s = line.rstrip()
    return s.strip("=").strip() if len(s) > 1 and s[0] == "=" == s[-1] else line


class _Reader:
    """The stack while a text is read. A closed thing becomes one part of what it stands in, so no text moves twice."""

    def __init__(self) -> None:
        self.stack, self.open_of = [_Open(-1, "")], [0] * 5

    def add(self, part: str | list) -> None:
        self.stack[-1].parts.append(part)

    def open(self, kind: int, opening: str) -> None:
        self.stack.append(_Open(kind, opening))
        self.open_of[kind] += 1

    def close(self, kind: int) -> _Open | None:
        """Takes the innermost open thing of a kind off the stack; what is still open inside becomes text in it."""
        if not self.open_of[kind]:
            return None
        inner: list[_Open] = []
        while (top := self.stack.pop()).kind != kind:
            self.open_of[top.kind] -= 1
            inner.append(top)
        self.open_of[kind] -= 1
        top.parts += [o.as_text() for o in reversed(inner)]
        return top


def plain_text(text: str) -> str:
    """One pass: each mark is looked at once."""
    r, at = _Reader(), 0
    follows = {"-->": True, "</nowiki>": True}  # whether such an end may still follow
    while (m := MARKS.search(text, at)) is not None:
        mark, top = m[0], r.stack[-1]
        low = mark.lower()
        if m.start() > at:
            r.add(text[at : m.start()])
        at = m.end()
        if mark == "|}" and top.kind == TEMPLATE and text[at : at + 1] == "}":
            mark, at = "|", at - 1  # the bar of an empty parameter
        elif mark == "]]" and top.kind == URL:
            mark, at = "]", at - 1
        if mark == "<!--" or (low.startswith("<nowiki") and not low.endswith("/>")):
            end = "-->" if mark == "<!--" else "</nowiki>"
            stop = text.find(end, at) if follows[end] else -1
            if stop < 0:
                follows[end] = False
                r.add(mark)
            else:
                if mark != "<!--":
                    r.add(text[at:stop])
                at = stop + len(end)
        elif mark in _OPENS:
            r.open(_OPENS[mark], mark)
        elif mark[0] == "[":
            r.open(URL, mark)
        elif _REF.match(low):
            r.open(REF, "")
        elif low.startswith("</ref"):
            r.close(REF)
        elif mark in _CLOSES:
            kind = _CLOSES[mark]
            done = None if kind == URL and top.kind != URL else r.close(kind)
            if done is None:
                r.add(mark)
            elif kind == LINK:
                r.add(done.words())
            elif kind == URL:
                if done.parts and isinstance(done.parts[0], str):
                    done.parts[0] = done.parts[0].lstrip()
                r.add(done.parts)
        elif mark == "|":
            if top.kind == LINK and top.bar is None:
                top.bar = len(top.parts)
            else:
                r.add("|")
        # emphasis and other tags leave nothing
    out = _joined([*(o.as_text() for o in r.stack), text[at:]])
    if "=" in out:
        out = "\n".join(map(_heading, out.split("\n")))
    return _ENTITY.sub(lambda e: _CHAR[e[0]], out)


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of at most PIECE bytes, a longer text alone."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")), at + 1)
        yield texts.slice(at, stop - at)
        at = stop


@F.arrow_udf(T.StringType())
def strip_markup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Plain text of each text, piece by piece of an Arrow batch; a null stays."""
    for texts in batches:
        for some in pieces(texts):
            yield pa.array([None if t is None else plain_text(t) for t in some.to_pylist()], pa.string())
