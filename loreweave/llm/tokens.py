"""Token ids by the tokenizers library, with a bounded per-worker cache of whole pre-tokens.

Byte-level BPE splits a text by a fixed pattern and merges inside the pieces only, so a piece's ids
do not depend on its surroundings. Texts of ASCII and Latin-1 letters are cut by that pattern on their
bytes, a slice of the column at once, and each different piece of a slice is looked up once. Pieces not
found go to the library's model, spelt in the letters that byte-level vocabularies write bytes in. Any
other text goes to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textblocks import _bytes_of

#: Pieces kept per worker, of at most LONGEST bytes each: about 150 MB.
CACHED, LONGEST = 1_000_000, 48
#: Bytes cut at once, and the most that a column may bring; a longer text is cut alone, in segments.
SEGMENT = 2 << 20
#: Pieces that go to the model at once.
TOGETHER = 2000
#: Bytes of texts that may be cut here: ASCII but for a few control characters, and letters of Latin-1.
_USUAL = bytes([*range(0x1C), *range(0x20, 0x7F), 0xC3, *range(0x80, 0xC0)])
_SIGNS = (b"\xc3\x97", b"\xc3\xb7", b"<|")  # two signs that are no letters; what could start a special token
#: Kind of each byte of such texts: letter, digit, blank or another.
_LETTER_KIND, _DIGIT, _BLANK, _OTHER = range(4)
_KIND = bytes(_LETTER_KIND if b >= 0x80 or chr(b).isalpha() else _DIGIT if 0x30 <= b <= 0x39 else _BLANK if b == 32 or 9 <= b <= 13 else _OTHER for b in range(256))


def _letters() -> dict[int, str]:
    """Byte -> the letter that byte-level vocabularies write it as (fixed values)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTER = _letters()
_SPELT = np.array([ord(_LETTER[b]) for b in range(256)], "<u2")


def piece_starts(raw: bytes, first: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin that lie end to end in raw, by the pre-token pattern of byte-level BPE.

    `first` has the first byte of each text that is not empty. The pattern: 's 't 'm 'd 're 've 'll |
    ?letters | ?digits | ?others | blanks without the last one before a sign | blanks (`?`: a space, if there is one).
    """
    data, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(_KIND), np.uint8)
    begins = np.zeros(len(data) + 1, bool)  # of texts; the end counts as one
    begins[first] = begins[-1] = True
    blank = kind == _BLANK
    out = np.empty(len(data), bool)
    out[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=out[1:])
    out[1:] &= data[:-1] != 0x20  # a space goes to what follows it
    out[1:] |= blank[1:] & ~blank[:-1]
    out[:-1] |= blank[:-1] & ~blank[1:] & ~begins[1:-1]
    out |= begins[:-1]
    quote = np.flatnonzero(data == 0x27)
    quote = quote[out[quote] & ~begins[quote + 1]]
    if len(quote):
        one = data[quote + 1]
        two = data[np.minimum(quote + 2, len(data) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ~begins[quote + 2 - short] & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)) & ~short
        out[quote[short | long] + 1] = False
        ends = np.concatenate([quote[short] + 2, quote[long] + 3])
        out[ends[ends < len(data)]] = True
    return np.flatnonzero(out)


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class IdEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or default_tokenizer())
        # takes pieces as they are; without the model's own cache, as no piece comes twice
        self.bare = Tokenizer(Tokenizer.from_file(path or default_tokenizer()).model)
        self.bare.model._resize_cache(0)
        vocabulary = self.library.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a character per byte
        # two generations: what was not asked for while one filled is forgotten
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces by the model; should they not stand for the pieces' bytes, by the library."""
        raw = [p.encode() for p in pieces]
        ends = np.cumsum([0, *map(len, raw)])
        letters, at = _SPELT[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-16-le"), ends.tolist()
        spelt = [letters[a:z] for a, z in zip(at, at[1:])]
        ids = np.array(self.bare.encode_batch_fast([spelt], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        reached = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])  # a letter a byte
        stops = np.searchsorted(reached, ends)
        if reached[-1] != ends[-1] or (reached[stops] != ends).any():
            return self._whole(pieces)
        found, at = ids.tobytes(), (4 * stops).tolist()
        return [found[a:z] for a, z in zip(at, at[1:])]

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces; they are young from now on."""
        found = list(map(self.young.get, pieces))
        rest = [k for k, x in enumerate(found) if x is None]
        unknown = []
        for k in rest:
            found[k] = self.old.get(pieces[k])
            if found[k] is None:
                unknown.append(k)
        for at in range(0, len(unknown), TOGETHER):
            some = unknown[at : at + TOGETHER]
            for k, x in zip(some, self._together([pieces[k].decode() for k in some])):
                found[k] = x
        if len(self.young) + len(rest) > CACHED // 2:
            self.young, self.old = {}, self.young
        if len(rest) <= CACHED // 2:
            self.young.update((pieces[k], found[k]) for k in rest if len(pieces[k]) <= LONGEST)
        return found

    def _cut(self, raw: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of usual texts that lie end to end in raw, and how many come before each text's first byte and in all."""
        starts = piece_starts(raw, first)
        ends = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        which = pieces.indices.to_numpy()
        found = self._look_up(pieces.dictionary.to_pylist())
        known, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        counts = sizes[which]
        before = np.concatenate([[0], np.cumsum(counts)])
        ids = known[np.repeat((np.cumsum(sizes) - sizes)[which] - before[:-1], counts) + np.arange(before[-1])]
        return ids, before[np.append(np.searchsorted(starts, first), len(starts))]

    def _segments(self, raw: bytes) -> Iterator[bytes]:
        """A text in parts; a part ends where a letter or a digit is followed by a space."""
        at = 0
        while len(raw) - at > SEGMENT:
            stop = at + SEGMENT
            while (stop := raw.find(b" ", stop)) >= 0 and _KIND[raw[stop - 1]] not in (_LETTER_KIND, _DIGIT):
                stop += 1
            if stop < 0:
                break
            yield raw[at:stop]
            at = stop
        yield raw[at:]

    def _usual(self, raw: bytes) -> bool:
        return not raw.translate(None, _USUAL) and not any(s in raw for s in _SIGNS)

    def _run(self, raw: bytes, ends: np.ndarray) -> list[bytes]:
        """Ids of texts that lie end to end in raw; `ends` has the first one's start, 0, and each one's end."""
        if self._usual(raw):
            if len(raw) > SEGMENT:  # one text
                return [b"".join(self._cut(x, np.zeros(1, np.int64))[0].tobytes() for x in self._segments(raw))]
            return self._pieces(raw, ends)
        if len(ends) == 2:
            return self._whole([raw.decode()])
        at, out, k = ends.tolist(), [], 0
        usual = [self._usual(raw[a:z]) for a, z in zip(at, at[1:])]
        while k < len(usual):
            stop = k + 1
            while stop < len(usual) and usual[k] and usual[stop]:
                stop += 1  # usual texts in a row go together
            mine = raw[at[k] : at[stop]]
            out += self._pieces(mine, ends[k : stop + 1] - at[k]) if usual[k] else self._whole([mine.decode()])
            k = stop
        return out

    def _pieces(self, raw: bytes, ends: np.ndarray) -> list[bytes]:
        some = np.diff(ends) > 0
        out: list[bytes] = [b""] * len(some)
        if raw:
            ids, at = self._cut(raw, ends[:-1][some])
            held, at = ids.tobytes(), (4 * at).tolist()
            for k, a, z in zip(np.flatnonzero(some).tolist(), at, at[1:]):
                out[k] = held[a:z]
        return out

    def encode_column(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a string column in its order; a null or empty text has none."""
        offsets, data = _bytes_of(pc.fill_null(column, ""))
        at = 0
        while at < len(column):
            stop = max(int(np.searchsorted(offsets, offsets[at] + SEGMENT, "right")) - 1, at + 1)
            yield from self._run(data[offsets[at] : offsets[stop]].tobytes(), offsets[at : stop + 1] - offsets[at])
            at = stop

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null or empty text has none."""
        return list(self.encode_column(pa.array(texts, pa.large_string())))


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> IdEncoder:
    """One encoder per Python worker and vocabulary."""
    return IdEncoder(path)
