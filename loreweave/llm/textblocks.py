"""Words of Arrow text columns as 64-bit hashes, computed on the UTF-8 bytes without Python strings.

Unless other breaks are given, a word is a run of bytes outside 0x20 and 0x09-0x0D, which is `[^\\x20\\x09-\\x0D]+` on the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Breaks of plain word features: every ASCII byte that is neither a letter nor a digit.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes whose words are found at once; a longer text is handled alone, in pieces that end between words.
BLOCK = 256 << 10
#: Bytes of texts that a Python worker holds as objects at once; a longer text is held alone.
SLICE = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (the one of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    p = np.ones(max(n, 1), np.uint64)
    if n > 1:
        with np.errstate(over="ignore"):
            p[1:] = np.cumprod(np.full(n - 1, 0x2545F4914F6CDD1D, np.uint64))
    return p


@dataclass
class Words:
    """Words of texts first..last-1 of a column. first_word[i] is the first word of text i, with an end mark."""

    first: int
    last: int
    first_word: np.ndarray
    hashes: np.ndarray


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls."""
    n = len(column)
    kind = np.int64 if column.type == pa.large_string() else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return offsets, np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `most` bytes in the text column, a longer text alone; an empty batch stays."""
    for b in batches:
        if b.num_rows < 2:
            yield b
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            stop = max(stop, at + 1)
            yield b.slice(at, stop - at)
            at = stop


def word_blocks(column: pa.Array, lower: bool = False, blank: np.ndarray = BLANK) -> Iterator[Words]:
    """Blocks of whole texts of a string column; a null text has no words."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets, raw = _bytes_of(column)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        last = min(last, n)
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin > BLOCK and last == first + 1:
            hashes = np.concatenate([_hashes(raw[a:z], np.zeros(0, np.int64), lower, blank)[0] for a, z in _between_words(raw, begin, end, blank)])
            yield Words(first, last, np.array([0, len(hashes)]), hashes)
        else:
            hashes, firsts = _hashes(raw[begin:end], offsets[first : last + 1] - begin, lower, blank)
            yield Words(first, last, firsts, hashes)
        first = last


def _between_words(raw: np.ndarray, begin: int, end: int, blank: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that cut no word; a longer word makes a longer range."""
    while begin < end:
        stop = min(begin + BLOCK, end)
        while stop < end:
            gaps = np.flatnonzero(blank[raw[stop : min(stop + BLOCK, end)]])
            if len(gaps):
                stop += int(gaps[0])
                break
            stop = min(stop + BLOCK, end)
        yield begin, stop
        begin = stop


def _hashes(data: np.ndarray, offsets: np.ndarray, lower: bool, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text that begins at offsets)."""
    if lower:
        data = ASCII_LOWER[data]
    solid = ~blank[data]
    begins = solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1]
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        begins[cut] = solid[cut]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    number = np.cumsum(begins) - 1
    at = np.arange(len(data)) - starts[np.maximum(number, 0)]
    lengths = np.add.reduceat(solid.astype(np.int64), starts)
    np.clip(at, 0, int(lengths.max()) - 1, out=at)
    with np.errstate(over="ignore"):
        terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[at]
        terms[~solid] = 0
        sums = np.add.reduceat(terms, starts)
        hashes = mix64(sums + lengths.astype(np.uint64) * _ODD)
    return hashes, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive entries; element i covers words[i : i + n]."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(size, (seed * 0x632BE59BD9B4E019 + 0x1234567) & ((1 << 64) - 1), np.uint64)
        for k in range(n):
            h = mix64(h * np.uint64(0xD1342543DE82EF95) + words[k : k + size])
    return h


def windowed_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of `width` consecutive entries, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
