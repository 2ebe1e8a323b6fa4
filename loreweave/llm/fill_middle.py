"""Fill-in-the-middle transformation by a matcher that streams twice over each text.

The first pass counts a text's units. Two ranks are drawn from the count, and a second pass advances a lazy
iterator of matches to the smaller and then the larger rank, where the text is cut. Units are never
held: a text costs the memory of itself and of its output, whatever its number of units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import read_table
from .textblocks import slices

#: A unit is a word with the blanks before it, or the blanks at the end. On UTF-8 bytes it matches what it does on the text.
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
#: Percentages: texts that stay plain from the first on, and of the others those whose suffix comes first.
CHANGED, SUFFIX_FIRST = 50, 80
#: Bytes whose code points are counted at once.
BLOCK = 1 << 20


def cuts(text: memoryview, first: int, second: int) -> tuple[int, int, int]:
    """(units, byte ends of the prefix and the middle): the draws are taken modulo the number of units + 1."""
    n = sum(1 for _ in UNIT.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    matches = UNIT.finditer(text)
    a = next(islice(matches, low - 1, None)).end() if low else 0
    return n, a, next(islice(matches, high - low - 1, None)).end() if high > low else a


def code_points(text: memoryview) -> int:
    """Code points of UTF-8 bytes: all bytes but continuation bytes, counted in blocks."""
    return sum(int(np.count_nonzero((np.frombuffer(text[at : at + BLOCK], np.uint8) & 0xC0) != 0x80)) for at in range(0, len(text), BLOCK))


def _has_marks(raw: memoryview) -> bool:
    return any(re.search(mark, raw) for mark in (PREFIX, SUFFIX, MIDDLE))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """key, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output.

    The draws come from the sha256 of seed and key, so reruns agree and rows with one key share their draws; a null key is
    drawn as an empty one. A null or empty text is plain with n = 0; a text that contains a mark is plain. Repeated rows each
    give a row, an empty table none; other columns are left out, whatever their names. A very long text is one row's work in one
    task and is never cut into units; several texts are held together only up to a few MB.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            n, form, prefix, middle, out = [], [], [], [], []
            for i, value in enumerate(b.column(1)):
                raw = memoryview(value.as_buffer() if value.is_valid else b"")
                h1, h2, h3, h4 = (c[i].as_py() for c in b.columns[2:])
                units, a, z = cuts(raw, h1, h2)
                n.append(units)
                if not units or h3 % 100 >= changed or _has_marks(raw):
                    form.append("plain"), prefix.append(None), middle.append(None), out.append(bytes(raw))
                    continue
                spm = h4 % 100 < suffix_first
                parts = (SUFFIX, raw[z:], PREFIX, raw[:a], MIDDLE, raw[a:z]) if spm else (PREFIX, raw[:a], SUFFIX, raw[z:], MIDDLE, raw[a:z])
                form.append("spm" if spm else "psm"), prefix.append(code_points(raw[:a])), middle.append(code_points(raw[a:z])), out.append(b"".join(parts))
            # the bytes of one text are a text already
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).view(pa.string())], names=[key, "n", "form", "prefix_chars", "middle_chars", "output"])

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text), *h).mapInArrow(rewrite, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of. Marks occur in it only where they were put."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    """The rewritten form of every document, as digests of the output and of the text rebuilt from it; rows as fill_in_middle has them."""
    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
r AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS z FROM u),
p AS (SELECT doc_id, text, n, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:z], '') AS middle, array_to_string(units[z + 1:], '') AS suffix,
  CASE WHEN n = 0 OR h3 % 100 >= {CHANGED} OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
