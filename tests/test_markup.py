"""Markup by a stack: generated trees whose text is known, unbalanced marks, and time that follows the length."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loreweave.functions import markup as mk, text as tx


def tree(rng, depth):
    """(markup, its plain text) of a random nest."""
    if depth == 0:
        w = rng.choice(["word", "a b", "x", "é", "5"])
        return w, w
    kind = rng.randrange(12)
    parts = [tree(rng, depth - 1 if k == 0 else rng.randrange(min(depth, 3))) for k in range(rng.randrange(1, 3))]
    raw, plain = " ".join(p[0] for p in parts), " ".join(p[1] for p in parts)
    if kind == 0:
        return "{{t|p=" + raw + "|}}", ""
    if kind == 1:
        return "{| class=x\n|" + raw + "\n|}", ""
    if kind == 2:
        return f"<ref name='n'>{raw}</ref>", ""
    if kind == 3:
        return f"[[Page|{raw}]]", plain
    if kind == 4:
        return f"[[File:p.png|thumb|{raw}]]", ""
    if kind == 5:
        return f"<b>{raw}</b>", plain
    if kind == 6:
        return f"''' {raw} ''", f" {plain} "
    if kind == 7:
        return f"<!-- {{{{ [[ -->{raw}", plain
    if kind == 8:
        return f"<nowiki>[[{{{{''</nowiki>{raw}", "[[{{''" + plain
    if kind == 9:
        return f"[http://h/p {raw}]", plain
    return raw, plain


def test_nests_of_any_depth():
    rng = random.Random(2)
    for depth in (1, 2, 3, 5, 8, 50):
        for _ in range(60):
            raw, plain = tree(rng, depth)
            assert mk.plain_text(raw) == plain, raw
    deep = "{{a|" * 50 + "x" + "}}" * 50
    assert mk.plain_text(f"a{deep}b") == "ab" and mk.plain_text("[[p|" * 50 + "x" + "]]" * 50) == "x"


@pytest.mark.parametrize(
    "raw,plain",
    [
        ("{{ never closed", "{{ never closed"), ("a }} b", "a }} b"), ("[[a|b", "[[a|b"), ("a ]] b ] c", "a ]] b ] c"), ("{{a [[b }} c", " c"), ("[[a {{b ]] c", "a {{b  c"), ("{| x [[y|z |} w", " w"),
        ("[http://x y", "[http://x y"), ("<ref>open", "open"), ("</ref>x", "x"), ("<nowiki>[[x", "<nowiki>[[x"), ("<!-- open [[a|b]]", "<!-- open b"), ("{{a|}}b", "b"), ("[[a|b|c]]", "b|c"), ("[[a]]s", "as"),
        ("[[a [http://x y]]]", "a y"), ("[http://x]", ""), ("<ref name=a/>b<references/>", "b"), ("<nowiki/>x", "x"), ("a | b", "a | b"), ("== h ==\ntext = 1\n===", "h\ntext = 1\n"), ("=", "="), ("&amp;lt;", "&lt;"), ("''''''x", "'x"),
        ("[[Category:A]][[:Category:B]]", ":Category:B"), ("<REF>x</REF>y", "y"), ("{|\n{| inner |}\n|} z", " z"), ("", ""),
    ],
)
def test_marks_that_do_not_match(raw, plain):
    assert mk.plain_text(raw) == plain


@pytest.mark.parametrize("mark", ["{{", "[[", "{|", "<ref>", "[http://x ", "<!--", "<nowiki>", "<", "}}", "|", "''", "[[a|", "<ref ", "="])
def test_time_follows_the_length(mark):
    def seconds(n):
        began = time.perf_counter()
        mk.plain_text(mark * (n // len(mark)))
        return time.perf_counter() - began

    seconds(100_000)
    assert seconds(1_000_000) < 10 * max(4 * seconds(100_000), 0.2)


def test_alternating_opens_and_closes_in_linear_time():
    began = time.perf_counter()
    mk.plain_text("[[a|" * 100_000 + "x" * 100_000 + "]]" * 100_000)
    mk.plain_text("{{[[" * 100_000 + "}}]]" * 100_000)
    assert time.perf_counter() - began < 10


def test_column_of_texts(spark):
    df = spark.createDataFrame([("[[a|b]] {{t}}",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tx.strip_markup(F.col("t"))).collect()] == ["b ", None, ""]


def test_a_batch_is_not_held_as_strings():
    """A batch of Arrow of any size is stripped piece by piece."""
    texts = pa.array(["[[a|%s]]" % ("x" * 100_000), None, ""] * 200)
    given = mk.strip_markup.func(iter([texts, texts.slice(0, 0)]))
    first = next(given)
    assert first.nbytes < 2 << 20  # of 20 MB
    got = [t for part in [first, *given] for t in part.to_pylist()]
    assert got == ["x" * 100_000, None, ""] * 200
