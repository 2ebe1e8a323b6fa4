"""One very long text among short ones: whole and right, in operators that hash words."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from loreweave.llm import fill_middle as fm, jaccard_join as jj, substrings as ss, toxicity as tox

MB = 20


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(5000)]
    text = " ".join(words[k] for k in rng.integers(0, 5000, MB * 170_000))
    assert len(text) > 900_000 * MB
    tail = " ".join(text[-4000:].split(" ")[1:])  # its last words stand alone, too
    return spark.createDataFrame([(1, text), (2, tail), (3, "short text"), (4, None)], "doc_id long, text string"), text, tail


def test_repeats_at_the_end_of_a_long_text(long_docs):
    docs, text, tail = long_docs
    got = {r["doc_id"]: r for r in ss.remove_repeats(docs).collect()}
    n = len(tail.split())
    assert got[1]["n_removed"] == n == got[2]["n_removed"] and got[1]["n_words"] == len(text.split()) and got[3]["n_removed"] == 0
    assert got[1]["kept_text"] == " ".join(text.split(" ")[:-n])


def test_shingles_of_a_long_text(long_docs):
    docs, text, tail = long_docs
    w = text.split()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.link_documents(docs).collect()}
    assert got == {1: (len(set(zip(w, w[1:], w[2:], w[3:]))), 1), 2: (len(tail.split()) - 3, 2), 3: (1, 3), 4: (0, 4)}


def test_score_and_cuts_of_a_long_text(long_docs):
    docs, text, _ = long_docs
    model = tox.Model(np.ones(tox.BUCKETS) * 1e-4, -0.1)
    (found,) = [k for _, k in tox.distinct_words(pa.array([text]))]
    scores = {r["doc_id"]: r["score"] for r in tox.score_documents(docs, model).collect()}
    assert abs(scores[1] - 1 / (1 + np.exp(0.1 - 1e-4 * len(found)))) < 1e-6 and 4500 < len(found) <= 5000
    out = {r["doc_id"]: r for r in fm.fill_in_middle(docs, changed=100).collect()}
    h = hashlib.sha256(b"42:1").hexdigest()
    n = len(text.split())
    low, high = sorted(int(h[8 * k : 8 * k + 8], 16) % (n + 1) for k in (0, 1))
    assert out[1]["n"] == n and out[1]["prefix_chars"] == len(" ".join(text.split(" ")[:low])) and out[1]["middle_chars"] == sum(len(x) + 1 for x in text.split(" ")[low:high]) - (low == 0)
