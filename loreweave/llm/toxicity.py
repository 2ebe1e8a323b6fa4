"""Toxicity scores by non-negative positive-unlabelled learning.

A linear model over hashed words is trained from confirmed toxic texts and unlabelled texts with
the class-prior-corrected risk  p E+[l(z)] + max(0, Eu[l(-z)] - p E+[l(-z)])  under the logistic
loss; where the bracket falls below zero, the step undoes it instead of fitting on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import read_table
from .textblocks import PUNCTUATED, slices, word_blocks

#: Hash space of words; the model is a vector of this many weights.
BUCKETS = 1 << 20
#: Training rows: at most so many confirmed toxic texts and unlabelled texts, the first by a hash of doc_id.
MOST_POSITIVE = 4000
MOST_UNLABELLED = 12000
#: A word counts if so many training texts hold it.
LEAST_TEXTS = 4
#: Least log-likelihood ratio of a word between the samples; chance alone reaches it for about one word in two thousand.
LEAST_RATIO = 12.0
ROUNDS = 250


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -30, 30)))


def distinct_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct buckets of its words) for each text."""
    for block in word_blocks(column, lower=True, blank=PUNCTUATED):
        ids = (block.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        row = np.repeat(np.arange(block.first, block.last), np.diff(block.first_word))
        keys = np.unique(row * BUCKETS + ids)
        cuts = np.searchsorted(keys, np.arange(block.first, block.last + 1) * BUCKETS)
        for k in range(block.last - block.first):
            yield block.first + k, keys[cuts[k] : cuts[k + 1]] % BUCKETS


def one_of_each(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The first of each group of copies: texts with the same set of words; texts without words go."""
    found: dict[bytes, np.ndarray] = {}
    for t in texts:
        if len(t):
            found.setdefault(t.tobytes(), t)
    return list(found.values())


def telling(a: np.ndarray, b: np.ndarray, n_pos: int, n_unl: int, least: float = LEAST_RATIO) -> np.ndarray:
    """Words, held by a positive and b unlabelled texts, whose share differs between the samples by a log-likelihood ratio of `least` or more."""

    def part(k, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.where(k > 0, k * np.log(k / (n * p)), 0.0)
            y = np.where(n - k > 0, (n - k) * np.log((n - k) / (n * (1 - p))), 0.0)
        return np.nan_to_num(x) + np.nan_to_num(y)

    p = (a + b) / (n_pos + n_unl)
    return 2 * (part(a, n_pos, p) + part(b, n_unl, p)) >= least


def counted(texts: list[np.ndarray]) -> np.ndarray:
    """How many texts hold each word."""
    out = np.zeros(BUCKETS, np.int32)
    for t in texts:
        out[t] += 1
    return out


def risk_gradient(z: np.ndarray, is_pos: np.ndarray, prior: float) -> np.ndarray:
    """Gradient by the scores z of the non-negative risk; below zero its bracket is over-fitted, and the step goes back along it."""
    n_pos, n_unl = int(is_pos.sum()), int((~is_pos).sum())
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    rest = np.logaddexp(0, z[~is_pos]).mean() - prior * np.logaddexp(0, z[is_pos]).mean()
    g = np.zeros(len(z))
    if rest >= 0:
        g[is_pos] = prior * (s[is_pos] - 1) / n_pos - prior * s[is_pos] / n_pos
        g[~is_pos] = s[~is_pos] / n_unl
    else:
        g[is_pos] = prior * s[is_pos] / n_pos
        g[~is_pos] = -s[~is_pos] / n_unl
    return g


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = ROUNDS, l2: float = 1e-4, rate: float = 0.1) -> Model:
    """Fits the model by Adam on the whole sample.

    Without positive or unlabelled texts, and without any word that tells them apart, nothing speaks for a text's being positive: every
    score is that of the prior, and below 0.5 whatever the prior.
    """
    weights = np.zeros(BUCKETS)
    prior = min(max(prior, 1e-3), 0.999)
    no_evidence = Model(weights, float(np.log(min(prior, 0.499) / (1 - min(prior, 0.499)))))
    positive, unlabelled = one_of_each(positive), one_of_each(unlabelled)
    if not positive or not unlabelled:
        return no_evidence
    n_pos, n_unl = len(positive), len(unlabelled)
    a, b = counted(positive), counted(unlabelled)
    words = np.flatnonzero(a + b >= LEAST_TEXTS)
    words = words[telling(a[words].astype(float), b[words].astype(float), n_pos, n_unl)]
    if not len(words):
        return no_evidence
    place = np.full(BUCKETS, -1, np.int32)
    place[words] = np.arange(len(words))
    kept = [p[p >= 0] for p in (place[t] for t in positive + unlabelled)]
    rows = np.repeat(np.arange(len(kept)), [len(t) for t in kept])
    cols = np.concatenate(kept)
    is_pos = np.arange(len(kept)) < n_pos
    w, b = np.zeros(len(words)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        g = risk_gradient(np.bincount(rows, w[cols], len(kept)) + b, is_pos, prior)
        gw, gb = np.bincount(cols, g[rows], len(w)) + l2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    weights[words] = w
    return Model(weights, float(b))


def held_out(doc_id) -> Column:
    """Rows whose labels are never learnt from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Trains on docs(doc_id, text) with labels(doc_id, toxic) outside the held-out fold.

    The prior is the toxic share of all labelled rows of that fold. The texts are bounded samples:
    the toxic ones, and documents taken whatever their label. Null labels are no labels.
    """
    labels = labels.filter("toxic is not null").filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), "toxic")
    prior = labels.agg(F.avg("toxic")).first()[0]
    pick = F.xxhash64("_id")
    known = docs.select(F.col("doc_id").alias("_id")).filter(~held_out(F.col("_id")))
    positive = labels.filter("toxic = 1").join(known, "_id", "left_semi").orderBy(pick, "_id").limit(most_positive).select("_id", F.lit(1).alias("kind"))
    unlabelled = known.orderBy(pick, "_id").limit(most_unlabelled).select("_id", F.lit(0).alias("kind"))
    chosen = F.broadcast(positive.unionAll(unlabelled))  # no more rows than the two bounds
    sample = docs.join(chosen, F.col("doc_id") == F.col("_id")).select("_id", "kind", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            words = [w.astype("<i4").tobytes() for _, w in distinct_words(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.binary())], names=["_id", "kind", "words"])

    # one buffer of bytes, of which the texts are views: bounded by the two numbers above
    table = sample.mapInArrow(features, "_id long, kind int, words binary").toArrow()
    table = table.take(pc.sort_indices(table, [(c, "ascending") for c in table.column_names])).combine_chunks()
    kinds, words = table.column("kind").to_numpy(), table.column("words").combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) and words.num_chunks else words
    of = lambda kind: [np.frombuffer(words[i].as_buffer(), "<i4") for i in np.flatnonzero(kinds == kind).tolist()]
    return train(of(1), of(0), float(prior) if prior is not None else 0.01)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 at 0.5 or more) to docs(text, ...); a null text has no words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    slim = docs.drop("score", "predicted")
    at, names = slim.columns.index("text"), [*slim.columns, "score", "predicted"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for b in slices(batches, at):
            sums = np.zeros(b.num_rows)
            for i, words in distinct_words(b.column(at)):
                sums[i] = weights[words].sum(dtype=np.float64)
            score = Model(weights, bias).score(sums)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=names)

    from pyspark.sql import types as T

    return slim.mapInArrow(apply, T.StructType([*slim.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score. Null and empty texts score as a text without words; a null doc_id is held out as the empty text is not.

    Rows with a repeated doc_id are scored each for itself; equal texts have equal scores. An empty
    table gives no rows, and without labels every score is that of the prior, below 0.5. A very long text is split into words in pieces.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
