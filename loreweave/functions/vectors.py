"""Vector functions: cosine, normalisation, seeds, the deterministic embedder and the message codec."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..schemas import ENCODED_VECTOR

#: Put before a query, not before documents (fixed value).
QUERY_PREFIX = "Instruct: Given a query, retrieve relevant Wikipedia passages that answer the query\nQuery: "


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector, a null or different lengths."""
    return F.when(F.size(a) == F.size(b), 1 - F.try_divide(dot(a, b), norm(a) * norm(b)))


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def truncate(v: Column, dimension: int) -> Column:
    return F.slice(v, 1, dimension)


def to_floats(v: Column, nested: bool = False) -> Column:
    return F.transform(F.flatten(v) if nested else v, lambda x: x.cast("float"))


def seed_of(text: Column, seed: int = 0) -> Column:
    """The first four bytes of sha256, little-endian, with the global seed mixed in by xor."""
    h = F.sha2(text.cast("binary"), 256)
    hex4 = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.conv(hex4, 16, 10).cast("long").bitwiseXOR(F.lit(seed))


class Embedder(Protocol):
    """One vector per text; called on a batch."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class RandomEmbedder:
    """Deterministic unit vectors: a normal draw seeded by the text."""

    def __init__(self, dimension: int = 512, seed: int = 0):
        self.dimension, self.seed = dimension, seed

    def embed(self, texts: list[str]) -> np.ndarray:
        import hashlib

        out = np.empty((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            key = int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "little") ^ self.seed
            out[i] = np.random.default_rng(key).standard_normal(self.dimension, dtype=np.float32)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def length_batches(lengths: np.ndarray, most: int, budget: int | None = None) -> list[np.ndarray]:
    """Places in batches of like lengths: at most `most` texts, and padded to their longest no more than `budget` tokens (a longer text is alone)."""
    order, out, at = np.argsort(-lengths, kind="stable"), [], 0
    while at < len(order):
        n = most if budget is None else max(1, min(most, budget // max(int(lengths[order[at]]), 1)))
        out.append(order[at : at + n])
        at += n
    return out


def _embedded(model: Embedder, texts: list[str]) -> list[np.ndarray | None]:
    """A vector for each text. If a batch fails its texts are tried one by one, and those that fail have none."""
    try:
        return list(model.embed(texts))
    except Exception:
        if len(texts) == 1:
            return [None]
        return [v for t in texts for v in _embedded(model, [t])]


def embed_with(make: Callable[[], Embedder], batch: int = 256, budget: int | None = None, padding=None) -> Callable[[Column], Column]:
    """A column function that embeds texts; the model is made once in a worker. A null text, and one that the model fails on, has a null vector.

    Texts go to the model in batches of like lengths, by the model's own `lengths(texts)` if it has one and by blank-separated
    words if not, and come back in their places, so their order has no bearing on the vectors. padding is a pair of
    accumulators for the tokens that batches are padded to and the tokens of their texts.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            out = pd.Series([None] * len(s), dtype=object)
            known = np.flatnonzero(s.notna().to_numpy())
            texts = s.iloc[known].tolist()
            lengths = np.array(model.lengths(texts) if hasattr(model, "lengths") else [len(t.split()) for t in texts], np.int64)
            for places in length_batches(lengths, batch, budget):
                if padding is not None:
                    padding[0].add(int(lengths[places].max()) * len(places))
                    padding[1].add(int(lengths[places].sum()))
                for i, v in zip(known[places], _embedded(model, [texts[p] for p in places])):
                    out.iat[i] = v
            yield out

    return run


def query_text(query: str) -> str:
    return QUERY_PREFIX + query


@F.pandas_udf(ENCODED_VECTOR)
def encode_vector(v: pd.Series) -> pd.DataFrame:
    """Message form of a float vector."""
    rows = [(None, None, None, None) if x is None else ("numpy", "float32", [len(x)], base64.b64encode(np.asarray(x, "<f4").tobytes()).decode()) for x in v]
    return pd.DataFrame(rows, columns=["kind", "dtype", "shape", "data_b64"])


def _decoded(kind: str | None, dtype: str, shape, data: str) -> np.ndarray | None:
    if kind is None:
        return None
    if kind not in ("numpy", "torch"):
        raise ValueError(f"unknown vector kind: {kind}")
    v = np.frombuffer(base64.b64decode(data, validate=True), np.dtype(dtype).newbyteorder("<")).astype(np.float32)
    if shape is not None and len(shape):
        v = v.reshape(tuple(int(n) for n in shape))
    return v.ravel()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(m: pd.DataFrame) -> pd.Series:
    """The floats of a message's vector, row by row if it has several; an unknown kind or a shape that does not fit is an error, a null message a null vector."""
    return pd.Series([_decoded(*r) for r in zip(m["kind"], m["dtype"], m["shape"], m["data_b64"])], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]))
def try_decode_vector(m: pd.DataFrame) -> pd.DataFrame:
    """The same without errors: what is wrong with a message is said beside a null vector."""
    vectors, errors = [], []
    for r in zip(m["kind"], m["dtype"], m["shape"], m["data_b64"]):
        try:
            vectors.append(_decoded(*r)), errors.append(None)
        except (ValueError, TypeError) as e:
            vectors.append(None), errors.append(str(e))
    return pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})
