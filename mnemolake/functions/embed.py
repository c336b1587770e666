"""Hashed bag-of-words embedding: tokens, features, signed buckets, unit vectors, int8 codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.functions.text import tokenize, tokens

DIMS = 384
MODEL = "hashbag-v1-384"
# FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def embeddable(body: Column, tags: Column) -> Column:
    """The text that stands for a record: its body, then each tag."""
    return F.concat_ws(" ", F.coalesce(body, F.lit("")), tags)


def features(documents: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, pos, feature): unigram i at 2i, the bigram it begins at 2i+1, its words joined by NUL."""
    steps = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    words = documents.select(id_col, tokens(text).alias("words")).select(id_col, F.posexplode(steps).alias("i", "s"))
    both = F.array(F.struct((F.col("i") * 2).alias("pos"), F.col("s.x").alias("feature")), F.struct((F.col("i") * 2 + 1).alias("pos"), F.concat("s.x", F.lit("\0"), "s.y").alias("feature")))
    return words.select(id_col, F.explode(both).alias("f")).select(id_col, "f.pos", "f.feature").where(F.col("feature").isNotNull())


def fnv1a(items: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of many strings: one vector step for each byte position."""
    if not items:
        return np.zeros(0, np.uint64)
    lengths = np.array([len(x) for x in items])
    order = np.argsort(-lengths, kind="stable")
    width = int(lengths.max())
    grid = np.zeros((len(items), width), np.uint8)
    for row, k in enumerate(order.tolist()):
        grid[row, : lengths[k]] = np.frombuffer(items[k], np.uint8)
    upto = np.searchsorted(-lengths[order], -np.arange(width), side="left")
    h = np.full(len(items), FNV_OFFSET, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            n = int(upto[j])  # strings longer than j bytes stand first
            h[:n] = (h[:n] ^ grid[:n, j].astype(np.uint64)) * FNV_PRIME
    out = np.empty(len(items), np.uint64)
    out[order] = h
    return out


@F.pandas_udf(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("sign", T.IntegerType())]))
def _bucket(feature: pd.Series) -> pd.DataFrame:
    h = fnv1a([x.encode() for x in feature])
    return pd.DataFrame({"bucket": (h % np.uint64(DIMS)).astype(np.int32), "sign": np.where(h >> np.uint64(63), -1, 1).astype(np.int32)})


def bucket(feature: Column) -> Column:
    return _bucket(feature)


def bucket_cells(texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers that have a token, and for each cell (row place * DIMS + bucket) in use: cell, count and sign.

    Counts add up in a bucket; the sign is that of the last feature seen in it.
    """
    known: dict[str, int] = {}
    rows, feats, doc = [], [], []
    for i, text in enumerate(texts):
        words = tokenize(text) if text else []
        if not words:
            continue
        k = len(rows)
        rows.append(i)
        for j, w in enumerate(words):
            feats.append(known.setdefault(w, len(known)))
            doc.append(k)
            if j + 1 < len(words):
                feats.append(known.setdefault(w + "\0" + words[j + 1], len(known)))
                doc.append(k)
    if not rows:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    h = fnv1a([f.encode("utf-8", "surrogatepass") for f in known])
    f = np.array(feats)
    cell = np.array(doc) * DIMS + (h % np.uint64(DIMS)).astype(np.int64)[f]
    count = np.bincount(cell, minlength=len(rows) * DIMS)
    sign = np.zeros(len(rows) * DIMS, np.int32)
    sign[cell] = np.where(h >> np.uint64(63), -1, 1).astype(np.int32)[f]  # later features overwrite earlier ones
    used = np.flatnonzero(count)
    return rows, used, count[used], sign[used]


def buckets(documents: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, bucket, n, sign) of every bucket a text uses, summed where the text lies: nothing is shuffled."""
    chosen = documents.select(id_col, text.alias("__text"))
    kind = dict(chosen.dtypes)[id_col]

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, used, count, sign = bucket_cells(b.column(1).to_pylist())
            if rows:
                at = np.array(rows)[used // DIMS]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array((used % DIMS).astype(np.int32)), pa.array(count.astype(np.int64)), pa.array(sign)], names=[id_col, "bucket", "n", "sign"])

    return chosen.mapInArrow(op, f"{id_col} {kind}, bucket int, n bigint, sign int")


def embed_texts(texts: list[str | None]) -> tuple[list[int], np.ndarray]:
    """Row numbers that have a token, and their unit vectors; the arithmetic of each step is float32."""
    rows, used, count, sign = bucket_cells(texts)
    vec = np.zeros(len(rows) * DIMS, np.float32)
    vec[used] = ((1 + np.log(count)) * sign).astype(np.float32)
    vec = vec.reshape(len(rows), DIMS)
    inverse = (1 / np.sqrt((vec.astype(np.float64) ** 2).sum(axis=1))).astype(np.float32)
    return rows, vec * inverse[:, None]


def quantize_array(vec: np.ndarray) -> np.ndarray:
    """Scale by 127, clamp, round half away from zero."""
    x = np.clip(vec.astype(np.float64) * 127, -127, 127)
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int8)


def quantize(c: Column) -> Column:
    return F.transform(c, lambda x: F.round(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x.cast("double") * 127))).cast("tinyint"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; 0 where lengths differ."""
    products = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), products).otherwise(0.0)


def vectors(documents: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, vec, q for every row that has a token; rows without one stay unindexed."""
    chosen = documents.select(*keys, text.alias("__text"))
    schema = ", ".join(f"{k} {dict(chosen.dtypes)[k]}" for k in keys) + ", vec array<float>, q array<tinyint>"

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, vec = embed_texts(b.column(len(keys)).to_pylist())
            if not rows:
                continue
            at = pa.array(rows, pa.int32())
            lists = lambda flat: pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * DIMS + 1, DIMS), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keys))), lists(vec), lists(quantize_array(vec))], names=[*keys, "vec", "q"])

    return chosen.mapInArrow(op, schema)
