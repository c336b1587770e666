"""Two-phase vector search: an int8 scan picks candidates, exact products rank them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.functions.embed import DIMS, MODEL, embeddable, quantize_array, vectors
from mnemolake.functions.ids import canonical, canonical_text
from mnemolake.schema import UNINDEXED_KINDS, canonical_records
from mnemolake.session import Scratch, setting

OVERSAMPLE, LEAST_CANDIDATES = 4, 32
QUERY_BLOCK = 1_000
"""Query vectors that one pass over the index answers."""


def pool(k: int) -> int:
    return max(OVERSAMPLE * k, LEAST_CANDIDATES)


def scored(index: DataFrame, vec: str, query: np.ndarray, keys: list[str]) -> DataFrame:
    """keys, q_dot (int8 product) and dot (double product of the float vectors), in one Arrow pass."""
    q = np.asarray(query, np.float32)
    q8 = quantize_array(q).astype(np.int32)
    chosen = index.select(*keys, vec)
    schema = ", ".join(f"{k} {dict(chosen.dtypes)[k]}" for k in keys) + ", q_dot int, dot double"

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys))
            sized = np.flatnonzero(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == len(q))
            at = pa.array(sized, pa.int32())
            m = lists.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(sized), len(q))
            exact = m.astype(np.float64) @ q.astype(np.float64)
            coarse = quantize_array(m).astype(np.int32) @ q8
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keys))), pa.array(coarse.astype(np.int32)), pa.array(exact)], names=[*keys, "q_dot", "dot"])

    return chosen.mapInArrow(op, schema)


def top_k(index: DataFrame, vec: str, query: np.ndarray, k: int, id_col: str = "id") -> DataFrame:
    """The ``k`` nearest by exact product among the ``pool(k)`` nearest by int8 product, ties by id."""
    s = scored(index, vec, query, [id_col])
    if k <= 0:
        return s.limit(0)
    return s.orderBy(F.desc("q_dot"), id_col).limit(pool(k)).orderBy(F.desc("dot"), id_col).limit(k)


def _scored_block(index: DataFrame, vec: str, ids: list, queries: np.ndarray, keep: int, id_col: str) -> DataFrame:
    """query_id, id, q_dot and dot of all rows that can be among a query's ``keep`` nearest by int8 product."""
    q8 = quantize_array(queries).astype(np.float32)
    chosen = index.select(id_col, vec)
    kind = dict(chosen.dtypes)[id_col]

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sized = np.flatnonzero(b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == queries.shape[1])
            if not len(sized):
                continue
            at = pa.array(sized, pa.int32())
            m = b.column(1).take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(sized), -1)
            coarse = q8 @ quantize_array(m).astype(np.float32).T  # integers below 2 ** 24, so exact
            least = np.partition(coarse, -keep, axis=1)[:, -keep, None] if len(sized) > keep else coarse.min(axis=1, keepdims=True)
            q, row = np.nonzero(coarse >= least)
            exact = np.concatenate([np.einsum("ij,ij->i", queries[q[k : k + 4096]].astype(np.float64), m[row[k : k + 4096]].astype(np.float64)) for k in range(0, len(q), 4096)])
            found = b.column(0).take(at).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in q.tolist()], found.type), found, pa.array(coarse[q, row].astype(np.int32)), pa.array(exact)], names=["query_id", id_col, "q_dot", "dot"])

    return chosen.mapInArrow(op, f"query_id {kind}, {id_col} {kind}, q_dot int, dot double")


def pooled_by_query(index: DataFrame, vec: str, queries: DataFrame, k: int, id_col: str = "id", block: int = QUERY_BLOCK) -> DataFrame:
    """The ``pool(k)`` nearest by int8 product of every row of ``queries`` (``id_col``, ``vec``), ties by id.

    Query ids are distinct; a query without a vector has no rows. The queries are taken in blocks, each a
    pass over the index that keeps a pool of every batch.
    """
    asked = queries.where(F.col(vec).isNotNull() & F.col(id_col).isNotNull()).select(id_col, vec)
    blocks = max(1, -(-asked.count() // block))
    out: DataFrame | None = None
    for n in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == n).collect()
        for dims in sorted({len(r[1]) for r in rows} - {0}):
            same = [r for r in rows if len(r[1]) == dims]
            found = _scored_block(index, vec, [r[0] for r in same], np.array([r[1] for r in same], np.float32), max(1, pool(k)), id_col)
            out = found if out is None else out.unionByName(found)
    if out is None:
        kind = dict(asked.dtypes)[id_col]
        return index.sparkSession.createDataFrame([], f"query_id {kind}, {id_col} {kind}, q_dot int, dot double")
    coarse = W.partitionBy("query_id").orderBy(F.desc("q_dot"), id_col)
    return out.withColumn("rank", F.row_number().over(coarse)).where(F.col("rank") <= pool(k)).drop("rank")


def top_k_by_query(index: DataFrame, vec: str, queries: DataFrame, k: int, id_col: str = "id", block: int = QUERY_BLOCK) -> DataFrame:
    """``top_k`` of every row of ``queries``."""
    exact = W.partitionBy("query_id").orderBy(F.desc("dot"), id_col)
    return pooled_by_query(index, vec, queries, k, id_col, block).withColumn("rank", F.row_number().over(exact)).where(F.col("rank") <= k)


@F.pandas_udf(T.BinaryType())
def codes(vec: pd.Series) -> pd.Series:
    """Int8 codes of a vector as bytes."""
    return vec.map(lambda v: None if v is None else quantize_array(np.asarray(v, np.float32)).tobytes())


def top_k_by_space(index: DataFrame, vec: str, query: np.ndarray, k: int) -> DataFrame:
    """``top_k`` inside every space. The rank filters become group limits below the shuffle."""
    coarse = W.partitionBy("space").orderBy(F.desc("q_dot"), "id")
    exact = W.partitionBy("space").orderBy(F.desc("dot"), "id")
    s = scored(index, vec, query, ["space", "id"])
    pooled = s.withColumn("rank", F.row_number().over(coarse)).where(F.col("rank") <= pool(k))
    return pooled.withColumn("rank", F.row_number().over(exact)).where(F.col("rank") <= k)


def build_index(records: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """space, id, model, vec, q of every indexable record, superseded ones included.

    With ``held``, only what it lacks under this model is embedded (warm start).
    """
    rows = canonical_records(records.where(~F.col("kind").isin(*UNINDEXED_KINDS)))
    if held is not None:
        rows = rows.join(held.where((F.col("model") == MODEL) & (F.size("vec") == DIMS)).select("space", "id"), ["space", "id"], "left_anti")
    return vectors(rows, ["space", "id"], embeddable(F.col("body"), F.col("tags"))).withColumn("model", F.lit(MODEL))


def pooled_by_space(codes: DataFrame, query: np.ndarray, keep: int) -> DataFrame:
    """space, id, q_dot of the ``keep`` nearest of each space by int8 product, ties by id, from ``q8`` bytes alone.

    A task keeps the best of each space in a batch, so little leaves it.
    """
    q8 = quantize_array(np.asarray(query, np.float32)).astype(np.float32)

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sized = np.flatnonzero(np.diff(np.frombuffer(b.column(2).buffers()[1], np.int32, len(b.column(2)) + 1, 4 * b.column(2).offset)) == len(q8))
            if not len(sized):
                continue
            rows = pa.RecordBatch.from_arrays([c.take(pa.array(sized, pa.int64())) for c in b.columns], names=["space", "id", "q8"])
            flat = b"".join(rows.column(2).to_pylist())
            dots = np.frombuffer(flat, np.int8).reshape(len(sized), -1).astype(np.float32) @ q8  # integers below 2 ** 24, so exact
            code = np.unique(np.array(rows.column(0).to_pylist(), object).astype(str), return_inverse=True)[1]
            order = np.lexsort((-dots, code))
            first = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
            size = np.diff(np.concatenate([first, [len(order)]]))
            least = dots[order][first + np.minimum(size, keep) - 1]  # ties of the last place stay
            at = pa.array(np.flatnonzero(dots >= least[code]), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(dots[at.to_numpy()].astype(np.int32))], names=["space", "id", "q_dot"])

    rank = F.row_number().over(W.partitionBy("space").orderBy(F.desc("q_dot"), "id"))
    return codes.select("space", "id", "q8").mapInArrow(op, "space string, id string, q_dot int").withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")


def replace_vectors(index: DataFrame, added: DataFrame) -> DataFrame:
    """Last write wins on (space, id)."""
    return index.join(added.select("space", "id"), ["space", "id"], "left_anti").unionByName(added)


def resident_bytes(slots: Column, live: Column, dims: int = DIMS) -> Column:
    return slots * dims + slots * 16 + live * 24


SMALL_POOL = 100_000
"""Candidates up to which they are broadcast to the vectors."""


class VectorIndex:
    """A kept index: space, id, model, q8 (int8 codes as bytes) and vec, a Parquet folder partitioned by space.

    A search reads the codes alone, a quarter of the bytes, and fetches vectors for the candidates only. Only
    rows of this model and length count; others are as good as missing, and ``warm`` embeds them again.
    """

    SCHEMA = "id string, model string, q8 binary, vec array<float>, space string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows.where((F.col("model") == MODEL) & (F.octet_length("q8") == DIMS))

    def _spaces(self, rows: DataFrame) -> list[str]:
        return [r.space for r in rows.select("space").distinct().collect()]  # one row a space

    def _rewrite(self, touched: list[str], rows: DataFrame) -> None:
        scratch = Scratch(self.spark, "reindex")
        kept = scratch.write(rows, "rows")
        filled = self._spaces(kept)
        if filled:
            with setting(self.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
                kept.hint("rebalance", "space").sortWithinPartitions("space", "id").write.mode("overwrite").partitionBy("space").parquet(self.path)
        jvm = self.spark._jvm
        for space in set(touched) - set(filled):
            folder = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(space)
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/space={folder}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def add(self, vectors: DataFrame) -> None:
        """Add rows of ``build_index``; the last write of an id wins."""
        scratch = Scratch(self.spark, "vectors")
        added = scratch.write(vectors.select("id", "model", codes("vec").alias("q8"), "vec", "space").dropDuplicates(["space", "id"]), "added")
        touched = self._spaces(added)
        if not touched:
            return
        if self.exists():
            old = self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("space").isin(touched))
            if not old.join(added.select("space", "id"), ["space", "id"], "left_semi").isEmpty():
                self._rewrite(touched, replace_vectors(old, added))
                return
        added.hint("rebalance", "space").sortWithinPartitions("space", "id").write.mode("append").partitionBy("space").parquet(self.path)

    def remove(self, keys: DataFrame) -> None:
        """Take rows (space, id) out."""
        touched = self._spaces(keys)
        if touched and self.exists():
            old = self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("space").isin(touched))
            self._rewrite(touched, old.join(keys.select("space", canonical("id").alias("id")), ["space", "id"], "left_anti"))

    def has(self, space: str, id: str) -> bool:
        return not self.read().where((F.col("space") == space) & (F.col("id") == canonical_text(id))).isEmpty()

    def warm(self, records: DataFrame) -> None:
        """Embed what the index lacks, or holds under another model."""
        self.add(build_index(records, self.read()))

    def cold(self, records: DataFrame) -> bool:
        """Whether a record that can be indexed is missing."""
        return not build_index(records, self.read()).isEmpty()

    def totals(self) -> DataFrame:
        """vectors, resident_bytes."""
        return self.read().agg(F.count("*").alias("vectors")).select("vectors", resident_bytes(F.col("vectors"), F.col("vectors")).alias("resident_bytes"))

    def search(self, query: np.ndarray, k: int, spaces: list[str] | None = None) -> DataFrame:
        """space, id, q_dot, dot, rank: the ``k`` nearest of each space, among ``pool(k)`` by int8 product."""
        rows = self.read()
        if spaces is not None:
            rows = rows.where(F.col("space").isin(spaces))
        found = Scratch(self.spark, "pool").write(pooled_by_space(rows, query, pool(k)), "pool")
        small = found.count() <= SMALL_POOL
        chosen = rows.select("space", "id", "vec").join(F.broadcast(found) if small else found, ["space", "id"])
        exact = W.partitionBy("space").orderBy(F.desc("dot"), "id")
        return scored(chosen, "vec", query, ["space", "id"]).drop("q_dot").join(found, ["space", "id"]).withColumn("rank", F.row_number().over(exact)).where(F.col("rank") <= k)
