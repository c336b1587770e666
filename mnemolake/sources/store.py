"""The append-only record store: one Parquet table partitioned by space.

The partition folder takes the place of a log directory. Appends are idempotent: the first write of an id
wins, and rows already held are skipped before anything else is looked at. A single writer is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.ids import canonical, canonical_text
from mnemolake.schema import first_violation
from mnemolake.session import Scratch, setting


def space_to_folder(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("__"))


def folder_to_space(c: Column) -> Column:
    """The first ``__`` becomes the slash; names without one are no space (null)."""
    return F.when(F.contains(c, F.lit("__")), F.regexp_replace(c, "^(.*?)__", "$1/"))


FEW_SPACES, FEW_KEYS = 1_000, 100_000
"""Spaces of a batch up to which they prune the store's folders, and keys up to which they are broadcast."""
FILE_ROWS = 2_000_000
"""Records that one file of a compacted space holds at most."""


def first_rows(batch: DataFrame) -> DataFrame:
    """One row an id of a batch, the first received, ids canonical."""
    named = batch.withColumn("id", canonical("id"))
    rest = [c for c in named.columns if c not in ("space", "id")]
    order = F.struct("received_at", F.xxhash64(*[c for c in named.columns if not c.startswith("causal")]))
    return named.groupBy("space", "id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("space", "id", "r.*").select(*named.columns)


def new_rows(held: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of ``batch`` that an append would add: one an id, the first received, none already held."""
    known = held.select("space", canonical("id").alias("id"))
    return first_rows(batch).join(known, ["space", "id"], "left_anti")


class RecordStore:
    """Append-only records of one folder, partitioned by space; ids are canonical in it.

    ``sealed`` beside it holds what is carried for others unread: (space, id, author_node, epoch, blob).
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _has(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def exists(self) -> bool:
        return self._has(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _append(self, fresh: DataFrame, path: str) -> None:
        # rebalanced by space, so a hot space is split over tasks; sorted, so that range scans skip row groups
        fresh.hint("rebalance", "space").sortWithinPartitions("space", "author_node", "id").write.mode("append").partitionBy("space").parquet(path)

    def _fresh(self, batch: DataFrame, path: str) -> DataFrame:
        """What is new in a batch, as a written table, so that it stays the same after the append.

        The batch's spaces and range of ids reach the store's scan, and of what is left only the keys of the
        batch are kept; so an append reads little of the store, and shuffles none of it where the batch is small.
        """
        scratch = Scratch(self.spark, "append")
        firsts = scratch.write(first_rows(batch), "firsts")
        if not self._has(path):
            return firsts
        span = firsts.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).first()
        if not span.n:
            return firsts
        held = self.spark.read.parquet(path).select("space", "id").where(F.col("id").between(span.lo, span.hi))
        spaces = [r.space for r in firsts.select("space").distinct().limit(FEW_SPACES + 1).collect()]
        if len(spaces) <= FEW_SPACES and None not in spaces:
            held = held.where(F.col("space").isin(spaces))
        if span.n <= FEW_KEYS:
            met = scratch.write(held.join(F.broadcast(firsts.select("space", "id")), ["space", "id"], "left_semi"), "met")
            return scratch.write(firsts.join(met, ["space", "id"], "left_anti"), "fresh")
        return scratch.write(firsts.join(held, ["space", "id"], "left_anti"), "fresh")

    def append(self, batch: DataFrame) -> DataFrame:
        """Write what is new, and return those rows as they were written."""
        fresh = self._fresh(batch, self.path)
        self._append(fresh, self.path)
        return fresh

    def accept(self, batch: DataFrame) -> DataFrame:
        """All or nothing: any new row that breaks a rule rejects the batch."""
        fresh = self._fresh(batch, self.path)
        bad = fresh.select("id", first_violation(fresh).alias("why")).where(F.col("why").isNotNull()).take(1)
        if bad:
            raise ValueError(f"batch rejected: record {bad[0].id}: {bad[0].why}")
        self._append(fresh, self.path)
        return fresh

    def accept_sealed(self, entries: DataFrame) -> DataFrame:
        """Entries of spaces that are only carried: kept unread, each (space, id) once. Returns the new ones."""
        named = entries.select("space", "id", "author_node", "epoch", "blob", "received_at").where(F.col("id").isNotNull() & F.col("space").isNotNull())
        fresh = self._fresh(named, f"{self.path}_sealed")
        self._append(fresh, f"{self.path}_sealed")
        return fresh

    def sealed(self) -> DataFrame:
        if self._has(f"{self.path}_sealed"):
            return self.spark.read.parquet(f"{self.path}_sealed")
        return self.spark.createDataFrame([], "id string, author_node string, epoch bigint, blob binary, received_at timestamp_ntz, space string")

    def spaces(self) -> DataFrame:
        return self.read().select("space").distinct()

    def segments(self) -> DataFrame:
        """space, segments: the number of files that hold a space."""
        return self.read().select("space", F.input_file_name().alias("file")).groupBy("space").agg(F.count_distinct("file").alias("segments"))

    def compact(self, most_files: int = 8, file_rows: int = FILE_ROWS) -> list[str]:
        """Rewrite the spaces kept in more than ``most_files`` files into as few as their rows need; their names."""
        wide = [r.space for r in self.segments().where(F.col("segments") > most_files).collect()]  # one row a space
        if not wide:
            return []
        scratch = Scratch(self.spark, "compact")
        rows = scratch.write(self.read().where(F.col("space").isin(wide)), "rows")
        counts = rows.groupBy("space").agg(F.ceil(F.count("*") / file_rows).cast("int").alias("files"))
        # several files of a space are dealt by id, so one author of most rows does not fill a single task
        dealt = rows.join(counts, "space").withColumn("__file", F.pmod(F.xxhash64("id"), F.col("files")))
        with setting(self.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            out = dealt.repartition("space", "__file").sortWithinPartitions("space", "author_node", "id").drop("files", "__file")
            out.write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy("space").parquet(self.path)
        return sorted(wide)


def point_lookup(records: DataFrame, id: str) -> DataFrame:
    """One record, its id in any spelling; the equality reaches the Parquet scan."""
    return records.where(F.col("id") == canonical_text(id))


def exists(records: DataFrame, id: str) -> DataFrame:
    """One row: whether an id is held."""
    return point_lookup(records, id).select("id").limit(1).agg((F.count("*") > 0).alias("held"))


def range_scan(records: DataFrame, node: str, after: str, through: str, limit: int | None = None) -> DataFrame:
    """Records of one node in (after, through], ids ascending; all comparisons reach the scan."""
    out = records.where((F.col("author_node") == node) & (F.col("id") > after) & (F.col("id") <= through)).orderBy("id")
    return out.limit(limit) if limit is not None else out


def ordered_scan(records: DataFrame) -> DataFrame:
    return records.orderBy("id")


def max_local_id(records: DataFrame, node: str) -> DataFrame:
    return records.where(F.col("author_node") == node).agg(F.coalesce(F.max(canonical("id")), F.lit("0" * 26)).alias("max_id"))
