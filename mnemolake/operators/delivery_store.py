"""At-least-once messages made exactly-once by an idempotent upsert into hash-bucketed, sorted runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.ids import canonical
from mnemolake.session import CLEANUP, Scratch, setting


KEYS = ("msg_id", "msg_node")
BUCKET_ROWS, MOST_BUCKETS = 5_000_000, 100_000
"""Deliveries that one bucket stands for, where the store may choose the number of its buckets, and Spark's own bound on that number."""
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"  # a bucket of one file is read in its order
_UNSORTED = "spark.sql.maxConcurrentOutputFileWriters"  # a task that writes one bucket need not sort by bucket


def buckets_for(spark: SparkSession, rows: int) -> int:
    """Buckets that keep a task's share the same at every size, and at least one a shuffle partition."""
    return min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS)))


class DeliveryStore:
    """For each message key the delivery that stays, kept as sorted runs in hash buckets.

    ``upsert`` collapses a batch to one row a key (map-side first, so a message repeated a billion times
    reaches the shuffle once a task) and writes it as a run: one file a bucket, sorted by key. ``compact``
    merges runs two by two until one is left: equal buckets of two sorted runs are merged by a full outer
    merge join, which needs neither shuffle nor sort, equal keys collapse to the smaller (received_at,
    delivery_no), and the merged run, one sorted file a bucket again, replaces both. Upserting a batch again
    changes nothing, whatever the order of arrival.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch = Scratch(spark, "deliveries")
        self.runs: list[str] = []

    @staticmethod
    def keyed(deliveries: DataFrame) -> DataFrame:
        """Message key and order of each delivery; rows with null id or author_node are no message."""
        return deliveries.where(F.col("id").isNotNull() & F.col("author_node").isNotNull()).select(
            canonical("id").alias("msg_id"), F.trim("author_node").alias("msg_node"), F.col("received_at"), F.col("delivery_no")
        )

    @staticmethod
    def _order(at: Column, no: Column) -> Column:
        return F.struct(at.isNull().alias("unknown"), at.alias("received_at"), no.alias("delivery_no"))

    def _table(self, name: str, path: str, schema: str) -> None:
        keys = ", ".join(KEYS)
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def upsert(self, deliveries: DataFrame) -> None:
        first = F.min(self._order(F.col("received_at"), F.col("delivery_no"))).alias("first")
        run = self.keyed(deliveries).groupBy(*KEYS).agg(first).select(*KEYS, F.col("first.received_at").alias("received_at"), F.col("first.delivery_no").alias("delivery_no"))
        name = f"delivery_run_{uuid.uuid4().hex}"
        # the aggregation's own shuffle makes the buckets
        with setting(self.spark, CLEANUP, "true"), setting(self.spark, "spark.sql.shuffle.partitions", str(self.buckets)):
            run.write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).option("path", self.scratch.at(name)).saveAsTable(name)
        self.runs.append(name)

    def merged(self, a: str, b: str) -> DataFrame:
        """The merge of two runs, bucket by bucket."""
        x, y = (self.spark.table(t).select(*KEYS, F.struct(self._order(F.col("received_at"), F.col("delivery_no")).alias("order")).alias(c)) for t, c in ((a, "x"), (b, "y")))
        both = x.hint("merge").join(y, list(KEYS), "full")
        first = F.least("x.order", "y.order")  # skips nulls
        return both.select(*KEYS, first["received_at"].alias("received_at"), first["delivery_no"].alias("delivery_no"))

    def compact(self) -> DataFrame:
        """One row a message: the delivery that stays, from the one run that is left."""
        if not self.runs:
            raise ValueError("nothing was ever upserted")
        while len(self.runs) > 1:
            a, b, *rest = self.runs
            name = f"delivery_run_{uuid.uuid4().hex}"
            with setting(self.spark, _ORDERED, "true"), setting(self.spark, _UNSORTED, "4"):
                run = self.merged(a, b)
                run.write.bucketBy(self.buckets, *KEYS).option("path", self.scratch.at(name)).saveAsTable(name)
            # the files are in key order already: say so
            schema = ", ".join(f"{c} {t}" for c, t in run.dtypes)
            self.spark.sql(f"DROP TABLE {name}")
            self._table(name, self.scratch.at(name), schema)
            self.runs = [*rest, name]
            self._drop(a)
            self._drop(b)
        return self.spark.table(self.runs[0])

    def close(self) -> DataFrame:
        """The compacted run as plain files; no table of the store stays in the catalog."""
        last = self.compact()
        name = self.runs.pop()
        self.spark.sql(f"DROP TABLE {name}")
        return self.spark.read.schema(last.schema).parquet(self.scratch.at(name))


def repeated_deliveries(deliveries: DataFrame, runs: int = 3, buckets: int | None = None) -> DataFrame:
    """Deliveries to drop (delivery_no): all but the earliest copy of each message.

    The deliveries are upserted in ``runs`` batches, ranges of delivery_no whose bounds reach the scan, and
    compacted; every keyed delivery that is not a winner is dropped, by an anti-join on the unique
    delivery_no, which no popular message can skew.

    Defined cases: rows with null id or author_node are never dropped; a null received_at is later than
    any time; equal times go to the smaller delivery_no; a null delivery_no belongs to the first batch, is
    the smallest, and is never dropped; rows that repeat a delivery_no stay or go together; an empty table
    gives an empty result.
    """
    spark = deliveries.sparkSession
    ends = deliveries.agg(F.min("delivery_no").alias("lo"), F.max("delivery_no").alias("hi"), F.count("*").alias("n")).first()  # one row
    store = DeliveryStore(spark, buckets or buckets_for(spark, ends.n))
    lo, hi = (ends.lo or 0), (ends.hi or 0) + 1
    bounds = [lo + (hi - lo) * k // runs for k in range(runs + 1)]
    no = F.col("delivery_no")
    for k in range(runs):
        mine = (no >= bounds[k]) & (no < bounds[k + 1])
        store.upsert(deliveries.where(mine | no.isNull() if k == 0 else mine))
    kept = store.close().select("delivery_no")
    return store.keyed(deliveries).where(no.isNotNull()).select("delivery_no").join(kept, "delivery_no", "left_anti")


def exactly_once(deliveries: DataFrame, runs: int = 3, buckets: int | None = None) -> DataFrame:
    """The deliveries themselves, one copy of each message; rows without a key stay."""
    return deliveries.join(repeated_deliveries(deliveries, runs, buckets), "delivery_no", "left_anti")
