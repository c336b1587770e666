"""Version vectors, the deltas two replicas owe each other, and set reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions.ids import canonical
from mnemolake.schema import ZERO_ID
from mnemolake.session import Scratch

BATCH, ROUNDS = 256, 64
MAX_RANGES = 100_000
"""Wanted ranges up to which they are broadcast: one for each author node, never for each record."""


def version_vector(records: DataFrame, *by: str) -> DataFrame:
    """(space, node, high): the greatest id of each author node. A mark, not a contiguous prefix."""
    keys = by or ("space",)
    return records.groupBy(*keys, F.col("author_node").alias("node")).agg(F.max(canonical("id")).alias("high"))


def as_map(vector: DataFrame) -> DataFrame:
    return vector.groupBy("space").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "high")))).alias("vector"))


def vector_text(vector: DataFrame) -> DataFrame:
    """``{node:ID, ...}`` in node order, ``{}`` where empty."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "high"))), lambda e: F.concat_ws(":", e["node"], e["high"])), ", ")
    return vector.groupBy("space").agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("vector_text"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lattice join: commutative, associative, idempotent."""
    return a.unionByName(b).groupBy("space", "node").agg(F.max("high").alias("high"))


def merge_changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """``merge``, and whether ``b`` moved each mark of ``a`` on."""
    both = a.withColumnRenamed("high", "mine").join(b.withColumnRenamed("high", "theirs"), ["space", "node"], "full")
    high = F.greatest("mine", "theirs")
    return both.select("space", "node", high.alias("high"), (F.col("mine").isNull() | (F.col("mine") < high)).alias("changed"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each space: a_dominates, b_dominates, equal, concurrent. Everything dominates the empty vector."""
    both = a.withColumnRenamed("high", "mine").join(b.withColumnRenamed("high", "theirs"), ["space", "node"], "full")
    lacks = F.count_if(F.col("theirs").isNotNull() & (F.col("mine").isNull() | (F.col("mine") < F.col("theirs")))).alias("behind")
    leads = F.count_if(F.col("mine").isNotNull() & (F.col("theirs").isNull() | (F.col("theirs") < F.col("mine")))).alias("ahead")
    counts = both.groupBy("space").agg(lacks, leads)
    return counts.select("space", (F.col("behind") == 0).alias("a_dominates"), (F.col("ahead") == 0).alias("b_dominates"), ((F.col("behind") == 0) & (F.col("ahead") == 0)).alias("equal"), ((F.col("behind") > 0) & (F.col("ahead") > 0)).alias("concurrent"))


def missing_ranges(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(space, node, after, through]: what the other side has beyond my marks."""
    both = theirs.withColumnRenamed("high", "through").join(mine.withColumnRenamed("high", "after"), ["space", "node"], "left")
    return both.where(F.col("after").isNull() | (F.col("after") < F.col("through"))).select("space", "node", F.coalesce("after", F.lit(ZERO_ID)).alias("after"), "through")


def delta(records: DataFrame, ranges: DataFrame) -> DataFrame:
    """Records inside wanted ranges: an equi-join on (space, node), the range as its residual."""
    wanted = ranges.select("space", F.col("node").alias("author_node"), "after", "through")
    if ranges.limit(MAX_RANGES + 1).count() <= MAX_RANGES:
        wanted = F.broadcast(wanted)
    known = records.withColumn("id", canonical("id"))
    return known.join(wanted, ["space", "author_node"]).where((F.col("id") > F.col("after")) & (F.col("id") <= F.col("through"))).select(*known.columns)


def delta_limited(records: DataFrame, ranges: DataFrame, limit: int = BATCH) -> DataFrame:
    """One bounded batch of a delta a space, filled node by node in node order, ids ascending."""
    limit = BATCH if limit <= 0 or limit > BATCH else limit
    order = W.partitionBy("space").orderBy("author_node", "id")
    return delta(records, ranges).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")


def common_spaces(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("space").distinct().join(b.select("space").distinct(), "space", "left_semi")


def lag(local: DataFrame, peer: DataFrame) -> DataFrame:
    """Marks (not records) in which the peer leads or trails, in spaces both hold."""
    shared = common_spaces(local, peer)
    both = local.withColumnRenamed("high", "mine").join(peer.withColumnRenamed("high", "theirs"), ["space", "node"], "full").join(shared, "space", "left_semi")
    behind = F.col("theirs").isNotNull() & (F.col("mine").isNull() | (F.col("mine") < F.col("theirs")))
    ahead = F.col("mine").isNotNull() & (F.col("theirs").isNull() | (F.col("theirs") < F.col("mine")))
    return both.agg(F.count_if(behind).alias("lag_behind"), F.count_if(ahead).alias("lag_ahead"))


def set_missing(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Exactly the records the other side has and I lack, holes below the marks included."""
    held = mine.select("space", canonical("id").alias("id")).distinct()
    return theirs.withColumn("id", canonical("id")).join(held, ["space", "id"], "left_anti")


def exchange(local: DataFrame, peer: DataFrame, rounds: int = ROUNDS, batch: int | None = None) -> DataFrame:
    """``local`` after pulling from ``peer``. Unbounded, one job does; with ``batch``, rounds of at most
    that many records a space, until no space has a gap or a round comes back empty."""
    if batch is None:
        got = delta(peer, missing_ranges(version_vector(local), version_vector(peer)))
        return local.withColumn("id", canonical("id")).unionByName(set_missing(local, got))
    scratch = Scratch(local.sparkSession, "exchange")
    held, known = local.withColumn("id", canonical("id")), scratch.write(version_vector(local), "marks")
    theirs = scratch.write(version_vector(peer), "theirs")
    for k in range(rounds):
        got = scratch.write(set_missing(held, delta_limited(peer, missing_ranges(known, theirs), batch)), f"round{k}")
        if got.isEmpty():
            break
        held = held.unionByName(got)
        known = scratch.write(merge(known, version_vector(got)), f"marks{k}")
    return held
