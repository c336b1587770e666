"""References to records that do not exist, came later, or were already withdrawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.ids import canonical, canonical_all
from mnemolake.operators.skew import HOT_ROWS, salted_join
from mnemolake.session import Scratch


def orphan_references(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges of ``supersedes`` and ``refs`` whose target is missing, late or deleted.

    Result: from_id, field_name, target_id, status, received_day, one row for each distinct edge.
    Parents, child references and tombstone marks go into one long table keyed by (space, id); one
    aggregation a key (partial sums first, so a popular key costs one row a task) keeps the keys that
    lack their parent or have it late or withdrawn. Only those keys meet the child rows again, in a join
    that salts keys with more than ``hot_rows`` references.

    Defined cases: null arrays are empty; null targets are no reference; blank targets name nothing and
    are missing; a null space forms a space of its own; rows with a null id are ignored; a null
    received_at never makes a target late and leaves received_day null, and a child without received_at
    is neither late nor deleted; repeated rows of an id count once, with the earliest parent time. Other
    columns are ignored. An empty table gives an empty result.
    """
    child = lambda name: F.transform(canonical_all(name), lambda t: F.struct(F.lit(name).alias("field"), t.alias("key")))
    own = F.array(F.struct(F.lit("").alias("field"), F.col("__id").alias("key")))
    long = (
        records.where(F.col("id").isNotNull())
        .select(F.col("space"), canonical("id").alias("__id"), F.col("received_at").alias("at"), (F.coalesce(F.col("kind"), F.lit("")) == "tombstone").alias("tomb"), "supersedes", "refs")
        .select("space", F.col("__id").alias("from_id"), "at", "tomb", F.explode(F.concat(own, child("supersedes"), child("refs"))).alias("e"))
        .select(F.coalesce("space", F.lit("\0")).alias("space"), F.col("e.key").alias("key"), "from_id", F.col("e.field").alias("field"), "at", "tomb")
    )
    parent, edge = F.col("field") == "", F.col("field") != ""
    tomb = F.when((F.col("field") == "supersedes") & F.col("tomb") & F.col("at").isNotNull(), F.unix_micros(F.col("at").cast("timestamp")))
    marks = (
        long.withColumn("tomb_at", tomb)
        .groupBy("space", "key")
        .agg(
            F.count(F.when(parent, 1)).alias("parents"),
            F.min(F.when(parent, F.col("at"))).alias("parent_at"),
            F.count(F.when(edge, 1)).alias("children"),
            F.min(F.when(edge, F.col("at"))).alias("first_child"),
            F.max(F.when(edge, F.col("at"))).alias("last_child"),
            F.min(F.when(F.col("tomb_at").isNotNull(), F.struct("tomb_at", "from_id"))).alias("tomb_lo"),
            F.max(F.when(F.col("tomb_at").isNotNull(), F.struct((-F.col("tomb_at")).alias("neg"), "from_id"))).alias("tomb_hi"),
        )
        .where((F.col("children") > 0) & ((F.col("parents") == 0) | (F.col("parent_at") > F.col("first_child")) | F.col("tomb_lo").isNotNull()))
        .select("space", "key", "parents", "parent_at", "children", F.col("tomb_lo.tomb_at").alias("tomb_at"), F.col("tomb_lo.from_id").alias("tomb_first"), F.col("tomb_hi.from_id").alias("tomb_last"))
    )
    marks = Scratch(records.sparkSession, "orphans").write(marks, "marks")
    met = salted_join(long.where(edge), marks, ["space", "key"], "children", [F.col("from_id"), F.col("field")], hot_rows=hot_rows)
    at = F.unix_micros(F.col("at").cast("timestamp"))
    by_other = (F.col("tomb_first") != F.col("from_id")) | (F.col("tomb_last") != F.col("from_id"))
    status = F.when(F.col("parents") == 0, "missing").when(F.col("parent_at") > F.col("at"), "late").when((F.col("tomb_at") <= at) & by_other, "deleted")
    return (
        met.withColumn("status", status)
        .where(F.col("status").isNotNull())
        .select("from_id", F.col("field").alias("field_name"), F.col("key").alias("target_id"), "status", F.date_format("at", "yyyy-MM-dd").alias("received_day"))
        .dropDuplicates(["from_id", "field_name", "target_id", "status"])
    )


def orphan_counts(edges: DataFrame) -> DataFrame:
    """Number of orphan references for each field, status and day of receipt."""
    return edges.groupBy("field_name", "status", "received_day").agg(F.count("*").alias("n_refs"))
