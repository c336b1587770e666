"""Current state of a table from an unordered feed of inserts, replacements and withdrawals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.ids import canonical, canonical_all
from mnemolake.session import Scratch

GONE = ("tombstone", "retraction")


def current_entries(changes: DataFrame, base: DataFrame | None = None, batches: int = 4, image: tuple[str, ...] = ()) -> DataFrame:
    """Entries still alive: space, entry_id, current_id, and the ``image`` columns of the current record.

    The feed is cut at quantiles of ``hlc.wall`` into batches that are resolved newest first. Of each
    batch the greatest change a key is taken (partial maxima first, so a key with most of the feed costs
    one row a task), keys already resolved are removed by an anti-join of two unique-key sides, and the
    rest is recorded as image or tombstone. Each batch reads only its own range of the feed. ``base`` rows
    (space, entry_id, current_id, image) that no change touched are appended at the end.

    Defined cases: order is (wall, counter, id), null parts lowest; a null space is a space of its own;
    a change with null id names no entry of its own, and cannot be a current record, but one that
    withdraws still withdraws; null kinds are alive; repeats change nothing; of repeats that differ in
    ``image`` the greatest counts, nulls lowest; null targets are ignored; an empty feed returns ``base``.
    """
    spark = changes.sparkSession
    scratch = Scratch(spark, "changefeed")
    wall = F.coalesce(F.col("hlc.wall"), F.lit(-1))
    shares = [k / batches for k in range(1, batches)] or [0.5]
    marks = changes.agg(F.percentile_approx("hlc.wall", shares, F.lit(1000)).alias("marks")).first().marks  # one row, one value a batch
    cuts = sorted(set(marks or []), reverse=True) if batches > 1 else []
    named = canonical_all("supersedes")
    resolved: DataFrame | None = None
    for k, (low, high) in enumerate(zip([*cuts, None], [None, *cuts])):
        rows = changes
        if low is not None:
            rows = rows.where(F.col("hlc.wall") >= int(low))
        if high is not None:
            rows = rows.where((F.col("hlc.wall") < int(high)) | F.col("hlc.wall").isNull() if low is None else F.col("hlc.wall") < int(high))
        latest = (
            rows.select("space", canonical("id").alias("id"), wall.alias("wall"), F.coalesce(F.col("hlc.counter"), F.lit(-1)).alias("counter"), F.coalesce(F.col("kind"), F.lit("")).alias("kind"), named.alias("named"), *(F.col(c).alias(f"image_{c}") for c in image))
            .withColumn("entry_id", F.explode(F.when(F.size("named") == 0, F.array("id")).otherwise(F.col("named"))))
            .where(F.col("entry_id").isNotNull())
            .groupBy("space", "entry_id")
            .agg(F.max(F.struct("wall", "counter", F.coalesce("id", F.lit("")).alias("id"), "kind", *(f"image_{c}" for c in image))).alias("last"))
            .select("space", "entry_id", F.col("last.id").alias("current_id"), F.col("last.kind").isin(*GONE).alias("gone"), *(F.col(f"last.image_{c}").alias(c) for c in image))
        )
        if resolved is not None:
            done = resolved.select(F.col("space").alias("done_space"), F.col("entry_id").alias("done_entry"))
            latest = latest.join(done, F.col("space").eqNullSafe(F.col("done_space")) & (F.col("entry_id") == F.col("done_entry")), "left_anti")
        scratch.write(latest, f"resolved/batch={k}")
        resolved = spark.read.schema(latest.schema).parquet(*[scratch.at(f"resolved/batch={i}") for i in range(k + 1)])
    alive = resolved.where(~F.col("gone") & (F.col("current_id") != "")).select("space", "entry_id", "current_id", *image)
    if base is None:
        return alive
    done = resolved.select(F.col("space").alias("done_space"), F.col("entry_id").alias("done_entry"))
    untouched = base.select("space", canonical("entry_id").alias("entry_id"), canonical("current_id").alias("current_id"), *image).join(done, F.col("space").eqNullSafe(F.col("done_space")) & (F.col("entry_id") == F.col("done_entry")), "left_anti")
    return alive.unionByName(untouched)
