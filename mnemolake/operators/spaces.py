"""Spaces and their keys: who can read what, rotation, sealing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.schema import policy


def readable(spaces: DataFrame, keys: DataFrame) -> DataFrame:
    """Spaces for which any key is held."""
    return spaces.select("space").distinct().join(keys.select("space").distinct(), "space", "left_semi")


def relayed(spaces: DataFrame, keys: DataFrame) -> DataFrame:
    return spaces.select("space").distinct().join(keys.select("space").distinct(), "space", "left_anti")


def key_report(keys: DataFrame) -> DataFrame:
    """space, current epoch, epochs as text in order."""
    epochs = F.array_sort(F.collect_set("epoch"))
    return keys.groupBy("space").agg(F.max("epoch").alias("current"), F.array_join(F.transform(epochs, lambda e: e.cast("string")), ",").alias("epochs"))


def rotate(keys: DataFrame, space: str) -> DataFrame:
    """Keys with a next epoch for ``space``: current + 1, the first one 0. Old epochs are kept."""
    mine = F.col("space") == space
    nxt = keys.where(mine).agg(F.lit(space).alias("space"), (F.coalesce(F.max("epoch"), F.lit(-1)) + 1).cast("bigint").alias("epoch"), F.lit(True).alias("is_current"))
    return keys.withColumn("is_current", F.when(mine, False).otherwise(F.col("is_current"))).unionByName(nxt)


def install(keys: DataFrame, space: str, epoch: int) -> DataFrame:
    """Keys with one epoch added; it becomes current if it is not behind."""
    added = keys.sparkSession.createDataFrame([(space, epoch)], "space string, epoch bigint")
    every = keys.select("space", "epoch").unionByName(added).distinct()
    tops = every.groupBy("space").agg(F.max("epoch").alias("top"))
    return every.join(tops, "space").select("space", "epoch", (F.col("epoch") == F.col("top")).alias("is_current"))


def forget_space(keys: DataFrame, space: str) -> DataFrame:
    return keys.where(F.col("space") != space)


def undecryptable(records: DataFrame, keys: DataFrame) -> DataFrame:
    """space, n: records of readable spaces whose epoch key is missing."""
    held = keys.select("space", "epoch").distinct()
    return records.select("space", "epoch", "id").join(readable(records, keys), "space", "left_semi").join(held, ["space", "epoch"], "left_anti").groupBy("space").agg(F.count("*").alias("n_undecryptable"))


def record_aad(space: Column, id: Column, node: Column, epoch: Column) -> Column:
    """Bytes that bind a sealed record to its envelope."""
    return F.concat_ws("\0", space, id, node, epoch.cast("string")).cast("binary")


def seal(plain: Column, key: Column, aad: Column) -> Column:
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), aad)


def open_sealed(blob: Column, key: Column, aad: Column) -> Column:
    """Plain bytes, or null where key or envelope do not fit."""
    return F.try_aes_decrypt(blob, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def snapshot(keys: DataFrame) -> DataFrame:
    """space, epochs: the keyring as one row a space, epochs in order; ``restore`` turns it back."""
    return keys.groupBy("space").agg(F.array_sort(F.collect_set("epoch")).alias("epochs"))


def restore(rings: DataFrame) -> DataFrame:
    return rings.select("space", F.explode("epochs").alias("epoch"), F.array_max("epochs").alias("top")).select("space", "epoch", (F.col("epoch") == F.col("top")).alias("is_current"))


def list_spaces(records: DataFrame, keys: DataFrame) -> DataFrame:
    """One row a space: policy, readable, records, bytes, nodes, live by kind; contents only where readable."""
    from mnemolake.operators import catalog

    base = records.groupBy("space").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.count_distinct("author_node").alias("nodes"))
    live = catalog.counts_by_kind(records).groupBy("space").agg(F.sum("n_live").alias("live"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n_live") > 0, F.concat_ws(":", "kind", F.col("n_live").cast("string"))))), " ").alias("by_kind"))
    pending = catalog.pending_supersessions(records).groupBy("space").agg(F.count("*").alias("pending"))
    held = keys.groupBy("space").agg(F.max("epoch").alias("epoch"))
    lost = undecryptable(records, keys)
    joined = base.join(live, "space", "left").join(pending, "space", "left").join(held, "space", "left").join(lost, "space", "left")
    can = F.col("epoch").isNotNull()
    return joined.select(
        "space", policy("space").alias("policy"), can.alias("readable"), "records", "bytes", "nodes", "epoch",
        F.when(can, F.coalesce("live", F.lit(0))).alias("live"), F.when(can, F.coalesce("by_kind", F.lit(""))).alias("by_kind"),
        F.when(can, F.coalesce("pending", F.lit(0))).alias("pending"), F.when(can, F.coalesce("n_undecryptable", F.lit(0))).alias("undecryptable"),
    )
