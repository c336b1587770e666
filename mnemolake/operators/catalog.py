"""Edges between records, and what they say: superseded, retracted, in conflict, live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions.ids import canonical
from mnemolake.schema import CLAIM_KINDS, canonical_records

MAX_SIBLINGS = 4


def newest() -> list[Column]:
    """Newest-first total order: clock, then id."""
    return [F.desc("hlc.wall"), F.desc("hlc.counter"), F.desc("id")]


def edges(records: DataFrame, field: str, *carried: str) -> DataFrame:
    """One row for each (space, target, by): record ``by`` of the space names ``target`` in ``field``."""
    return canonical_records(records).select("space", F.col("id").alias("by"), *carried, F.explode(field).alias("target"))


def _sources(records: DataFrame, field: str, name: str) -> DataFrame:
    return edges(records, field).groupBy("space", F.col("target").alias("id")).agg(F.array_sort(F.collect_set("by")).alias(name))


def superseded_by(records: DataFrame) -> DataFrame:
    """space, id, superseded_by: the ascending ids that supersede each target, present or not."""
    return _sources(records, "supersedes", "superseded_by")


def referenced_by(records: DataFrame) -> DataFrame:
    return _sources(records, "refs", "referenced_by")


def dead_keys(records: DataFrame) -> DataFrame:
    """Distinct (space, id) at which a supersession points: one hop, any author, never revived."""
    return edges(records, "supersedes").select("space", F.col("target").alias("id")).distinct()


def live(records: DataFrame) -> DataFrame:
    """Records no edge points at. Only keys of the edges are shuffled against the records."""
    return canonical_records(records).join(dead_keys(records), ["space", "id"], "left_anti")


def with_liveness(records: DataFrame, columns: list[str]) -> DataFrame:
    dead = dead_keys(records).withColumn("dead", F.lit(True))
    return canonical_records(records).select("space", "id", *columns).join(dead, ["space", "id"], "left").withColumn("live", F.col("dead").isNull()).drop("dead")


def live_by_kind(records: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """Live records of a kind, newest first. The kind filter reaches the scan before the anti-join."""
    out = canonical_records(records.where(F.col("kind") == kind)).join(dead_keys(records), ["space", "id"], "left_anti").orderBy(*newest())
    return out.limit(limit) if limit else out


def live_by_tag(records: DataFrame, tag: str, limit: int | None = None) -> DataFrame:
    out = canonical_records(records.where(F.array_contains("tags", tag))).join(dead_keys(records), ["space", "id"], "left_anti").orderBy(*newest())
    return out.limit(limit) if limit else out


def tombstoned(records: DataFrame) -> DataFrame:
    """Present records at which a present tombstone points."""
    marks = edges(records.where(F.col("kind") == "tombstone"), "supersedes").select("space", F.col("target").alias("id")).distinct()
    return canonical_records(records).select("space", "id").join(marks, ["space", "id"], "left_semi")


def _annotations(records: DataFrame, field: str, kind: str) -> DataFrame:
    return edges(records.where(F.col("kind") == kind), field, "hlc", "body").select("space", F.col("target").alias("id"), F.col("by"), "hlc", "body").dropDuplicates(["space", "id", "by"])


def retractions(records: DataFrame) -> DataFrame:
    """space, id, position, retraction, reason: what retracts a present record, newest first."""
    latest = W.partitionBy("space", "id").orderBy(F.desc("hlc.wall"), F.desc("hlc.counter"), F.desc("by"))
    present = canonical_records(records).select("space", "id")
    return _annotations(records, "supersedes", "retraction").join(present, ["space", "id"], "left_semi").select("space", "id", F.row_number().over(latest).alias("position"), F.col("by").alias("retraction"), F.col("body").alias("reason"))


def conflicts(records: DataFrame) -> DataFrame:
    """space, id, position, conflict: the conflict records that name a present record, newest first."""
    latest = W.partitionBy("space", "id").orderBy(F.desc("hlc.wall"), F.desc("hlc.counter"), F.desc("by"))
    present = canonical_records(records).select("space", "id")
    return _annotations(records, "refs", "conflict").join(present, ["space", "id"], "left_semi").select("space", "id", F.row_number().over(latest).alias("position"), F.col("by").alias("conflict"))


def saw(context: Column, node: Column, seen: Column) -> Column:
    """Whether a causal context covers record ``seen`` of ``node``."""
    return F.coalesce(canonical(F.element_at(context, node)) >= seen, F.lit(False))


def all_siblings(records: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Contradicting siblings of claims, before the cap: space, id, sibling, via, rn, saw_this_claim, evidence.

    A conflict record names both sides; a sibling must exist and not be superseded, of any kind; the hit
    must be a claim. A tombstoned conflict still counts. Each sibling appears once, by its newest conflict.
    """
    known = canonical_records(records)
    sides = known.where((F.col("kind") == "conflict") & (F.size("refs") > 1)).select("space", F.col("id").alias("via"), "hlc", "refs")
    claims = known.where(F.col("kind").isin(*CLAIM_KINDS)).select("space", "id", "author_node")
    if hits is not None:
        claims = claims.join(hits.select("space", "id"), ["space", "id"], "left_semi")
    named = sides.select("space", "via", "hlc", "refs", F.explode("refs").alias("id"))
    met = claims.join(named, ["space", "id"]).select("space", "id", "author_node", "via", "hlc", F.explode("refs").alias("sibling")).where(F.col("sibling") != F.col("id"))
    first = W.partitionBy("space", "id", "sibling").orderBy(F.desc("hlc.wall"), F.desc("hlc.counter"), F.desc("via"))
    once = met.withColumn("seen", F.row_number().over(first)).where(F.col("seen") == 1).drop("seen")
    others = known.select("space", F.col("id").alias("sibling"), "causal_ctx", "evidence", F.col("kind").alias("sibling_kind")).join(dead_keys(records).withColumnRenamed("id", "sibling"), ["space", "sibling"], "left_anti")
    standing = once.join(others, ["space", "sibling"])
    order = W.partitionBy("space", "id").orderBy(F.desc("hlc.wall"), F.desc("hlc.counter"), F.desc("via"), "sibling")
    return standing.select("space", "id", "sibling", "via", F.row_number().over(order).alias("rn"), saw(F.col("causal_ctx"), F.col("author_node"), F.col("id")).alias("saw_this_claim"), "evidence", "sibling_kind")


def siblings(records: DataFrame, cap: int = MAX_SIBLINGS) -> DataFrame:
    """The first ``cap`` siblings of each claim, and how many more there are."""
    every = all_siblings(records).withColumn("n", F.count("*").over(W.partitionBy("space", "id")))
    return every.where(F.col("rn") <= cap).withColumn("more", F.greatest(F.col("n") - cap, F.lit(0))).drop("n")


def pending_supersessions(records: DataFrame) -> DataFrame:
    """Targets that are superseded but not present."""
    return dead_keys(records).join(canonical_records(records).select("space", "id"), ["space", "id"], "left_anti")


def counts_by_kind(records: DataFrame) -> DataFrame:
    """Live records by space and kind; kinds with none left alive stay, with zero."""
    return with_liveness(records, ["kind"]).groupBy("space", "kind").agg(F.count_if("live").alias("n_live"))


def metadata(records: DataFrame) -> DataFrame:
    """Records without body and signature, as the catalog holds them."""
    return canonical_records(records).drop("body", "sig")


def embed_models(records: DataFrame) -> DataFrame:
    return records.groupBy("embed_model").agg(F.count("*").alias("n"))


def agents(records: DataFrame) -> DataFrame:
    return records.groupBy("author_agent").agg(F.count("*").alias("n"))


def provenance() -> Column:
    return F.struct("author_agent", "author_node", "author_model", "evidence", "hlc", "epoch")
