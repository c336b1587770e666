"""Recall: nearest records of each space, filtered after the search, annotated with their standing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.embed import MODEL, embed_texts
from mnemolake.operators import catalog
from mnemolake.functions.ids import canonical_text
from mnemolake.operators.vector_index import VectorIndex, build_index, top_k_by_space
from mnemolake.schema import canonical_records
from mnemolake.session import Scratch

LIMIT = 8
FEW_HITS = 10_000
"""Hits up to which their keys are broadcast."""


def fetch(limit: int) -> int:
    """Matches taken from each space before filtering. Filters come after, so a result may be short."""
    return 4 * limit + 4


def query_vector(query: str):  # noqa: ANN201
    if not query.strip():
        raise ValueError("a query is needed")
    rows, vec = embed_texts([query])
    if not rows:
        raise ValueError("the query has no token")
    return vec[0]


def recall(records: DataFrame, query: str, spaces: list[str] | None = None, limit: int = LIMIT, kinds: list[str] | None = None, tags: list[str] | None = None, include_superseded: bool = False, min_score: float = 0.0, index: VectorIndex | DataFrame | None = None) -> DataFrame:
    """space, id, kind, score, superseded, body, tags, provenance of the best hits.

    ``index`` is a kept index or a table of ``build_index``; without one the records are embedded on the way.
    Only the ids that survive the search meet the records, whose bodies are fetched last.
    """
    limit = limit if limit > 0 else LIMIT
    vec = query_vector(query)
    if spaces is not None:
        records = records.where(F.col("space").isin(*spaces))
    if isinstance(index, VectorIndex):
        near = index.search(vec, fetch(limit), spaces)
    else:
        index = index if index is not None else build_index(records)
        near = top_k_by_space(index.where(F.col("space").isin(*spaces)) if spaces is not None else index, "vec", vec, fetch(limit))
    found = near.select("space", "id", F.col("dot").alias("score")).where(F.col("score") >= min_score)
    meta = canonical_records(records)
    hits = found.join(meta, ["space", "id"])  # at most fetch(limit) rows a space; AQE broadcasts them where that is little
    if kinds:
        hits = hits.where(F.col("kind").isin(*kinds))
    if tags:
        hits = hits.where(F.size(F.array_except(F.array(*map(F.lit, tags)), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    dead = catalog.dead_keys(records).withColumn("superseded", F.lit(True))
    hits = hits.join(dead, ["space", "id"], "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
    if not include_superseded:
        hits = hits.where(~F.col("superseded"))
    return hits.select("space", "id", "kind", "score", "superseded", "body", "tags", catalog.provenance().alias("provenance"), "refs").orderBy(F.desc("score"), "id").limit(limit)


def annotated(records: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with superseded_by, retractions (reasons, newest first), siblings up to the cap and more_siblings.

    The hits are written first, so that the search behind them runs once. Edges are cut to the hits before
    they are gathered; the hits are broadcast where there are few of them.
    """
    hits = Scratch(records.sparkSession, "hits").write(hits, "hits")
    keys = hits.select("space", "id").distinct()
    few = keys.limit(FEW_HITS + 1).count() <= FEW_HITS
    only = lambda d: d.join(F.broadcast(keys) if few else keys, ["space", "id"], "left_semi")
    edges = catalog.edges(records, "supersedes").select("space", F.col("target").alias("id"), "by")
    by = only(edges).groupBy("space", "id").agg(F.array_sort(F.collect_set("by")).alias("superseded_by"))
    reasons = only(catalog.retractions(records)).groupBy("space", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "reason"))), lambda e: e["reason"]).alias("retractions"))
    every = catalog.all_siblings(records, keys)
    sides = every.groupBy("space", "id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rn", "sibling", "via", "saw_this_claim", "evidence"))), 1, catalog.MAX_SIBLINGS).alias("siblings"), F.greatest(F.count("*") - catalog.MAX_SIBLINGS, F.lit(0)).alias("more_siblings"))
    return hits.join(by, ["space", "id"], "left").join(reasons, ["space", "id"], "left").join(sides, ["space", "id"], "left").withColumn("more_siblings", F.coalesce("more_siblings", F.lit(0)))


def get(records: DataFrame, space: str, id: str) -> DataFrame:
    """One record as a hit of score 1, superseded or not."""
    row = canonical_records(records.where(F.col("space") == space)).where(F.col("id") == canonical_text(id))
    dead = catalog.dead_keys(records.where(F.col("space") == space)).withColumn("superseded", F.lit(True))
    hit = row.join(dead, ["space", "id"], "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
    return hit.select("space", "id", "kind", F.lit(1.0).alias("score"), "superseded", "body", "tags", catalog.provenance().alias("provenance"), "refs")


def skipped_spaces(asked: DataFrame, records: DataFrame, keys: DataFrame, index: DataFrame) -> DataFrame:
    """space, reason for every asked space that cannot be searched: not held, relayed or not indexed."""
    flag = lambda d, name: d.select("space").distinct().withColumn(name, F.lit(True))
    all_ = asked.join(flag(records, "held"), "space", "left").join(flag(keys, "readable"), "space", "left").join(flag(index, "indexed"), "space", "left")
    reason = F.when(F.col("held").isNull(), "not held").when(F.col("readable").isNull(), "relayed").when(F.col("indexed").isNull(), "not indexed")
    return all_.select("space", reason.alias("reason")).where(F.col("reason").isNotNull())


def warnings(records: DataFrame, hits: DataFrame, model: str = MODEL, warm: bool = True) -> DataFrame:
    """Conditions that make results worse: a cold index; several embed models held; the first hit with further siblings."""
    models = records.select("embed_model").distinct()
    foreign = models.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("embed_model") != model, F.col("embed_model")))).alias("others")).where(F.col("n") > 1)
    mixed = foreign.select(F.concat(F.lit("records embedded by other models are held: "), F.array_join("others", ", ")).alias("warning"))
    first = hits.where(F.col("more_siblings") > 0).orderBy(F.desc("score"), "id").limit(1)
    cold = records.sparkSession.createDataFrame([] if warm else [("the index is not complete yet; results may be missing",)], "warning string")
    return cold.unionByName(mixed).unionByName(first.select(F.format_string("record %s has %d further contradicting siblings", "id", "more_siblings").alias("warning")))
