"""Items that appear together: pair counts over baskets of any size, and association scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.session import Scratch

CHUNK = 32
"""Items of a basket, or of a chunk of a large one, that one row expands into pairs."""


def clean_tags(c: Column) -> Column:
    """Distinct tags in order, lower case, without blanks around; null and empty ones are dropped."""
    tags = F.coalesce(c, F.array().cast("array<string>"))
    trimmed = F.transform(tags, lambda x: F.lower(F.btrim(x, F.lit(" \t\r\n"))))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: F.length(x) > 0)))


def _pairs_of(items: str) -> Column:
    """All (x, y) with x before y in one sorted array."""
    return F.expr(f"flatten(transform({items}, (x, i) -> transform(slice({items}, i + 2, size({items})), y -> struct(x AS a, y AS b))))")


def _pairs_across(left: str, right: str) -> Column:
    return F.expr(f"flatten(transform({left}, x -> transform({right}, y -> struct(x AS a, y AS b))))")


def pair_counts(baskets: DataFrame, items: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(pairs, singles): n_ab of every item pair (tag_a < tag_b) and n of every item, over sorted distinct arrays.

    Equal baskets are merged first and weigh as many, so a basket repeated a billion times is expanded
    once. Baskets of up to ``chunk`` items are expanded where they are. Larger ones are cut into chunks of
    ``chunk`` items; each pair of chunks is a row of its own, and these rows are dealt over all tasks, so
    one row never expands into more than ``chunk * chunk`` pairs. Both kinds of pairs are summed together.
    """
    scratch = Scratch(baskets.sparkSession, "cooccurrence")
    merged = scratch.write(baskets.where(F.size(items) > 0).groupBy(items).agg(F.count("*").alias("n")), "baskets")
    ordinary = merged.where((F.size(items) > 1) & (F.size(items) <= chunk)).select("n", F.explode(_pairs_of(items)).alias("p"))
    large = merged.where(F.size(items) > chunk).select("n", items, F.ceil(F.size(items) / chunk).cast("int").alias("chunks"))
    halves = large.select("n", items, "chunks", F.explode(F.expr("sequence(0, chunks - 1)")).alias("i")).select("n", items, "i", F.explode(F.expr("sequence(i, chunks - 1)")).alias("j"))
    part = lambda k: F.slice(items, F.col(k) * chunk + 1, F.lit(chunk))
    blocks = halves.select("n", part("i").alias("left"), part("j").alias("right"), (F.col("i") == F.col("j")).alias("same")).repartition(F.xxhash64("left", "right"))
    crossed = blocks.select("n", F.explode(F.when(F.col("same"), _pairs_of("left")).otherwise(_pairs_across("left", "right"))).alias("p"))
    pairs = ordinary.unionByName(crossed).groupBy(F.col("p.a").alias("tag_a"), F.col("p.b").alias("tag_b")).agg(F.sum("n").alias("n_ab"))
    singles = merged.select("n", F.explode(items).alias("tag")).groupBy("tag").agg(F.sum("n").alias("n"))
    return pairs, singles.withColumn("total", merged.agg(F.sum("n").alias("total")).scalar())


def associated_tags(records: DataFrame, least: int = 10, lift: float = 4.0, chunk: int = CHUNK) -> DataFrame:
    """Pairs of tags on at least ``least`` common records, ``lift`` times more often than chance.

    Result: tag_a < tag_b, n_ab, n_a, n_b, lift, pmi (in bits) and jaccard.

    Defined cases: null and empty tag arrays are no basket and do not count in the total; tags are
    compared without surrounding blanks and in lower case, once a record; null tags are dropped; repeated
    rows are separate baskets; other columns are ignored; an empty table gives an empty result.
    """
    baskets = records.select(clean_tags(F.col("tags")).alias("items"))
    pairs, singles = pair_counts(baskets, "items", chunk)
    frequent = pairs.where(F.col("n_ab") >= least)
    known = singles.where(F.col("n") >= least)
    scored = frequent.join(known.select(F.col("tag").alias("tag_a"), F.col("n").alias("n_a"), "total"), "tag_a").join(known.select(F.col("tag").alias("tag_b"), F.col("n").alias("n_b")), "tag_b")
    ratio = F.col("n_ab").cast("double") * F.col("total").cast("double") / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))
    return scored.withColumn("lift", ratio).where(F.col("lift") >= lift).select("tag_a", "tag_b", "n_ab", "n_a", "n_b", "lift", F.log2("lift").alias("pmi"), (F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))).alias("jaccard"))
