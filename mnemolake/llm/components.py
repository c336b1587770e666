"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.operators.skew import HOT_ROWS, salted_join
from mnemolake.session import Scratch


def _star(scratch: Scratch, edges: DataFrame, name: str, large: bool, hot_rows: int) -> DataFrame:
    """Hang the neighbours of every node on the smallest of them: the greater neighbours, or the smaller ones and the node.

    Minima are partial sums of tasks first; the way back to the edges salts nodes of many links.
    """
    there = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = there.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), f"{name}_least")
    met = salted_join(both, least, ["u"], "n", [F.col("v")], hot_rows=hot_rows)
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = met.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    out = scratch.write(out.where(F.col("a") != F.col("b")).distinct(), name)
    scratch.drop(f"{name}_least")
    return out


def components(links: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """node, root of every node of ``links`` (a, b): the root is the smallest node that links lead to.

    Rounds of one large and one small star, until a round changes nothing; they grow with the square of the
    logarithm of the number of nodes at most. Each round is a written table. Null ends, loops and repeated
    links are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(links.sparkSession, "components")
    edges = scratch.write(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen, k, held = None, 0, "edges"
    while True:
        # the hash sum tells two edge sets of equal size apart
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if now == seen or not now.n:
            break
        seen, k = now, k + 1
        grown = _star(scratch, edges, f"large{k}", True, hot_rows)
        edges = _star(scratch, grown, f"small{k}", False, hot_rows)
        scratch.drop(held, f"large{k}")
        held = f"small{k}"
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
