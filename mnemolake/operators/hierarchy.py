"""Parent-child links of unknown depth: roots, depths, full paths, descendants and circles.

Nodes are range-partitioned by (space, id), so a replacement chain, whose ids ascend in time, mostly lies
inside one partition. Each partition contracts its own chains to their exits, the ids at which they leave
the partition. The exits form a much smaller forest, the quotient, solved the same way: a quotient that one
bounded task can hold is contracted there; a larger one first moves every link over its target, which halves
all its paths, and is then partitioned anew. So the number of levels is logarithmic in the longest path,
whatever the order of ids. At the end every node adds its exit's answer to its own.

Circles inside a partition close there. One across partitions closes when the smallest id passed by a record
is the record itself, or at the latest when two links in a row are longer than there are records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.ids import canonical, canonical_all
from mnemolake.operators.skew import HOT_ROWS, salted_join
from mnemolake.session import Scratch

FRAGMENT = "space string, id string, state string, anchor string, hops bigint, low string"
TRAIL = ", trail array<string>"
TASK_ROWS = 250_000
"""Nodes that one contraction task holds at most, on average; the last quotient is one such task."""


def contract(pdf: pd.DataFrame, trails: bool = False) -> pd.DataFrame:
    """Follow every link as far as it stays inside ``pdf``.

    Rows are (space, id, state, anchor, hops, low): an *open* row leads in ``hops`` steps to ``anchor``, and
    ``low`` is the smallest id it meets behind itself, ``anchor`` included; *root* and *circle* rows are
    final. Pointer doubling: the number of vector operations is logarithmic in the longest chain.
    """
    n = len(pdf)
    if n == 0:
        return pdf
    key = (pdf["space"] + "\0" + pdf["id"]).to_numpy()
    target = (pdf["space"] + "\0" + pdf["anchor"]).to_numpy()
    is_open = (pdf["state"] == "open").to_numpy()
    at = pd.Index(key).get_indexer(target)
    inner = is_open & (at >= 0)
    here = np.arange(n)
    step = np.where(inner, at, here)
    names = pd.Index(np.unique(pdf["low"].to_numpy().astype(object)))
    low = names.get_indexer(pdf["low"])
    hops = np.where(inner, pdf["hops"].to_numpy(np.int64), 0)
    jump, far = step.copy(), 1
    while far < 2 * n:
        hops = hops + hops[jump]
        low = np.minimum(low, low[jump])
        jump = jump[jump]
        far *= 2
    last = jump
    circling = inner[last]
    own_hops = pdf["hops"].to_numpy(np.int64)
    state = pdf["state"].to_numpy()[last].astype(object)
    anchor = pdf["anchor"].to_numpy()[last].astype(object)
    total = hops + own_hops[last]
    # Beyond 2n steps every circling node stands on its circle, whose smallest id it has passed.
    state[circling] = "circle"
    anchor[circling] = names.to_numpy()[low[last[circling]]]
    total = np.where(state == "circle", -1, total)
    out = pd.DataFrame({"space": pdf["space"].to_numpy(), "id": pdf["id"].to_numpy(), "state": state, "anchor": anchor, "hops": total, "low": names.to_numpy()[low]})
    if trails:
        own = pdf["trail"].tolist()
        done: list[list[str] | None] = [None] * n
        for i in range(n):
            if circling[i]:
                done[i] = []
                continue
            walk, j = [], i
            while done[j] is None and inner[j]:
                walk.append(j)
                j = int(step[j])
            if done[j] is None:
                done[j] = list(own[j])
            for k in reversed(walk):
                done[k] = [*own[k], *done[int(step[k])]]
        out["trail"] = done
    return out


def _contract_partition(batches: Iterator[pd.DataFrame], trails: bool) -> Iterator[pd.DataFrame]:
    held = [b for b in batches if len(b)]
    if held:
        yield contract(pd.concat(held, ignore_index=True), trails)


def parent_links(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """space, id, parent: the greatest id in ``supersedes`` that exists in the same space."""
    scratch = Scratch(records.sparkSession, "links")
    known = records.where(F.col("id").isNotNull()).select(F.coalesce("space", F.lit("\1")).alias("space"), canonical("id").alias("id"), canonical_all("supersedes").alias("named"))
    edges = known.where(F.size("named") > 0).select("space", F.col("id").alias("child"), F.explode("named").alias("id"))
    wanted = edges.groupBy("space", "id").agg(F.count("*").alias("children"))
    existing = scratch.write(wanted.join(known.select("space", "id").distinct(), ["space", "id"], "left_semi"), "existing")
    met = salted_join(edges, existing, ["space", "id"], "children", [F.col("child")], hot_rows=hot_rows)
    return met.groupBy("space", "child").agg(F.max("id").alias("parent")).select("space", F.col("child").alias("id"), "parent")


def _solve(scratch: Scratch, nodes: DataFrame, level: int, rows: int, most: int, trails: bool, task_rows: int, hot_rows: int) -> DataFrame:
    """All of ``nodes`` final. ``most`` is the number of records at level 0, which no path without a circle exceeds."""
    schema = FRAGMENT + (TRAIL if trails else "")
    op = lambda it: _contract_partition(it, trails)
    if level and rows <= task_rows:
        return scratch.write(nodes.coalesce(1).mapInPandas(op, schema), f"solved{level}")
    parts = max(-(-rows // task_rows), 1 if level else scratch.spark.sparkContext.defaultParallelism)
    local = scratch.write(nodes.repartitionByRange(parts, "space", "id").mapInPandas(op, schema), f"local{level}")
    exits = local.where(F.col("state") == "open").groupBy("space", F.col("anchor").alias("id")).agg(F.count("*").alias("arrivals"))
    inner = scratch.write(local.join(exits, ["space", "id"]).select(*local.columns, "arrivals"), f"inner{level}")
    met = inner.count()
    if met == 0:
        return local
    quotient = _jump(scratch, inner, level, most, trails, hot_rows) if met > task_rows else inner.drop("arrivals")
    solved = _solve(scratch, quotient, level + 1, met, most, trails, task_rows, hot_rows)
    answer = solved.select("space", F.col("id").alias("anchor"), F.col("state").alias("to_state"), F.col("anchor").alias("to_anchor"), F.col("hops").alias("to_hops"), *([F.col("trail").alias("to_trail")] if trails else []))
    answer = scratch.write(answer.join(inner.select("space", F.col("id").alias("anchor"), "arrivals"), ["space", "anchor"]), f"answers{level}")
    waiting = salted_join(local.where(F.col("state") == "open"), answer, ["space", "anchor"], "arrivals", [F.col("id")], hot_rows=hot_rows)
    circle = F.col("to_state") == "circle"
    closed = waiting.select(
        "space", "id", F.col("to_state").alias("state"), F.col("to_anchor").alias("anchor"), F.when(circle, F.lit(-1)).otherwise(F.col("hops") + F.col("to_hops")).cast("bigint").alias("hops"), "low",
        *([F.concat("trail", "to_trail").alias("trail")] if trails else []),
    )
    return scratch.write(local.where(F.col("state") != "open").unionByName(closed), f"solved{level}")


def _jump(scratch: Scratch, nodes: DataFrame, level: int, most: int, trails: bool, hot_rows: int) -> DataFrame:
    """Every open row moved over its anchor, and the circles that show closed."""
    nxt = nodes.select("space", F.col("id").alias("anchor"), "arrivals", F.col("state").alias("n_state"), F.col("anchor").alias("n_anchor"), F.col("hops").alias("n_hops"), F.col("low").alias("n_low"), *([F.col("trail").alias("n_trail")] if trails else []))
    is_open = F.col("state") == "open"
    met = salted_join(nodes.where(is_open).drop("arrivals"), nxt, ["space", "anchor"], "arrivals", [F.col("id")], hot_rows=hot_rows)
    into = F.col("n_state") == "circle"
    round_ = (F.col("n_state") == "open") & (F.col("hops") >= most) & (F.col("n_hops") >= most)  # the anchor lies on a circle, all of which lies behind it
    moved = met.select(
        "space", "id", F.when(round_, "circle").otherwise(F.col("n_state")).alias("state"), F.when(round_, F.col("n_low")).otherwise(F.col("n_anchor")).alias("anchor"),
        F.when(into | round_, F.lit(-1)).otherwise(F.col("hops") + F.col("n_hops")).cast("bigint").alias("hops"), F.when(F.col("n_state") == "open", F.least("low", "n_low")).otherwise(F.col("low")).alias("low"),
        *([F.concat("trail", "n_trail").alias("trail")] if trails else []),
    )
    moved = scratch.write(moved.unionByName(nodes.where(~is_open).drop("arrivals")), f"moved{level}")
    # A record that meets itself as the smallest id has seen its whole circle; whoever has met it leads into that circle.
    seen = moved.where(is_open).groupBy("space", "low").agg(F.count("*").alias("n"), F.max(F.col("id") == F.col("low")).alias("closes")).where("closes").select("space", "low", "n")
    rings = scratch.write(seen, f"rings{level}")
    if rings.isEmpty():
        return moved
    ringed = salted_join(moved, rings, ["space", "low"], "n", [F.col("id")], how="left", hot_rows=hot_rows)
    closes = is_open & F.col("n").isNotNull()
    out = ringed.withColumns({"anchor": F.when(closes, F.col("low")).otherwise(F.col("anchor")), "hops": F.when(closes, F.lit(-1)).otherwise(F.col("hops")).cast("bigint"), "state": F.when(closes, "circle").otherwise(F.col("state"))})
    return scratch.write(out.select(*moved.columns), f"jumped{level}")


def hierarchy(records: DataFrame, trails: bool = False, task_rows: int = TASK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """id, root_id, depth (and space, and path with ``trails``) of every record that has a parent or is one.

    On a circle, or leading into one, depth is -1, root_id the smallest id on that circle and path empty;
    else path runs from the root to the record.

    Defined cases: null or empty supersedes make a record a root, listed only if it is a parent; ids that
    name nothing in the record's space are no parents; the record's own id counts, as a circle of one;
    rows with null id are ignored; repeated rows of an id are one record with all their links; a null
    space is a space of its own, given back as null; an empty table gives an empty result.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "hierarchy")
    links = scratch.write(parent_links(records, hot_rows), "links")
    children = links.select("space", "id", F.lit("open").alias("state"), F.col("parent").alias("anchor"), F.lit(1).cast("bigint").alias("hops"), F.col("parent").alias("low"))
    tops = links.select("space", F.col("parent").alias("id")).distinct().join(links, ["space", "id"], "left_anti").select("space", "id", F.lit("root").alias("state"), F.col("id").alias("anchor"), F.lit(0).cast("bigint").alias("hops"), F.col("id").alias("low"))
    nodes = scratch.write(children.unionByName(tops), "nodes")
    n = nodes.count()
    solved = _solve(scratch, nodes, 0, n, n, False, task_rows, hot_rows)
    out = [F.when(F.col("space") != "\1", F.col("space")).alias("space"), "id", F.col("anchor").alias("root_id"), F.col("hops").alias("depth")]
    if not trails:
        return solved.select(*out)
    # Trails are gathered where no circle is left, so none grows beyond its path.
    ringed = solved.where(F.col("state") == "circle")
    walk = Scratch(spark, "trails")
    free = walk.write(nodes.join(ringed.select("space", "id"), ["space", "id"], "left_anti").withColumn("trail", F.array("id")), "nodes")
    pathed = _solve(walk, free, 0, free.count(), n, True, task_rows, hot_rows)
    return pathed.select(*out, F.reverse("trail").alias("path")).unionByName(ringed.select(*out, F.array().cast("array<string>").alias("path")))


def descendants(paths: DataFrame) -> DataFrame:
    """Every (id, descendant_id, distance) pair below a record, from the paths of ``hierarchy(trails=True)``."""
    return (
        paths.where(F.col("depth") > 0)
        .select("space", F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "id"))
        .where(F.col("at") < F.col("depth"))
        .select("space", "id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
    )
