"""Hybrid logical clocks: order, advance, skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hlc_text(c: str = "hlc") -> Column:
    return F.concat_ws(".", F.col(f"{c}.wall").cast("string"), F.col(f"{c}.counter").cast("string"))


def skew_ms(peer_wall: Column, local_ms: Column) -> Column:
    return peer_wall - local_ms


def advance(last: tuple[int, int], remote: tuple[int, int] | None, now: int) -> tuple[int, int]:
    """Next clock value: physical time if it leads; else the leading wall with its counter moved on."""
    wall, counter = last
    seen_wall, seen_counter = remote or (-1, -1)
    top = max(wall, seen_wall, now)
    held = [c for w, c in ((wall, counter), (seen_wall, seen_counter)) if w == top]
    return top, max(held) + 1 if held else 0


def hlc_fold(events: DataFrame, node: str = "author_node", order: str = "received_at") -> DataFrame:
    """The clock of each node after observing its events in order: final wall and counter.

    The fold has a closed form. The final wall is the greatest wall or local time; the counter counts the
    events since that wall was first reached, unless a counter seen at that wall leads. So two
    aggregations and a join on the node find the last stretch, and only it is ranked.
    """
    tagged = events.select(node, "id", F.col(order).alias("at"), F.col("hlc.wall").alias("wall"), F.col("hlc.counter").alias("counter"), F.unix_millis(F.col(order).cast("timestamp")).alias("now"))
    peaks = tagged.groupBy(node).agg(F.max(F.greatest("wall", "now")).alias("top"))
    reached = tagged.join(peaks, node).where(F.greatest("wall", "now") == F.col("top")).groupBy(node, "top").agg(F.min(F.struct("at", "id")).alias("since"))
    stretch = tagged.join(reached, node).where(F.struct("at", "id") >= F.col("since"))
    ranked = stretch.withColumn("step", F.row_number().over(W.partitionBy(node).orderBy("at", "id")))
    ahead = F.max(F.when(F.col("wall") == F.col("top"), F.col("counter") + 1 - F.col("step")))
    return ranked.groupBy(node).agg(F.max("top").alias("wall"), (F.greatest(F.coalesce(ahead, F.lit(-1)), F.lit(-1)) + F.max("step")).cast("bigint").alias("counter"))
