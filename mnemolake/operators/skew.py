"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
MOST_HOT = 10_000
"""Keys that are ever dealt over salts. A key is hot only with more than one row in ``MOST_HOT`` of all rows, so there are fewer of them by arithmetic."""


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: list[Column], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join many rows to a side that has one row a key and knows in ``weight`` how many rows will meet it.

    Keys with more than ``hot_rows`` rows, and more than one in ``MOST_HOT`` of all rows, are dealt over salts
    of about that many rows by the hash of ``spread``, and their right row is repeated once a salt. The list
    of such keys is broadcast; it holds fewer than ``MOST_HOT`` keys whatever the size of the input. Where
    there is none, the join is a plain one. ``right`` is read twice, so it should be a written table. Null
    keys match nothing.
    """
    known = right.agg(F.sum(weight).alias("total"), F.max(weight).alias("most")).first()  # one row
    limit = max(hot_rows, -(-(known.total or 0) // MOST_HOT))
    if (known.most or 0) <= limit:
        return left.join(right, keys, how)
    salts = F.ceil(F.col(weight) / limit).cast("int")
    hot = right.where(F.col(weight) > limit).select(*keys, salts.alias("__salts"))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.coalesce("__salts", F.lit(1))).cast("int"))).drop("__salts")
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > limit, salts).otherwise(1) - 1)))
    return dealt.join(repeated, [*keys, "__salt"], how).drop("__salt")
