"""Reading the domain tables, and the shared projection of events to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemolake.session import ship_package


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A domain table of the folder ``root``."""
    ship_package(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")
