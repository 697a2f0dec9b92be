"""What the query modules share: reading a table of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyomics.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
