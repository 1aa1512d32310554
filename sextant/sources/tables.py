"""The given tables as collections of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_path() -> Column:
    return F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (path, sig, body): a unit's signature is its first line that isn't blank."""
    return table(spark, sf_dir, "documents").select(unit_path().alias("path"), T.first_line(F.col("text")).alias("sig"), F.col("text").alias("body"))
