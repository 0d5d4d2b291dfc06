"""Differences of tables: by sets, null-safe, and by bags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_diff(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(side, *columns): distinct rows of one table that the other lacks, nulls
    equal to nulls. One shuffle of each side: rows are grouped with the sides
    they occur on."""
    both = left.select(*columns, F.lit("left").alias("side")).unionByName(right.select(*columns, F.lit("right").alias("side")))
    sides = both.groupBy(*columns).agg(F.min("side").alias("a"), F.max("side").alias("b"))
    return sides.where("a = b").select(F.col("a").alias("side"), *columns)


def bag_diff(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(*columns, surplus): how many more copies left has than right; rows that
    both hold equally often are left out."""
    both = left.select(*columns, F.lit(1).alias("n")).unionByName(right.select(*columns, F.lit(-1).alias("n")))
    return both.groupBy(*columns).agg(F.sum("n").alias("surplus")).where("surplus <> 0")
