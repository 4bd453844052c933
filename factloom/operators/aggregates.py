"""Counts, sums and averages of every table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import round_two
from factloom.keyed import KeyedTable


def count(t: KeyedTable) -> DataFrame:
    """(by, n): rows, empty ones included."""
    return t.df.groupBy(*t.by).agg(F.count(F.lit(1)).alias("n"))


def only(t: KeyedTable) -> DataFrame:
    """(by, holds): does the table have exactly one row?"""
    return t.df.groupBy(*t.by).agg((F.count(F.lit(1)) == 1).alias("holds"))


def col_sum(t: KeyedTable, col: str) -> DataFrame:
    """(by, total): sum without empty cells, 0 when all are empty, two decimals."""
    total = F.coalesce(F.sum(t.value(col).cast("double")), F.lit(0.0))
    return t.df.groupBy(*t.by).agg(round_two(total).alias("total"))


def col_avg(t: KeyedTable, col: str) -> DataFrame:
    """(by, mean): average without empty cells, two decimals; no row when all are empty."""
    means = t.df.groupBy(*t.by).agg(round_two(F.avg(t.value(col).cast("double"))).alias("mean"))
    return means.where(F.col("mean").isNotNull())
