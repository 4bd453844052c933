"""Row selectors with a hole: for which literals does the selector pick rows?

Every operator returns (by, filled, val_count). ``rows`` is the constraint the enclosing statement
puts on the selection: ``many`` (more than one row, the rule below count, aggregates and majority
claims), ``one`` (exactly one, the rule below ``only`` and ``hop``) or ``any``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import number_text
from factloom.keyed import KeyedTable
from factloom.operators import ngrams
from factloom.operators.values import lower_bounds, upper_bounds, value_counts, value_profile
from factloom.plans.ranking import join_on


def rows_condition(rows: str, count: Column) -> Column:
    """Number of selected rows allowed by the enclosing statement."""
    return {"many": count > 1, "one": count == 1, "any": F.lit(True)}[rows]


def _options(df: DataFrame, t: KeyedTable, filled: Column, count: Column, rows: str) -> DataFrame:
    chosen = df.select(*t.by, filled.alias("filled"), count.cast("bigint").alias("val_count"))
    return chosen.where(rows_condition(rows, F.col("val_count")))


def filter_all(t: KeyedTable, col: str | None = None) -> DataFrame:
    """The table itself."""
    return t.df


def filter_eq(t: KeyedTable, col: str, rows: str = "many") -> DataFrame:
    """Rows equal to a value; for text, rows that contain it as a run of whole tokens. Frequent
    n-grams of the column are candidates too. Values with several original texts are skipped."""
    counts = value_counts(t, col).where("one_raw")
    if not t.is_string(col) and not t.has_raw(col):
        return _options(counts, t, F.col("raw"), F.col("cnt"), rows)

    empties = counts.where(F.col("v").isNull()).select(*t.by, F.col("raw").alias("filled"), F.col("cnt").alias("val_count"))
    grams = ngrams.frequent_ngrams(t, col).select(
        *t.by, F.col("gram").alias("filled"), F.col("n_rows").alias("val_count")
    )
    present = counts.where(F.col("v").isNotNull())
    if t.is_string(col):
        values = ngrams.containment_counts(t, col, present.select(*t.by, F.col("v").alias("candidate"))).select(
            *t.by, F.col("candidate").alias("filled"), F.col("n_rows").alias("val_count")
        )
    else:
        values = present.select(*t.by, F.col("raw").alias("filled"), F.col("cnt").alias("val_count"))
    both = values.unionByName(grams).unionByName(empties).distinct()
    return _options(both, t, F.col("filled"), F.col("val_count"), rows)


def filter_not_eq(t: KeyedTable, col: str, rows: str = "many") -> DataFrame:
    """Rows different from a value; empty cells count as different. Exact comparison, also for text."""
    counts = value_counts(t, col)
    totals = counts.groupBy(*t.by).agg(F.sum("cnt").alias("n_rows"))
    joined = join_on(counts.where("one_raw"), totals, t.by)
    return _options(joined, t, F.col("raw"), F.col("n_rows") - F.col("cnt"), rows)


def filter_greater_eq(t: KeyedTable, col: str, rows: str = "many") -> DataFrame:
    """Rows >= a value of the column other than its maximum."""
    profile = value_profile(t, col).where(F.col("upto") < F.col("n"))
    return _options(profile, t, F.col("raw"), F.col("n") - F.col("below"), rows)


def filter_less_eq(t: KeyedTable, col: str, rows: str = "many") -> DataFrame:
    """Rows <= a value of the column other than its minimum."""
    profile = value_profile(t, col).where(F.col("below") > 0)
    return _options(profile, t, F.col("raw"), F.col("upto"), rows)


def filter_greater(t: KeyedTable, col: str, rows: str = "many") -> DataFrame:
    """Rows above a round bound; bounds that select all non-empty cells are left out."""
    bounds = lower_bounds(t, col).where(F.col("beyond") < F.col("n"))
    return _options(bounds, t, number_text(F.col("bound")), F.col("beyond"), rows)


def filter_less(t: KeyedTable, col: str, rows: str = "many") -> DataFrame:
    """Rows below a round bound; bounds that select all non-empty cells are left out."""
    bounds = upper_bounds(t, col).where(F.col("beyond") < F.col("n"))
    return _options(bounds, t, number_text(F.col("bound")), F.col("beyond"), rows)
