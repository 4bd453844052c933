"""A DataFrame seen as many tables: one table per distinct value of the ``by`` columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.numbers import value_text

class KeyedTable:
    """Typed rows split into tables.

    ``by``     columns that identify a table; empty for one big table.
    ``order``  columns that give the row order inside a table (used for first-row ties).
    ``raw``    value column -> column with its original text; without an entry the text is derived
               from the value.
    ``weight`` column with the number of rows that a row stands for; one each without it.
    """

    def __init__(
        self,
        df: DataFrame,
        by: Sequence[str] = (),
        order: Sequence[str] = (),
        raw: Mapping[str, str] | None = None,
        weight: str | None = None,
    ):
        self.df = df
        self.by = list(by)
        self.order = list(order)
        self.raw = dict(raw or {})
        self.weight = weight

    def dtype(self, col: str) -> T.DataType:
        return self.df.schema[col].dataType

    def is_string(self, col: str) -> bool:
        return isinstance(self.dtype(col), T.StringType)

    def is_number(self, col: str) -> bool:
        return isinstance(self.dtype(col), T.NumericType)

    def has_raw(self, col: str) -> bool:
        return col in self.raw

    def weighed(self) -> Column:
        """How many rows a row stands for."""
        return (F.lit(1) if self.weight is None else F.col(self.weight)).cast("long").alias("__rows")

    def value(self, col: str) -> Column:
        """The value column; NaN is an empty cell."""
        if isinstance(self.dtype(col), (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(F.col(col)), F.col(col))
        return F.col(col)

    def text(self, col: str) -> Column:
        """Original text of a cell of ``col``."""
        if self.has_raw(col):
            return F.col(self.raw[col])
        return value_text(self.value(col), self.dtype(col))

    def text_of_value(self, col: str, value: Column) -> Column:
        return value_text(value, self.dtype(col))
