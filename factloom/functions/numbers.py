"""Number helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_two(x: Column) -> Column:
    """Two decimals, ties to even on the scaled double."""
    return F.rint(x * 100) / 100


def number_text(x: Column) -> Column:
    """Integral values without a decimal point, others as plain (never exponent) decimals."""
    x = x.cast("double")
    integral = (x == F.rint(x)) & (F.abs(x) < F.lit(9.0e18))
    plain = F.regexp_replace(x.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return (
        F.when(integral, x.cast("bigint").cast("string"))
        .when((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7), x.cast("string"))
        .otherwise(F.coalesce(plain, x.cast("string")))
    )


def float_text(x: Column, keep_point: Column) -> Column:
    """As ``number_text``; a float keeps ``.0`` when it is integral."""
    text = number_text(x)
    return F.when(keep_point & ~text.contains("."), F.concat(text, F.lit(".0"))).otherwise(text)


def value_text(x: Column, dtype: T.DataType) -> Column:
    """Text of a typed value; an empty cell has an empty text."""
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        text = number_text(x)
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit(""))


def digit_order(x: Column) -> Column:
    """Digits of the rounded number, minus one."""
    whole = F.abs(F.rint(x.cast("double"))).try_cast("decimal(38,0)").cast("string")
    return (F.length(whole) - 1).cast("int")


def step_of(order: Column, largest: Column) -> Column:
    """Rounding step of a range whose usual numbers have ``order`` + 1 digits, ``largest`` being the
    largest of those."""
    scale = F.pow(F.lit(10.0), order)
    first_digit = F.floor(F.rint(largest) / scale)
    return (
        F.when(order == 0, F.lit(1.0))
        .when(first_digit <= 5, scale / 10 * 5)
        .otherwise(scale)
    )


def floor_to(x: Column, step: Column) -> Column:
    """Multiple of ``step`` below ``x``; zero is its own floor."""
    down = step * F.floor(x / step)
    return F.when((x != 0) & (down == x), down - step).otherwise(down)


def ceil_to(x: Column, step: Column) -> Column:
    """Multiple of ``step`` above ``x``, never ``x`` itself."""
    up = step * F.ceil(x / step)
    return F.when(up == x, up + step).otherwise(up)
