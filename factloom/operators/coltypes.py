"""Type inference of text columns and parsing of their cells, for all tables of a corpus at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import parsing as P
from factloom.functions import text as X
from factloom.operators.corpus import TABLE_ROW, clean_cells
from factloom.plans.ranking import join_on
from factloom.session import stored

COLUMN = ["table_id", "col_idx"]
# Fixed value: the day that dates without a year or a day are completed from.
BASE_DATE = "2023-07-30"


def is_time(raw: Column) -> Column:
    return P.is_duration(raw) | raw.rlike(X.SECONDS_CELL)


def rank_columns(cells: DataFrame) -> DataFrame:
    """Columns whose whole numbers never fall and rise by at most one, row by row.

    That holds when the distinct numbers have no gap and every number's last row comes before the
    first row of the next number; rows need no ordering. A cell tells its number its row, and the number before that it
    is followed there, so both meet in one grouping. Cells of other kinds are not looked at here.
    """
    v, row, none = F.col("raw").try_cast("decimal(38,0)"), F.col("row_idx"), F.lit(None).cast(cells.schema["row_idx"].dataType)
    told = F.array(
        F.struct(v.alias("v"), row.alias("last"), none.alias("next_first")),
        F.struct((v - 1).cast("decimal(38,0)").alias("v"), none.alias("last"), row.alias("next_first")))
    numbers = (
        cells.where(F.col("raw").rlike(X.DIGITS_CELL)).select(*COLUMN, F.inline(told))
        # numbers too large to be told apart have no successor
        .where(F.col("v").isNotNull() | F.col("last").isNotNull())
        .groupBy(*COLUMN, "v").agg(F.max("last").alias("last"), F.min("next_first").alias("next_first"))
        .where(F.col("last").isNotNull())
    )
    # the largest number alone has no successor
    return (
        numbers.groupBy(*COLUMN)
        .agg(
            F.sum(F.col("next_first").isNull().cast("int")).alias("ends"),
            F.bool_and(F.coalesce(F.col("last") < F.col("next_first"), F.lit(True))).alias("ordered"),
        )
        .where((F.col("ends") == 1) & F.col("ordered"))
        .select(*COLUMN)
    )


def text_marks(texts: DataFrame, base: str = BASE_DATE) -> DataFrame:
    """What the patterns say of each (col_name, processed): marks of the types that a cell with it allows."""
    raw, header = F.col("processed"), F.col("col_name")
    digit, month, num = F.col("digit"), F.col("month"), F.col("num")
    # cheap marks first: they spare most texts the expensive patterns
    kept = texts.select("col_name", "processed", (~raw.rlike(X.NO_DIGITS)).alias("digit"), raw.rlike(X.MONTH_WORD).alias("month"))
    kept = kept.withColumn("num", digit & raw.rlike(X.NUMBER_CELL))
    maybe = ~num & (month | (digit & raw.rlike(P.NUMERIC_DATE)))
    dated = P.add_dates(kept, raw, "whole", "inside", base, maybe, month)
    looks = month | header.rlike(X.DATE_WORD) | raw.rlike(X.YEAR_INSIDE) | raw.rlike(X.SLASH_DATE)
    is_date = ~num & ((F.col("whole").isNotNull() & looks) | F.col("inside").isNotNull())
    return dated.select(
        "col_name", "processed", is_date.alias("date"), "num",
        (digit & raw.rlike(X.YEAR_INSIDE)).alias("year"), (digit & is_time(raw)).alias("time"),
        raw.contains(":").cast("int").alias("colon"), (num & raw.rlike(X.DIGITS_CELL)).alias("digits"), (~digit).alias("str"),
        F.when(digit, P.number_count(raw)).when(~digit, 0).alias("numbers"),
    )


def column_checks(cells: DataFrame, base: str = BASE_DATE) -> DataFrame:
    """Which types would all non-empty cells of a column allow? The checks of an empty cell are null, which the
    aggregates skip.

    Cells are summed up to the distinct texts of their column, which are written once; the patterns look once at each text
    under a header, however many tables have it.
    """
    texts = stored(cells.groupBy(*COLUMN, "col_name", "processed").agg(F.count(F.lit(1)).alias("n")), "types-texts")
    known = text_marks(texts.where("processed is not null").select("col_name", "processed").distinct(), base)
    # A hash stands for a text: texts would make up most of what is shuffled here.
    text = F.when(F.col("processed").isNotNull(), F.xxhash64("processed"))
    marked = join_on(texts, known, ["col_name", "processed"], "left_outer")
    return marked.groupBy(*COLUMN).agg(
        F.first("col_name").alias("col_name"),
        F.sum(F.when(F.col("processed").isNull(), 0).otherwise(F.col("n"))).alias("cells"),
        *[F.bool_and(c).alias(c) for c in ("date", "year", "num", "time", "digits", "str")],
        F.sum(F.col("colon") * F.col("n")).alias("colons"),
        F.min("numbers").alias("least"), F.max("numbers").alias("most"),
        (F.min(text) == F.max(text)).alias("all_equal"),
    )


def infer_types(cells: DataFrame, base: str = BASE_DATE) -> DataFrame:
    """(table_id, col_idx, col_name, coltype) of cleaned cells: the first type that all non-empty
    cells allow, from the strictest; ``mixed`` when none does, ``empty`` without such cells.

    Checks and ranks, one row a column, are written once, so that the shuffles of a step are gone when the next begins."""
    checks = stored(column_checks(cells, base), "types-checks")
    may_rank = F.col("digits") & ~F.col("all_equal")
    titled = F.col("col_name").startswith("rank")
    ordered = stored(rank_columns(cells.where(F.col("processed").isNotNull())), "types-ranks").withColumn("ordered", F.lit(True))
    same_n = (F.col("least") == F.col("most")) & (F.col("least") > 0)
    coltype = (
        F.when(F.col("cells") == 0, "empty")
        .when(F.col("date"), "date")
        .when(same_n & F.col("year"), "year")
        .when(may_rank & (titled | F.coalesce("ordered", F.lit(False))), "rank")
        .when(F.col("num"), "num")
        .when(F.col("time") & (F.col("colons") > F.floor(F.col("cells") / 2)), "time")
        .when(same_n, "same_n_nums")
        .when(F.col("str"), "str")
        .otherwise("mixed")
    )
    return checks.join(ordered, COLUMN, "left_outer").select(*COLUMN, "col_name", coltype.alias("coltype"))


def parse_cells(cells: DataFrame, coltypes: DataFrame, base: str = BASE_DATE) -> DataFrame:
    """Cells with ``coltype`` and the value their type gives them: ``num`` (num, rank and seconds of
    time), ``nums`` (year, same_n_nums), ``ts`` (date). ``is_float`` tells a number written with a
    point."""
    value = F.col("processed")
    kind = F.col("coltype")
    typed = cells.join(coltypes.select(*COLUMN, "coltype"), COLUMN)
    dated = P.parse_dates(typed, F.when(kind == "date", value), "ts", base)
    return dated.select(
        *cells.columns,
        "coltype",
        F.when(kind.isin("num", "rank"), P.parse_number(value)).when(kind == "time", P.parse_seconds(value)).alias("num"),
        F.when(kind.isin("num", "rank", "time"), value.contains(".")).alias("is_float"),
        F.when(kind.isin("year", "same_n_nums"), P.parse_numbers(value)).alias("nums"),
        "ts",
    )


def parse_tables(cells: DataFrame, base: str = BASE_DATE) -> DataFrame:
    """Clean, infer and parse: raw cells to typed cells. The clean cells, read three times, are written once."""
    clean = stored(clean_cells(cells), "types-cells")
    return parse_cells(clean, infer_types(clean, base), base)


def first_cells(cells: DataFrame, *kept: Column | str) -> DataFrame:
    """(table_id, col_idx, kept) of the cells in the first remaining row of every table.

    Columns are summed up to their first cells before those meet the first rows: cells are not shuffled by row."""
    first = cells.groupBy(*COLUMN).agg(F.min(F.struct("row_idx", *kept)).alias("c")).select(*COLUMN, "c.*")
    rows = first.groupBy("table_id").agg(F.min("row_idx").alias("row_idx"))
    return first.join(rows.hint("merge"), TABLE_ROW, "left_semi").drop("row_idx")


def revise_types(typed: DataFrame) -> DataFrame:
    """(table_id, col_idx, coltype) for queries: a column whose first row holds exactly one number is
    a number (a year stays a year); an empty first cell blocks the change. ``revised`` marks it."""
    single = (F.col("numbers") == 1) & F.col("coltype").isin("same_n_nums", "year")
    return first_cells(typed, "col_name", "coltype", F.size("nums").alias("numbers")).select(
        *COLUMN,
        "col_name",
        F.when(single & (F.col("coltype") == "same_n_nums"), "num").otherwise(F.col("coltype")).alias("coltype"),
        F.coalesce(single, F.lit(False)).alias("revised"),
    )


def query_cells(typed: DataFrame) -> DataFrame:
    """Cells as statements see them: (table_id, row_idx, col_idx, col_name, coltype, raw, num, ts, str).

    A year and a revised column take the first number of a cell, other multi-number columns their raw
    text."""
    types = revise_types(typed).select(*COLUMN, F.col("coltype").alias("qtype"))
    kind = F.col("qtype")
    joined = typed.join(types, COLUMN)
    return joined.select(
        "table_id", "row_idx", "col_idx", "col_name", kind.alias("coltype"), "raw",
        F.when(kind.isin("num", "year"), F.coalesce("num", F.try_element_at("nums", F.lit(1)))).otherwise(F.col("num")).alias("num"),
        "ts",
        F.when(kind == "same_n_nums", F.when(F.col("processed").isNotNull(), F.col("raw")))
        .when(kind.isin("str", "mixed"), F.col("processed")).alias("str"),
    )
