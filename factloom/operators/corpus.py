"""Preparing a corpus of tables: cells, cleaning, dedupe, leak removal, references.

A corpus is a long relation of cells (table_id, row_idx, col_idx, col_name, raw): every value is text,
``row_idx`` starts at 1 and the header is ``col_name``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import EMPTY_CELL, TOTAL_ROW
from factloom.plans.ranking import join_on, running

TABLE_ROW = ["table_id", "row_idx"]


def table_id(url: Column, given: Column | None = None) -> Column:
    """The given id, else the last segment of the url."""
    last = F.substring_index(url, "/", -1)
    return last if given is None else F.coalesce(F.when(given != "", given), last)


def wide_to_cells(df: DataFrame, table: Column, order: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Cells of a wide DataFrame: one row of it is one row of its table, in the given order."""
    narrow = df.select(table.alias("table_id"), *[F.col(o).alias(f"__{o}") for o in order], *[c.alias(n) for n, c in columns.items()])
    numbered = running(
        narrow, ["table_id"], [f"__{o}" for o in order],
        sums={"row_idx": F.lit(1)}, totals={},
    )
    cells = F.array(*[
        F.struct(F.lit(i).alias("col_idx"), F.lit(n).alias("col_name"), F.col(n).alias("raw"))
        for i, n in enumerate(columns)
    ])
    exploded = numbered.select("table_id", F.col("row_idx").cast("int").alias("row_idx"), F.explode(cells).alias("c"))
    return exploded.select("table_id", "row_idx", "c.col_idx", "c.col_name", "c.raw")


def cells_to_wide(cells: DataFrame, columns: Sequence[str], value: str = "raw") -> DataFrame:
    """One row per table row; ``columns`` are the headers to keep. Equal headers: the first column wins."""
    picked = [
        F.min(F.when(F.col("col_name") == c, F.struct("col_idx", value)))[value].alias(c) for c in columns
    ]
    return cells.where(F.col("col_name").isin(*columns)).groupBy(*TABLE_ROW).agg(*picked)


def processed(raw: Column) -> Column:
    """Null for an empty cell (nothing, a dash, n/a), else its text."""
    return F.when(~raw.rlike(EMPTY_CELL), raw)


def null_empty_cells(cells: DataFrame) -> DataFrame:
    """Adds ``processed``; ``raw`` is kept."""
    return cells.withColumn("processed", processed(F.col("raw")))


def header_rows(cells: DataFrame) -> DataFrame:
    """(table_id, row_idx) of rows that repeat the header: only rows whose first cell does are read
    again in full."""
    same = F.col("raw") == F.lower(F.trim("col_name"))
    suspects = cells.where((F.col("col_idx") == 0) & same).select(*TABLE_ROW)
    return (
        cells.join(suspects, TABLE_ROW, "left_semi")
        .groupBy(*TABLE_ROW).agg(F.bool_and(same).alias("all_same"))
        .where("all_same").select(*TABLE_ROW)
    )


def drop_header_rows(cells: DataFrame) -> DataFrame:
    return cells.join(header_rows(cells), TABLE_ROW, "left_anti")


def total_rows(cells: DataFrame) -> DataFrame:
    """(table_id, row_idx) of last rows whose first cell announces a total."""
    first = F.col("raw")
    totals = (F.col("col_idx") == 0) & processed(first).isNotNull() & F.lower(first).rlike(TOTAL_ROW)
    announced = cells.where(totals).select(*TABLE_ROW)
    last = cells.groupBy("table_id").agg(F.max("row_idx").alias("row_idx"))
    return announced.join(last, TABLE_ROW, "left_semi")


def drop_total_rows(cells: DataFrame) -> DataFrame:
    return cells.join(total_rows(cells), TABLE_ROW, "left_anti")


def clean_cells(cells: DataFrame) -> DataFrame:
    """Empty cells to null, rows that repeat the header and a trailing total row dropped. Whether a row
    is the last is decided before any row is dropped.

    Cells meet once, by row: a row says whether it repeats the header or announces a total, and carries its cells on.
    The last rows of tables are found from the same rows and told apart by the key they are already dealt by.
    """
    same, first = F.col("raw") == F.lower(F.trim("col_name")), F.col("col_idx") == 0
    total = F.coalesce(processed(F.col("raw")).isNotNull() & F.lower("raw").rlike(TOTAL_ROW), F.lit(False))
    others = [c for c in cells.columns if c not in TABLE_ROW]
    rows = cells.groupBy(*TABLE_ROW).agg(
        F.collect_list(F.struct(*others)).alias("__cells"),
        F.coalesce(F.bool_and(same) & F.max(first & same), F.lit(False)).alias("__header"),
        F.coalesce(F.max(first & total), F.lit(False)).alias("__total"))
    # All columns are named here, so that both uses of the rows share one shuffle.
    named = F.struct("row_idx", "__total", "__header", (F.size("__cells") > 0).alias("some"))
    ends = rows.groupBy("table_id").agg(F.max(named).alias("l")).where("l.__total").select("table_id", F.col("l.row_idx").alias("row_idx"), F.lit(True).alias("__total"))
    kept = rows.where(~F.col("__header")).join(ends, [*TABLE_ROW, "__total"], "left_anti")
    return null_empty_cells(kept.select(*TABLE_ROW, F.inline("__cells")).select(*cells.columns))


def remove_leaks(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Drop train rows whose table is in the dev or test split of the other corpus.

    Both have ``table_id`` and ``split``. An id listed in several splits there counts by the last one
    in the order train, dev, test.
    """
    rank = F.when(F.col("split") == "test", 3).when(F.col("split") == "dev", 2).otherwise(1)
    held_out = other.groupBy("table_id").agg(F.max(rank).alias("r")).where(F.col("r") > 1).select("table_id")
    train = rows.where(F.col("split") == "train").join(held_out, "table_id", "left_anti")
    return rows.where(~F.col("split").eqNullSafe(F.lit("train"))).unionByName(train)


def restrict_splits(rows: DataFrame, splits: Sequence[str] | None) -> DataFrame:
    return rows if splits is None else rows.where(F.col("split").isin(*splits))


def first_occurrence(rows: DataFrame, seq: str, keep: Sequence[str]) -> DataFrame:
    """One row per table: ``keep`` of its first row by ``seq``."""
    first = F.min_by(F.struct(*keep), F.col(seq))
    return rows.groupBy("table_id").agg(first.alias("f")).select("table_id", "f.*")


def table_items(rows: DataFrame, seq: str, item: str) -> DataFrame:
    """(table_id, pos, item): all items of a table in order, numbered from 1 (references, forms)."""
    numbered = running(
        rows.select("table_id", F.col(seq).alias("__seq"), F.col(item).alias("item")),
        ["table_id"], ["__seq"], sums={"pos": F.lit(1)}, totals={},
    )
    return numbered.select("table_id", F.col("pos").cast("int").alias("pos"), "item")


def collect_items(rows: DataFrame, seq: str, item: str) -> DataFrame:
    """(table_id, items): the items of a table as one ordered array, for tables of web size."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(item))))
    return rows.groupBy("table_id").agg(F.transform(pairs, lambda p: p[item]).alias("items"))


def replace_references(refs: DataFrame, statements: DataFrame) -> DataFrame:
    """The k-th reference of a table becomes its k-th entailed statement.

    refs (table_id, pos, ...), statements (table_id, pos, sentence, label): positions order the rows
    across all splits. A reference without a counterpart keeps its row with an empty ``ref``.
    """
    def kth(df: DataFrame) -> DataFrame:
        return running(df, ["table_id"], ["pos"], sums={"k": F.lit(1)}, totals={})

    entailed = kth(statements.where(F.col("label") == 1).select("table_id", "pos", "sentence"))
    return join_on(kth(refs), entailed.select("table_id", "k", F.col("sentence").alias("ref")), ["table_id", "k"], "left_outer").drop("k")


def unique_predictions(preds: DataFrame) -> DataFrame:
    """(table_id, text, pos): first position of every distinct prediction of a table."""
    return preds.groupBy("table_id", "text").agg(F.min("pos").alias("pos"))


def distinct_sorted(rows: DataFrame, item: str) -> DataFrame:
    """(table_id, pos, item): the distinct items of a table in ascending order."""
    distinct = rows.select("table_id", F.col(item).alias("item")).distinct()
    return running(distinct, ["table_id"], ["item"], sums={"pos": F.lit(1)}, totals={}).select(
        "table_id", F.col("pos").cast("int").alias("pos"), "item")


def tagged_union(main: DataFrame, generated: DataFrame) -> DataFrame:
    """Both sources of forms with a ``source`` tag; a table with neither has no row."""
    return main.withColumn("source", F.lit("main")).unionByName(generated.withColumn("source", F.lit("generated")))


def attach_tables(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Look the table of every row up by its id."""
    return rows.join(tables, "table_id")


def flatten_groups(nested: DataFrame, col: str) -> DataFrame:
    """(table_id, grp, pos, item) of an array of arrays; the position travels with the item."""
    outer = nested.select("table_id", F.posexplode(col).alias("grp", "members"))
    return outer.select("table_id", "grp", F.posexplode("members").alias("pos", "item"))


def regroup(flat: DataFrame) -> DataFrame:
    """Back from (table_id, grp, pos, item) to (table_id, groups), an array of arrays."""
    members = F.array_sort(F.collect_list(F.struct("pos", "item")))
    groups = flat.groupBy("table_id", "grp").agg(F.transform(members, lambda m: m["item"]).alias("members"))
    ordered = F.array_sort(F.collect_list(F.struct("grp", "members")))
    return groups.groupBy("table_id").agg(F.transform(ordered, lambda g: g["members"]).alias("groups"))


def fill_missing(tables: DataFrame, preds: DataFrame) -> DataFrame:
    """Every table has at least one prediction: the empty text when it had none."""
    return (
        tables.select("table_id").join(preds.select("table_id", "text"), "table_id", "left_outer")
        .select("table_id", F.coalesce("text", F.lit("")).alias("text"))
    )


def fix_spacing(text: Column) -> Column:
    """A space before every brace, no double spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"([{}])", " $1"), " +", " ")
