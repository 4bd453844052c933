"""Tables and statements as text, and the records made of them.

A table becomes parts of ``rows_per_part`` rows, so that no task ever holds an unbounded table; a
table of fewer rows is one part with its whole text. The parts of a table follow each other by
``part`` and are joined with the style's separator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.corpus import TABLE_ROW
from factloom.plans.ranking import running

ROWS_PER_PART = 10_000
# Markers of the marker style.
MARKERS = {"title": "<T>", "row": "<R>", "cell": "<C>", "header": "<H>"}


def _row_texts(cells: DataFrame, cell: Column, separator: str, highlighted_only: bool) -> DataFrame:
    kept = F.col("highlighted") if highlighted_only else F.lit(True)
    rows = cells.groupBy(*TABLE_ROW).agg(
        F.array_sort(F.collect_list(F.when(kept, F.struct("col_idx", cell.alias("t"))))).alias("cs"))
    return rows.select(*TABLE_ROW, F.transform("cs", lambda c: c["t"]).alias("cs"), F.lit(separator).alias("sep"))


def _tables(rows: DataFrame, row: Column, titles: DataFrame, head: Column, separator: str, rows_per_part: int) -> DataFrame:
    part = F.floor((F.col("row_idx") - 1) / rows_per_part).cast("int")
    parts = (
        rows.select("table_id", part.alias("part"), "row_idx", row.alias("t"))
        .groupBy("table_id", "part")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "t"))), lambda r: r["t"]), separator).alias("body"))
    )
    text = F.when(F.col("part") == 0, F.concat(head, F.lit(separator), "body")).otherwise(F.col("body"))
    return parts.join(titles.select("table_id", "title"), "table_id").select("table_id", "part", text.alias("input"))


def linearise(
    cells: DataFrame, titles: DataFrame, style: str = "nl", highlighted_only: bool = False, rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """(table_id, part, input) in style ``nl`` (Row, h: v), ``nl_idxs`` (Row: i, h: v) or ``markers``.

    Parts are numbered from 0 in row order; title and header stand in part 0. All joined with the separator (``. ``,
    a space for ``markers``) are the text of the table."""
    name, raw, number = F.col("col_name"), F.col("raw"), F.col("row_idx").cast("string")
    if style == "markers":
        cell = F.concat(F.lit(f"{MARKERS['header']} "), name, F.lit(f" {MARKERS['cell']} "), raw)
        rows = _row_texts(cells, cell, " ", highlighted_only)
        start = F.concat(F.lit(f"{MARKERS['row']} "), number)
        head = F.concat(F.lit(f"{MARKERS['title']} "), "title")
        return _tables(rows, F.array_join(F.concat(F.array(start), "cs"), " "), titles, head, " ", rows_per_part)
    if style not in ("nl", "nl_idxs"):
        raise ValueError(f"unknown style {style}: use nl, nl_idxs or markers")
    rows = _row_texts(cells, F.concat(name, F.lit(": "), raw), ", ", highlighted_only)
    start = F.concat(F.lit("Row: "), number) if style == "nl_idxs" else F.lit("Row")
    head = F.concat(F.lit("Title: "), "title")
    return _tables(rows, F.array_join(F.concat(F.array(start), "cs"), ", "), titles, head, ". ", rows_per_part)


def table_csv(cells: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(table_id, part, csv): header line and rows as CSV text; quotes where a value needs them.

    Parts are numbered from 0 in row order; the header line stands in part 0. Joined by line breaks they are the file."""
    quoted = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    rows = cells.groupBy(*TABLE_ROW).agg(
        F.array_sort(F.collect_list(F.struct("col_idx", quoted(F.col("raw")).alias("t"), quoted(F.col("col_name")).alias("h")))).alias("cs"))
    line = lambda f: F.array_join(F.transform("cs", lambda c: c[f]), ",")
    part = F.floor((F.col("row_idx") - 1) / rows_per_part).cast("int").alias("part")
    parts = rows.select("table_id", part, "row_idx", line("t").alias("t"), line("h").alias("h")).groupBy("table_id", "part").agg(
        F.max("h").alias("h"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "t"))), lambda r: r["t"]), "\n").alias("body"))
    return parts.select(
        "table_id", "part", F.when(F.col("part") == 0, F.concat("h", F.lit("\n"), "body")).otherwise(F.col("body")).alias("csv"))


def headers(cells: DataFrame) -> DataFrame:
    """(table_id, header): lower-case column names in order."""
    columns = cells.select("table_id", "col_idx", F.lower(F.trim("col_name")).alias("h")).distinct()
    return columns.groupBy("table_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "h"))), lambda x: x["h"]).alias("header"))


def statement_input(title: Column, header: Column, lf: Column) -> Column:
    """Input text of a statement; a trailing `` = true`` is dropped."""
    return F.concat(
        F.lit("Title: "), title, F.lit(". Header: "), F.array_join(header, " | "),
        F.lit(". Logical form: "), F.regexp_replace(lf, r" = true\z", ""))


def statement_records(tables: DataFrame, forms: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Records of the statement-to-text step. tables (table_id, split, title, header), forms (table_id,
    pos, lf) and, for training, references (table_id, pos, ref): the i-th form goes with the i-th."""
    rows = forms.join(tables, "table_id")
    made = rows.select(
        "table_id", "split", "pos", statement_input(F.col("title"), F.col("header"), F.col("lf")).alias("input"), "lf")
    if references is None:
        return made
    return made.join(references.select("table_id", "pos", F.col("ref").alias("output")), ["table_id", "pos"])


def whole_texts(parts: DataFrame, column: str, separator: str) -> DataFrame:
    """(table_id, ``column``): the parts of each table in order, joined to its whole text in one row."""
    return parts.groupBy("table_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", column))), lambda x: x[column]), separator).alias(column))


def whole_digests(parts: DataFrame, column: str, separator: str) -> DataFrame:
    """(table_id, ``column``): MD5, as hexadecimal text, of each table's whole text (``whole_texts``).

    The parts of a table are read in order, one behind the other, so a table of any size takes the room of a batch."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, digest, started = None, None, False
        row = lambda: pa.RecordBatch.from_arrays([pa.array([table], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["table_id", column])
        for batch in batches:
            for name, text in zip(batch["table_id"], batch[column]):
                name = name.as_py()
                if digest is None or name != table:
                    if digest is not None:
                        yield row()
                    table, digest, started = name, hashlib.md5(), False
                if text.is_valid:
                    digest.update(separator.encode() if started else b"")
                    digest.update(text.as_buffer())
                    started = True
        if digest is not None:
            yield row()

    ordered = parts.select("table_id", "part", column).repartition("table_id").sortWithinPartitions("table_id", "part")
    return ordered.select("table_id", column).mapInArrow(digests, f"table_id string, {column} string")


def baseline_records(rows: DataFrame, texts: DataFrame, csv: DataFrame) -> DataFrame:
    """(table_id, output, parts): one row for each of the rows (table_id, ref) whose table has a text, whatever its
    size. Input and CSV of a record are the ``parts`` parts of ``texts`` and ``csv`` with its table_id, in order."""
    sizes = texts.join(csv.select("table_id", "part"), ["table_id", "part"]).groupBy("table_id").agg(F.count(F.lit(1)).alias("parts"))
    return rows.select("table_id", F.col("ref").alias("output")).join(sizes, "table_id")


def selection_records(features: DataFrame, templates: DataFrame | None, mode: str, header: DataFrame | None = None) -> DataFrame:
    """Records of content selection: ``train`` one per template (table_id, output, source), ``eval`` all templates
    (table_id, pos, output) of a table in order, ``predict`` the input alone.

    An ``eval`` record has a ``part`` number and ``outputs``, ``ROWS_PER_PART`` of them at most: tables of more templates
    have several records, in order from part 0."""
    if mode == "train":
        return features.join(templates.select("table_id", "output", "source"), "table_id")
    if mode == "eval":
        placed = running(templates.select("table_id", "pos", "output"), ["table_id"], ["pos"], sums={"k": F.lit(1).cast("long")}, totals={})
        part = F.floor((F.col("k") - 1) / ROWS_PER_PART).cast("int").alias("part")
        outputs = placed.groupBy("table_id", part).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "output"))), lambda x: x["output"]).alias("outputs"))
        found = features.join(outputs, "table_id")
        return found if header is None else found.join(header, "table_id")
    return features.select("input", "table_id")


def token_health(df: DataFrame, inputs: str, outputs: str, unknown: int, max_length: int = 512) -> DataFrame:
    """One row: share of inputs and outputs cut at ``max_length`` and share of unknown tokens, of
    columns with arrays of token ids."""
    cut = lambda c: F.avg((F.size(c) == max_length).cast("int"))
    unknowns = lambda c: F.sum(F.size(F.filter(c, lambda t: t == unknown))) / F.sum(F.size(c))
    return df.agg(
        F.bround(cut(inputs), 4).alias("truncated_inputs"), F.bround(cut(outputs), 4).alias("truncated_outputs"),
        F.bround(unknowns(inputs), 4).alias("unknown_inputs"), F.bround(unknowns(outputs), 4).alias("unknown_outputs"))
