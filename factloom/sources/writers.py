"""Writing corpora, predictions and scores; tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def write_corpus(rows: DataFrame, path: str) -> None:
    """One folder per split, so that a later read of some splits touches only their files."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """JSON lines with an ``out`` array."""
    preds.select("out").write.mode("overwrite").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def tidy_scores(scores: DataFrame) -> DataFrame:
    """(metric, score) from a one-row frame of scores."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("score")) for c in scores.columns]))
    return scores.select(pairs.alias("p")).select("p.metric", "p.score")


def write_scores(tidy: DataFrame, path: str) -> None:
    """``metric: value`` lines."""
    columns = [c for c in tidy.columns if c != "metric"]
    line = F.concat(F.col("metric"), F.lit(": "), F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    tidy.select(line.alias("value")).write.mode("overwrite").text(path)


# One cell with what ends it: quoted (quotes inside doubled) or plain.
_CELL = r'("(?:[^"]++|"")*+"|[^,\n]*+)(,|\n|\z)'


def read_table_csv(csv: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of strings from (table_id, part, csv), the header record of part 0 left out; rows are numbered from 1
    through all parts. Without ``part`` every text is a whole table.

    Records end at line breaks outside of quotes; an empty cell is the empty text, a missing one null."""
    given = csv if "part" in csv.columns else csv.withColumn("part", F.lit(0))
    found = F.arrays_zip(F.regexp_extract_all("csv", F.lit(_CELL), F.lit(1)).alias("cell"), F.regexp_extract_all("csv", F.lit(_CELL), F.lit(2)).alias("end"))
    # Behind the last cell the pattern matches once more, the empty text.
    size = F.size(F.filter(found, lambda x: x["end"] != "")) + 1
    cells = given.select("table_id", "part", F.posexplode(F.slice(found, F.lit(1), size)).alias("pos", "c"))
    order = W.partitionBy("table_id", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    broken = F.sum((F.col("c.end") == "\n").cast("int")).over(order)
    quoted = F.col("c.cell").startswith('"')
    text = F.when(quoted, F.replace(F.substring("c.cell", F.lit(2), F.length("c.cell") - 2), F.lit('""'), F.lit('"'))).otherwise(F.col("c.cell"))
    # A record has as many cells as the table has columns.
    records = cells.select("table_id", "part", F.coalesce(broken, F.lit(0)).alias("record"), "pos", text.alias("text")).groupBy("table_id", "part", "record").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("r"))
    body = records.where((F.col("part") > 0) | (F.col("record") > 0))
    sizes = body.groupBy("table_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("table_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("table_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    row = F.col("before") + F.col("record") + F.when(F.col("part") > 0, 1).otherwise(0)
    return body.join(offsets, ["table_id", "part"]).select("table_id", row.cast("int").alias("row_idx"), *[F.get("r", F.lit(i)).alias(c) for i, c in enumerate(columns)])
