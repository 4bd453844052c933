"""Reading corpora, statements, generated forms and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.corpus import restrict_splits, table_id
from factloom.plans.ranking import cumulated, join_on, running
from factloom.session import stored


def read_corpus(spark: SparkSession, path: str, splits: Sequence[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Rows of a corpus; with ``splits`` only those partitions (or rows) are read."""
    return restrict_splits(spark.read.format(fmt).load(path), splits)


def read_lines(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """(file, line, value): lines of text files with a key that sorts them inside their file.

    Files are split between tasks; the start of a split and the row number inside it give the order. With ``end`` a
    line ends at that text and not at a line break.
    """
    return spark.read.text(path, **({"lineSep": end} if end else {})).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
        ).alias("line"),
        "value",
    )


# Pieces in a stretch of a file: 2 to this power.
_STRETCH = 17


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, key, value) of files with one JSON object each: its entries in order from 1, values as JSON text.

    An object of any size is read by many tasks: the file is split at quotes. A quote counts unless an odd number of
    backslashes is before it; how many counted before a piece says whether it is inside a string; brackets outside
    of strings add up to the depth; a string at depth one begins an entry. All three are running totals per file, each
    written once to the shared folder. The pieces of one entry meet, not those of the object. Values at depth one are
    arrays or objects: a file that is no such object fails the read.
    """
    one = F.lit(1).cast("long")
    pieces = read_lines(spark, path, '"')
    # Pieces of a split are numbered one after the other, so their numbers tell stretches of the file.
    stretch = F.struct("line.block", F.shiftright("line.id", _STRETCH).alias("at"))
    counted = pieces.select("*", F.when((F.length("value") - F.length(F.rtrim("value", F.lit("\\")))) % 2 == 0, one).otherwise(0).alias("real"))
    told = stored(cumulated(counted, ["file"], ["line"], {"quotes": ("sum", "before", F.col("real"))}, part=stretch), "entries-quotes")
    inside = F.coalesce(F.col("quotes") % 2 == 1, F.lit(False))
    size = lambda chars: F.length("value") - F.length(F.translate("value", chars, ""))
    levelled = told.select("file", "line", "value", "real", inside.alias("inside"), F.when(inside, F.lit(0)).otherwise(size("[{") - size("]}")).cast("long").alias("net"))
    deep = stored(cumulated(levelled, ["file"], ["line"], {"depth": ("sum", "upto", F.col("net")), "left": ("sum", "all", F.col("net"))}, part=stretch), "entries-depth")
    # A quote that counts, outside of strings and at depth one, begins the string behind it.
    begins = F.when((F.col("real") == 1) & ~F.col("inside") & (F.col("depth") == 1), one).otherwise(0)
    numbered = cumulated(deep.select("file", "line", "value", "left", begins.alias("begins")), ["file"], ["line"], {"no": ("sum", "before", F.col("begins"))}, part=stretch)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), '"')
    whole = numbered.groupBy("file", F.coalesce("no", F.lit(0)).alias("entry")).agg(text.alias("text"), F.first("left").alias("left"))
    # Ends: of a string key, of the value before the comma, and of the object after the last one.
    shape = r"(?s)^((?:[^\"\\]|\\.)*)\"\s*:\s*([\[{].*[\]}])\s*[,}]\s*$"
    opened = F.when(F.col("entry") == 0, F.col("text").rlike(r"^\s*\{\s*\}?\s*$")).otherwise(F.col("text").rlike(shape))
    # What is no entry is looked at too, so both go in one condition.
    checked = whole.where(F.when(opened & (F.col("left") == 0), F.col("entry") > 0).otherwise(F.raise_error(F.concat(F.lit("not one JSON object of lists: "), "file")).cast("boolean")))
    key = F.from_json(F.concat(F.lit('["'), F.regexp_extract("text", shape, 1), F.lit('"]')), "array<string>", {"mode": "FAILFAST"})
    # The brace that ends the object is behind its last value.
    return checked.select("file", "entry", F.get(key, F.lit(0)).alias("key"), F.regexp_extract("text", shape, 2).alias("value"))


def read_labelled_statements(spark: SparkSession, path: str) -> DataFrame:
    """(table_id, pos, sentence, label) from JSON ``{table_id: [[sentences], [labels], ...]}``.

    ``path`` holds one such object per file, of any size (``read_entries``). Only the first two elements of an entry are
    lists to read; what follows (a caption) may be anything. A file that is no such object fails the read."""
    strict = {"mode": "FAILFAST"}
    entries = read_entries(spark, path).select(F.col("key").alias("table_id"), F.from_json("value", "array<string>", strict).alias("parts"))
    part = lambda i: F.from_json(F.get("parts", F.lit(i)), "array<string>", strict)
    zipped = F.arrays_zip(part(0).alias("sentence"), part(1).alias("label"))
    each = entries.select("table_id", F.posexplode(zipped).alias("pos", "s"))
    return each.select("table_id", "pos", "s.sentence", F.col("s.label").cast("int").alias("label"))


def pair_generated(lines: DataFrame) -> DataFrame:
    """(table_id, file, pos, lf) from lines (file, line, value) of generated JSON: the i-th ``"url"`` value of
    a file goes with its i-th ``"logic_str"`` value. A file with more of one than of the other fails the read."""
    value = F.regexp_extract("value", r'\s+".+?": "(.+?)"', 1)
    kind = F.when(F.col("value").contains('"url":'), "url").when(F.col("value").contains('"logic_str":'), "lf")
    found = lines.select("file", "line", kind.alias("kind"), value.alias("v")).where(F.col("kind").isNotNull())

    def ith(name: str) -> DataFrame:
        return running(found.where(F.col("kind") == name), ["file"], ["line"], sums={"i": F.lit(1)}, totals={})

    urls = ith("url").select("file", "i", table_id(F.col("v")).alias("table_id"))
    forms = ith("lf").select("file", "i", F.col("line").alias("pos"), F.col("v").alias("lf"))
    paired = join_on(urls.withColumn("has_url", F.lit(True)), forms.withColumn("has_lf", F.lit(True)), ["file", "i"], "full_outer")
    alone = F.raise_error(F.concat(F.lit("urls and forms differ in number: "), F.coalesce("file", F.lit("a file")))).cast("boolean")
    return paired.where(F.when(F.col("has_url") & F.col("has_lf"), F.lit(True)).otherwise(alone)).select("table_id", "file", "pos", "lf")


def read_generated(spark: SparkSession, path: str) -> DataFrame:
    """Generated forms of a pretty-printed JSON file."""
    return pair_generated(read_lines(spark, path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(pos, text): the first output of every line of ``.jsonl``; all texts of ``.json`` ``{id: [text]}`` in order.

    Both are split between tasks and numbered by running totals (``read_entries`` for one JSON object)."""
    one = F.lit(1).cast("bigint")
    if path.endswith(".jsonl"):
        outs = F.from_json("value", "struct<out: array<string>>")["out"]
        lines = read_lines(spark, path).where(F.trim("value") != "").select("file", "line", F.get(outs, F.lit(0)).alias("text"))
        numbered = running(lines, [], ["file", "line"], sums={"pos": one}, totals={})
        return numbered.select((F.col("pos") - 1).alias("pos"), "text")
    if path.endswith(".json"):
        texts = F.from_json("value", "array<string>", {"mode": "FAILFAST"})
        each = read_entries(spark, path).select("file", "entry", F.posexplode(texts).alias("i", "text"))
        numbered = running(each, [], ["file", "entry", "i"], sums={"pos": one}, totals={})
        return numbered.select((F.col("pos") - 1).alias("pos"), "text")
    raise ValueError(f"predictions must be .jsonl or .json: {path}")
