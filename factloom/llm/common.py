"""What the operators share: a place for intermediate tables, whole rows carried under one name, small expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words, as characters of a class and one by one.
BLANKS = r"\x20\x09-\x0D"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local master without it gets a folder of its own for the session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="factloom-llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back.

    Cuts the lineage, keeps column pruning and survives lost executors. The files stay until the folder is
    emptied: a lazy result may still read them.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows at most (counted now); else the join shuffles.

    For staged tables of one row a group, whose number of groups is not known before.
    """
    return F.broadcast(df) if df.count() <= most else df


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), use)[0]


def word_list(text: Column) -> Column:
    """The maximal runs without blanks of a text; none for null."""
    pieces = F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", -1)
    return F.filter(pieces, lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words ``word_list`` has, without keeping them."""
    t = F.trim(F.translate(F.coalesce(text, F.lit("")), BLANK_CHARS, " " * len(BLANK_CHARS)))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " +", -1))).cast("long")


def without(text: Column, chars: str) -> Column:
    """A text without the given characters."""
    return F.translate(F.coalesce(text, F.lit("")), chars, "")


# Elements of an array that are scanned in a row; longer arrays are scanned in blocks of as many, and then their totals.
SCAN = 256


def scanned(values: Column, op: Callable[[Column, Column], Column], zero: Column, kind: str = "int") -> Column:
    """For each element what ``op`` makes of all elements before it, from ``zero`` on.

    ``op`` is associative and ``zero`` neutral. An accumulator that grows by concatenation copies itself in every step, so
    none holds more than a block's elements, or the totals of the blocks: ten million elements take some ten seconds.
    """
    none = F.array().cast(f"array<{kind}>")

    def in_a_row(block: Column) -> Column:
        start = F.struct(zero.cast(kind).alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct(op(acc["at"], x).cast(kind).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, start, step, lambda acc: acc["out"])

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero.cast(kind), lambda acc, x: op(acc, x).cast(kind)))
        return F.flatten(F.zip_with(F.transform(blocks, in_a_row), in_a_row(totals), lambda b, s: F.transform(b, lambda x: op(s, x).cast(kind))))

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / SCAN).cast("int")), lambda k: F.slice(v, k * SCAN + 1, F.lit(SCAN)))

    return bind(values, lambda v: F.when(F.size(v) <= SCAN, in_a_row(v)).otherwise(bind(cut(v), of_blocks)))


def sums_before(values: Column) -> Column:
    """Sum of the elements before each element."""
    return scanned(values, lambda a, b: a + b, F.lit(0))


def _parts(t: Column, pattern: str, found: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use(start, gap, match)`` for each match with the gap before it; starts are those of the gaps."""

    def placed(pairs: Column) -> Column:
        steps = F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["match"]))
        return bind(sums_before(steps), lambda at: F.transform(pairs, lambda x, i: use(F.get(at, i), x["gap"], x["match"])))

    return bind(F.arrays_zip(F.split(t, pattern, -1).alias("gap"), found.alias("match")), placed)


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern as (start, end, match), in code points, end exclusive.

    The matches and the pieces between them come from the same search, so their lengths add up to positions.
    ``pattern`` never matches the empty text; it must not look behind the end of an earlier match. Linear in the
    length of a text and the number of its matches.
    """
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def span(at: Column, gap: Column, match: Column) -> Column:
        return bind(at + F.length(gap), lambda start: F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match")))

    def placed(found: Column) -> Column:
        return F.when(F.size(found) == 0, none).otherwise(F.slice(_parts(t, pattern, found, span), F.lit(1), F.size(found)))

    return bind(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), placed)


def gap_spans(text: Column, pattern: str) -> Column:
    """What lies between the matches of a pattern (see ``match_spans``), and before and after them: (start, match)."""
    t = F.coalesce(text, F.lit(""))
    gap = lambda at, gap, match: F.struct(at.alias("start"), gap.alias("match"))
    return bind(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: _parts(t, pattern, found, gap))


def pieces(text: Column, size: int) -> Column:
    """A text as pieces of ``size`` code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def stretch(cut: Column, size: int, start: Column, length: Column) -> Column:
    """``length`` (``size`` at most) code points of a text in ``pieces`` of ``size``, from ``start`` (0 for the first) on.

    A substring of the whole text would walk from its first character every time.
    """
    k = (start / size).cast("int")
    both = F.concat(F.coalesce(F.get(cut, k), F.lit("")), F.coalesce(F.get(cut, k + 1), F.lit("")))
    return both.substr(start - k * size + 1, length)
