"""Column statistics and their text, for all columns of all tables of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import float_text
from factloom.operators.coltypes import COLUMN, first_cells
from factloom.session import stored


def quantity_group(n: Column, total: Column) -> Column:
    """all, one, several (at most half) or most, tested in this order."""
    return (
        F.when(n == total, "all").when(n == 1, "one").when(n / total <= 0.5, "several").otherwise("most")
    )


def value_occurrences(cells: DataFrame) -> DataFrame:
    """(column, occurrences, n_values, first_row): how many values occur how often, and the first row
    in which such a value appears. Columns are counted twice, each time combined before the shuffle."""
    counts = cells.groupBy(*COLUMN, "raw").agg(F.count(F.lit(1)).alias("occurrences"), F.min("row_idx").alias("first_row"))
    return counts.groupBy(*COLUMN, "occurrences").agg(
        F.count(F.lit(1)).alias("n_values"), F.min("first_row").alias("first_row"))


def _s(n: Column, word: str) -> Column:
    return F.when(n == 1, F.lit(word)).otherwise(F.lit(word + "s"))


def common_stats_counts(cells: DataFrame) -> DataFrame:
    """(column, unique, only_unique, counts): distinct values, whether all are, and the sentence list
    "n values have m occurrences" by falling n."""
    occ = value_occurrences(cells)
    n, m = F.col("n_values"), F.col("occurrences")
    sentence = F.concat(
        n.cast("string"), F.lit(" "), _s(n, "value"), F.when(n == 1, " has ").otherwise(" have "),
        m.cast("string"), F.lit(" "), _s(m, "occurrence"),
    )
    listed = F.array_sort(F.collect_list(F.struct((-n).alias("o"), "first_row", sentence.alias("s"))))
    return occ.groupBy(*COLUMN).agg(
        F.sum("n_values").alias("unique"),
        (F.sum("n_values") == F.sum(n * m)).alias("only_unique"),
        F.array_join(F.transform(listed, lambda x: x["s"]), ", ").alias("counts"),
    )


def common_stats_groups(cells: DataFrame) -> DataFrame:
    """(column, stats): how many values are unique and how often values occur, in rough groups."""
    occ = value_occurrences(cells)
    totals = occ.groupBy(*COLUMN).agg(
        F.sum("n_values").alias("uniq"), F.sum(F.col("n_values") * F.col("occurrences")).alias("total"))
    grouped = (
        occ.join(totals, COLUMN)
        .withColumn("vg", quantity_group(F.col("n_values"), F.col("uniq")))
        .withColumn("og", quantity_group(F.col("occurrences"), F.col("total")))
        .groupBy(*COLUMN, "uniq", "total", "vg", "og").agg(F.min("first_row").alias("first_row"))
    )
    plural = lambda g, word: F.when(F.col(g) == "one", word).otherwise(word + "s")
    sentence = F.concat(
        F.col("vg"), F.lit(" "), plural("vg", "value"), F.when(F.col("vg") == "one", " has ").otherwise(" have "),
        F.col("og"), F.lit(" "), plural("og", "occurrence"),
    )
    by_group = grouped.groupBy(*COLUMN, "uniq", "total", "vg").agg(
        F.min("first_row").alias("first_row"),
        F.array_sort(F.collect_list(F.struct("og", sentence.alias("s")))).alias("sentences"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("first_row", F.transform("sentences", lambda x: x["s"]).alias("s"))))
    unique = quantity_group(F.col("uniq"), F.col("total"))
    head = F.concat(F.lit("Column has "), unique, F.lit(" unique value"), F.when(unique == "one", "").otherwise("s"))
    return by_group.groupBy(*COLUMN, "uniq", "total").agg(ordered.alias("o")).select(
        *COLUMN,
        F.array_join(F.concat(F.array(head), F.flatten(F.transform("o", lambda x: x["s"]))), ", ").alias("stats"),
    )


def number_stats(df: DataFrame, by: list[str], value: str = "num") -> DataFrame:
    """(by, n, max, min, sum, avg, max_diff) of the non-empty numbers, three decimals."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max(v).alias("max"), F.min(v).alias("min"),
        F.bround(F.sum(v), 3).alias("sum"), F.bround(F.avg(v), 3).alias("avg"),
        F.bround(F.max(v) - F.min(v), 3).alias("max_diff"),
    )


def date_stats(df: DataFrame, by: list[str], value: str = "ts") -> DataFrame:
    """(by, first, last, diff_days, diff_months, diff_years); months and years by calendar."""
    lo, hi = F.col("lo"), F.col("hi")
    span = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.min(F.col(value).cast("timestamp_ntz")).alias("lo"), F.max(F.col(value).cast("timestamp_ntz")).alias("hi"))
    seconds = lambda c: F.unix_micros(F.to_timestamp_ltz(c))
    return span.select(
        *by, F.to_date(lo).alias("first"), F.to_date(hi).alias("last"),
        F.floor((seconds(hi) - seconds(lo)) / F.lit(86_400_000_000)).alias("diff_days"),
        ((F.year(hi) * 12 + F.month(hi)) - (F.year(lo) * 12 + F.month(lo))).alias("diff_months"),
        (F.year(hi) - F.year(lo)).alias("diff_years"),
    )


def _number_texts(full: Column) -> Column:
    """Statistics of one number column as text; the sum and the average only when ``full``."""
    any_float = F.col("any_float")
    parts = [
        F.concat(F.lit("max: "), float_text(F.col("max"), F.col("max_float"))),
        F.concat(F.lit("min: "), float_text(F.col("min"), F.col("min_float"))),
        F.when(full, F.concat(F.lit("sum: "), float_text(F.col("sum"), any_float))),
        F.when(full, F.concat(F.lit("avg: "), float_text(F.col("avg"), F.lit(True)))),
        F.concat(F.lit("max diff: "), float_text(F.col("max_diff"), F.col("max_float") | F.col("min_float"))),
    ]
    return F.filter(F.array(*parts), lambda p: p.isNotNull())


def _number_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """``number_stats`` and whether the numbers were written with a point."""
    v = F.col("num")
    marked = df.where(v.isNotNull()).withColumn("f", F.coalesce("is_float", F.lit(False)))
    ends = marked.groupBy(*by).agg(
        F.max(v).alias("max"), F.min(v).alias("min"),
        F.bround(F.sum(v), 3).alias("sum"), F.bround(F.avg(v), 3).alias("avg"), F.bround(F.max(v) - F.min(v), 3).alias("max_diff"),
        F.max("f").alias("any_float"),
        F.max_by("f", v).alias("max_float"), F.min_by("f", v).alias("min_float"),
    )
    return ends


def multi_number_stats(typed: DataFrame) -> DataFrame:
    """(column, coltype, pos, the number statistics) for every position of multi-number columns."""
    raw_nums = typed.where(F.col("coltype").isin("same_n_nums", "year") & F.col("nums").isNotNull())
    points = F.regexp_extract_all(F.col("raw"), F.lit(r"(?U)\b\d+(?:\s*,\s*\d{3})*(?:\.\d+)?\b"), F.lit(0))
    each = raw_nums.select(*COLUMN, "coltype", F.posexplode(F.arrays_zip(F.col("nums"), points.alias("t"))).alias("pos", "x"))
    flat = each.select(*COLUMN, "coltype", "pos", F.col("x.nums").alias("num"), F.col("x.t").contains(".").alias("is_float"))
    return _number_summary(flat, [*COLUMN, "coltype", "pos"])


def typed_stats_text(typed: DataFrame) -> DataFrame:
    """(column, typed_stats): the statistics of the column's type as text."""
    single = _number_summary(typed.where(F.col("coltype").isin("num", "rank", "time")), [*COLUMN, "coltype"])
    numbers = single.select(*COLUMN, F.array_join(_number_texts(F.col("coltype") == "num"), ", ").alias("typed_stats"))

    multi = multi_number_stats(typed)
    full = F.col("coltype") == "same_n_nums"
    texts = multi.select(*COLUMN, "pos", F.posexplode(_number_texts(full)).alias("i", "t"))
    split = texts.select(
        *COLUMN, "i", "pos", F.substring_index("t", ": ", 1).alias("name"), F.substring_index("t", ": ", -1).alias("v"))
    per_name = split.groupBy(*COLUMN, "i", "name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]), ", ").alias("vs"))
    joined = per_name.groupBy(*COLUMN).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("i", F.concat("name", F.lit(": "), "vs").alias("t")))),
                lambda x: x["t"],
            ),
            ", ",
        ).alias("typed_stats"))

    d = date_stats(typed.where(F.col("coltype") == "date"), COLUMN)
    dates = d.select(*COLUMN, F.concat(
        F.lit("first: "), F.col("first").cast("string"), F.lit(", last: "), F.col("last").cast("string"),
        F.lit(", max diff days: "), F.col("diff_days").cast("string"),
        F.lit(", max diff months: "), F.col("diff_months").cast("string"),
        F.lit(", max diff years: "), F.col("diff_years").cast("string")).alias("typed_stats"))
    return numbers.unionByName(joined).unionByName(dates)


def column_stats(typed: DataFrame, version: str = "v2", include_num_stats: bool = False) -> DataFrame:
    """(column, stats): common statistics (``v1`` counts, ``v2`` groups) and those of the type. Where both are asked for, each
    is written once, so that the shuffles of all cells do not lie on the disk together."""
    if version == "v1":
        c = common_stats_counts(typed)
        common = c.select(*COLUMN, F.concat(
            F.lit("unique: "), F.col("unique").cast("string"), F.lit(", only unique: "),
            F.when(F.col("only_unique"), "True").otherwise("False"), F.lit(", counts: "), "counts").alias("stats"))
    else:
        common = common_stats_groups(typed)
    if not include_num_stats:
        return common
    return stored(common, "stats-common").join(stored(typed_stats_text(typed), "stats-typed"), COLUMN, "left_outer").select(
        *COLUMN, F.concat_ws(", ", "stats", "typed_stats").alias("stats"))


def table_features(
    typed: DataFrame,
    titles: DataFrame,
    version: str = "v2",
    include_stats: bool = True,
    include_num_stats: bool = False,
    include_value: bool = False,
) -> DataFrame:
    """(table_id, input): title, and for every column its name, type, statistics and first value."""
    columns = first_cells(typed, "col_name", "coltype", "raw").select(
        *COLUMN, F.lower("col_name").alias("name"), "coltype", F.col("raw").alias("example"))
    parts = [F.lit("Column "), F.col("name"), F.lit(". Type: "), F.col("coltype"), F.lit(".")]
    if include_stats:
        columns = columns.join(column_stats(typed, version, include_num_stats), COLUMN)
        parts += [F.lit(" Stats: "), F.col("stats"), F.lit(".")]
    if include_value:
        parts += [F.lit(" Value: "), F.col("example"), F.lit(".")]
    described = columns.select(*COLUMN, F.concat(*parts).alias("d"))
    listed = described.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "d"))).alias("ds"))
    return listed.join(titles.select("table_id", "title"), "table_id").select(
        "table_id",
        F.concat(F.lit("Title: "), "title", F.lit(". "), F.array_join(F.transform("ds", lambda x: x["d"]), " ")).alias("input"))


def coltype_report(coltypes: DataFrame, split: str = "split", examples: int = 50, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Counts and shares of column types, and sampled examples from outside the test split."""
    from pyspark.sql import Window as W

    from factloom.functions.text import seeded_hash
    from factloom.plans.ranking import join_on

    counts = coltypes.groupBy("coltype").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("total"))
    report = join_on(counts, totals, []).select("coltype", "n", F.bround(F.col("n") / F.col("total"), 3).alias("share"))
    order = W.partitionBy("coltype").orderBy(seeded_hash(seed, F.col("table_id"), F.col("col_idx")), "table_id", "col_idx")
    picked = coltypes.where(F.col(split) != "test").withColumn("i", F.row_number().over(order)).where(F.col("i") <= examples)
    return report, picked
