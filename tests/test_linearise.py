"""Tables over the bound of a part: texts in order, one record per reference."""

import hashlib

from pyspark.sql import functions as F

from factloom.operators import linearise as L


def test_records_of_a_table_over_the_bound(spark):
    n = L.ROWS_PER_PART + 1
    big = spark.range(1, n + 1).select(F.lit("big").alias("table_id"), F.col("id").cast("int").alias("row_idx"), F.col("id").cast("string").alias("raw"))
    small = spark.createDataFrame([("small", 1, "x")], "table_id string, row_idx int, raw string")
    cells = big.union(small).withColumn("col_idx", F.lit(0)).withColumn("col_name", F.lit("h"))
    titles = spark.createDataFrame([("big", "B"), ("small", "S"), ("none", "N")], "table_id string, title string")
    refs = spark.createDataFrame([("big", "a"), ("big", "b"), ("small", "c"), ("none", "d")], "table_id string, ref string")
    texts, csv = L.linearise(cells, titles), L.table_csv(cells)
    assert sorted((x.table_id, x.part) for x in texts.collect()) == [("big", 0), ("big", 1), ("small", 0)]
    got = L.baseline_records(refs, texts, csv).collect()
    assert sorted((x.table_id, x.output, x.parts) for x in got) == [("big", "a", 2), ("big", "b", 2), ("small", "c", 1)]
    whole = {x.table_id: x.input for x in L.whole_texts(texts, "input", ". ").collect()}
    assert whole == {"big": "Title: B. " + ". ".join(f"Row, h: {i}" for i in range(1, n + 1)), "small": "Title: S. Row, h: x"}
    files = {x.table_id: x.csv for x in L.whole_texts(csv, "csv", "\n").collect()}
    assert files == {"big": "\n".join(["h", *map(str, range(1, n + 1))]), "small": "h\nx"}


def test_digests_are_those_of_the_whole_text(spark):
    """Not of the digests of its parts: a table over the bound of a part, and three of one row each."""
    place = F.col("id").cast("int")
    cells = spark.range(1, 24).select(
        F.when(place > 20, place.cast("string")).otherwise("big").alias("table_id"), F.when(place > 20, 1).otherwise(place).alias("row_idx"),
        F.lit("é,").alias("raw"), F.lit(0).alias("col_idx"), F.lit("h").alias("col_name"))
    csv = L.table_csv(cells, rows_per_part=3)
    got = {x.table_id: x.csv for x in L.whole_digests(csv, "csv", "\n").collect()}
    text = lambda n: hashlib.md5("\n".join(["h", *['"é,"'] * n]).encode()).hexdigest()
    assert got == {"big": text(20), "21": text(1), "22": text(1), "23": text(1)}
