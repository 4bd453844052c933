"""What filters remove together: every order of a set of filters, audited from one pass over the documents.

A document fails some of the filters; its row of the mask matrix has 0 for those and a far number for the others.
The position matrix has the place of each filter in each order (inverse permutations). Their min-plus product is
the step at which each order removes the document. Documents with one mask have one row of that product, so they
are counted per part and mask first, and the counts are scattered to (order, step).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import bind, staged, word_list

# Fixed values of the five filters.
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITALS_PERCENT = 5
SYMBOL = r"[#$%&*|]"
FILTERS = ("A", "B", "C", "D", "E")

# Masks of this many filters are listed per part at most; all their orders are taken if none are given.
MOST_FILTERS = 16
MOST_PERMUTED = 7


def all_orders(n: int) -> np.ndarray:
    """Every order of ``n`` filters, a row each, in lexical order of their numbers."""
    return np.array(list(permutations(range(n))), dtype=np.int64).reshape(-1, n)


def removal_steps(masks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Step (from 1) at which each order removes each mask; one more than the number of filters: never.

    masks: failed filters as booleans, a row each. orders: filter numbers in the order of steps, a row each.
    """
    n = orders.shape[1]
    never = n + 1
    cost = np.where(masks, 0, never)
    place = np.argsort(orders, axis=1) + 1
    product = np.full((len(masks), len(orders)), never, dtype=np.int64)
    for f in range(n):
        np.minimum(product, cost[:, f, None] + place[None, :, f], out=product)
    return product


def scattered(steps: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Weight that each order removes at each step 1 to ``n``: orders x steps."""
    out = np.zeros((steps.shape[1], n + 2), dtype=np.int64)
    at = np.broadcast_to(np.arange(steps.shape[1])[None, :], steps.shape)
    np.add.at(out, (at, steps), np.broadcast_to(weights[:, None], steps.shape))
    return out[:, 1 : n + 1]


def audit(flagged: DataFrame, filters: Sequence[str], part: Column, weights: Mapping[str, Column] | None = None, orders: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """One row for each part, order and step: what the filter of that step does there.

    flagged: a boolean column for each of ``filters`` (true: fails; null passes), any others. ``part``: expression
    of a text (null: the empty one). ``weights``: conditions whose documents are counted among the removed as
    ``lost_<name>``. ``orders``: sequences of all filters; every permutation if None (up to seven filters).

    Columns: ``part``, ``filter_order`` (names joined), ``step``, ``filter``, ``kept`` (after the step), ``removed``,
    ``redundant`` (fails the filter, removed before), ``unique_fails`` (fails this filter only), ``lost_*``,
    ``shapley`` (removed by the filter over all given orders). Rows are counted one by one, repeated ones too; a
    part without documents has no rows. Documents meet as counts by part and mask, summed before they are shuffled.
    """
    filters, weights = list(filters), dict(weights or {})
    n = len(filters)
    if not 0 < n <= MOST_FILTERS or len(set(filters)) < n:
        raise ValueError(f"1 to {MOST_FILTERS} different filters, not {filters}")
    if orders is None:
        if n > MOST_PERMUTED:
            raise ValueError(f"give orders for more than {MOST_PERMUTED} filters")
        taken = all_orders(n)
    else:
        if any(sorted(o) != sorted(filters) for o in orders):
            raise ValueError("an order is a sequence of all filters")
        taken = np.array([[filters.index(f) for f in o] for o in orders], dtype=np.int64).reshape(-1, n)
    names = ["".join(filters[f] for f in o) for o in taken]

    mask = sum((F.when(F.col(f"`{f}`"), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(filters)), F.lit(0))
    cells = flagged.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"), *[c.alias(f"c{i}") for i, c in enumerate(weights.values(), 1)])
    columns = [F.count("*").alias("w0")] + [F.count(F.when(F.col(f"c{i}"), F.lit(1))).alias(f"w{i}") for i in range(1, len(weights) + 1)]
    grouped = cells.groupBy("part", "mask").agg(*columns)
    # One short list a part: a mask is in it once.
    parts = grouped.groupBy("part").agg(F.collect_list(F.struct("mask", *[f"w{i}" for i in range(len(columns))])).alias("cells"))

    whole = T.LongType()
    lost = [f"lost_{w}" for w in weights]
    schema = T.StructType(
        [T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), T.StructField("filter", T.StringType())]
        + [T.StructField(c, whole) for c in ("kept", "removed", "redundant", "unique_fails", *lost, "shapley")]
    )
    n_weights = len(columns)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_of = np.array(filters, dtype=object)[taken].reshape(-1)
        order_of = np.repeat(np.array(names, dtype=object), n)
        step_of = np.tile(np.arange(1, n + 1, dtype=np.int32), len(taken))
        for batch in batches:
            for name, found in zip(batch["part"].to_pylist(), batch["cells"].to_pylist()):
                bits = np.array([c["mask"] for c in found], dtype=np.int64)
                masks = (bits[:, None] >> np.arange(n)[None, :]) & 1 == 1
                steps = removal_steps(masks, taken)
                sums = [np.array([c[f"w{i}"] for c in found], dtype=np.int64) for i in range(n_weights)]
                removed = scattered(steps, sums[0], n)
                failing = (masks * sums[0][:, None]).sum(axis=0)
                alone = np.array([sums[0][bits == 1 << f].sum() for f in range(n)], dtype=np.int64)
                shapley = np.zeros(n, dtype=np.int64)
                np.add.at(shapley, taken, removed)
                out = {
                    "part": pa.array([name] * len(step_of), pa.string()), "filter_order": pa.array(order_of, pa.string()),
                    "step": pa.array(step_of), "filter": pa.array(filter_of, pa.string()),
                    "kept": pa.array((sums[0].sum() - np.cumsum(removed, axis=1)).reshape(-1)), "removed": pa.array(removed.reshape(-1)),
                    "redundant": pa.array((failing[taken] - removed).reshape(-1)), "unique_fails": pa.array(alone[taken].reshape(-1)),
                }
                for column, weight in zip(lost, sums[1:]):
                    out[column] = pa.array(scattered(steps, weight, n).reshape(-1))
                out["shapley"] = pa.array(shapley[taken].reshape(-1))
                yield pa.RecordBatch.from_pydict(out)

    return parts.mapInArrow(spread, schema)


def text_failures(text: Column) -> list[Column]:
    """Filters A to D of a text: few words, few different words, many capitals, symbols. Null is the empty text."""
    t = F.coalesce(text, F.lit(""))
    words = bind(word_list(t), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return [
        words.alias("words"), (100 * capitals > MOST_CAPITALS_PERCENT * F.length(t)).alias("C"), t.rlike(SYMBOL).alias("D"),
    ]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, the five filters as booleans, and ``good`` and ``toxic`` from the labels, a row each.

    docs: ``doc_id``, ``text``, ``source``; labels: ``doc_id``, ``quality``, ``toxic``; other columns are not read.
    E fails where a smaller ``doc_id`` has the same text (told by SHA-256); null and empty texts are the same; a row
    without ``doc_id`` has no smaller one and no label, rows with one ``doc_id`` are not smaller than each other. A
    document is good (toxic) if any of its label rows says so. Texts are read once; digests go on. The least id of
    a text is met by (digest, doc_id), so a text with many copies makes no hot key.
    """
    words, c, d = text_failures(docs["text"])
    digest = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)).alias("digest")
    read = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), digest, words, c, d)
    light = staged(
        read.select(
            "doc_id", "source", "digest", (F.col("words.n") < LEAST_WORDS).alias("A"),
            (100 * F.col("words.distinct") < LEAST_DISTINCT_PERCENT * F.col("words.n")).alias("B"), "C", "D",
        ),
        "audit-documents",
    )
    least = light.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    told = light.join(least, ["digest", "doc_id"], "left").withColumn("E", F.col("least").isNull() & F.col("doc_id").isNotNull())
    flagged = told.select("doc_id", "source", *FILTERS).join(marks, "doc_id", "left")
    return flagged.select("doc_id", "source", *FILTERS, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


# The same by SQL over the tables ``documents`` and ``labels``, document by document.
AUDIT_SQL = r"""
WITH marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), texts AS (
  SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS t,
    regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS words,
    coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id
), fails AS (
  SELECT part, good, toxic, [
    len(words) < 50,
    100 * len(list_distinct(words)) < 65 * len(words),
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'),
    doc_id IS NOT NULL AND coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)
  ] AS f FROM texts
), cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, f
), one AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT part, o, i AS step, o[i] AS filter, n, good, toxic, f[o[i]] AS failing,
    list_bool_or([f[o[1]], f[o[2]], f[o[3]], f[o[4]], f[o[5]]][1:i - 1]) IS TRUE AS gone,
    CAST(f[1] AS INTEGER) + CAST(f[2] AS INTEGER) + CAST(f[3] AS INTEGER) + CAST(f[4] AS INTEGER) + CAST(f[5] AS INTEGER) = 1 AS alone
  FROM cells, orders, one
), found AS (
  SELECT part, o, step, filter,
    sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (NOT gone AND failing) AS removed,
    sum(n) FILTER (gone AND failing) AS redundant, sum(n) FILTER (failing AND alone) AS unique_fails,
    sum(good) FILTER (NOT gone AND failing) AS good_lost, sum(toxic) FILTER (NOT gone AND failing) AS toxic_lost
  FROM steps GROUP BY part, o, step, filter
)
SELECT part,
  substr('ABCDE', o[1], 1) || substr('ABCDE', o[2], 1) || substr('ABCDE', o[3], 1) || substr('ABCDE', o[4], 1) || substr('ABCDE', o[5], 1) AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM found
"""
