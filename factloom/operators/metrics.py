"""Corpus metrics of predictions against references and judgements.

Predictions are rows (pred_id, table_id, text), references rows (table_id, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.text import runs, tokens
from factloom.operators.ngrams import text_id

# Weights of the sentence scores, and the smallest positive normal double, which stands
# for a precision of zero.
BLEU_WEIGHTS = {"bleu_1": (1.0, 0.0, 0.0), "bleu_2": (0.5, 0.5, 0.0), "bleu_3": (0.33, 0.33, 0.33)}
SMALLEST = 2.2250738585072014e-308


def prediction_stats(tables: DataFrame, preds: DataFrame) -> DataFrame:
    """One row: predictions, predictions per table and tables without any."""
    counts = preds.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
    per_table = tables.select("table_id").join(counts, "table_id", "left_outer")
    return per_table.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_preds"),
        (F.coalesce(F.sum("n"), F.lit(0)) / F.count(F.lit(1))).alias("avg_preds_per_table"),
        F.count_if(F.col("n").isNull()).alias("tables_without_preds"),
    )


def _gram_counts(words: DataFrame, keys: list[str], max_n: int) -> DataFrame:
    """(keys, n, gram, c) from rows with an array ``w`` of tokens."""
    grams = F.concat(*[_tagged(n) for n in range(1, max_n + 1)])
    each = words.select(*keys, F.explode(grams).alias("g"))
    return each.groupBy(*keys, F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(F.count(F.lit(1)).alias("c"))


def _tagged(n: int) -> Column:
    return F.transform(runs(F.col("w"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))


def closest_lengths(preds: DataFrame, refs: DataFrame) -> DataFrame:
    """(table_id, len, closest): for the lengths of a table's predictions, the nearest reference
    length, the shorter of two. Only distinct lengths are ordered, never texts; they are as many as
    the longest text has tokens."""
    mine = preds.select("table_id", "len").distinct()
    theirs = refs.select("table_id", F.col("len")).distinct()
    both = mine.select("table_id", "len", F.lit(1).alias("asked")).unionByName(
        theirs.select("table_id", "len", F.lit(0).alias("asked")))
    lengths = both.groupBy("table_id", "len").agg(F.max("asked").alias("asked"), F.min("asked").alias("not_ref"))
    ref_len = F.when(F.col("not_ref") == 0, F.col("len"))
    order = W.partitionBy("table_id").orderBy("len")
    around = lengths.select(
        "table_id", "len", "asked",
        F.last(ref_len, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("lo"),
        F.first(ref_len, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)).alias("hi"),
    )
    lower = F.col("hi").isNull() | (F.col("len") - F.col("lo") <= F.col("hi") - F.col("len"))
    return around.where(F.col("asked") == 1).select(
        "table_id", "len", F.when(lower, F.coalesce("lo", "hi")).otherwise(F.col("hi")).alias("closest"))


def clipped_matches(preds: DataFrame, refs: DataFrame, max_n: int) -> DataFrame:
    """(pred_id, n, matches, total): n-grams of a prediction, and those found in one of its table's
    references, each as often as the reference that has it most. ``preds`` and ``refs`` have ``w``."""
    mine = _gram_counts(preds, ["pred_id", "table_id"], max_n)
    # a reference is identified by a hash of its text, so that its grams do not carry it along
    named = refs.select("table_id", text_id(F.col("text")).alias("ref_id"), "w").dropDuplicates(["table_id", "ref_id"])
    theirs = _gram_counts(named, ["table_id", "ref_id"], max_n)
    best = theirs.groupBy("table_id", "n", "gram").agg(F.max("c").alias("best"))
    joined = mine.join(best, ["table_id", "n", "gram"], "left_outer")
    return joined.groupBy("pred_id", "n").agg(
        F.sum(F.least("c", F.coalesce("best", F.lit(0)))).alias("matches"), F.sum("c").alias("total"))


def _words(df: DataFrame, words: Column) -> DataFrame:
    return df.withColumn("w", words).withColumn("len", F.size("w"))


def sentence_bleu(preds: DataFrame, refs: DataFrame) -> DataFrame:
    """(pred_id, table_id, bleu_1, bleu_2, bleu_3) of lower-case, space-separated texts."""
    known = refs.select("table_id").distinct()
    p = _words(preds.join(known, "table_id", "left_semi"), tokens(F.lower("text")))
    r = _words(refs, tokens(F.lower("text")))
    counts = clipped_matches(p, r, 3)
    stats = counts.groupBy("pred_id").agg(
        *[F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{c}_{n}") for n in (1, 2, 3) for c in ("matches", "total")])
    lengths = p.select("pred_id", "table_id", "len").join(closest_lengths(p, r), ["table_id", "len"])
    joined = lengths.join(stats, "pred_id")
    penalty = F.when(F.col("len") > F.col("closest"), 0.0).otherwise(1 - F.col("closest") / F.col("len"))

    def log_precision(n: int) -> Column:
        found = F.coalesce(F.col(f"matches_{n}"), F.lit(0))
        share = found / F.greatest(F.coalesce(F.col(f"total_{n}"), F.lit(1)), F.lit(1))
        return F.log(F.when(found == 0, F.lit(SMALLEST)).otherwise(share))

    def score(weights: tuple) -> Column:
        total = penalty
        for n, w in enumerate(weights, 1):
            if w:
                total = total + w * log_precision(n)
        return F.when(F.coalesce("matches_1", F.lit(0)) == 0, F.lit(0.0)).otherwise(F.exp(total))

    return joined.select("pred_id", "table_id", *[score(w).alias(name) for name, w in BLEU_WEIGHTS.items()])


def mean_sentence_bleu(preds: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: the sentence scores averaged over predictions."""
    return sentence_bleu(preds, refs).agg(*[F.avg(b).alias(b) for b in BLEU_WEIGHTS])


def international_tokens(text: Column) -> Column:
    """Tokens of the usual evaluation tokenisation (13a)."""
    t = F.regexp_replace(F.replace(text, F.lit("<skipped>"), F.lit("")), "-\n", "")
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([\.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")


def corpus_bleu(preds: DataFrame, refs: DataFrame) -> DataFrame:
    """One row (score, sys_len, ref_len): n-gram matches up to 4 pooled over all predictions, 0 to 100.

    Empty references are none; a table whose references are all empty takes no part. Without references the
    score is null.
    """
    written = refs.where(F.col("text") != "")
    known = written.select("table_id").distinct()
    p = _words(preds.join(known, "table_id", "left_semi"), international_tokens(F.rtrim("text")))
    r = _words(written, international_tokens(F.rtrim("text")))

    pooled = clipped_matches(p, r, 4).groupBy("n").agg(F.sum("matches").alias("matches"), F.sum("total").alias("total"))
    stats = pooled.agg(*[
        F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}_{n}") for n in (1, 2, 3, 4) for c in ("matches", "total")])
    lengths = p.select("table_id", "len").join(closest_lengths(p, r), ["table_id", "len"]).agg(
        F.sum("len").alias("sys_len"), F.sum("closest").alias("ref_len"))
    # two frames of one row each, laid over each other
    both = stats.unionByName(lengths, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])

    logs, halvings = F.lit(0.0), F.lit(0.0)
    for n in (1, 2, 3, 4):
        m, t = F.col(f"matches_{n}"), F.col(f"total_{n}")
        halvings = halvings + F.when((m == 0) & (t > 0), 1.0).otherwise(0.0)
        share = F.when(m == 0, 1 / (F.pow(F.lit(2.0), halvings) * t)).otherwise(m / t)
        logs = logs + F.when(t > 0, F.log(F.when(t > 0, share))).otherwise(F.lit(-9999999999.0))
    penalty = F.when(F.col("sys_len") < F.col("ref_len"), 1 - F.col("ref_len") / F.col("sys_len")).otherwise(0.0)
    none = (F.col("matches_1") + F.col("matches_2") + F.col("matches_3") + F.col("matches_4")) == 0
    score = F.when(F.col("sys_len").isNotNull(), F.when(none, F.lit(0.0)).otherwise(100 * F.exp(penalty + logs / 4)))
    return one.select(score.alias("score"), "sys_len", "ref_len")


def judged_accuracy(judged: DataFrame, name: str = "judge") -> DataFrame:
    """One row: share of predictions judged right, over all (micro) and as the mean of tables (macro);
    an empty prediction is wrong. judged (table_id, prediction, label)."""
    right = F.when(F.col("prediction") == "", 0).otherwise(F.col("label"))
    per_table = judged.groupBy("table_id").agg(F.sum(right).alias("s"), F.count(F.lit(1)).alias("c"))
    return per_table.agg(
        (F.sum("s") / F.sum("c")).alias(f"{name}_micro"), F.avg(F.col("s") / F.col("c")).alias(f"{name}_macro"))


def error_free_share(judged: DataFrame, errors: str) -> DataFrame:
    """One row: share of predictions whose list of errors is empty."""
    return judged.agg(F.avg((F.size(errors) == 0).cast("int")).alias("share"))


def variability(tables: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """One row: how different the items of a table are, (distinct - 1) / (n - 1), averaged over tables.
    One item counts as 1, and so does a table without any; no table gives 0."""
    counts = items.groupBy("table_id", item).agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("table_id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"))
    per_table = tables.select("table_id").join(sizes, "table_id", "left_outer")
    v = F.when(F.col("n") > 1, (F.col("d") - 1) / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(1.0)
    return per_table.agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("variability"))


def rates(checked: DataFrame) -> DataFrame:
    """One row: shares of templates that are well formed and that have at least one true statement.
    checked (syntax_ok, n_statements)."""
    return checked.agg(
        F.bround(F.avg(F.col("syntax_ok").cast("int")), 3).alias("syntax"),
        F.bround(F.avg((F.col("n_statements") > 0).cast("int")), 3).alias("executability"))


def combined_score(checked: DataFrame, skeleton: str) -> DataFrame:
    """One row: distinct skeletons of executable templates, and their mean with the executability in
    percent."""
    runs_ = F.col("n_statements") > 0
    n = F.count_distinct(F.when(runs_, F.col(skeleton)))
    return checked.agg(
        n.alias("n_corpus_templates"), F.bround((n + F.avg(runs_.cast("int")) * 100) / 2, 1).alias("exec_var_mean"))


def best_run(scores: DataFrame, metric: str) -> DataFrame:
    """One row (run, score): the first run with the largest score; runs are ordered by the number in
    their name. scores (run, metric, score)."""
    number = F.regexp_extract("run", r"(\d+)", 1).try_cast("bigint")
    ordered = scores.where(F.col("metric") == metric).select("run", "score", number.alias("k"))
    return ordered.agg(F.max_by(F.struct("run", "score"), F.struct("score", -F.col("k"))).alias("b")).select("b.run", "b.score")


def pair_by_position(preds: DataFrame, rows: DataFrame, position: str = "pos") -> DataFrame:
    """The i-th prediction with the i-th row."""
    return preds.join(rows, position)
