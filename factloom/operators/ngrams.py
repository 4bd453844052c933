"""Frequent 1-3-grams of a text column and containment of token runs, per table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import CLEAN_WORD, CLEAN_WORDS, STOP_WORDS, run_text, tokens
from factloom.keyed import KeyedTable
from factloom.plans.ranking import join_on
from factloom.session import stored

MAX_N = 3


def distinct_texts(t: KeyedTable, col: str) -> DataFrame:
    """(by, txt, cnt, words): distinct original texts, so that copies of a cell are read once."""
    return (
        t.df.select(*t.by, t.text(col).alias("txt"), t.weighed())
        .groupBy(*t.by, "txt")
        .agg(F.sum("__rows").alias("cnt"))
        .withColumn("words", tokens(F.col("txt")))
    )


def _triples(words: Column) -> Column:
    """(w1, w2, w3) at every token: it and the two after it, null behind the end."""
    after = lambda n: F.slice(words, n, F.size(words))
    return F.arrays_zip(words.alias("w1"), after(2).alias("w2"), after(3).alias("w3"))


def _gram_rows(texts: DataFrame, *keep: str) -> DataFrame:
    """(keep, n, gram, first): every occurrence of a gram; ``first`` is 1 at one occurrence in each text.

    The tokens of a text are sorted with the two after them inside its row. Equal grams of every length are neighbours
    then, so one look back marks the first of them and no text needs a grouping of its own.
    """
    names = [f"w{i}" for i in range(1, MAX_N + 1)]
    ordered = texts.select(*keep, F.sort_array(_triples(F.col("words"))).alias("__s"))
    before = F.concat(F.array(F.lit(None).cast(ordered.schema["__s"].dataType.elementType)), F.col("__s"))
    places = ordered.select(*keep, F.inline(F.arrays_zip("__s", before.alias("__b")))).where(F.col("__s").isNotNull())
    grams, same = [], F.lit(True)
    for n in range(1, MAX_N + 1):
        same = same & F.col(f"__s.w{n}").eqNullSafe(F.col(f"__b.w{n}"))
        gram = F.concat(*[x for w in names[:n] for x in (F.lit(" "), F.col(f"__s.{w}"))][1:])
        grams.append(F.struct(F.lit(n).alias("n"), gram.alias("gram"), (~same).cast("int").alias("first")))
    return places.select(*keep, F.inline(F.array(*grams))).where(F.col("gram").isNotNull())


def _counted(by: list[str], texts: DataFrame) -> DataFrame:
    return (
        _gram_rows(texts, *by, "cnt")
        .groupBy(*by, "n", "gram")
        .agg(
            F.sum("cnt").alias("freq"),
            F.sum("first").alias("n_texts"),
            F.sum(F.col("cnt") * F.col("first")).alias("n_rows"),
        )
    )


def ngram_counts(t: KeyedTable, col: str) -> DataFrame:
    """(by, n, gram, freq, n_texts, n_rows): occurrences, distinct texts and rows with the gram."""
    return _counted(t.by, distinct_texts(t, col))


def _repeated(min_freq: int) -> Column:
    # n_rows >= n_texts always holds; naming all counts keeps them in every branch of a plan, so that
    # the branches share one shuffle of the counts
    return (F.col("freq") >= min_freq) & (F.col("n_texts") > 1) & (F.col("n_rows") >= F.col("n_texts"))


def clean_ngrams(counts: DataFrame, min_freq: int = 3) -> DataFrame:
    """Only letters and digits, no stop word, at least ``min_freq`` occurrences, in several texts."""
    words = tokens(F.col("gram"))
    # a lookup for each token: an overlap of arrays would hash all stop words anew for every gram
    stop = reduce(or_, [F.coalesce(F.get(words, F.lit(i)).isin(STOP_WORDS), F.lit(False)) for i in range(MAX_N)])
    return counts.where(_repeated(min_freq) & F.col("gram").rlike(CLEAN_WORDS) & ~stop)


def clean_counts(t: KeyedTable, col: str, min_freq: int = 3) -> DataFrame:
    """``clean_ngrams`` of ``ngram_counts``: a token that no clean gram has is looked at once, before it is written into
    grams, and empty from there on, so that grams with it are neither built nor shuffled."""
    clean = F.transform("words", lambda w: F.when(w.rlike(CLEAN_WORD) & ~w.isin(STOP_WORDS), w))
    return _counted(t.by, distinct_texts(t, col).withColumn("words", clean)).where(_repeated(min_freq))


def _n() -> Column:
    """``n`` for a condition that stays above the counts, whose one shuffle all branches share."""
    return F.when(F.col("freq") > 0, F.col("n"))


def _pieces(by: list[str], split: DataFrame) -> DataFrame:
    """(by, word, inside, ends, starts): the shorter grams of one token inside each token of a longer gram, the tokens that
    begin a shorter gram of two among its ends, and those that end one among its starts.

    Looked up by equality over distinct tokens, which are far fewer than grams, and only at lengths that are met.
    """
    short = split.where(_n() < MAX_N)
    last = F.element_at("words", -1)
    kinds = F.when(F.col("n") == 1, F.array(F.struct(F.lit("inside").alias("kind"), last.alias("piece")))).otherwise(
        F.array(F.struct(F.lit("ends").alias("kind"), F.element_at("words", 1).alias("piece")), F.struct(F.lit("starts").alias("kind"), last.alias("piece"))))
    known = short.select(*by, F.inline(kinds)).distinct()
    lengths = known.agg(F.array_sort(F.collect_set(F.length("piece")))).scalar()
    words = split.where(_n() > 1).select(*by, F.explode("words").alias("word")).distinct()
    word, size = F.col("word"), F.col("size")
    sized = words.select(*by, "word", F.explode(lengths).alias("size")).where(size <= F.length(word))
    every = F.transform(F.sequence(F.lit(1), F.length(word) - size + 1), lambda at: F.struct(F.lit("inside").alias("kind"), F.substring(word, at, size).alias("piece")))
    outer = F.array(F.struct(F.lit("ends").alias("kind"), F.right(word, size).alias("piece")), F.struct(F.lit("starts").alias("kind"), F.left(word, size).alias("piece")))
    listed = sized.select(*by, "word", F.inline(F.array_distinct(F.concat(every, outer))))
    found = join_on(listed, known, [*by, "kind", "piece"])
    return found.groupBy(*by, "word").agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("piece"))).alias(k) for k in ("inside", "ends", "starts")])


def drop_explained(by: list[str], grams: DataFrame) -> DataFrame:
    """Drop a gram that is part of the text of a gram with one more token and the same frequency.

    A gram of one token lies inside a token of the longer one; a gram of two lies over a joint of it: its first token
    is an end of the token before the joint, its second a start of the one behind. So longer grams list what the
    pieces of their tokens allow (``_pieces``), and those few texts are looked up by equality.
    """
    split = grams.withColumn("words", tokens(F.col("gram")))
    pieces = _pieces(by, split)
    joint = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda at: F.struct(F.element_at("words", at).alias("left"), F.element_at("words", at + 1).alias("right")))
    joints = split.where(_n() > 1).select(*by, (F.col("n") - 1).alias("n"), "freq", F.inline(joint))
    side = lambda name, *kept: pieces.select(*by, F.col("word").alias(name), *[F.col(k).alias(f"{name}_{k}") for k in kept])
    known = join_on(join_on(joints, side("left", "inside", "ends"), [*by, "left"], "left_outer"), side("right", "inside", "starts"), [*by, "right"], "left_outer")
    none = F.array().cast("array<string>")
    lists = {k: F.coalesce(F.col(k), none) for k in ("left_inside", "right_inside", "left_ends", "right_starts")}
    over = F.flatten(F.transform(lists["left_ends"], lambda a: F.transform(lists["right_starts"], lambda b: F.concat(a, F.lit(" "), b))))
    texts = F.when(F.col("n") == 1, F.concat(lists["left_inside"], lists["right_inside"])).otherwise(over)
    listed = known.select(*by, "n", "freq", F.explode(texts).alias("gram"))
    return join_on(grams, listed.distinct(), [*by, "n", "freq", "gram"], "left_anti")


def frequent_ngrams(t: KeyedTable, col: str) -> DataFrame:
    """Frequent n-grams of a column, without those explained by a longer one. Their counts, which are looked at several
    times, are written once."""
    return drop_explained(t.by, stored(clean_counts(t, col), "ngram-counts"))


def text_id(txt: Column) -> Column:
    """Two hashes that stand for a text where the text itself would be repeated."""
    return F.struct(F.xxhash64(txt).alias("h1"), F.xxhash64(F.lit(7), txt).alias("h2"))


def _places(df: DataFrame, at: str, *keep: str) -> DataFrame:
    """(keep, at, run): the places of the runs of three tokens; a run is known by its hash alone."""
    placed = df.select(*keep, F.posexplode(_triples(F.col("words"))).alias(at, "__w")).where(F.col("__w.w3").isNotNull())
    return placed.select(*keep, at, F.xxhash64("__w.w1", "__w.w2", "__w.w3").alias("run"))


def _long_containment(t: KeyedTable, base: DataFrame, candidates: DataFrame) -> DataFrame:
    """(by, candidate_id, txt_id, cnt) of candidates of more than three tokens.

    Every candidate is looked for by the rarest of its three-token runs, at the places of that run. Places and runs are
    numbers and ids; texts are fetched once, by id, and compared at the places found.
    """
    places = _places(base, "place", *t.by, "txt_id", "size")
    rarity = places.groupBy(*t.by, "run").agg(F.count(F.lit(1)).alias("n"))
    runs_of = _places(candidates, "at", *t.by, "candidate_id", "size")
    # a run that no text has rules its candidate out
    anchors = (
        join_on(runs_of, rarity, [*t.by, "run"], "left_outer").groupBy(*t.by, "candidate_id", "size")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "run")).alias("a")).where("a.n > 0")
        .select(*t.by, "candidate_id", F.col("size").alias("length"), "a.at", "a.run")
    )
    start = F.col("place") - F.col("at") + 1
    met = join_on(places, anchors, [*t.by, "run"]).where((start >= 1) & (start + F.col("length") - 1 <= F.col("size")))
    hits = join_on(met.select(*t.by, "candidate_id", "length", "txt_id", start.alias("start")), base.select(*t.by, "txt_id", "cnt", "words"), [*t.by, "txt_id"])
    same = text_id(run_text(F.col("words"), F.col("start"), F.col("length"))) == F.col("candidate_id")
    return hits.where(same).select(*t.by, "candidate_id", "txt_id", "cnt").distinct()


def _identified(t: KeyedTable, col: str) -> DataFrame:
    # The condition, which always holds, keeps the count in every use of the texts, so that they share one shuffle.
    return distinct_texts(t, col).where("cnt > 0").select("*", text_id(F.col("txt")).alias("txt_id"), F.size("words").alias("size"))


def _sized(t: KeyedTable, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of up to three tokens, and longer ones with an id."""
    sized = candidates.withColumn("words", tokens(F.col("candidate"))).withColumn("size", F.size("words"))
    return sized.where(F.col("size") <= MAX_N), sized.where(F.col("size") > MAX_N).withColumn("candidate_id", text_id(F.col("candidate")))


def containment(t: KeyedTable, col: str, candidates: DataFrame) -> DataFrame:
    """(by, candidate, txt_id, cnt): distinct texts that contain a candidate as a run of whole tokens, of
    any number of tokens, and the rows that have them. Candidates are read several times, so they are written once."""
    base = _identified(t, col)
    short, longer = _sized(t, stored(candidates, "ngram-candidates"))
    listed = _gram_rows(base, *t.by, "txt_id", "cnt").where("first = 1").withColumnRenamed("gram", "candidate")
    few = join_on(listed, short.select(*t.by, "candidate"), [*t.by, "candidate"]).select(*t.by, "candidate", "txt_id", "cnt")
    long = join_on(_long_containment(t, base, longer), longer.select(*t.by, "candidate_id", "candidate"), [*t.by, "candidate_id"])
    return few.unionByName(long.select(*t.by, "candidate", "txt_id", "cnt"))


def containment_counts(t: KeyedTable, col: str, candidates: DataFrame) -> DataFrame:
    """(by, candidate, n_rows): rows whose text contains the candidate as a run of whole tokens.

    Candidates of up to three tokens are n-grams themselves, so their rows are known from the n-gram
    counts. A longer one is looked up by the rarest of its three-token runs and compared in full at
    the place that run points to.
    """
    short, longer = _sized(t, candidates)
    few = join_on(
        short.select(*t.by, F.col("size").alias("n"), F.col("candidate").alias("gram")),
        ngram_counts(t, col).select(*t.by, "n", "gram", "n_rows"),
        [*t.by, "n", "gram"],
    ).select(*t.by, F.col("gram").alias("candidate"), "n_rows")
    counts = _long_containment(t, _identified(t, col), longer).groupBy(*t.by, "candidate_id").agg(F.sum("cnt").alias("n_rows"))
    long = join_on(longer.select(*t.by, "candidate_id", "candidate"), counts, [*t.by, "candidate_id"]).select(*t.by, "candidate", "n_rows")
    return few.unionByName(long)
