"""Statistics against brute force, the estimate against numpy, planted outliers."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_statistics(spark):
    r = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x\n\nx\nx ", "a a a a a", "é ß #*$%&|<> \x0b\x0c\r\x1c\x85 y", "w " * 60000, "one two three " * 3 + "end"]
    texts += ["".join(r.choice(["a", "b", "ü", "#"]) + r.choice([" ", "\n", "  ", ""]) for _ in range(r.randint(0, 200))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, None, "s", 3) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")
    got = {x.doc.doc_id: x for x in rules.with_statistics(docs).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(t), repr(t and t[:80])
        assert x.doc.text == t and x.doc.n_words == 3


def test_chi_square():
    assert rules.chi2_point(5, 0.75) == pytest.approx(6.62568, abs=1e-4)
    assert rules.chi2_point(2, 0.95) == pytest.approx(-2 * math.log(0.05))


def numpy_estimate(x):
    """The same concentration steps over one group, x in feature units."""
    floor = np.array(rules.FLOOR)
    centre = np.sort(x, axis=0)[(len(x) + 1) // 2 - 1]
    mad = np.sort(np.abs(x - centre), axis=0)[(len(x) + 1) // 2 - 1]
    cov = np.diag(np.maximum(1.4826 * mad, floor) ** 2)
    distance = lambda: np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    for _ in range(rules.STEPS):
        band = np.floor(rules.FINE * np.log2(1e-6 + distance()))
        values, counts = np.unique(band, return_counts=True)
        taken = values[np.concatenate([[0], np.cumsum(counts)[:-1]]) < rules.CORE * len(x)]
        core = x[np.isin(band, taken)]
        centre = core.mean(axis=0)
        cov = rules.consistency() * np.cov(core.T, bias=True) + np.diag(floor**2)
    return distance()


def test_estimate_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1200):
        n = int(np.exp(rng.normal(6, 0.8))) + 60
        chars = int(n * rng.normal(5, 0.3))
        junk = i % 10 < 3
        rows.append((i, "en" if i % 3 else None, ["a", "b", None][i % 3], n, chars, int(chars * 0.2) if junk else 0, n // 20 if junk else int(rng.integers(0, 2)), int(n * 0.1 * rng.random()), False))
    rows.append((5000, "xx", "rare", 100, 500, 0, 0, 0, False))
    rows.append((5001, "xx", "rare", 10, 50, 0, 0, 0, True))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    got = {x.doc_id: x for x in rules.judged(stats, least_group=300).collect()}
    values = {x.doc_id: [x[f"x{i}"] / 1000 for i in range(5)] for x in stats.select("doc_id", *[f.alias(f"x{i}") for i, f in enumerate(rules.features())]).collect()}
    for source in range(3):
        ids = [i for i in range(1200) if i % 3 == source]
        want = numpy_estimate(np.array([values[i] for i in ids]))
        assert np.allclose([got[i].distance for i in ids], want, rtol=1e-6)
    assert got[5000].distance is not None and got[5001].distance is None and not got[5001].kept
    assert not any(got[i].kept for i in range(1200) if i % 10 < 3)
    assert all(got[i].kept for i in range(1200) if i % 10 >= 3)


def test_small_groups_lean_on_their_language_smoothly(spark):
    rng = np.random.default_rng(2)
    schema = "doc_id long, text string, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"

    def row(i, source, letters):
        n = int(np.exp(rng.normal(6, 0.5))) + 60
        return (i, "", "en", source, n, int(n * rng.normal(letters, 0.2)), 0, 0, 0, False)

    wide, small = [row(i, "wide", 5) for i in range(400)], [row(1000 + i, "small", 9) for i in range(100)]
    probe = (2000, "", "en", "small", 460, 460 * 17 // 2, 0, 0, 0, False)

    def distance(least_group):
        stats = spark.createDataFrame([*wide, *small[:99], probe], schema)
        return {x.doc_id: x.distance for x in rules.judged(stats, least_group=least_group).collect()}[2000]

    # One document less than the number changes little; half of the number leans half on the language.
    full = distance(100)
    assert abs(distance(101) - full) < 0.3 * full
    assert distance(200) > full


def test_documents(spark):
    r = random.Random(0)
    words = [r.choice(["lo", "ri", "tem", "an"]) + r.choice(["sa", "du", "ki"]) + str(k)[:1] for k in range(3000)]
    prose = [" ".join(r.choice(words) for _ in range(r.randint(60, 400))) for _ in range(300)]
    junk = [" ".join(r.choice(words) + r.choice(["###", "%%%"]) for _ in range(200)) for _ in range(20)]
    rows = [(i, t, "en", "s" if i % 2 else "hot", "x") for i, t in enumerate(prose + junk)] + [(900, None, None, None, "x"), (901, "too short", "en", "hot", "x"), (5, prose[5], "en", "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    kept = rules.good(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == sorted([*range(300), 5])
    assert rules.assess(docs.limit(0)).count() == 0
    assert rules.assess(docs.where(F.col("doc_id") >= 900)).where("kept").count() == 0


def test_only_the_joint_vector_explains_a_rejection(spark):
    """Long texts have long words here. A long text with the short words of a short one is usual figure by figure."""
    import math

    shape = lambda n: round(n * (1 + 1.5 * math.log(n)))
    sizes = [round(60 * 1000 ** (i / 399)) for i in range(400)]
    rows = [(i, "en", "s", n, shape(n), 0, 0, 0, False) for i, n in enumerate(sizes)]
    rows.append((999, "en", "s", 50_000, round(50_000 * shape(70) / 70), 0, 0, 0, False))
    stats = spark.createDataFrame(rows, "doc long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    got = {x.doc: x for x in rules.judged(stats).collect()}
    assert not got.pop(999).kept and all(x.kept for x in got.values())
    length = lambda x: x[4] / x[3]
    assert min(sizes) < 50_000 < max(sizes) and min(map(length, rows[:400])) < length(rows[400]) < max(map(length, rows[:400]))
