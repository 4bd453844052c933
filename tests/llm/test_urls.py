"""Rules against brute force, the model against a plain Python one, calibration on planted URLs."""

import math
import random

import pytest

from factloom.llm import urls


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    tail = rest[len(host) :]
    path = next((tail[:i] for i, c in enumerate(tail) if c in "?#"), tail)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    best = (None, None)
    for what, text in urls.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and len(text) > len(best[0] or ""):
            best = (text, what)
    return best


def brute_scores(strings):
    """strings: text -> (verdict, half, n)"""
    pad = lambda t: urls.START * urls.ORDER + t + urls.END
    own, whole = {}, {}
    for t, (v, half, n) in strings.items():
        p = pad(t)
        for i in range(urls.ORDER, len(p)):
            for k in range(urls.ORDER + 1):
                for h in (half, 2):
                    own[v, h, k, p[i - k : i + 1]] = own.get((v, h, k, p[i - k : i + 1]), 0) + n
                    whole[v, h, k, p[i - k : i]] = whole.get((v, h, k, p[i - k : i]), 0) + n

    def chance(v, h, gram):
        p = 1 / urls.ALPHABET
        for k in range(urls.ORDER + 1):
            g = gram[len(gram) - k - 1 :]
            p = (own.get((v, h, k, g), 0) + urls.TRUST * p) / (whole.get((v, h, k, g[:-1]), 0) + urls.TRUST)
        return p

    def score(t, h):
        p = pad(t)
        parts = [math.log(chance("allow", h, p[i - urls.ORDER : i + 1])) - math.log(chance("block", h, p[i - urls.ORDER : i + 1])) for i in range(urls.ORDER, len(p))]
        return sum(parts) / len(parts)

    return score


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeo") for _ in range(r.randint(2, 6)))
    rows = ["http://WWW.Example.com/en/x?q#f", "https://example.com/en", "https://example.com/en/a", "http://b.net/es/", "http://net/fr/é", "noscheme", None, "://x.com", "http://a.com?x/y", "http://a.org#z", "ftp://q.net/de/1://2", "http://notexample.com/en/", "http://é.com/", "http://x.com/" + "long/" * 3000]
    for _ in range(150):
        rows.append(f"https://{r.choice(['', 'www.', 'm.'])}{r.choice(['good', 'fine'])}{word()}.{r.choice(['com', 'org'])}/{word()}/{word()}")
        rows.append(f"http://{r.choice(['spam', 'pills'])}{word()}.net/{r.choice(['es', 'fr', 'de'])}/{word()}")
    rows += [rows[2]] * 3
    return rows, spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(rows)], "page_id long, url string, text string, score double").repartition(4)


def test_rules_and_verdicts(pages):
    rows, df = pages
    got = {x.page.page_id: x for x in urls.judge(df).collect()}
    assert len(got) == len(rows)
    for i, u in enumerate(rows):
        host, path = brute_split(u)
        rule, verdict = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
        assert got[i].page.text == "x"
    wrong = [u for i, u in enumerate(rows) if i >= 14 and (got[i].verdict == "allow") != ("good" in (u or "") or "fine" in (u or "")) and "example" not in u]
    assert len(wrong) <= 4, wrong


def test_model_equals_plain_python(spark, pages):
    rows, df = pages
    strings = {}
    for x in df.collect():
        host, path = brute_split(x.url)
        rule, verdict = brute_rule(host, path)
        strings.setdefault(host + path, [verdict, 0])[1] += 1
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(k, t, v, n) for k, (t, (v, n)) in enumerate(strings.items())], "string_no long, text string, verdict string, n long")
    frame = frame.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")).cache()
    given = {x.text: (x.verdict, x.half, x.n) for x in frame.collect() if x.verdict}
    score = brute_scores(given)
    got = {x.string_no: x for x in urls.scores(frame, urls.model(frame.where("verdict is not null"))).collect()}
    for k, t in list(enumerate(strings))[:60]:
        if len(t) < 1000:
            assert got[k].score == pytest.approx(score(t, 2), abs=1e-6)
            assert got[k].score0 == pytest.approx(score(t, 0), abs=1e-6)
            assert got[k].score1 == pytest.approx(score(t, 1), abs=1e-6)


def test_threshold(spark):
    rows = [("allow", 2, 0.5), ("allow", 1, 0.3), ("block", 5, -0.2), ("block", 1, 0.4)]
    assert urls.threshold(spark.createDataFrame(rows, "verdict string, n long, held double")) == pytest.approx(0.3, abs=0.11)
    assert urls.threshold(spark.createDataFrame(rows[:2], "verdict string, n long, held double")) == 0.0


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none).count() == 0
    one = spark.createDataFrame([(1, None), (2, "x://y.org/")], "page_id long, url string")
    assert {x.verdict for x in urls.judge(one).collect()} == {"allow"}
