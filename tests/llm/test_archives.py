"""Archives: exact round trip, revisits, damaged records, and the merged order against a sort."""

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import archives as A

PAGES = "page_id long, url string, html string, path string, digest string, captured string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], PAGES)


def sample(seed=1, n=300):
    r = random.Random(seed)
    hosts = ["a.example.com", "B.example.com", "example.org", "münchen.de"]
    text = lambda: "é" + "".join(r.choice("abc <>\r\n") for _ in range(r.randint(0, 300)))
    rows = [(i, f"http://{r.choice(hosts)}/{r.randint(0, 5)}?q={r.randint(0, 3)}#f", text()) for i in range(n)]
    # Copies of two payloads, one long and one too short to be revisited.
    rows += [(n + i, "http://example.org/hot", "copy " * 50) for i in range(n // 2)] + [(2 * n + i, "http://example.org/hot", "short") for i in range(5)]
    rows += [(-3, None, "copy " * 50), (None, "no scheme", "copy " * 50), (None, "http://x\r\ny z/", None), (5_000_000_000_000, "http://long/", "z" * 3_000_000)]
    return rows + rows[:4]


def want(rows):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        least = min(same, default=None)
        again = len(raw) >= 100 and least is not None and (page is None or page > least)
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least if again else None))
    return sorted(out, key=str)


def test_round_trip_in_global_order(spark):
    rows = sample()
    pieces = A.write_archives(pages(spark, rows).repartition(3), archive_bytes=20_000, piece_bytes=3_000)
    assert pieces.count() > 20
    runs = A.capture_runs(pieces, run_rows=40, block_rows=7)
    found = A.merged_captures(runs, least_range=30, most_range=100).collect()
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in found), key=str) == want(rows)
    found.sort(key=lambda x: (x.range, x["at"]))
    keys = [(x.url_key, x.captured, x.page_id is None, x.page_id or 0, x.path, x.offset) for x in found]
    assert keys == sorted(keys) and len({x.range for x in found}) > 3
    assert [x["at"] for x in found if x.range == 1] == list(range(sum(x.range == 1 for x in found)))


def test_captured_times(spark):
    rows = [(1, "http://a/", "x"), (2, "http://a/", "y"), (3, "http://a/", "z")]
    when = F.when(F.col("page_id") == 1, F.lit("2020-05-05 01:02:03.5")).when(F.col("page_id") == 2, F.lit("0001-01-01")).cast("timestamp")
    found = {x.page_id: x.captured for x in A.history(pages(spark, rows), when).collect()}
    assert found[1] == 1_588_640_523_500_000 and found[3] == 3_000_000 and found[2] == A._TIMES[0]
    far = pages(spark, rows[:1])
    assert A.history(far, F.timestamp_seconds(F.lit(10**12))).first().captured == A._TIMES[1]


def test_no_pages(spark):
    assert A.history(pages(spark, [])).collect() == []


def test_many_revisits_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(A, "FEW_REVISITS", 3)
    rows = sample(2, 40)
    found = A.history(pages(spark, rows)).collect()
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in found), key=str) == want(rows)


def test_records_are_standard_and_damage_is_found():
    data = A.record(7, "http://a b/é", 0, b"<p>", 3, hashlib.sha256(b"<p>").hexdigest(), None)
    got = A.parsed(data)
    assert got["warc-type"] == "response" and got["warc-target-uri"] == "http://a%20b/%C3%A9" and got["warc-date"] == "1970-01-01T00:00:00.000000Z"
    assert data.startswith(b"WARC/1.1\r\n") and got["block"].endswith(b"\r\n\r\n<p>")
    for bad in (data[:-1], b"HTTP" + data, data.replace(b"<p>", b"<pp>")):
        with pytest.raises(ValueError):
            A.parsed(bad)
    zipped = gzip.compress(data) + gzip.compress(b"two") + gzip.compress(b"")
    assert [c for _, _, c in A.members(io.BytesIO(zipped), 0, len(zipped), chunk=5)] == [data, b"two", b""]
    with pytest.raises(ValueError):
        list(A.members(io.BytesIO(zipped[:-3]), 0, len(zipped)))


def test_a_changed_payload_is_found(tmp_path):
    path = tmp_path / "x.warc.gz"
    path.write_bytes(gzip.compress(A.record(1, None, 0, b"abc", 3, hashlib.sha256(b"abd").hexdigest(), None)))
    with pytest.raises(ValueError, match="not the one"):
        list(A._captures(str(path), 0, path.stat().st_size))


def test_url_keys():
    assert A.url_key("HTTP://WWW.Example.com:80/A?b#c") == "com:80,example,www)/A?b"
    assert A.url_key("http://example.com") == "com,example)/" and A.url_key(None) == "" and A.url_key("plain#x") == "plain"
    assert A.url_key("http://a.b?x=//") == "b,a)?x=//"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 64])
def test_loser_tree(k):
    r = random.Random(k)
    lists = [sorted(((r.randint(0, 50), i, j), None) for j in range(r.choice([0, 1, 5, 40]))) for i in range(k)]
    assert list(A.LoserTree([iter(x) for x in lists])) == sorted(x for y in lists for x in y)
