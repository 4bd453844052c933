"""Web archives: WARC records written and read in parallel, and capture histories by external index merge.

Writers make gzip archives with one member a record. Readers go over pieces of archives and leave runs of captures,
each sorted by (URL key, time). The merge cuts the runs at common borders, deals the pieces by range, and merges
the k pieces of a range with a loser tree, so that the captures of all archives come out in one global order.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import shared_folder, staged
from factloom.llm.tokens import place

# Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
# Compressed bytes after which a writer begins another archive, and after which a reader's piece ends.
ARCHIVE_BYTES = 1 << 30
PIECE_BYTES = 32 << 20
# Captures in a run, in a block of a run, and in a range of the merge: at least and at most.
RUN_ROWS = 65_536
BLOCK_ROWS = 512
LEAST_RANGE, MOST_RANGE = 4_096, 200_000
# Rows of revisits that are broadcast, of 48 bytes each.
FEW_REVISITS = 100_000

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:factloom:page:{}>"
_EPOCH = datetime(1970, 1, 1)
# Microseconds of the years 1 to 9999, and after how many seconds the times made up from page ids begin again.
_TIMES = (-62_135_596_800_000_000, 253_402_300_799_000_000)
_AGAIN = 2_000_000_000
_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))

FILE_SCHEMA = "path string, start long, stop long, records long"
CAPTURE = T.StructType([
    T.StructField("url_key", T.StringType()), T.StructField("captured", T.LongType()), T.StructField("page_id", T.LongType()),
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
])
# What captures are ordered by; the place in the archives parts those that are alike.
ORDER = ("url_key", "captured", "page_id", "path", "offset")


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query: keys of one site lie side by side. Null: empty."""
    rest = (url or "").partition("#")[0]
    scheme, sep, after = rest.partition("://")
    if not sep:
        return rest
    host, path = re.match(r"([^/?]*)(.*)", after, re.S).groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + (path or "/")


def _date(micros: int) -> str:
    return (_EPOCH + timedelta(microseconds=micros)).isoformat(timespec="microseconds") + "Z"


def _micros(date: str) -> int:
    return (datetime.fromisoformat(date.rstrip("Z")) - _EPOCH) // timedelta(microseconds=1)


def _name(page_id: int | None) -> str:
    return RECORD_ID.format("none" if page_id is None else page_id)


def _page_of(name: str) -> int | None:
    last = name.rstrip(">").rpartition(":")[2]
    return None if last == "none" else int(last)


def record(page_id: int | None, url: str | None, captured: int, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC record; without a payload a revisit of ``refers_to``. ``n_bytes`` and ``digest`` are of the full payload."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", _date(captured))]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=_SAFE)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Header fields (lower-case names) and ``block`` of a record; raises ValueError if it is none."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not sep or not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    out: dict = {}
    for line in lines:
        k, _, v = line.partition(b":")
        out[k.decode().strip().lower()] = v.decode().strip()
    size = int(out["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    out["block"] = rest[:size]
    return out


def _http(block: bytes) -> tuple[dict, bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode().strip().lower(): v.decode().strip() for k, _, v in pairs}, payload


def members(source, start: int, stop: int, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an open file that begin from ``start`` on and before ``stop``."""
    source.seek(start)
    at, rest = start, b""
    while at < stop:
        unzip, out, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not rest:
                rest = source.read(chunk)
                if not rest:
                    raise ValueError("a member that ends before its end")
            out.append(unzip.decompress(rest))
            used += len(rest)
            rest = unzip.unused_data
        used -= len(rest)
        yield at, used, b"".join(out)
        at += used


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id``, ``digest`` and ``refers_to`` of the pages whose payload a smaller ``page_id`` has, staged."""
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    read = pages.select(pages["page_id"].cast("long").alias("page_id"), F.when(F.octet_length(payload) >= LEAST_REVISIT, F.unhex(F.sha2(payload, 256))).alias("digest"))
    light = staged(read.where("digest is not null"), "warc-digests")
    many = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    # A payload with very many copies is a hot key on the left; the adaptive plan splits it.
    later = light.join(many, "digest").where("page_id is null or page_id > refers_to")
    return staged(later.groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to")), "warc-revisits")


def write_archives(pages: DataFrame, captured: Column | None = None, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, piece_bytes: int = PIECE_BYTES, level: int = 6) -> DataFrame:
    """Write a record for each row and give the pieces of the archives: ``path``, ``start``, ``stop``, ``records``.

    pages: ``page_id`` (integer), ``url``, ``html``; other columns are not read. ``captured``: the time of a capture;
    without it, and where it is null, ``page_id`` seconds after 1970
    (modulo 2,000 million); times outside of the years 1 to 9999 become the nearest inside. The payload is the html in UTF-8, empty for
    null. Of rows with equal payloads (by SHA-256) of 100 bytes or more those with the smallest ``page_id`` are
    responses, the others revisits without payload; rows without ``page_id`` come last, alone they are responses.
    Repeated rows are a record each. A null url leaves the field out; characters that no field may hold are
    percent-encoded. No pages: no archives. Which pages are revisits is found out from digests and joined back by page, so
    payloads are shuffled only if more than ``FEW_REVISITS`` pages are revisits, and never by payload. An attempt of
    a task writes files of its own; only the pieces that a finished attempt names are read.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/llm-warc-{uuid.uuid4().hex}"
    again = revisits(pages)
    again = F.broadcast(again) if again.count() <= FEW_REVISITS else again.hint("shuffle_hash")
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    page_id = pages["page_id"].cast("long")
    when = F.coalesce(*([F.unix_micros(captured.cast("timestamp"))] if captured is not None else []), F.pmod(page_id, F.lit(_AGAIN)) * 1_000_000, F.lit(0))
    when = F.greatest(F.least(when, F.lit(_TIMES[1])), F.lit(_TIMES[0]))
    read = pages.select(page_id.alias("page_id"), pages["url"].cast("string").alias("url"), when.alias("captured"), payload.alias("payload"), F.sha2(payload, 256).alias("hash"))
    told = read.join(again.withColumnRenamed("page_id", "of"), read["page_id"].eqNullSafe(F.col("of")) & (F.unhex("hash") == F.col("digest")), "left")
    rows = told.select("page_id", "url", "captured", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("n_bytes"), F.col("hash").alias("digest"), "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = place(folder)
        out = None
        pieces: list[tuple[str, int, int, int]] = []
        at = start = n = 0

        def ended() -> None:
            if n:
                pieces.append((f"{folder}/{name}", start, at, n))

        for batch in batches:
            plain = [batch[c].to_pylist() for c in ("page_id", "url", "captured", "n_bytes", "digest", "refers_to")]
            for page, url, time, size, digest, other, raw in zip(*plain, batch["payload"]):
                if out is None:
                    files.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at, start, n = files.open_output_stream(f"{root}/{name}", compression=None), 0, 0, 0
                zipped = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = zipped.compress(record(page, url, time, raw.as_py(), size, digest, other)) + zipped.flush()
                out.write(data)
                at, n = at + len(data), n + 1
                if at - start >= piece_bytes or at >= archive_bytes:
                    ended()
                    start, n = at, 0
                if at >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            ended()
            out.close()
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pieces)], names=["path", "start", "stop", "records"])

    return staged(rows.mapInArrow(write, FILE_SCHEMA), "warc-pieces")


def _captures(path: str, start: int, stop: int) -> Iterator[dict]:
    files, inside = place(path)
    with files.open_input_file(inside) as source:
        for offset, length, content in members(source, start, stop):
            found = parsed(content)
            http, payload = _http(found["block"])
            digest = found["warc-payload-digest"].partition(":")[2]
            revisit = found["warc-type"] == "revisit"
            size = int(http["content-length"])
            if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"the payload of {found['warc-record-id']} in {path} is not the one that was written")
            url = found.get("warc-target-uri")
            yield {
                "url_key": url_key(url), "captured": _micros(found["warc-date"]), "page_id": _page_of(found["warc-record-id"]), "path": path,
                "offset": offset, "length": length, "url": url, "record_type": found["warc-type"],
                "refers_to": _page_of(found["warc-refers-to"]) if revisit else None, "payload_bytes": size, "payload_digest": digest,
            }


def _place(x: dict) -> tuple:
    """What captures are sorted by; a missing ``page_id`` is last."""
    return (x["url_key"], x["captured"], x["page_id"] is None, x["page_id"] or 0, x["path"], x["offset"])


_RUN = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("no", T.IntegerType()), *[f for f in CAPTURE if f.name in ORDER],
    T.StructField("captures", T.ArrayType(CAPTURE)),
])


def capture_runs(pieces: DataFrame, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Read the pieces back: runs of captures sorted by URL key and time, in blocks of ``captures``, staged.

    A row is a block: ``run``, ``no`` (its place in the run), the first capture's key columns, and its captures. A task
    holds one run; payloads are held one at a time and compared with their digest.
    """
    spark = pieces.sparkSession
    types = pa.struct([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in CAPTURE])

    def blocks(held: list[dict]) -> Iterator[pa.RecordBatch]:
        held.sort(key=_place)
        run = uuid.uuid4().hex
        for no, at in enumerate(range(0, len(held), block_rows)):
            part = held[at : at + block_rows]
            first = {c: pa.array([part[0][c]], pa.string() if c in ("url_key", "path") else pa.int64()) for c in ORDER}
            yield pa.RecordBatch.from_pydict({"run": [run], "no": pa.array([no], pa.int32()), **first, "captures": pa.array([part], pa.list_(types))})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for path, start, stop in zip(*(batch[c].to_pylist() for c in ("path", "start", "stop"))):
                for capture in _captures(path, start, stop):
                    held.append(capture)
                    if len(held) >= run_rows:
                        yield from blocks(held)
                        held = []
        if held:
            yield from blocks(held)

    # A piece is one small row; dealt out so that pieces are read side by side.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = pieces.repartition(n, "path", "start").select("path", "start", "stop")
    return staged(dealt.mapInArrow(read, _RUN), "warc-runs")


class LoserTree:
    """The values of sorted sources of (key, value) in one order, one at a time; a step compares along one path from a leaf to the root.

    Inner nodes hold the loser of their match, ``top`` the winner. A source that has ended loses against all.
    """

    def __init__(self, sources: Sequence[Iterator[tuple]]):
        self.sources = list(sources)
        k = len(self.sources)
        self.heads = [next(s, None) for s in self.sources]
        self.losers = [0] * max(k, 1)
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.top = winners[1] if k else -1

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x[0] <= y[0]

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.sources)
        while k and self.heads[self.top] is not None:
            s = self.top
            yield self.heads[s]
            self.heads[s] = next(self.sources[s], None)
            node = (s + k) // 2
            while node:
                if not self._first(s, self.losers[node]):
                    s, self.losers[node] = self.losers[node], s
                node //= 2
            self.top = s


def _borders(runs: DataFrame, n: int) -> list[tuple]:
    """``n`` - 1 places between ranges of about as many blocks each; one row a range comes to the driver."""
    if n < 2:
        return []
    columns = [F.col("url_key"), F.col("captured"), F.col("page_id").asc_nulls_last(), F.col("path"), F.col("offset")]
    whole = F.struct("url_key", "captured", F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "path", "offset")
    dealt = runs.select(*ORDER).repartitionByRange(n, *columns)
    least = dealt.select(F.spark_partition_id().alias("part"), whole.alias("at")).groupBy("part").agg(F.min("at").alias("at"))
    return sorted(tuple(r["at"]) for r in least.select("at").collect())[1:]


def merged_captures(runs: DataFrame, least_range: int = LEAST_RANGE, most_range: int = MOST_RANGE) -> DataFrame:
    """All captures in one order of URL key and time: ``range``, ``at`` (place in the range) and the capture's columns.

    Ranges follow each other in the order of their numbers, so (``range``, ``at``) is the global order; captures that
    are alike in key and time are ordered by ``page_id`` (none last) and place in the archives. Borders lie between single captures, so a
    URL of any number of captures falls into as many ranges as it needs. Blocks of runs are cut at the borders and
    shuffled; a task merges the pieces of one range after the other and decodes one block of each run at a time.
    """
    spark = runs.sparkSession
    total = runs.agg(F.coalesce(F.sum(F.size("captures")), F.lit(0))).first()[0]
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-total // most_range), min(wide, -(-total // least_range)))
    # About one key a range: 2,000 million captures have 10,000 of them.
    borders = spark.sparkContext.broadcast(_borders(runs, n))
    cut_schema = T.StructType([T.StructField("range", T.IntegerType()), *_RUN.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = borders.value
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                captures = one["captures"].flatten()
                keys = [captures.field(c).to_pylist() for c in ORDER]
                places = [(k, t, p is None, p or 0, f, o) for k, t, p, f, o in zip(*keys)]
                a = 0
                while a < len(places):
                    no = bisect_right(at, places[a])
                    b = len(places) if no == len(at) else a + _before(places[a:], at[no])
                    part = captures.slice(a, b - a)
                    first = [part.field(c).slice(0, 1) for c in ORDER]
                    lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([part]))
                    yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), one["run"], one["no"], *first, lists], names=cut_schema.fieldNames())
                    a = b

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, {}
        for batch in batches:
            for i, (no, run) in enumerate(zip(batch["range"].to_pylist(), batch["run"].to_pylist())):
                if no != number and held:
                    yield from _merge(number, held)
                    held = {}
                number = no
                held.setdefault(run, []).append(batch["captures"].slice(i, 1).flatten())
        if held:
            yield from _merge(number, held)

    pieces = runs.mapInArrow(cut, cut_schema).repartition(n, "range").sortWithinPartitions("range", "run", "no")
    return pieces.mapInArrow(merge, T.StructType([T.StructField("range", T.IntegerType()), T.StructField("at", T.LongType()), *CAPTURE.fields]))


def _before(places: list[tuple], border: tuple) -> int:
    """How many of the sorted places lie before the border."""
    return next((i for i, p in enumerate(places) if p >= border), len(places))


def _merge(number: int, held: dict[str, list[pa.StructArray]]) -> Iterator[pa.RecordBatch]:
    """One range: the blocks of its runs through a loser tree."""

    def values(blocks: list[pa.StructArray]) -> Iterator[tuple]:
        for block in blocks:
            for x in block.to_pylist():
                yield _place(x), x

    names = [f.name for f in CAPTURE]
    out: list[dict] = []
    done = 0
    for _, x in LoserTree([values(blocks) for blocks in held.values()]):
        out.append(x)
        if len(out) == 10_000:
            yield _rows(number, done, out, names)
            done, out = done + len(out), []
    if out:
        yield _rows(number, done, out, names)


def _rows(number: int, done: int, out: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {f.name: pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in CAPTURE}
    columns = {c: pa.array([x[c] for x in out], kinds[c]) for c in names}
    return pa.RecordBatch.from_pydict({"range": pa.array([number] * len(out), pa.int32()), "at": pa.array(range(done, done + len(out)), pa.int64()), **columns})


def history(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """Archives written, read back and merged: every capture of ``pages`` in global order (see ``merged_captures``)."""
    return merged_captures(capture_runs(write_archives(pages, captured)))


# What the records of the table ``pages`` must say, by SQL.
WARC_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to
FROM q
"""
