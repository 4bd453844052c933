"""Repeated byte strings, by ranking positions over growing lengths.

Prefix doubling ranks all positions by their first h bytes, then by pairs of ranks at growing offsets, and drops a
position once its rank is its own. Ranking every byte would sort dozens of bytes for each byte of text, so here

* one position stands for a run of neighbours: of the windows of LENGTH bytes that start in a run, each holds the
  same anchor, the leftmost of its grams of least hash. Equal windows have equal anchors at equal offsets.
* a rank is a hash of the string, so that a pair of ranks needs no sort of its own. Every run has a pair: of the
  bytes that all its windows share (``core``) and of the bytes that any of them has (``upper``).

Rounds go on until a run's core is its own (nothing there repeats), or its upper is not (everything there repeats).
Other runs are cut into shorter ones, with longer cores: 32, 337, 393 and at last LENGTH bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import staged

LENGTH = 400
GRAM = 32
# Windows in a run of each round; the first round takes runs as they are.
RUNS = (64, 8, 1)
# Bytes that are hashed by one numpy call; a longer text is taken in overlapping parts.
CHUNK = 1 << 20

_SEED = np.random.default_rng(20240607)
_TABLE = _SEED.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_HIGH = np.uint64(0xFFFFFFFF00000000)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 to the 64."""
    out = []
    for base in (_BASE, _INVERSE):
        p = np.ones(n, dtype=np.uint64)
        filled = 1
        while filled < n:
            m = min(filled, n - filled)
            p[filled : filled + m] = p[:m] * np.uint64(pow(base, filled, 1 << 64))
            filled += m
        out.append(p)
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(v)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = v
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts laid end to end.

    Gives the text's index, the first and last window start, the anchor, and hashes of core and upper.
    """
    none = tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    long = np.flatnonzero(ends - starts >= length)
    if not len(long):
        return none
    n = len(data)
    up, down = _powers(1 << max(n + 1, 2 * CHUNK).bit_length())
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[:n], out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    places = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min((grams & _HIGH) | places, length - gram + 1)
    counts = ends[long] - starts[long] - length + 1
    which = np.repeat(long, counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[which]
    anchor = (least[at] & ~_HIGH).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1])]))
    last = np.append(first[1:], len(at)) - 1
    low, high, a = at[first], at[last], anchor[first]
    span = _mix((sums[high + length] - sums[low]) * down[low])
    upper = _mix(span + np.uint64(0xD6E8FEB86659FD93) * ((a - low) * (length + 1) + (a - high) + 1).astype(np.uint64))
    return which[first], low, high, a, grams[a], upper


def _text_keys(text: Column) -> list[Column]:
    """Two independent hashes: texts with both alike are one text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


_KEY = ["k1", "k2"]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of windows: the text, anchor, offsets of anchor in its first and last window, hashes."""

    def rows(parts: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.array([len(p[3]) for p in parts], dtype=np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        which, low, high, a, core, upper = runs_of(np.concatenate([p[3] for p in parts]), starts, ends)
        shift = np.array([p[2] for p in parts], dtype=np.int64)[which] - starts[which]
        k1, k2 = (np.array([p[i] for p in parts], dtype=np.int64)[which] for i in (0, 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(k1), pa.array(k2), pa.array(a + shift), pa.array((a - high).astype(np.int16)), pa.array((a - low).astype(np.int16)), pa.array(core.view(np.int64)), pa.array(upper.view(np.int64))],
            ["k1", "k2", "anchor", "least", "most", "core", "upper"],
        )

    held: list[tuple[int, int, int, np.ndarray]] = []
    size = 0
    for batch in batches:
        for k1, k2, raw in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["raw"]):
            text = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
            for s in range(0, len(text) - LENGTH + 1, CHUNK):
                part = text[s : s + CHUNK + LENGTH - 1]
                held.append((k1, k2, s, part))
                size += len(part)
                if size >= CHUNK:
                    yield rows(held)
                    held, size = [], 0
    if held:
        yield rows(held)


def _settled(runs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Split runs into those that repeat as a whole and those that need a longer look.

    runs: ``run`` (struct, what the run is), ``core`` (grouped by), ``upper`` (null for a run cut short). A run
    whose core is its own is dropped. Equal uppers repeat; one of them goes on as a witness if others share the
    core. Groups are counted and joined, never listed, so one of any size spreads over tasks.
    """
    shared = runs.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    open_runs = staged(runs.join(shared, "core", "left_semi"), f"repeats-{name}")
    classes = open_runs.where("upper is not null").groupBy("core", "upper").agg(F.count("*").alias("n"), F.min("run").alias("witness"))
    cut = open_runs.where("upper is null").groupBy("core").agg(F.count("*").alias("kinds"))
    kinds = classes.groupBy("core").agg(F.count("*").alias("kinds")).unionByName(cut).groupBy("core").agg(F.sum("kinds").alias("kinds"))
    twins = classes.where("n > 1")
    whole = open_runs.join(twins.select("core", "upper"), ["core", "upper"], "left_semi").select("run")
    alone = open_runs.join(twins.select("core", "upper"), ["core", "upper"], "left_anti").select("core", "run")
    going = alone.unionByName(twins.select("core", F.col("witness").alias("run")))
    return whole, going.join(kinds.where("kinds > 1"), "core", "left_semi").select("run")


def _shorter(runs: DataFrame, size: int, widest: int, length: int) -> DataFrame:
    """Runs cut at multiples of ``size``, with core and upper hashed anew from the bytes around the anchor.

    runs: ``run`` and ``bytes``, the bytes from the first window's start to the last one's end.
    """
    run = F.col("run")
    pieces = F.sequence(F.floor(run["least"] / F.lit(size)).cast("int"), F.floor(run["most"] / F.lit(size)).cast("int"))
    each = runs.select("run", "bytes", F.explode(pieces).alias("piece"))
    x, y = F.col("piece") * size, F.least(F.col("piece") * size + size - 1, F.lit(widest))
    low, high = F.greatest(x, run["least"].cast("int")), F.least(y, run["most"].cast("int"))
    at = run["most"].cast("int")
    core = F.substring(F.col("bytes"), at - x + 1, length - y + x)
    upper = F.substring(F.col("bytes"), at - y + 1, length + y - x)
    whole = (low == x) & (high == y)
    smaller = F.struct(run["k1"].alias("k1"), run["k2"].alias("k2"), run["anchor"].alias("anchor"), low.cast("short").alias("least"), high.cast("short").alias("most"))
    return each.select(smaller.alias("run"), F.xxhash64(F.lit(size), "piece", core).alias("core"), F.when(whole, F.struct(F.xxhash64(upper).alias("u1"), F.xxhash64(F.lit(3), upper).alias("u2"))).alias("upper"))


def _with_bytes(runs: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Runs with their bytes. Each distinct text meets its runs once."""
    of_text = runs.select("run.k1", "run.k2", "run").groupBy(*_KEY).agg(F.collect_list("run").alias("runs"))
    met = texts.join(of_text, _KEY).select("raw", F.explode("runs").alias("run"))
    start = F.col("run.anchor") - F.col("run.most")
    return met.select("run", F.substring("raw", (start + 1).cast("int"), (F.col("run.most") - F.col("run.least") + length).cast("int")).alias("bytes"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``k1``, ``k2`` (keys of a text) and ``spans``: (start, end) in bytes, not merged, of what repeats in it.

    What repeats depends on a text alone, so copies of a text have one row; texts in which nothing repeats none.
    """
    if length != LENGTH:
        raise ValueError("the rounds are laid out for one length")
    raw = F.coalesce(docs["text"], F.lit("")).cast("binary")
    keyed = docs.select(*_text_keys(raw), raw.alias("raw")).where(F.length("raw") >= length)
    texts = keyed.dropDuplicates(_KEY)
    found = keyed.mapInArrow(_anchored, "k1 long, k2 long, anchor long, least short, most short, core long, upper long")
    runs = found.select(F.struct("k1", "k2", "anchor", "least", "most").alias("run"), "core", F.struct(F.col("upper").alias("u1")).alias("upper"))
    widest = length - GRAM
    whole, rest = _settled(staged(runs, "repeats-runs"), "first")
    repeats = [whole]
    for size in RUNS:
        # Fetched anew in each round, for fewer and fewer runs: bytes never go through a shuffle on the way.
        rest = staged(rest, f"repeats-open-{size}")
        whole, rest = _settled(staged(_shorter(_with_bytes(rest, texts, length), size, widest, length), f"repeats-cut-{size}"), f"of-{size}")
        repeats.append(whole)
    spans = None
    for x in repeats:
        part = x.select("run.k1", "run.k2", F.struct((F.col("run.anchor") - F.col("run.most")).alias("start"), (F.col("run.anchor") - F.col("run.least") + length).alias("end")).alias("span")).distinct()
        spans = part if spans is None else spans.unionByName(part)
    return spans.groupBy(*_KEY).agg(F.collect_list("span").alias("spans"))


def _merged(spans: Sequence[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The kept columns of each row as ``doc``, with ``n_bytes``, ``n_removed``, ``n_spans``, ``removed`` (spans) and ``kept_sha256``.

    docs: ``text``, any other columns. Every byte is removed that lies in a string of LENGTH bytes which also starts
    anywhere else in the input, in the same text or another. Null is the empty text; shorter texts keep all; rows
    that repeat lose all if they are long enough. ``removed`` has maximal runs, in bytes, end exclusive.
    """
    keep = docs.columns if keep is None else keep
    raw = F.coalesce(docs["text"], F.lit("")).cast("binary")
    spans = staged(repeated_spans(docs), "repeats-spans")
    texts = docs.select(*_text_keys(raw), raw.alias("raw")).dropDuplicates(_KEY).join(spans, _KEY, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("n_bytes", "n_removed", "removed", "kept_sha256")}
            for text, found in zip(batch["raw"], batch["spans"].to_pylist()):
                data = memoryview(text.as_buffer())
                digest, at, gone = hashlib.sha256(), 0, _merged(found or [])
                for a, b in gone:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                out["n_bytes"].append(len(data))
                out["n_removed"].append(sum(b - a for a, b in gone))
                out["removed"].append([{"start": a, "end": b} for a, b in gone])
                out["kept_sha256"].append(digest.hexdigest())
            removed = pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch["k1"], batch["k2"], pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), removed, pa.array(out["kept_sha256"], pa.string())], ["k1", "k2", "n_bytes", "n_removed", "removed", "kept_sha256"])

    results = texts.mapInArrow(cut, "k1 long, k2 long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("doc"), *_text_keys(raw))
    return rows.join(results, _KEY).select("doc", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "removed", "kept_sha256")


REPEATS_SQL = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
bytes as (select doc_id, hex(encode(t)) as h, octet_length(encode(t)) as n from texts),
windows as (
  select doc_id, unnest(range(0, n - {LENGTH} + 1)) as p, h from bytes where n >= {LENGTH}),
named as (select doc_id, p, md5(substr(h, 2 * p + 1, {2 * LENGTH})) as name from windows),
hits as (select doc_id, p from named qualify count(*) over (partition by name) > 1),
marked as (select doc_id, p, p > lag(p) over (partition by doc_id order by p) + {LENGTH} or lag(p) over (partition by doc_id order by p) is null as fresh from hits),
numbered as (select doc_id, p, sum(fresh::int) over (partition by doc_id order by p) as run from marked),
spans as (select doc_id, run, min(p) as a, max(p) + {LENGTH} as b from numbered group by doc_id, run),
gaps as (select doc_id, a, b, lead(a) over (partition by doc_id order by a) as next, row_number() over (partition by doc_id order by a) as no from spans),
cut as (
  select s.doc_id, sum(b - a) as n_removed, count(*) as n_spans,
    substr(any_value(h), 1, 2 * min(a)) || string_agg(substr(h, 2 * b + 1, 2 * (coalesce(next, n) - b)), '' order by a) as kept
  from gaps s join bytes using (doc_id) group by s.doc_id)
select x.doc_id, x.n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from bytes x left join cut using (doc_id)
"""
