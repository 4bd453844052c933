"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds the word sequences of a block of items. A document streams through it word by word; the state
and the length of the longest match say which windows of items end at a word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words in a window; an item with fewer words is one window.
WINDOW = 10
# UTF-8 bytes of items that are broadcast at once; more items are taken in blocks, one after the other.
BLOCK_BYTES = 8 << 20

# A-Z become small, digits, small letters and all bytes of other scripts stay, the rest parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return (raw or b"").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over the words of items, with the windows each state stands for."""

    def __init__(self, items: Sequence[tuple[str | None, Sequence[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        # By state: the items that have the window, for windows of full size and for whole short items.
        self.full: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, set]]] = {}
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        self.shortest = min((min(window, len(c)) for _, c in coded), default=0)
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        for name, codes in coded:
            self._mark(name, codes)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        # The ancestor whose texts include the last ``window`` words of a match, and the next state with a short item.
        self.at_window = list(range(len(self.length)))
        self.short_at = [-1] * len(self.length)
        for v in order:
            up = self.link[v]
            if self.length[up] >= window:
                self.at_window[v] = self.at_window[up]
            self.short_at[v] = v if v in self.short else self.short_at[up] if up >= 0 else -1
        pairs = {a * len(self.ids) + b for _, codes in coded for a, b in zip(codes, codes[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of ``q`` for the texts that are one word longer than those of ``p``."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _mark(self, name: str | None, codes: list[int]) -> None:
        size = min(self.window, len(codes))
        v = 0
        for i, c in enumerate(codes):
            v = self.next[v][c]
            while self.length[self.link[v]] >= size:
                v = self.link[v]
            if i + 1 < size:
                continue
            if size == self.window:
                self.full.setdefault(v, set()).add(name)
            else:
                kept = self.short.setdefault(v, [])
                for m, names in kept:
                    if m == size:
                        names.add(name)
                        break
                else:
                    kept.append((size, {name}))

    def scan(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Merged hit runs of words (start, end), the items met, and the longest match."""
        n = len(words)
        if not n or not self.ids:
            return [], set(), 0
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=n)
        known = codes >= 0
        # A window needs each of its words and neighbouring pairs in the items: only such runs can hold one.
        joined = known[:-1] & known[1:]
        if len(self.pairs) and joined.any():
            pair = codes[:-1] * len(self.ids) + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined &= self.pairs[at] == pair
        else:
            joined[:] = False
        breaks = np.flatnonzero(~joined) + 1
        starts, ends = np.concatenate([[0], breaks]), np.concatenate([breaks, [n]])
        worth = (ends - starts >= self.shortest) & known[starts]
        hits: list[tuple[int, int]] = []
        items: set = set()
        longest = int((ends - starts)[known[starts]].max(initial=0) > 0)
        for a, b in zip(starts[worth].tolist(), ends[worth].tolist()):
            longest = max(longest, self._run(codes[a:b].tolist(), a, hits, items))
        return hits, items, longest

    def _run(self, codes: list[int], offset: int, hits: list[tuple[int, int]], items: set) -> int:
        nexts, link, length, window = self.next, self.link, self.length, self.window
        v = matched = longest = 0
        for i, c in enumerate(codes, offset + 1):
            while v and c not in nexts[v]:
                v = link[v]
                matched = length[v]
            v = nexts[v].get(c, 0)
            matched = matched + 1 if v else 0
            longest = max(longest, matched)
            reach = 0
            if matched >= window:
                reach = window
                found = self.full.get(self.at_window[v])
                if found:
                    items |= found
            s = self.short_at[v]
            while s >= 0:
                for m, names in self.short.get(s, ()):
                    if m <= matched:
                        items |= names
                        reach = max(reach, m)
                s = self.short_at[link[s]] if link[s] >= 0 else -1
            if reach:
                start = i - reach
                while hits and start <= hits[-1][1]:
                    start = min(start, hits.pop()[0])
                hits.append((start, i))
        return longest


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a text start and end."""
    inside = np.frombuffer(raw.translate(_TABLE), dtype=np.uint8) != 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def char_spans(raw: bytes, runs: Sequence[tuple[int, int]]) -> list[dict]:
    """Runs of words as spans of code points, end exclusive."""
    if not runs:
        return []
    starts, ends = word_places(raw)
    # Code points up to each byte: all bytes but those that continue one.
    upto = np.concatenate([[0], np.cumsum(np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80)])
    return [{"start": int(upto[starts[a]]), "end": int(upto[ends[b - 1]])} for a, b in runs]


def without_runs(raw: bytes, runs: Sequence[tuple[int, int]]) -> bytes:
    """A text without runs of words; what remains around a run is joined as it stands."""
    starts, ends = word_places(raw)
    at, out = 0, []
    for a, b in runs:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]])


# The automaton a worker built last: its tasks share it.
_BUILT: dict[str, Automaton] = {}


def _automaton(key: str, shared, window: int) -> Automaton:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton([(name, words_of(raw)) for name, raw in shared.value], window)
    return _BUILT[key]


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of about ``block_bytes``; the driver holds one block at a time.

    The number of blocks follows the total size, so a benchmark of any size is used whole; only one item that is
    larger than a block by itself makes a larger block.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("raw")).where("raw is not null")
    total = items.agg(F.sum(F.length("raw"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for i in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(n)) == i)
        yield [(r.item_id, bytes(r.raw)) for r in rows.distinct().collect()]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
LEAKS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", _SPANS),
    T.StructField("spans", _SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()),
])


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, rest: bool = False) -> DataFrame:
    """Each row of ``docs`` as the struct ``doc``, and ``leak``: words, hit runs (of words; as spans of code points),
    items met, longest match. With ``rest`` also the text without the hit runs (null if there are none).

    docs: ``text``, any other columns. benchmark: ``item_id``, ``text``. Words are runs of digits, letters and
    characters beyond ASCII, A-Z lower-cased. A run is made of words inside occurrences of item windows. Null
    and empty texts have no words; items without words match nothing; an item without id counts for hits only.
    Items with the same id are one item. Rows are kept as they are, repeated ones too. No shuffle: blocks of
    items follow each other in one pass over the documents.
    """
    schema = T.StructType([T.StructField("doc", docs.schema), T.StructField("raw", T.BinaryType()), T.StructField("leak", LEAKS), T.StructField("rest", T.BinaryType())])
    spark = docs.sparkSession
    names = [docs[f"`{c}`"] for c in docs.columns]
    out = docs.select(F.struct(*names).alias("doc"), docs["text"].cast("binary").alias("raw"), F.lit(None).cast(LEAKS).alias("leak"), F.lit(None).cast("binary").alias("rest"))
    for block in item_blocks(benchmark, block_bytes):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                machine = _automaton(key, shared, window)
                found, left = [], []
                for raw, before in zip(batch["raw"], batch["leak"].to_pylist()):
                    text = raw.as_py() or b""
                    words = words_of(text)
                    runs, items, longest = machine.scan(words)
                    if before is not None and before["runs"]:
                        runs = _merged([*runs, *((x["start"], x["end"]) for x in before["runs"])])
                    items = {x for x in items if x is not None} | set(before["items"] if before else ())
                    found.append({"n_words": len(words), "runs": [{"start": a, "end": b} for a, b in runs], "spans": char_spans(text, runs), "items": sorted(items), "longest": max(longest, before["longest"] if before else 0)})
                    left.append(without_runs(text, runs) if rest and runs else None)
                yield pa.RecordBatch.from_arrays([batch["doc"], batch["raw"], pa.array(found, batch.schema.field("leak").type), pa.array(left, batch.schema.field("rest").type)], schema=batch.schema)

        out = out.mapInArrow(scan, schema)
    return out.select("doc", "leak", *([F.col("rest").cast("string").alias("rest")] if rest else []))


def n_hit(leak: str = "leak"):
    """Hit words of a document."""
    return F.aggregate(f"{leak}.runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_covered: float = 0.5) -> DataFrame:
    """``docs`` with hit runs cut out of ``text``; a document whose words are hit to more than ``most_covered`` goes.

    Columns and clean rows stay as they are. What remains around a cut is joined as it stands.
    """
    found = find_leaks(docs, benchmark, window, rest=True)
    kept = found.where((F.size("leak.runs") == 0) | (n_hit() <= most_covered * F.col("leak.n_words")))
    clean = F.when(F.size("leak.spans") == 0, F.col("doc.text")).otherwise(F.col("rest"))
    return kept.select(*[clean.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
