"""Ranked lexical search: the best documents of every item, by a dual-tree search.

An item is a vector of term weights, a document a vector of term impacts; a score is their inner product. Items are
held by a tree, and so are the documents of each batch; a node knows the largest value of every coordinate below
it. The product of two nodes' maxima bounds every score between their items and documents, so a pair of nodes
whose bound is below the weakest kth score of its items is left out whole, without an error.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import staged
from factloom.llm.leaks import _TABLE as WORD_BYTES

# Fixed values of the score.
SPREAD = 90
SCALE = 1_000_000_000
TOP = 10

# UTF-8 bytes of items that are searched for in one pass; more items are taken in blocks, one after the other.
BLOCK_BYTES = 8 << 20
# A text is cut into pieces of about this many bytes, at blanks, when its words are counted.
PIECE = 4 << 20
# Numbers in the matrix of one batch of documents, and the fewest and most documents of a batch.
CELLS = 2 << 20
LEAST_BATCH, MOST_BATCH = 32, 4096
LEAF_ITEMS, LEAF_DOCS = 8, 32
# One of this many documents is searched first: its kth scores are floors of the true ones.
FIRST = 32
# Whole numbers up to here are exact in doubles, in any order of summation.
EXACT = 1 << 53
# Groups by which the rows of an item are ranked before they meet.
SALTS = 64

_NO_ID = np.iinfo(np.int64).max


def term_counts(raw: bytes, known: Mapping[bytes, int]) -> tuple[int, dict[int, int]]:
    """Number of terms of a UTF-8 text, and how often it has each known one."""
    raw = raw.translate(WORD_BYTES)
    n, at, out = 0, 0, Counter()
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        words = raw[at:end].split()
        counts = Counter(words)
        n, at = n + len(words), end
        out.update({known[w]: counts[w] for w in counts.keys() & known.keys()})
    return n, out


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Coordinates of documents: what each occurrence count is worth in a document of ``n`` terms."""
    m = 100 - SPREAD + (SPREAD * n * n_docs) // n_terms
    return (SCALE * tf) // (1000 * tf + 8 * m)


class ItemTree:
    """Hierarchy over items. An item is its terms; the weight of a term is the same in all items.

    Node 0 is the root, children follow their parent. ``terms`` of a node: all terms below it, so the largest
    value of a coordinate is the term's weight for those and zero for the others.
    """

    def __init__(self, items: Sequence[np.ndarray], weight: np.ndarray):
        self.items, self.weight = items, weight
        self.terms: list[np.ndarray] = []
        self.below: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.parent: list[int] = []
        todo = [(np.arange(len(items)), -1)]
        while todo:
            members, parent = todo.pop()
            node = len(self.below)
            held = np.unique(np.concatenate([items[i] for i in members])) if len(members) else np.empty(0, np.int64)
            self.terms.append(held)
            self.below.append(members)
            self.children.append(None)
            self.parent.append(parent)
            if parent >= 0:
                kids = self.children[parent]
                self.children[parent] = (node, -1) if kids is None else (kids[0], node)
            if len(members) > LEAF_ITEMS:
                one, two = self._cut(members, held)
                todo += [(two, node), (one, node)]
        # Of leaves: a column for each item, its weights over the leaf's terms.
        self.columns = [self._column(node) if kids is None else None for node, kids in enumerate(self.children)]
        self.values = [weight[t].astype(np.float64) for t in self.terms]
        self.exact = [int(weight[t].sum()) * (SCALE // 1000) < EXACT for t in self.terms]

    def _cut(self, members: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items with and without the term that parts them most evenly and weighs most; halves if none parts them well."""
        spots = np.concatenate([np.searchsorted(held, self.items[i]) for i in members])
        counts = np.bincount(spots, minlength=len(held))
        even = np.minimum(counts, len(members) - counts)
        best = int(np.argmax(even * self.weight[held])) if len(held) else 0
        if len(held) and even[best] >= max(1, len(members) // 8):
            has = np.array([bool(np.any(self.items[i] == held[best])) for i in members])
            return members[has], members[~has]
        half = len(members) // 2
        return members[:half], members[half:]

    def _column(self, node: int) -> np.ndarray:
        held, members = self.terms[node], self.below[node]
        out = np.zeros((len(held), len(members)), dtype=np.float64)
        for j, i in enumerate(members):
            out[np.searchsorted(held, self.items[i]), j] = self.weight[self.items[i]]
        return out


class Best:
    """The best ``k`` documents of each item so far, best first, and the score below which a document is none of them."""

    def __init__(self, tree: ItemTree, floors: np.ndarray, k: int):
        n = len(tree.items)
        self.tree, self.k = tree, k
        # Scores are above zero.
        self.least = np.maximum(floors, 1).astype(np.int64)
        self.last = np.full(n, _NO_ID, dtype=np.int64)
        self.scores = [np.empty(0, np.int64) for _ in range(n)]
        self.ids = [np.empty(0, np.int64) for _ in range(n)]
        self.known = [np.empty(0, bool) for _ in range(n)]
        self.weakest = np.array([self.least[b].min() if len(b) else _NO_ID for b in tree.below], dtype=np.int64)

    def offer(self, leaf: int, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """``scores``: documents x items of a leaf."""
        members = self.tree.below[leaf]
        least, last = self.least[members], self.last[members]
        hit = (scores > least) | ((scores == least) & (ids[:, None] <= last))
        for j in np.flatnonzero(hit.any(axis=0)):
            i, rows = members[j], hit[:, j]
            s = np.concatenate([self.scores[i], scores[rows, j]])
            d = np.concatenate([self.ids[i], ids[rows]])
            sure = np.concatenate([self.known[i], known[rows]])
            order = np.lexsort((~sure, d, -s))[: self.k]
            self.scores[i], self.ids[i], self.known[i] = s[order], d[order], sure[order]
            if len(order) == self.k:
                self.least[i], self.last[i] = s[order[-1]], d[order[-1]]
        node = leaf
        weakest = self.least[members].min()
        while node >= 0 and weakest > self.weakest[node]:
            self.weakest[node] = weakest
            node = self.tree.parent[node]
            if node >= 0:
                weakest = min(self.weakest[c] for c in self.tree.children[node])


class DocTree:
    """Hierarchy over the documents of a batch: halves by the coordinate that spreads most.

    Node ``i`` has the children ``2 i + 1`` and ``2 i + 2``; ``order`` lays the documents of every node side by side.
    """

    def __init__(self, x: np.ndarray, weight: np.ndarray):
        n = len(x)
        depth = 0
        while n >> depth > LEAF_DOCS:
            depth += 1
        self.first_leaf = (1 << depth) - 1
        total = 2 * self.first_leaf + 1
        self.begin, self.end = [0] * total, [0] * total
        self.end[0] = n
        order = np.arange(n)
        for node in range(self.first_leaf):
            a, b = self.begin[node], self.end[node]
            rows = order[a:b]
            part = x[rows]
            spread = part.var(axis=0, dtype=np.float64) * weight * weight
            column = int(np.argmax(spread))
            order[a:b] = rows[np.argsort(part[:, column], kind="stable")]
            mid = (a + b) // 2
            for child, lo, hi in ((2 * node + 1, a, mid), (2 * node + 2, mid, b)):
                self.begin[child], self.end[child] = lo, hi
        self.order = order
        self.x = x[order]
        self.most = np.zeros((total, x.shape[1]), dtype=x.dtype)
        for node in range(total - 1, -1, -1):
            if node >= self.first_leaf:
                if self.end[node] > self.begin[node]:
                    self.most[node] = self.x[self.begin[node] : self.end[node]].max(axis=0)
            else:
                np.maximum(self.most[2 * node + 1], self.most[2 * node + 2], out=self.most[node])


def dual_search(tree: ItemTree, best: Best, docs: DocTree, ids: np.ndarray, known: np.ndarray) -> int:
    """Bring ``best`` up to date with a batch of documents; gives the number of leaf pairs that were scored."""

    def bound(q: int, d: int) -> float:
        # Doubles are exact up to EXACT; beyond, the bound is widened by more than they can lose.
        return float(tree.values[q] @ docs.most[d, tree.terms[q]].astype(np.float64)) * (1.0 if tree.exact[q] else 1.0 + 1e-9)

    ids, known = ids[docs.order], known[docs.order]
    scored = 0
    todo = [(bound(0, 0), 0, 0)] if tree.items else []
    while todo:
        upper, q, d = todo.pop()
        if upper < best.weakest[q]:
            continue
        kids, leaf = tree.children[q], d >= docs.first_leaf
        if kids is None and leaf:
            a, b = docs.begin[d], docs.end[d]
            held = docs.x[a:b, tree.terms[q]]
            if tree.exact[q]:
                scores = (held.astype(np.float64) @ tree.columns[q]).astype(np.int64)
            else:
                scores = held.astype(np.int64) @ tree.columns[q].astype(np.int64)
            best.offer(q, scores, ids[a:b], known[a:b])
            scored += 1
            continue
        # The wider node of the two is opened; the more promising half is searched first.
        if leaf or kids is not None and len(tree.below[q]) * LEAF_DOCS >= (docs.end[d] - docs.begin[d]) * LEAF_ITEMS:
            pairs = [(bound(c, d), c, d) for c in kids]
        else:
            pairs = [(bound(q, c), q, c) for c in (2 * d + 1, 2 * d + 2)]
        todo += sorted(p for p in pairs if p[0] >= best.weakest[p[1]])
    return scored


def _vectors(docs: DataFrame, known: Mapping[bytes, int], name: str) -> DataFrame:
    """``doc_id``, ``n`` and the known terms with their counts of every document with a term, staged."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["raw"]):
                raw = raw.as_py()
                n, found = term_counts(raw, vocabulary) if raw else (0, {})
                if n:
                    ids.append(doc_id)
                    sizes.append(n)
                    order = sorted(found)
                    terms.append(order)
                    counts.append([found[t] for t in order])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int32()))})

    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("raw"))
    return staged(read.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<int>"), name)


def _found(vectors: DataFrame, shared, floors: Sequence[int], k: int) -> DataFrame:
    """The best ``k`` documents of each item in each task, by item number."""
    floors = np.array(floors, dtype=np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, n_docs, n_terms = shared.value
        tree = best = None
        rows = min(MOST_BATCH, max(LEAST_BATCH, CELLS // max(1, len(weight))))
        for batch in batches:
            if best is None:
                tree = ItemTree(items, weight)
                best = Best(tree, floors, k)
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part["terms"]
                sizes = np.diff(lists.offsets.to_numpy())
                term, tf = lists.flatten().to_numpy(zero_copy_only=False), part["counts"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                n = part["n"].to_numpy(zero_copy_only=False)
                x = np.zeros((len(sizes), len(weight)), dtype=np.float32)
                x[row, term] = impacts(tf, n[row], n_docs, n_terms)
                ids = part["doc_id"].fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                dual_search(tree, best, DocTree(x, weight), ids, part["doc_id"].is_valid().to_numpy(zero_copy_only=False))
        if best is not None:
            for i in range(len(items)):
                if len(best.scores[i]):
                    yield pa.RecordBatch.from_pydict({"item": pa.array([i] * len(best.scores[i]), pa.int32()), "doc_id": pa.array(best.ids[i], pa.int64(), mask=~best.known[i]), "score": pa.array(best.scores[i], pa.int64())})

    return vectors.mapInArrow(search, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each item with ``rank``; within groups of an item first, so no item's rows meet whole."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    few = salted.withColumn("at", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("at") <= k)
    return few.select("item", "doc_id", "score", F.row_number().over(W.partitionBy("item").orderBy(*order)).alias("rank")).where(F.col("rank") <= k)


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Different rows (``item_id``, UTF-8 text) in blocks of about ``block_bytes``; the driver holds one block at a time."""
    rows = items.select(items["item_id"].alias("item_id"), items["text"].cast("binary").alias("raw")).where("raw is not null").distinct()
    total = rows.agg(F.sum(F.length("raw"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for i in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(n)) == i)
        yield [(r.item_id, bytes(r.raw)) for r in block.collect()]


def search(items: DataFrame, docs: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of every item with a score above zero.

    items: ``item_id``, ``text``. docs: ``doc_id`` (integer), ``text``. Other columns are not read. Terms are runs of digits,
    letters and characters beyond ASCII, A-Z lower-cased. Equal scores rank by ascending ``doc_id``, rows without
    one last; repeated documents are ranked each. Equal item rows are one item; rows with one ``item_id`` and
    different texts are ranked each by itself. Null and empty texts have no terms: such items find nothing, such
    documents count for nothing. Without items or documents there are no rows.

    Documents are read once for each block of items (``block_bytes`` of text): the counts of the block's terms go on
    as a staged table. Every task keeps ``k`` rows an item; floors from a part of the documents keep them few.
    """
    spark = docs.sparkSession
    empty = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], empty)
    for block in item_blocks(items, block_bytes):
        known: dict[bytes, int] = {}
        named = [(name, sorted({known.setdefault(w, len(known)) for w in raw.translate(WORD_BYTES).split()})) for name, raw in block]
        named = [(name, terms) for name, terms in named if terms]
        if not named:
            continue
        vectors = _vectors(docs, known, "ranked-vectors")
        n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        # As many rows as the block has terms.
        df = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weight = np.array([term_weight(n_docs, df.get(t, 0)) for t in range(len(known))], dtype=np.int64)
        terms = [np.array(t, dtype=np.int64) for _, t in named]
        shared = spark.sparkContext.broadcast((terms, weight, n_docs, n_terms))
        first = vectors.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0)
        # One row an item of the block at most.
        reached = dict(_ranked(_found(first, shared, [0] * len(terms), k), k).where(F.col("rank") == k).select("item", "score").collect())
        found = _ranked(_found(vectors, shared, [reached.get(i, 0) for i in range(len(terms))], k), k)
        numbers = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(named)], T.StructType([T.StructField("item", T.IntegerType()), empty["item_id"]]))
        out = out.unionByName(found.join(F.broadcast(numbers), "item").select("item_id", "rank", "doc_id", "score"))
    return out


# The same by SQL over the tables ``documents`` and ``benchmark``, every pair of an item and a document scored.
RANKED_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), sized AS (SELECT doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized)
  WHERE term IN (SELECT term FROM items) GROUP BY doc_id, n, term
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
worth AS (
  SELECT tf.doc_id, tf.term,
    CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
      * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS gain
  FROM tf JOIN df ON tf.term = df.term, totals
), scores AS (
  SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM worth JOIN items ON worth.term = items.term GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
