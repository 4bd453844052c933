"""Secrets: fixed patterns, and windows of high Shannon entropy inside long runs of key characters.

Everything is one expression over a row. A window slides over a run; the sum of c * log2(c) over its character
counts c is kept up to date by the character that leaves and the one that enters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bind, gap_spans, match_spans, pieces, scanned, stretch

# Fixed values of the base patterns, their kinds in order, and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
LEAST_ACCESS = 18
KINDS = ("assign", "access", "hex", "entropy")

# Characters of keys, and the window that slides over runs of them.
KEY_CHARS = r"A-Za-z0-9+/_=-"
WINDOW = 20
# A run is cut into pieces of this many characters that share all but one of a window's, so that no step walks a long text.
PIECE = 512
# Per character class: what a window must consist of, what it must contain, and its least entropy in bits a character.
CLASSES = (
    (r"^[0-9a-f]+$", (r"[0-9]", r"[a-f]"), 2.9),
    (r"^[0-9A-F]+$", (r"[0-9]", r"[A-F]"), 2.9),
    (rf"^[{KEY_CHARS}]+$", (r"[0-9]", r"[a-z]", r"[A-Z]"), 3.6),
)
# Runs and words in them that are no secrets although they look random, and words just before a run that say it is a checksum.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456|12345678|abcdefg",
)
ALLOWED_BEFORE = r"(?i)(sha-?\d*|md5|checksum|digest|integrity|etag|commit|revision|uuid|guid)\W{0,4}$"
# What may be a checksum: hexadecimal, base64 or UUID of a usual length, perhaps behind its method.
CHECKSUM = (
    r"^(?i:(?:sha-?[0-9]{1,3}|md5)[_=-])?(?:(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"
    r"|(?:[A-Za-z0-9+/_-]{22}|[A-Za-z0-9+/_-]{38}|[A-Za-z0-9+/_-]{86})(?:==)?|(?:[A-Za-z0-9+/_-]{27}|[A-Za-z0-9+/_-]{43})=?|[A-Za-z0-9+/_-]{64})$"
)
# An allowed word excuses the key it is part of: letters and digits around it, this many on each side.
KEY = 40

# Code points of the pieces of a text in which the surroundings of a run are looked up.
NEAR = 128

_SPANS = "array<struct<start:int,end:int>>"


def _times_log(n: int = WINDOW) -> Column:
    """c * log2(c) for c from 0 on, one after the other."""
    return F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(n + 1)])


def _count(window: Column, char: Column) -> Column:
    return F.length(window) - F.length(F.replace(window, char, F.lit("")))


def _suspicious(window: Column, entropy: Column, classes: Sequence[tuple]) -> Column:
    out = F.lit(False)
    for whole, parts, least in classes:
        one = (entropy >= least) & window.rlike(whole)
        for part in parts:
            one = one & window.rlike(part)
        out = out | one
    return out


def _windows(piece: Column, offset: Column, classes: Sequence[tuple]) -> Column:
    """Spans of the windows of a piece that are suspicious; windows that touch are one span."""
    first = F.substring(piece, 1, WINDOW)
    log_of = _times_log()

    def f(c: Column) -> Column:
        return F.element_at(log_of, c + 1)

    begin = F.aggregate(F.split(first, ""), F.lit(0.0), lambda acc, ch: acc + F.log2(_count(first, ch).cast("double")))

    def flagged(i: Column, total: Column, spans: Column) -> Column:
        entropy = F.round(math.log2(WINDOW) - total / WINDOW, 9)
        window = piece.substr(i + 1, F.lit(WINDOW))
        start, end = offset + i, offset + i + WINDOW
        last = F.element_at(spans, -1)
        joined = F.when(
            (F.size(spans) > 0) & (last["end"] >= start),
            F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end")))),
        ).otherwise(F.concat(spans, F.array(F.struct(start.alias("start"), end.alias("end")))))
        return F.when(_suspicious(window, entropy, classes), joined).otherwise(spans)

    def step(acc: Column, i: Column) -> Column:
        before, common = piece.substr(i, F.lit(WINDOW)), piece.substr(i + 1, F.lit(WINDOW - 1))
        gone, new = _count(before, piece.substr(i, F.lit(1))), _count(common, piece.substr(i + WINDOW, F.lit(1)))
        total = acc["total"] - f(gone) + f(gone - 1) + f(new + 1) - f(new)
        return F.struct(total.alias("total"), acc["spans"].alias("spans"), i.alias("i"))

    def walk(acc: Column, i: Column) -> Column:
        moved = F.when(i > 0, step(acc, i)).otherwise(F.struct(acc["total"].alias("total"), acc["spans"].alias("spans"), i.alias("i")))
        return bind(moved, lambda m: F.struct(m["total"].alias("total"), flagged(i, m["total"], m["spans"]).alias("spans")))

    start = F.struct(begin.alias("total"), F.array().cast(_SPANS).alias("spans"))
    return F.aggregate(F.sequence(F.lit(0), F.length(piece) - WINDOW), start, walk, lambda acc: acc["spans"])


def _merged(spans: Column) -> Column:
    """Spans in order of starts and of ends, joined where they touch."""

    def joined(x: Column) -> Column:
        first = F.filter(x, lambda s, i: F.coalesce(F.get(x, i - 1)["end"] < s["start"], F.lit(True)))
        last = F.filter(x, lambda s, i: F.coalesce(F.get(x, i + 1)["start"] > s["end"], F.lit(True)))
        return F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    return bind(spans, joined)


def entropy_spans(text: Column, classes: Sequence[tuple] = CLASSES, allowed: Sequence[str] = ALLOWED, allowed_before: str = ALLOWED_BEFORE) -> Column:
    """Spans (start, end) of high entropy inside runs of key characters that the allow lists do not excuse.

    Windows that touch an allowed word or the letters and digits next to it (``KEY`` on each side) are excused, the
    others of the run are not. A word before a run excuses it if it has the form of a checksum.
    """
    words = "|".join(f"(?:{p})" for p in allowed) or "(?!)"
    part = f"(?:[A-Za-z0-9]{{0,{KEY}}}(?:{words}))++[A-Za-z0-9]{{0,{KEY}}}"

    def free(run: Column) -> Column:
        """What the allowed words leave of a run: (start, match) of the pieces between them."""
        whole = F.array(F.struct(run["start"].alias("start"), run["match"].alias("match")))
        between = lambda: F.transform(gap_spans(run["match"], part), lambda x: F.struct((run["start"] + x["start"]).alias("start"), x["match"].alias("match")))
        return F.filter(F.when(run["match"].rlike(words), between()).otherwise(whole), lambda x: F.length(x["match"]) >= WINDOW)

    def of_piece(run: Column) -> Column:
        stride = PIECE - WINDOW + 1
        each = lambda cut: F.transform(cut, lambda p, k: bind(F.concat(p, F.substring(F.coalesce(F.get(cut, k + 1), F.lit("")), 1, WINDOW - 1)), lambda q: F.when(F.length(q) >= WINDOW, _windows(q, run["start"] + k * stride, classes)).otherwise(F.array().cast(_SPANS))))
        return F.flatten(bind(pieces(run["match"], stride), each))

    def judged(runs: Column) -> Column:
        def scanned_runs(cut: Column) -> Column:
            begin = lambda run: F.greatest(run["start"] - 24, F.lit(0))
            checksum = lambda run: run["match"].rlike(CHECKSUM) & stretch(cut, NEAR, begin(run), run["start"] - begin(run)).rlike(allowed_before)
            return _merged(F.flatten(F.transform(F.flatten(F.transform(F.filter(runs, lambda r: ~checksum(r)), free)), of_piece)))

        return F.when(F.size(runs) == 0, F.array().cast(_SPANS)).otherwise(bind(pieces(text, NEAR), scanned_runs))

    return bind(match_spans(text, rf"(?<![{KEY_CHARS}])[{KEY_CHARS}]{{{WINDOW},}}+"), judged)


def secrets(text: Column) -> Column:
    """All spans of a text as (start, kind_no, end, kind), in order of start and kind."""
    found = {
        "assign": F.filter(match_spans(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= LEAST_ASSIGNED),
        "access": F.filter(match_spans(text, ACCESS), lambda m: F.length(m["match"]) >= LEAST_ACCESS),
        "hex": match_spans(text, HEX),
    }

    def tagged(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.concat(*[tagged(spans, kind) for kind, spans in found.items()])

    def with_method(base: Column) -> Column:
        """In order of starts, base spans before others: a span inside a base one ends before the last of their ends so far."""

        def outside(spans: Column) -> Column:
            ends = F.transform(spans, lambda x: F.when(x["kind"] == "entropy", F.lit(-1)).otherwise(x["end"]))
            reach = scanned(ends, F.greatest, F.lit(-1))
            return bind(reach, lambda r: F.filter(spans, lambda x, i: (x["kind"] != "entropy") | (F.get(r, i) < x["end"])))

        more = lambda found: F.when(F.size(found) == 0, F.array_sort(base)).otherwise(bind(F.array_sort(F.concat(base, tagged(found, "entropy"))), outside))
        return bind(entropy_spans(text), more)

    return bind(base, with_method)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as the struct ``doc`` with ``secrets``: an array of (start, kind_no, end, kind).

    docs: ``text``, any other columns. Positions are code points, end exclusive. Kinds: ``assign`` (a named value
    of 12 or more characters), ``access`` (key ids of 18 or more), ``hex`` (runs of 16 or more), ``entropy``
    (what the sliding window finds outside of those). Null and empty texts have none; rows stay one by one.
    """
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), secrets(F.coalesce(docs["text"], F.lit(""))).alias("secrets"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
