"""Text helpers as Column expressions, and the fixed patterns and word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words, in the usual published order.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at "
    "by for with about against between into through during before after above below to from up down "
    "in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn "
    "doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Patterns of cells. (?U): letters, digits and word ends of any script.
EMPTY_CELL = r"(?U)^\s*(|-|n\s*[\\/]\s*a)\s*$"
NUMBER_INSIDE = r"(?U)\b\d+(?:\s*,\s*\d{3})*(?:\.\d+)?\b"
NUMBER_CELL = r"(?U)^\s*([\-+]\s*)?\d+(\s*,\s*\d{3})*(\.\d+)?(\s*%)?\s*$"
DIGITS_CELL = r"(?U)^\d+$"
NO_DIGITS = r"(?U)^\D+$"
TOTAL_ROW = r"(?U)\b((o ?v ?e ?r ?)?a ?l ?l|t ?o ?t ?a ?l( ?s)?|s ?u ?m)\b"
YEAR_INSIDE = r"(?U)\b((?:1[789]|20)\d\d)\b"
SECONDS_CELL = r"(?U)^\s*\d\d?\.\d\d\s*$"
DATE_WORD = r"(?iU)\bdate\b"
SLASH_DATE = r"(?U)\d\s*/\s*\d+\s*/\s*\d+"
MONTH_WORD = (
    r"(?iU)\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?"
    r"|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b"
)
ALNUM_WORDS = r"^[\p{L}\p{N}]+( [\p{L}\p{N}]+)*$"
# The same in Java's notation, where $ lets a line break at the end pass.
CLEAN_WORD = r"^[\p{L}\p{N}]+\z"
CLEAN_WORDS = r"^[\p{L}\p{N}]+( [\p{L}\p{N}]+)*\z"


def tokens(text: Column) -> Column:
    """Tokens between single spaces."""
    return F.split(text, " ", -1)


def run_text(words: Column, start: Column, length: Column) -> Column:
    """``length`` tokens from 1-based ``start``, joined."""
    return F.array_join(F.slice(words, start, length), " ")


def starts(words: Column, length: int | Column) -> Column:
    """1-based start positions of the runs of ``length`` tokens; none when the text is shorter."""
    last = F.size(words) - length + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def runs(words: Column, length: int) -> Column:
    """All runs of ``length`` tokens, in order."""
    return F.transform(starts(words, length), lambda i: run_text(words, i, F.lit(length)))


def seeded_hash(seed: int | Column, *ids: Column) -> Column:
    """Reproducible random order of rows."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", seed.cast("string"), *[i.cast("string") for i in ids]))
