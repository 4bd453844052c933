"""Personal data: fixed patterns, and identifiers learnt from the words around them.

Entities that the fixed patterns find are seeds. The words next to an entity are its lexical patterns. Over the
whole corpus, patterns and instances (distinct values) make a graph: a pattern is as good as the instances it
meets, an unknown value as good as the patterns it meets. After a few rounds, values of high score join the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BLANKS, bind, match_spans, pieces, scanned, staged, stretch

# Fixed values of the base patterns, in the order of kinds. Possessive forms match the same texts without
# walking back; a match starts where a run of its first class starts or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

# What may be an identifier that the base patterns miss: a run of tokens that each have a digit, whatever dots, brackets,
# hyphens and letters are in them, and addresses without a dot. Contexts decide which of them are.
_TOKEN = r"(?=[A-Za-z._()+/-]{0,40}+[0-9])[A-Za-z0-9(+](?:[A-Za-z0-9._()+/-]*[A-Za-z0-9)])?"
RUN = rf"(?<![A-Za-z0-9._()+/@-]){_TOKEN}(?:\x20{_TOKEN}){{0,11}}(?![A-Za-z0-9@])"
ADDRESS = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![A-Za-z0-9.@-])"
# Letters and digits of a run, and digits at least.
LEAST_SIGNS, MOST_SIGNS, LEAST_DIGITS = 7, 34, 5
# Kinds whose values an identifier of digits may repeat in another notation.
OF_DIGITS = ("card", "phone")

ROUNDS = 3
# A pattern speaks when it meets this many good instances, weighs with at least this share of good ones among all.
LEAST_SUPPORT = 3
LEAST_PATTERN = 0.5
ACCEPTED = 0.9
# What a pattern of one word is worth next to one of two: alone it never suffices.
ONE_WORD = 0.8
# Characters before and after an entity in which its neighbour words are looked for.
REACH = 60
# Code points of the pieces of a text in which the surroundings of an entity are looked up.
NEAR = 64

_SPANS = "array<struct<start:int,end:int,match:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Does a string of 13 to 19 digits pass the check sum?"""

    def term(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + term(i))
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(_SPANS))


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind_no"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["match"].alias("value")))


def base_entities(text: Column) -> Column:
    """Entities of the fixed patterns as (kind_no, start, end, kind, value), by kind and start."""
    has_digit = text.rlike("[0-9]")
    email = _if(F.contains(text, F.lit("@")), match_spans(text, EMAIL))
    ip = F.filter(_if(has_digit, match_spans(text, IP)), lambda m: m["match"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    card = F.filter(_if(has_digit, match_spans(text, CARD)), lambda m: bind(_digits(m["match"]), _luhn))
    phone = F.filter(_if(F.contains(text, F.lit("+")), match_spans(text, PHONE)), lambda m: F.length(_digits(m["match"])).between(9, 15))
    return F.concat(_tagged(email, "email"), _tagged(ip, "ip"), _tagged(card, "card"), _tagged(phone, "phone"))


def unknown_entities(text: Column, base: Column) -> Column:
    """Spans that look like identifiers and touch no base entity, in order."""
    signs = lambda m: F.length(F.regexp_replace(m["match"], "[^A-Za-z0-9]", "")).between(LEAST_SIGNS, MOST_SIGNS) & (F.length(_digits(m["match"])) >= LEAST_DIGITS)
    runs = F.filter(_if(text.rlike("[0-9]"), match_spans(text, RUN)), signs)
    found = F.concat(runs, _if(F.contains(text, F.lit("@")), match_spans(text, ADDRESS)))
    placed = lambda spans, no: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("no"), m["end"].alias("end"), (m["match"] if no else m["value"]).alias("match")))

    def free(both: Column) -> Column:
        """In order of starts: what ends of base spans reach before, and where the next base span starts."""
        far = F.lit(2**31 - 1)
        reach = scanned(F.transform(both, lambda x: F.when(x["no"] == 0, x["end"]).otherwise(F.lit(-1))), F.greatest, F.lit(-1))
        coming = scanned(F.reverse(F.transform(both, lambda x: F.when(x["no"] == 0, x["start"]).otherwise(far))), F.least, far)
        return bind(F.struct(reach.alias("reach"), F.reverse(coming).alias("next")), lambda at: F.filter(both, lambda x, i: (x["no"] == 1) & (F.get(at["reach"], i) <= x["start"]) & (F.get(at["next"], i) >= x["end"])))

    none = F.array().cast("array<struct<start:int,no:int,end:int,match:string>>")
    alone = lambda f: F.when(F.size(f) == 0, none).when(F.size(base) == 0, F.array_sort(placed(f, 1))).otherwise(bind(F.array_sort(F.concat(placed(base, 0), placed(f, 1))), free))
    return _tagged(bind(found, alone), "context")


def _patterns(cut: Column, entity: Column) -> Column:
    """Lexical patterns of an entity: the word before, the two words before, the word after; ``cut``: the text in pieces."""

    def words(part: Column) -> Column:
        bare = F.transform(F.split(part, f"[{BLANKS}]+", -1), lambda w: F.lower(F.regexp_replace(w, r"^[\p{Punct}]+|[\p{Punct}]+$", "")))
        return F.filter(bare, lambda w: w != "")

    begin = F.greatest(entity["start"] - REACH, F.lit(0))
    left = words(stretch(cut, NEAR, begin, entity["start"] - begin))
    right = words(stretch(cut, NEAR, entity["end"], F.lit(REACH)))
    found = F.array(
        F.when(F.size(left) > 0, F.concat(F.lit("<"), F.element_at(left, -1))),
        F.when(F.size(left) > 1, F.concat(F.lit("<<"), F.element_at(left, -2), F.lit(" "), F.element_at(left, -1))),
        F.when(F.size(right) > 0, F.concat(F.lit(">"), F.element_at(right, 1))),
    )
    return F.array_compact(found)


def _key(entity: Column) -> Column:
    """What notations of one value share. Addresses and ip keep their dots, so they never equal a group of digits."""
    whole = (entity["kind"] == "ip") | F.contains(entity["value"], F.lit("@"))
    return F.lower(F.when(whole, entity["value"]).otherwise(F.regexp_replace(entity["value"], "[^A-Za-z0-9]", "")))


def _with_patterns(text: Column, entities: Column) -> Column:
    told = lambda cut: F.transform(entities, lambda e: F.struct(e["kind_no"].alias("kind_no"), e["start"].alias("start"), e["end"].alias("end"), e["kind"].alias("kind"), _key(e).alias("value"), _patterns(cut, e).alias("patterns")))
    return bind(F.when(F.size(entities) > 0, pieces(text, NEAR)).otherwise(F.array().cast("array<string>")), told)


def accepted_values(entities: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Values (``value``) of unknown entities that reach the score, from all entities (``value``, ``patterns``, ``kind``).

    A value that is a seed anywhere is known and not among them. Repeats of a value with the same pattern are one edge, so copies of a
    document add nothing. Edges are joined and summed, never listed per pattern or value.
    """
    pairs = entities.select("value", (F.col("kind") != KINDS[-1]).alias("seed"), F.explode("patterns").alias("pattern"))
    seeds = entities.where(F.col("kind") != KINDS[-1]).select("value").distinct()
    edges = staged(pairs.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    # Only patterns that meet an unknown value matter, and only they are scored.
    unknown = staged(edges.where("not seed").join(seeds, "value", "left_anti").select("pattern", "value"), "pii-unknown")
    asked = unknown.select("pattern").distinct()
    known = staged(edges.join(asked, "pattern", "left_semi").join(seeds, "value", "left_semi").groupBy("pattern").agg(F.count("*").alias("good")), "pii-patterns")
    trust = F.when(F.startswith(F.col("pattern"), F.lit("<<")), F.lit(1.0)).otherwise(F.lit(ONE_WORD))
    scores = unknown.select("value").distinct().withColumn("score", F.lit(0.0))
    for _ in range(rounds):
        met = unknown.join(scores, "value").groupBy("pattern").agg(F.count("*").alias("open"), F.sum(F.col("score").cast("decimal(20,6)")).cast("double").alias("gained"))
        weighed = met.join(known, "pattern", "left").select("pattern", (F.coalesce("good", F.lit(0)) + F.col("gained")).alias("worth"), (F.coalesce("good", F.lit(0)) + F.col("open")).alias("all"))
        strong = weighed.where(F.col("worth") >= LEAST_SUPPORT).select("pattern", (trust * F.col("worth") / (F.col("all") + 0.5)).alias("share")).where(F.col("share") >= LEAST_PATTERN)
        doubt = F.sum(F.ln(1 - F.col("share")).cast("decimal(20,9)")).cast("double")
        scores = staged(unknown.join(strong, "pattern").groupBy("value").agg(F.round(1 - F.exp(doubt), 6).alias("score")), "pii-scores")
        scores = unknown.select("value").distinct().join(scores, "value", "left").select("value", F.coalesce("score", F.lit(0.0)).alias("score"))
    return scores.where(F.col("score") >= ACCEPTED).select("value")


def find_pii(docs: DataFrame, keep: Sequence[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The kept columns of each row as ``doc`` with ``entities``: an array of (kind_no, start, end, kind), by kind and start.

    docs: ``text``, any other columns. Positions are code points, end exclusive. Kinds: ``email``, ``ip``, ``card``,
    ``phone`` from fixed patterns, ``context`` from learnt ones or as another notation of a card or phone found
    anywhere. What contexts may propose are runs of up to twelve tokens with a digit in each (7 to 34 letters and
    digits, 5 digits at least, any dots, brackets and hyphens), and addresses without a dot; names and other words
    without digits are out of reach. Null and empty texts have none; rows stay one by one. Texts are read once;
    what goes on holds entities only. Work is linear in the length of a text and the number of its entities.
    """
    keep = docs.columns if keep is None else keep
    text = F.coalesce(docs["text"], F.lit(""))
    based = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("doc"), text.alias("t"), base_entities(text).alias("base"))
    both = based.select("doc", bind(F.concat("base", unknown_entities(F.col("t"), F.col("base"))), lambda found: _with_patterns(F.col("t"), found)).alias("all"))
    rows = staged(both.withColumn("row_no", F.monotonically_increasing_id()), "pii-rows")
    entities = rows.select("row_no", F.explode("all").alias("e")).select("row_no", "e.*")
    learnt = accepted_values(entities.select("value", "patterns", "kind"), rounds)
    certain = entities.where(F.col("kind").isin(*OF_DIGITS)).select("value").distinct()
    # Few rows: one for each learnt or certain entity, collected per document.
    new = entities.where(F.col("kind") == KINDS[-1]).join(learnt.union(certain), "value", "left_semi").groupBy("row_no").agg(F.collect_list(F.struct("kind_no", "start", "end", "kind")).alias("more"))
    plain = F.transform(F.filter("all", lambda e: e["kind"] != KINDS[-1]), lambda e: F.struct(e["kind_no"].alias("kind_no"), e["start"].alias("start"), e["end"].alias("end"), e["kind"].alias("kind")))
    found = rows.join(new, "row_no", "left")
    return found.select("doc", F.array_sort(F.concat(plain, F.coalesce("more", F.array().cast("array<struct<kind_no:int,start:int,end:int,kind:string>>")))).alias("entities"))
