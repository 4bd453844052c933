"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source that is to give more words than it has gives whole epochs first; the rest of its target is a weighted
sample without replacement. Each document draws an exponential key, divided by its quality weight; the smallest
keys come first, and a running sum of sizes says where the budget ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import beside, staged, without, word_count

# Fixed values of the mix: weights of the sources in code point order, repeated, and all words it takes, in percent.
WEIGHTS = (3, 1, 2)
PERCENT = 150
MOST_EPOCHS = 2
SEED = 42
# Parts into which the keys of a source are dealt, so that a source of any size is summed side by side.
KEY_PARTS = 4096
# Characters that make a text a worse one for the default weight.
POOR = "#*$%&|<>0123456789"

_S = ["no_source", "source_key"]


def plainness(text: Column) -> Column:
    """Default quality weight, over 0 and at most 1: the share of characters that are neither digits nor symbols."""
    t = F.coalesce(text, F.lit(""))
    return (1.0 + F.length(without(t, POOR))) / (1.0 + F.length(t))


def draw(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """Exponential key of a document: minus the logarithm of its uniform draw, over its weight."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.ln(uniform) / weight


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: float = PERCENT, epochs: int = MOST_EPOCHS) -> DataFrame:
    """``target`` words of each source of ``sizes`` (one row a source, with ``source_size``).

    All sources share ``percent`` of all words by weight, none above ``epochs`` times its size; what one cannot
    give the others share. Sorted by the level at which they are full, the first source that is not full sets
    the level: one running sum over one row a source.
    """
    by_name = W.orderBy("no_source", "source_key")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.select("*", listed[(F.row_number().over(by_name) - 1) % len(weights)].alias("w"), (F.lit(float(epochs)) * F.col("source_size")).alias("most"))
    everything = W.partitionBy()
    before = W.orderBy("full_at", "no_source", "source_key").rowsBetween(W.unboundedPreceding, -1)
    levels = (
        weighed.withColumn("full_at", F.col("most") / F.col("w"))
        .withColumn("share", F.lit(percent) * F.sum("source_size").over(everything) / F.lit(100.0))
        .withColumn("level", (F.col("share") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("first", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "no_source", "source_key", "level"))).over(everything))
    )
    level = F.coalesce(F.col("first.level"), F.lit(float("inf")))
    return levels.select(*_S, "source_size", F.least("most", F.col("w") * level).alias("target"))


def plan(rows: DataFrame) -> DataFrame:
    """For each source of sized rows: ``epochs``, the last ``cut`` in key order that still fits, and one ``extra`` row.

    The running sum takes parts of the key range first and rows inside a part after, so the largest group is one
    part of one source. The extra row is the one that brings the total nearest to the target.
    """
    sizes = rows.groupBy(*_S).agg(F.sum("size").alias("source_size"))
    aims = targets(sizes)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("int")
    aims = staged(aims.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    parts = rows.groupBy(*_S, "part").agg(F.sum("size").alias("part_size"))
    earlier = W.partitionBy(*_S).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    placed = parts.withColumn("before", F.coalesce(F.sum("part_size").over(earlier), F.lit(0))).join(aims.select(*_S, "rest"), _S)
    # Only the part in which the budget ends needs its rows in order.
    edge = placed.where((F.col("rest") > 0) & (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("part_size") > F.col("rest")))
    inside = rows.join(edge.select(*_S, "part", "before", "rest"), [*_S, "part"])
    # Rows alike in all that orders them are taken together.
    upto = W.partitionBy(*_S, "part").orderBy("turn").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = inside.withColumn("run", F.col("before") + F.sum("size").over(upto)).where("run <= rest").groupBy(*_S).agg(F.max("turn").alias("turn"), F.max("run").alias("run"))
    cuts = (
        aims.join(edge.select(*_S, "part", "before"), _S, "left").join(last, _S, "left")
        .select(*_S, "source_size", "target", "epochs", F.col("part").alias("edge_part"), F.col("turn").alias("cut"), (F.col("rest") - F.coalesce("run", "before", F.lit(0))).alias("gap"))
    )
    cuts = staged(cuts, "mix-cuts")
    left = rows.join(beside(cuts.where("edge_part is not null")), _S).where(~_fits() & (F.col("size") < 2 * F.col("gap")))
    alike = left.groupBy(*_S, "turn").agg(F.sum("size").alias("size"), F.first("gap").alias("gap"))
    off = F.abs(F.col("size") - F.col("gap"))
    extra = alike.where(off < F.col("gap")).groupBy(*_S).agg(F.min(F.struct(off.alias("off"), F.col("turn"))).alias("extra"))
    return staged(cuts.join(extra.select(*_S, F.col("extra.turn").alias("extra")), _S, "left"), "mix-plan")


def _fits() -> Column:
    """Is a row before the cut of its source? Without an edge the rest is nothing."""
    in_edge = F.coalesce(F.col("turn") <= F.col("cut"), F.lit(False))
    return F.coalesce((F.col("part") < F.col("edge_part")) | ((F.col("part") == F.col("edge_part")) & in_edge), F.lit(False))


def mix(docs: DataFrame, weight: Column | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """The kept columns of each row as ``doc``, with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    docs: ``doc_id``, ``text`` and ``source``, any other columns. ``weight`` (over 0) defaults to ``plainness`` of
    the text. Sizes are numbers of words; a null text has none. A null source is a source, the last one. A source
    without words is taken once, at no words. Rows with one ``doc_id`` draw alike and are ordered by text; rows
    with one ``doc_id`` and text are taken together. Reruns over the same rows agree. No documents: no rows.
    """
    text = docs["text"]
    key = draw(docs["doc_id"], plainness(text) if weight is None else weight)
    kept = docs.columns if keep is None else keep
    named = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in kept]).alias("doc"), docs["source"].isNull().alias("no_source"), F.coalesce(docs["source"], F.lit("")).alias("source_key"),
        word_count(text).alias("size"), key.alias("key"), F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("hash"),
    )
    part = F.floor(F.lit(KEY_PARTS) * F.col("key") / (1.0 + F.col("key"))).cast("int")
    rows = named.select("doc", *_S, "size", F.struct("key", "id", "hash").alias("turn"), part.alias("part"))
    if keep is None:
        # Whole rows are read a second time, so that no second copy of them is written.
        aims = plan(staged(rows.drop("doc"), "mix-rows"))
    else:
        rows = staged(rows, "mix-rows")
        aims = plan(rows.drop("doc"))
    chosen = _fits() | F.coalesce(F.col("turn") == F.col("extra"), F.lit(False))
    copies = F.col("epochs") + chosen.cast("int")
    found = rows.join(beside(aims), _S).withColumn("copies", copies)
    return found.select("doc", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    return mix(docs, weight).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


MIX_SQL = f"""
with sized as (
  select doc_id, source, coalesce(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 0)::bigint as size,
    -ln((('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::bigint::double + 0.5) / {1 << 52}.0)
      / ((1.0 + length(translate(coalesce(text, ''), '{POOR}', ''))) / (1.0 + length(coalesce(text, '')))) as key
  from documents),
sizes as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)}]::double as w, {MOST_EPOCHS}.0::double * source_size as most from sizes),
levels as (
  select *, most / w as full_at,
    ({PERCENT} * sum(source_size) over () / 100.0::double - coalesce(sum(most) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
  from weighed window before as (order by most / w, source nulls last rows between unbounded preceding and 1 preceding)),
aims as (
  select source, source_size, least(most, w * (select min_by(level, full_at) from levels where level <= full_at)) as target from levels),
budget as (select *, floor(target / source_size)::bigint as epochs, target - floor(target / source_size) * source_size as rest from aims),
runs as (
  select s.doc_id, s.source, s.size, s.key, b.source_size, b.target, b.epochs, b.rest,
    sum(s.size) over (partition by s.source order by s.key, s.doc_id rows between unbounded preceding and current row) as run
  from sized s join budget b on s.source is not distinct from b.source),
gaps as (select source, max(rest) - coalesce(max(run) filter (where run <= rest), 0) as gap from runs group by source),
extras as (
  select r.source, min_by(r.doc_id, struct_pack(o := abs(r.size - g.gap), k := r.key, d := r.doc_id)) as doc_id
  from runs r join gaps g on r.source is not distinct from g.source where r.run > r.rest and abs(r.size - g.gap) < g.gap group by r.source)
select r.doc_id, r.size, r.source_size, r.target,
  (r.size * (r.epochs + case when r.run <= r.rest or r.doc_id = e.doc_id then 1 else 0 end))::bigint as taken
from runs r left join extras e on r.source is not distinct from e.source
"""
