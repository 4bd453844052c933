"""Statement operators over orders per customer, lines per supplier, events per user, parts per brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import KeyedTable
from factloom.catalog import Catalog, read
from factloom.catalog import sqltext as S
from factloom.operators import aggregates, compare, majority, ngrams, selectors, superlatives, universal, values


def orders(spark, sf):
    return KeyedTable(read(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"])


def lines(spark, sf):
    return KeyedTable(read(spark, sf, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber"])


def baskets(spark, sf):
    return KeyedTable(read(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber"])


def events(spark, sf):
    """Events of a user; an error has no value."""
    df = read(spark, sf, "events").withColumn("val", F.expr("case when event_type <> 'error' then value end"))
    return KeyedTable(df, ["user_id"], ["event_id"])


def parts(spark, sf):
    return KeyedTable(read(spark, sf, "part"), ["p_brand"], ["p_partkey"])


LABEL = "case when p_size > 10 then 'bulk part ' else 'part ' end || p_name"


def labelled_parts(spark, sf):
    df = read(spark, sf, "part").withColumn("label", F.expr(LABEL))
    return KeyedTable(df, ["p_brand"], ["p_partkey"])


RAW_QUANTITY = "cast(cast(l_quantity as int) as {s}) || case when l_linenumber = 1 and l_quantity > 25 then '.0' else '' end"


def written_lines(spark, sf):
    """Quantities with their text; some values are written in two ways."""
    df = read(spark, sf, "lineitem").withColumn("l_quantity_raw", F.expr(RAW_QUANTITY.format(s="string")))
    return KeyedTable(df, ["l_suppkey"], ["l_orderkey", "l_linenumber"], raw={"l_quantity": "l_quantity_raw"})


LINES = S.values("lineitem", "l_suppkey", "l_quantity")
PRICES = S.values("orders", "o_custkey", "o_totalprice")
EVENTS = S.values("events", "user_id", "case when event_type <> 'error' then value end")
DATES = S.values("orders", "o_custkey", "o_orderdate", "cast(v as varchar)")
WRITTEN = (
    f"r as (select l_suppkey as k, l_quantity as v, {RAW_QUANTITY.format(s='varchar')} as raw from lineitem),\n"
    "vc as (select k, v, count(*) as cnt, min(raw) as raw, count(distinct raw) = 1 as one_raw from r group by k, v)"
)
PROFILE = (
    "vp as (select *, sum(cnt) over (partition by k order by v)::bigint as upto, sum(cnt) over (partition by k)::bigint as n,"
    " (sum(cnt) over (partition by k order by v) - cnt)::bigint as below from vc where v is not null)"
)


def register(c: Catalog) -> None:
    _selectors(c)
    _superlatives(c)
    _aggregates(c)
    _majority(c)
    _universal(c)
    _ngrams(c)
    _comparisons(c)


def _selectors(c: Catalog) -> None:
    c.add("filter_all", lambda s, d: selectors.filter_all(orders(s, d)).select("o_custkey", "o_orderkey", "o_totalprice"),
          "select o_custkey, o_orderkey, o_totalprice from orders")
    c.add("filter_eq_number", lambda s, d: selectors.filter_eq(lines(s, d), "l_quantity"),
          f"with {LINES} select k as l_suppkey, raw as filled, cnt as val_count from vc where one_raw and cnt > 1")
    c.add("filter_eq_with_empty", lambda s, d: selectors.filter_eq(events(s, d), "val"),
          f"with {EVENTS} select k as user_id, raw as filled, cnt as val_count from vc where cnt > 1")
    c.add("filter_eq_ambiguous_text", lambda s, d: selectors.filter_eq(written_lines(s, d), "l_quantity"),
          f"""with {WRITTEN}, {S.grams('lineitem', 'l_suppkey', RAW_QUANTITY.format(s='varchar'))},
u as (select k, raw as filled, cnt as val_count from vc where one_raw union select k, gram, n_rows from ge)
select k as l_suppkey, filled, val_count from u where val_count > 1""")
    text = S.grams("part", "p_brand", "p_name")
    c.add("filter_eq_text", lambda s, d: selectors.filter_eq(parts(s, d), "p_name"),
          f"""with {text}, cand as (select k, txt as filled from tx union select k, gram from ge)
select c.k as p_brand, filled, sum(cnt)::bigint as val_count from cand c join tx on c.k = tx.k and contains(' ' || txt || ' ', ' ' || filled || ' ')
group by all having sum(cnt) > 1""")
    c.add("filter_eq_conversation_text",
          lambda s, d: selectors.filter_eq(KeyedTable(read(s, d, "conversations"), ["role"], ["conv_id", "turn"]), "text", rows="any"),
          f"""with {S.grams('conversations', 'role', 'text')}, cand as (select k, txt as filled from tx union select k, gram from ge)
select c.k as role, filled, sum(cnt)::bigint as val_count from cand c join tx on c.k = tx.k and contains(' ' || txt || ' ', ' ' || filled || ' ')
group by all""")
    c.add("filter_not_eq", lambda s, d: selectors.filter_not_eq(events(s, d), "val"),
          f"with {EVENTS}, n as (select k, count(*) as n from r group by k) "
          "select vc.k as user_id, raw as filled, n - cnt as val_count from vc join n on vc.k = n.k where n - cnt > 1")
    c.add("filter_greater_eq", lambda s, d: selectors.filter_greater_eq(orders(s, d), "o_totalprice"),
          f"""with {PRICES} select vc.k as o_custkey, vc.raw as filled, count(*) as val_count from vc join r on r.k = vc.k and r.v >= vc.v
where vc.v < (select max(v) from r m where m.k = vc.k) group by all having count(*) > 1""")
    c.add("filter_less_eq", lambda s, d: selectors.filter_less_eq(orders(s, d), "o_orderdate"),
          f"""with {DATES} select vc.k as o_custkey, vc.raw as filled, count(*) as val_count from vc join r on r.k = vc.k and r.v <= vc.v
where vc.v > (select min(v) from r m where m.k = vc.k) group by all having count(*) > 1""")
    c.add("filter_greater", lambda s, d: selectors.filter_greater(orders(s, d), "o_totalprice"),
          f"""with {PRICES}, {S.step()}, b as (select distinct r.k, {S.floor_to('v')} as bound from r join st on r.k = st.k)
select b.k as o_custkey, {S.number_text('bound')} as filled, count(*) as val_count from b join r on r.k = b.k and v > bound
group by b.k, bound having count(*) > 1 and count(*) < (select count(*) from r n where n.k = b.k)""")
    c.add("filter_less", lambda s, d: selectors.filter_less(events(s, d), "val", rows="any"),
          f"""with {EVENTS}, {S.step()}, b as (select distinct r.k, {S.ceil_to('v')} as bound from r join st on r.k = st.k where v is not null)
select b.k as user_id, {S.number_text('bound')} as filled, count(*) as val_count from b join r on r.k = b.k and v < bound
group by b.k, bound having count(*) < (select count(v) from r n where n.k = b.k)""")


def _superlatives(c: Catalog) -> None:
    c.add("col_max", lambda s, d: superlatives.col_max(orders(s, d), "o_totalprice").select("o_custkey", "v", "raw"),
          f"with {PRICES} select k as o_custkey, max(v) as v, {S.number_text('max(v)')} as raw from r group by k")
    c.add("col_min", lambda s, d: superlatives.col_min(orders(s, d), "o_orderdate"),
          f"with {DATES} select k as o_custkey, min(v) as v, cast(min(v) as varchar) as raw from r group by k")
    c.add("col_max_written", lambda s, d: superlatives.col_max(written_lines(s, d), "l_quantity"),
          f"with {WRITTEN} select k as l_suppkey, v, raw from vc qualify row_number() over (partition by k order by v desc) = 1")
    for name, func, order in (
        ("col_argmax", superlatives.col_argmax, "val desc"), ("col_argmin", superlatives.col_argmin, "val"),
    ):
        c.add(name, lambda s, d, func=func: func(events(s, d), "val").select("user_id", "event_id", "event_type", "value"),
              f"""select user_id, event_id, event_type, value from (select *, case when event_type <> 'error' then value end as val from events)
where val is not null qualify row_number() over (partition by user_id order by {order}, event_id) = 1""")
    for name, func, order in (("nth_max", superlatives.nth_max, "v desc"), ("nth_min", superlatives.nth_min, "v")):
        c.add(name, lambda s, d, func=func: func(events(s, d), "val"),
              f"""with {EVENTS} select k as user_id, nth, raw from (select *, row_number() over (partition by k order by {order}) as nth,
count(*) over (partition by k) as n from r where v is not null) where nth <= n // 2""")
    for name, func, order in (("nth_argmax", superlatives.nth_argmax, "o_totalprice desc"), ("nth_argmin", superlatives.nth_argmin, "o_totalprice")):
        c.add(name, lambda s, d, func=func: func(orders(s, d), "o_totalprice").select("o_custkey", "nth", "o_orderkey", "o_totalprice"),
              f"""select o_custkey, nth, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by {order}, o_orderkey) as nth,
count(*) over (partition by o_custkey) as n from orders) where nth <= n // 2""")


def _aggregates(c: Catalog) -> None:
    c.add("count", lambda s, d: aggregates.count(orders(s, d)), "select o_custkey, count(*) as n from orders group by all")
    c.add("only", lambda s, d: aggregates.only(baskets(s, d)), "select l_orderkey, count(*) = 1 as holds from lineitem group by all")
    c.add("col_sum", lambda s, d: aggregates.col_sum(lines(s, d), "l_quantity"),
          f"select l_suppkey, {S.round_two('sum(l_quantity)')} as total from lineitem group by all")
    c.add("col_avg", lambda s, d: aggregates.col_avg(lines(s, d), "l_quantity"),
          f"select l_suppkey, {S.round_two('avg(l_quantity)')} as mean from lineitem group by all")
    c.add("raw_forms", lambda s, d: values.raw_forms(written_lines(s, d), "l_quantity"),
          f"with {WRITTEN} select distinct r.k as l_suppkey, r.v, r.raw as form, vc.raw as smallest from r join vc on r.k = vc.k and r.v = vc.v")
    c.add("range_step", lambda s, d: values.range_step(orders(s, d), "o_totalprice"),
          f"with {PRICES}, {S.step()} select k as o_custkey, step from st")
    c.add("lower_bounds", lambda s, d: values.lower_bounds(orders(s, d), "o_totalprice").select("o_custkey", "bound", "beyond"),
          f"""with {PRICES}, {S.step()}, b as (select distinct r.k, {S.floor_to('v')} as bound from r join st on r.k = st.k)
select b.k as o_custkey, bound, count(*) as beyond from b join r on r.k = b.k and v > bound group by b.k, bound""")
    c.add("upper_bounds", lambda s, d: values.upper_bounds(orders(s, d), "o_totalprice").select("o_custkey", "bound", "beyond"),
          f"""with {PRICES}, {S.step()}, b as (select distinct r.k, {S.ceil_to('v')} as bound from r join st on r.k = st.k)
select b.k as o_custkey, bound, count(*) as beyond from b join r on r.k = b.k and v < bound group by b.k, bound""")


def _majority(c: Catalog) -> None:
    flags = S.values("lineitem", "l_orderkey", "l_returnflag", "v")
    label = f"{S.values('part', 'p_brand', LABEL, 'v')}, nn as (select k, count(*) as total from r group by k)"
    c.add("most_eq", lambda s, d: majority.most_eq(baskets(s, d), "l_returnflag"),
          f"""with {flags}, n as (select k, count(*) as n from r group by k)
select vc.k as l_orderkey, raw as filled from vc join n on vc.k = n.k where cnt > n / 2 and cnt < n""")
    c.add("most_eq_ngrams", lambda s, d: majority.most_eq(labelled_parts(s, d), "label"),
          f"""with {label}, {S.grams('part', 'p_brand', LABEL)},
m as (select vc.k, raw as filled from vc join nn on vc.k = nn.k where cnt > total / 2 and cnt < total)
select k as p_brand, filled from m union all
select ge.k, gram from ge join nn on ge.k = nn.k where freq > total / 2 and freq < total and ge.k not in (select k from m)""")
    c.add("most_not_eq", lambda s, d: majority.most_not_eq(baskets(s, d), "l_returnflag"),
          f"""with {flags}, n as (select k, count(*) as n from r group by k)
select vc.k as l_orderkey, raw as filled from vc join n on vc.k = n.k where n - cnt > n / 2""")
    c.add("most_greater", lambda s, d: majority.most_greater(orders(s, d), "o_totalprice"),
          f"""with {PRICES}, {S.step()}, q as (select k, v, row_number() over (partition by k order by v) as i, count(*) over (partition by k) as n from r),
b as (select distinct q.k, n, {S.floor_to('v')} as bound from q join st on q.k = st.k where i <= n // 2)
select b.k as o_custkey, {S.number_text('bound')} as filled from b join r on r.k = b.k group by b.k, bound, n
having count_if(v > bound) > n // 2 and count_if(v > bound) < n""")
    c.add("most_less", lambda s, d: majority.most_less(events(s, d), "val"),
          f"""with {EVENTS}, {S.step()}, q as (select k, v, row_number() over (partition by k order by v desc) as i, count(*) over (partition by k) as n from r where v is not null),
b as (select distinct q.k, n, {S.ceil_to('v')} as bound from q join st on q.k = st.k where i <= n // 2)
select b.k as user_id, {S.number_text('bound')} as filled from b join r on r.k = b.k group by b.k, bound, n
having count_if(v < bound) > n // 2 and count_if(v < bound) < n""")
    ranked = "q as (select k, raw, row_number() over (partition by k order by v) - 1 as i, count(*) over (partition by k) as n from r where v is not null)"
    c.add("most_greater_eq", lambda s, d: majority.most_greater_eq(events(s, d), "val"),
          f"with {EVENTS}, {ranked} select distinct k as user_id, raw as filled from q where i >= 1 and i < n // 2")
    c.add("most_less_eq", lambda s, d: majority.most_less_eq(orders(s, d), "o_orderdate"),
          f"""with {DATES}, {ranked} select distinct k as o_custkey, raw as filled from q
where (n = 1 and i = 0) or (n > 1 and i in (n - n // 2, least(n - n // 2 + 1, n - 1)))""")
    c.add("most_less_eq_full_half", lambda s, d: majority.most_less_eq(lines(s, d), "l_quantity", full_half=True),
          f"with {LINES}, {ranked} select distinct k as l_suppkey, raw as filled from q where i >= n - n // 2 and i <= n - 2")


def _universal(c: Catalog) -> None:
    status = S.values("lineitem", "l_orderkey", "l_linestatus", "v")
    c.add("all_eq", lambda s, d: universal.all_eq(baskets(s, d), "l_linestatus"),
          f"with {status} select k as l_orderkey, min(raw) as filled from r group by k having count(distinct raw) = 1")
    c.add("all_eq_ngrams", lambda s, d: universal.all_eq(labelled_parts(s, d), "label"),
          f"""with {S.values('part', 'p_brand', LABEL, 'v')}, {S.grams('part', 'p_brand', LABEL)}, n as (select k, count(*) as n from r group by k),
u as (select k, filled, sum(c) as c from (select k, raw as filled, cnt as c from vc union all select k, gram, freq from ge) group by all)
select u.k as p_brand, filled from u join n on u.k = n.k where c = n""")
    c.add("all_not_eq", lambda s, d: universal.all_not_eq(orders(s, d), "o_orderstatus"),
          "select o_custkey, o_orderstatus as filled from orders where false")
    c.add("all_greater_eq", lambda s, d: universal.all_greater_eq(events(s, d), "val"),
          f"with {EVENTS} select k as user_id, {S.number_text('min(v)')} as filled from r group by k having min(v) is not null")
    c.add("all_less_eq", lambda s, d: universal.all_less_eq(orders(s, d), "o_orderdate"),
          f"with {DATES} select k as o_custkey, cast(max(v) as varchar) as filled from r group by k")
    for name, func, f, agg in (
        ("all_greater", universal.all_greater, S.floor_to, "min"), ("all_less", universal.all_less, S.ceil_to, "max"),
    ):
        c.add(name, lambda s, d, func=func: func(orders(s, d), "o_totalprice"),
              f"""with {PRICES}, {S.step()}, m as (select k, {agg}(v) as v from r group by k), b as (select m.k, {f('v')} as bound from m join st on m.k = st.k)
select k as o_custkey, {S.number_text('bound')} as filled from b""")


def _ngrams(c: Catalog) -> None:
    def documents(s, d):
        return KeyedTable(read(s, d, "documents"), ["source"], ["doc_id"])

    text = S.grams("documents", "source", "text")
    c.add("ngram_counts", lambda s, d: ngrams.ngram_counts(documents(s, d), "text"),
          f"with {text} select k as source, n, gram, freq, n_texts, n_rows from gc")
    c.add("clean_ngrams", lambda s, d: ngrams.clean_ngrams(ngrams.ngram_counts(documents(s, d), "text")),
          f"with {text} select k as source, n, gram, freq, n_texts, n_rows from gf")
    c.add("frequent_ngrams", lambda s, d: ngrams.frequent_ngrams(documents(s, d), "text"),
          f"with {text} select k as source, n, gram, freq, n_texts, n_rows from ge")
    c.add("frequent_ngrams_labels", lambda s, d: ngrams.frequent_ngrams(labelled_parts(s, d), "label"),
          f"with {S.grams('part', 'p_brand', LABEL)} select k as p_brand, n, gram, freq, n_texts, n_rows from ge")


def _comparisons(c: Catalog) -> None:
    c.add("hop", lambda s, d: compare.hop(superlatives.col_argmax(orders(s, d), "o_totalprice"), orders(s, d), "o_orderdate", raw=True),
          "select o_custkey, cast(o_orderdate as varchar) as out from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1")

    def extremes(s, d):
        df = read(s, d, "lineitem")
        return df.groupBy("l_suppkey").agg(
            F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.avg("l_quantity").alias("mean"),
            F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))

    agg = "(select l_suppkey, min(l_quantity) as lo, max(l_quantity) as hi, avg(l_quantity) as mean, min(l_shipdate) as first, max(l_shipdate) as last from lineitem group by all)"
    col = F.col
    c.add("eq", lambda s, d: extremes(s, d).select("l_suppkey", compare.eq(col("lo"), col("hi")).alias("holds")), f"select l_suppkey, lo = hi as holds from {agg}")
    c.add("not_eq", lambda s, d: extremes(s, d).select("l_suppkey", compare.not_eq(col("lo"), col("hi")).alias("holds")), f"select l_suppkey, lo <> hi as holds from {agg}")
    c.add("round_eq", lambda s, d: extremes(s, d).select("l_suppkey", compare.round_eq(col("mean")).alias("filled")), f"select l_suppkey, {S.round_two('mean')} as filled from {agg}")
    c.add("diff", lambda s, d: extremes(s, d).select("l_suppkey", compare.diff(col("hi"), col("lo")).alias("out")), f"select l_suppkey, {S.round_two('hi - lo')} as out from {agg}")
    c.add("diff_days", lambda s, d: extremes(s, d).select("l_suppkey", compare.diff(col("first"), col("last"), timestamps=True).alias("out")),
          f"select l_suppkey, floor((epoch_us(first) - epoch_us(last)) / 86400000000) as out from {agg}")
    c.add("greater", lambda s, d: extremes(s, d).select("l_suppkey", compare.greater(col("hi"), col("mean")).alias("holds")), f"select l_suppkey, hi > mean as holds from {agg}")
    c.add("less", lambda s, d: extremes(s, d).select("l_suppkey", compare.less(col("hi"), col("mean")).alias("holds")), f"select l_suppkey, hi < mean as holds from {agg}")
    c.add("logic_and", lambda s, d: extremes(s, d).select("l_suppkey", compare.logic_and(col("hi") > col("mean"), col("lo") < 1.5).alias("holds")),
          f"select l_suppkey, hi > mean and lo < 1.5 as holds from {agg}")
    c.add("rows_one", lambda s, d: selectors.filter_eq(events(s, d), "val", rows="one"),
          f"with {EVENTS} select k as user_id, raw as filled, cnt as val_count from vc where cnt = 1")
    single = "s as (select o_custkey as k, o_orderdate as f, min(o_totalprice) as v from orders group by all having count(*) = 1)"
    ranges = {"greater": ("1", "lo", "0", "0", "lo"), "less": ("hi + 1", "n", "0", "0", "n - hi"), "not_eq": ("1", "n", "lo + 1", "hi", "n - (hi - lo)"), "diff": ("1", "n", "lo + 1", "hi", "n - (hi - lo)")}
    names = ("partner_from", "partner_to", "except_from", "except_to", "n_pairs")
    around = "p as (select *, rank() over (partition by k order by v) - 1 as lo, count(*) over (partition by k order by v) as hi, count(*) over (partition by k) as n from s)"
    for func, parts in ranges.items():
        listed = ", ".join(f"cast({r} as bigint) as {x}" for r, x in zip(parts, names))
        c.add(f"pairs_{func}",
              lambda s, d, func=func: compare.pairs(orders(s, d), func, "o_orderdate", "o_totalprice").select("o_custkey", "first", "v", *[F.coalesce(x, F.lit(0)).alias(x) for x in names]),
              f"with {single}, {around} select * from (select k as o_custkey, cast(f as varchar) as first, v, {listed} from p) where n_pairs > 0")
    c.add("pairs_eq",
          lambda s, d: compare.pairs(KeyedTable(read(s, d, "lineitem"), ["l_suppkey"]), "eq", "l_extendedprice", "l_quantity").select("l_suppkey", "first", "n_pairs"),
          f"""with s as (select l_suppkey as k, l_extendedprice as f, min(l_quantity) as v from lineitem group by all having count(*) = 1)
select a.k as l_suppkey, {S.number_text('a.f')} as first, count(*) as n_pairs from s a join s b on a.k = b.k and a.f <> b.f and a.v = b.v group by a.k, a.f""")
