"""Type inference, parsing and profiling of orders per customer written as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import Catalog, read
from factloom.catalog import sqltext as S
from factloom.functions import parsing as P
from factloom.operators import coltypes as T
from factloom.operators import corpus as C
from factloom.operators import profiles as D
from factloom.session import stored

# name -> (Spark, SQL) text of a column
COLUMNS = {
    "day": ("lower(date_format(o_orderdate, 'MMMM d , yyyy'))", "lower(strftime(o_orderdate, '%B %-d , %Y'))"),
    "Date": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "season": ("cast(year(o_orderdate) as string)", "cast(year(o_orderdate) as varchar)"),
    "no": ("cast(i as string)", "cast(i as varchar)"),
    "price": ("cast(cast(floor(o_totalprice) as bigint) as string)", "cast(cast(floor(o_totalprice) as bigint) as varchar)"),
    "clock": ("lpad(cast(o_orderkey % 60 as string), 2, '0') || ':' || lpad(cast(o_orderkey % 59 as string), 2, '0')",) * 2,
    "score": ("cast(o_orderkey % 7 as string) || ' - ' || cast(o_orderkey % 5 as string)",) * 2,
    "level": ("o_orderpriority",) * 2,
    "state": ("o_orderstatus",) * 2,
    "code": ("case when o_orderkey % 2 = 0 then 'x1y' else 'abc' end",) * 2,
    "share": ("case when o_orderkey % 4 = 0 then 'n/a' else cast(o_orderkey % 50 as string) || '.5 %' end",) * 2,
    "note": ("'-'",) * 2,
}


def cells(spark, sf):
    from pyspark.sql import Window as W

    orders = read(spark, sf, "orders").withColumn("i", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    return C.null_empty_cells(C.wide_to_cells(orders, F.col("o_custkey").cast("string"), ["o_orderkey"], {n: F.expr(e[0]) for n, e in COLUMNS.items()}))


def typed(spark, sf):
    clean = stored(cells(spark, sf), "types-cells")
    return T.parse_cells(clean, T.infer_types(clean))


def parsed(spark, sf):
    """The parsed corpus, written down once as every later job reads it several times."""
    return stored(typed(spark, sf), "types-parsed")


def titles(s, d):
    return read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("table_id"), F.col("c_name").alias("title"))


def _sql() -> str:
    each = " union all ".join(
        f"select cast(o_custkey as varchar) as table_id, i::int as row_idx, {k} as col_idx, '{n}' as col_name, {e[1].replace('as string', 'as varchar')} as raw from ro"
        for k, (n, e) in enumerate(COLUMNS.items()))
    num = r"^\s*([\-+]\s*)?\d+(\s*,\s*\d{3})*(\.\d+)?(\s*%)?\s*$"
    inside = r"\b\d+(?:\s*,\s*\d{3})*(?:\.\d+)?\b"
    return f"""ro as (select *, row_number() over (partition by o_custkey order by o_orderkey) as i from orders),
cells as (select *, case when raw not in ('-', 'n/a') then raw end as processed from ({each})),
pr as (select *, regexp_matches(raw, '^[a-z]+ [0-9]+ , [0-9]{{4}}$') or regexp_matches(raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') as is_date,
  regexp_matches(raw, '{num}') as is_num, len(regexp_extract_all(raw, '{inside}')) as k, regexp_matches(raw, '\\b(1[789]|20)\\d\\d\\b') as is_year,
  regexp_matches(raw, '^\\d+$') as is_digits, regexp_matches(raw, '^\\d{{1,2}}:\\d\\d$') as is_time,
  try_cast(raw as bigint) - lag(try_cast(raw as bigint)) over (partition by table_id, col_idx order by row_idx) as jump
  from cells where processed is not null),
ct0 as (select table_id, col_idx, case when bool_and(is_date) then 'date' when min(k) = max(k) and min(k) > 0 and bool_and(is_year) then 'year'
  when bool_and(is_digits) and count(distinct raw) > 1 and coalesce(bool_and(jump in (0, 1)), true) then 'rank' when bool_and(is_num) then 'num'
  when bool_and(is_time) then 'time' when min(k) = max(k) and min(k) > 0 then 'same_n_nums' when bool_and(not regexp_matches(raw, '\\d')) then 'str' else 'mixed' end as coltype
  from pr group by all),
ct as (select distinct c.table_id, c.col_idx, c.col_name, coalesce(coltype, 'empty') as coltype from cells c left join ct0 on c.table_id = ct0.table_id and c.col_idx = ct0.col_idx),
ty as (select c.*, ct.coltype,
  case when coltype in ('num', 'rank') then try_cast(replace(replace(processed, ' ', ''), '%', '') as double)
       when coltype = 'time' then cast(split_part(processed, ':', 1) as double) * 60 + cast(split_part(processed, ':', 2) as double) end as num,
  case when coltype in ('num', 'rank', 'time') then contains(processed, '.') end as is_float,
  case when coltype in ('year', 'same_n_nums') then list_transform(regexp_extract_all(processed, '{inside}'), lambda x: cast(x as double)) end as nums,
  case when coltype = 'date' then coalesce(try_strptime(processed, '%B %-d , %Y'), try_strptime(processed, '%Y-%m-%d')) end as ts
  from cells c join ct on c.table_id = ct.table_id and c.col_idx = ct.col_idx)"""


TYPED = _sql()


def _float_text(x: str, keep: str) -> str:
    t = S.number_text(x)
    return f"(case when {keep} and not contains({t}, '.') then {t} || '.0' else {t} end)"


def _group(n: str, total: str) -> str:
    return f"(case when {n} = {total} then 'all' when {n} = 1 then 'one' when {n} / {total} <= 0.5 then 'several' else 'most' end)"


OCC = """vc as (select table_id, col_idx, raw, count(*) as c, min(row_idx) as fr from cells group by all),
occ as (select table_id, col_idx, c, count(*) as nv, min(fr) as fr from vc group by all)"""
STATS_V1 = f"""{OCC},
v1 as (select table_id, col_idx, sum(nv)::bigint as uniq, sum(nv) = sum(nv * c) as only_unique,
  string_agg(nv || (case when nv = 1 then ' value has ' else ' values have ' end) || c || (case when c = 1 then ' occurrence' else ' occurrences' end), ', ' order by nv desc, fr) as counts from occ group by all)"""
STATS_V2 = f"""{OCC},
tot as (select table_id, col_idx, sum(nv)::bigint as uniq, sum(nv * c)::bigint as total from occ group by all),
gr as (select occ.table_id, occ.col_idx, uniq, total, {_group('nv', 'uniq')} as vg, {_group('c', 'total')} as og, min(fr) as fr
  from occ join tot on occ.table_id = tot.table_id and occ.col_idx = tot.col_idx group by all),
gs as (select *, min(fr) over (partition by table_id, col_idx, vg) as vfr from gr),
v2 as (select table_id, col_idx, 'Column has ' || {_group('uniq', 'total')} || ' unique value' || (case when {_group('uniq', 'total')} = 'one' then '' else 's' end) || ', ' ||
  string_agg(vg || (case when vg = 'one' then ' value has ' else ' values have ' end) || og || (case when og = 'one' then ' occurrence' else ' occurrences' end), ', ' order by vfr, og) as stats
  from gs group by table_id, col_idx, uniq, total)"""


def _one_text(where: str, source: str, value: str, flag: str, full: bool) -> str:
    f = f"coalesce({flag}, false)"
    mx, mn = f"arg_max({f}, {value})", f"arg_min({f}, {value})"
    parts = [f"'max: ' || {_float_text(f'max({value})', mx)}", f"'min: ' || {_float_text(f'min({value})', mn)}"]
    if full:
        parts += [f"'sum: ' || {_float_text(f'round_even(sum({value}), 3)', f'bool_or({f})')}", f"'avg: ' || {_float_text(f'round_even(avg({value}), 3)', 'true')}"]
    parts.append(f"'max diff: ' || {_float_text(f'round_even(max({value}) - min({value}), 3)', f'({mx} or {mn})')}")
    body = " || ', ' || ".join(parts)
    return f"select table_id, col_idx, {body} as typed_stats from {source} where {where} group by table_id, col_idx"


def _typed_stats() -> str:
    single = _one_text("coltype = 'num' and num is not null", "ty", "num", "is_float", True)
    ranks = _one_text("coltype in ('rank', 'time') and num is not null", "ty", "num", "is_float", False)
    pos = "ps as (select table_id, col_idx, coltype, unnest(nums) as x, generate_subscripts(nums, 1) as p from ty where nums is not null)"
    agg = ("pa as (select table_id, col_idx, coltype, p, max(x) as mx, min(x) as mn, round_even(sum(x), 3) as sm, round_even(avg(x), 3) as av, "
           "round_even(max(x) - min(x), 3) as df from ps group by all)")
    j = lambda c, keep="false": f"string_agg({_float_text(c, keep)}, ', ' order by p)"
    full = f"'max: ' || {j('mx')} || ', min: ' || {j('mn')} || ', sum: ' || {j('sm')} || ', avg: ' || {j('av', 'true')} || ', max diff: ' || {j('df')}"
    part = f"'max: ' || {j('mx')} || ', min: ' || {j('mn')} || ', max diff: ' || {j('df')}"
    dates = ("select table_id, col_idx, 'first: ' || min(ts)::date || ', last: ' || max(ts)::date || ', max diff days: ' || date_diff('day', min(ts), max(ts)) || "
             "', max diff months: ' || ((year(max(ts)) * 12 + month(max(ts))) - (year(min(ts)) * 12 + month(min(ts)))) || ', max diff years: ' || (year(max(ts)) - year(min(ts))) as typed_stats "
             "from ty where coltype = 'date' and ts is not null group by all")
    return f"""{pos}, {agg},
ts as ({single} union all {ranks} union all
  select table_id, col_idx, case when coltype = 'year' then {part} else {full} end from pa group by table_id, col_idx, coltype union all {dates})"""


def register(c: Catalog) -> None:
    _types(c)
    _profiles(c)


def _types(c: Catalog) -> None:
    c.add("infer_types", lambda s, d: T.infer_types(cells(s, d)), f"with {TYPED} select table_id, col_idx, col_name, coltype from ct")
    for kind in ("date", "year", "rank", "num", "time", "same_n_nums", "str"):
        c.add(f"infer_{kind}", lambda s, d, kind=kind: T.infer_types(cells(s, d)).where(F.col("coltype") == kind).groupBy("col_name").agg(F.count(F.lit(1)).alias("n")),
              f"with {TYPED} select col_name, count(*) as n from ct where coltype = '{kind}' group by all")
    c.add("parse_cells_numbers", lambda s, d: typed(s, d).select("table_id", "row_idx", "col_idx", "coltype", "num", "is_float"),
          f"with {TYPED} select table_id, row_idx, col_idx, coltype, num, is_float from ty")
    c.add("parse_cells_multi", lambda s, d: typed(s, d).select("table_id", "row_idx", "col_idx", F.posexplode("nums").alias("p", "x")),
          f"with {TYPED} select table_id, row_idx, col_idx, unnest(nums) as x, (generate_subscripts(nums, 1) - 1)::int as p from ty where nums is not null")
    c.add("parse_cells_dates", lambda s, d: typed(s, d).where("ts is not null").select("table_id", "row_idx", "col_idx", F.col("ts").cast("date").cast("string").alias("day")),
          f"with {TYPED} select table_id, row_idx, col_idx, cast(ts::date as varchar) as day from ty where ts is not null")
    c.add("parse_number", lambda s, d: read(s, d, "orders").select("o_orderkey", P.parse_number(F.expr("format_number(o_totalprice, 2) || ' %'")).alias("x")),
          "select o_orderkey, o_totalprice as x from orders")
    c.add("parse_numbers", lambda s, d: read(s, d, "pages").select("page_id", F.aggregate(P.parse_numbers(F.col("url")), F.lit(0.0), lambda a, x: a + x).alias("total"), P.number_count(F.col("url")).cast("bigint").alias("n")),
          r"with x as (select page_id, regexp_extract_all(url, '\b\d+(?:\s*,\s*\d{3})*(?:\.\d+)?\b') as m from pages) "
          "select page_id, coalesce(list_sum(list_transform(m, lambda v: cast(v as double))), 0.0) as total, len(m) as n from x")
    c.add("parse_duration", lambda s, d: read(s, d, "events").select("event_id", P.parse_seconds(F.expr("cast(event_id % 24 as string) || ':' || date_format(ts, 'mm:ss')")).alias("secs"),
                                                                     P.parse_duration(F.expr("cast(event_id % 24 as string) || 'h ' || cast(event_id % 50 as string) || ' min'")).alias("units")),
          "select event_id, cast((event_id % 24) * 3600 + minute(ts) * 60 + second(ts) as double) as secs, cast((event_id % 24) * 3600 + (event_id % 50) * 60 as double) as units from events")

    def dated(s, d):
        notations = {
            "a": "date_format(ts, 'd MMM yyyy h:mm a')", "b": "date_format(ts, 'M/d/yyyy')", "e": "date_format(ts, 'EEEE , MMMM d')",
            "f": "'moved on ' || date_format(ts, 'MMMM d , yyyy') || ' to a new place'",
        }
        df = read(s, d, "events").select("event_id", *[F.expr(e).alias(f"{n}_raw") for n, e in notations.items()])
        for n in notations:
            df = P.parse_dates(df, F.col(f"{n}_raw"), n, T.BASE_DATE)
        return df.select("event_id", *[F.col(n).cast("string").alias(n) for n in notations])

    c.add("parse_date", dated,
          """select event_id, strftime(ts, '%Y-%m-%d %H:%M:00') as a, strftime(ts, '%Y-%m-%d 00:00:00') as b, strftime(ts, '2023-%m-%d 00:00:00') as e, strftime(ts, '%Y-%m-%d 00:00:00') as f from events""")
    first = "f as (select ty.* from ty where row_idx = 1)"
    rev = f"{first}, rv as (select table_id, col_idx, col_name, case when coltype = 'same_n_nums' and len(nums) = 1 then 'num' else coltype end as coltype, coalesce(len(nums) = 1, false) as revised from f)"
    c.add("revise_types", lambda s, d: T.revise_types(parsed(s, d)), f"with {TYPED}, {rev} select table_id, col_idx, col_name, coltype, revised from rv")
    c.add("query_cells", lambda s, d: T.query_cells(parsed(s, d)).select("table_id", "row_idx", "col_idx", "coltype", "raw", "num", "str"),
          f"""with {TYPED}, {rev} select ty.table_id, row_idx, ty.col_idx, rv.coltype, raw, case when rv.coltype in ('num', 'year') then coalesce(num, nums[1]) else num end as num,
case when rv.coltype in ('same_n_nums', 'str', 'mixed') then processed end as str from ty join rv on ty.table_id = rv.table_id and ty.col_idx = rv.col_idx""")

    def dirty(s, d):
        from factloom.catalog.corpus import order_cells
        return order_cells(s, d)

    from factloom.catalog.corpus import CELLS
    c.add("parse_tables", lambda s, d: T.parse_tables(dirty(s, d)).select("table_id", "row_idx", "col_idx", "coltype", "raw", "num"),
          f"""with {CELLS}, pc as (select table_id, col_idx, count(processed) as n, bool_and(regexp_matches(raw, '^\\d+$')) as dg, count(distinct raw) as dv, bool_and(jump in (0, 1)) as up
  from (select *, try_cast(raw as bigint) - lag(try_cast(raw as bigint)) over (partition by table_id, col_idx order by row_idx) as jump from clean where processed is not null) group by all),
ct as (select c.table_id, c.col_idx, case when n is null then 'empty' when c.col_idx = 0 then 'str' when c.col_idx = 2 then 'date' when dv > 1 and up then 'rank' else 'num' end as coltype
  from (select distinct table_id, col_idx from clean) c left join pc on c.table_id = pc.table_id and c.col_idx = pc.col_idx)
select cl.table_id, row_idx, cl.col_idx, coltype, raw, case when coltype in ('num', 'rank') then cast(processed as double) end as num
from clean cl join ct on cl.table_id = ct.table_id and cl.col_idx = ct.col_idx""")

    def report(s, d, i):
        types = T.infer_types(cells(s, d)).withColumn("split", F.expr("case when cast(table_id as int) % 5 = 0 then 'test' else 'train' end"))
        return D.coltype_report(types)[i]

    c.add("coltype_report", lambda s, d: report(s, d, 0), f"with {TYPED} select coltype, count(*) as n, round_even(count(*) / (select count(*) from ct), 3) as share from ct group by all")
    c.add("coltype_examples", lambda s, d: report(s, d, 1).select("coltype", "table_id", "col_idx"),
          f"""with {TYPED} select coltype, table_id, col_idx from ct where cast(table_id as int) % 5 <> 0
qualify row_number() over (partition by coltype order by md5('42|' || table_id || '|' || col_idx), table_id, col_idx) <= 50""")


def _profiles(c: Catalog) -> None:
    c.add("quantity_group", lambda s, d: read(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_quantity").alias("u"), F.count(F.lit(1)).alias("n")).select("l_suppkey", D.quantity_group(F.col("u"), F.col("n")).alias("g")),
          f"select l_suppkey, {_group('count(distinct l_quantity)', 'count(*)')} as g from lineitem group by all")
    c.add("number_stats", lambda s, d: D.number_stats(read(s, d, "lineitem"), ["l_suppkey"], "l_quantity"),
          """select l_suppkey, count(*) as n, max(l_quantity) as max, min(l_quantity) as min, round_even(sum(l_quantity), 3) as sum, round_even(avg(l_quantity), 3) as avg,
round_even(max(l_quantity) - min(l_quantity), 3) as max_diff from lineitem group by all""")
    c.add("restricted_number_stats", lambda s, d: D.number_stats(read(s, d, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "max", "min", F.col("max_diff").cast("bigint").alias("max_diff")),
          "select o_custkey, max(o_orderkey) as max, min(o_orderkey) as min, max(o_orderkey) - min(o_orderkey) as max_diff from orders group by all")
    c.add("multi_number_stats", lambda s, d: D.multi_number_stats(typed(s, d)).select("table_id", "col_idx", "pos", "max", "min", "sum", "avg", "max_diff"),
          f"""with {TYPED}, ps as (select table_id, col_idx, unnest(nums) as x, (generate_subscripts(nums, 1) - 1)::int as pos from ty where nums is not null)
select table_id, col_idx, pos, max(x) as max, min(x) as min, round_even(sum(x), 3) as sum, round_even(avg(x), 3) as avg, round_even(max(x) - min(x), 3) as max_diff from ps group by all""")
    c.add("date_stats", lambda s, d: D.date_stats(read(s, d, "orders"), ["o_custkey"], "o_orderdate").select("o_custkey", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"),
              F.col("diff_days").cast("bigint").alias("diff_days"), F.col("diff_months").cast("bigint").alias("diff_months"), F.col("diff_years").cast("bigint").alias("diff_years")),
          """select o_custkey, cast(min(o_orderdate)::date as varchar) as first, cast(max(o_orderdate)::date as varchar) as last, date_diff('day', min(o_orderdate), max(o_orderdate)) as diff_days,
(year(max(o_orderdate)) * 12 + month(max(o_orderdate))) - (year(min(o_orderdate)) * 12 + month(min(o_orderdate))) as diff_months, year(max(o_orderdate)) - year(min(o_orderdate)) as diff_years from orders group by all""")
    c.add("common_stats_counts", lambda s, d: D.common_stats_counts(cells(s, d)).select("table_id", "col_idx", F.col("unique").alias("uniq"), "only_unique", "counts"), f"with {TYPED}, {STATS_V1} select * from v1")
    c.add("common_stats_groups", lambda s, d: D.common_stats_groups(cells(s, d)), f"with {TYPED}, {STATS_V2} select * from v2")
    c.add("typed_stats_text", lambda s, d: D.typed_stats_text(parsed(s, d)), f"with {TYPED}, {_typed_stats()} select * from ts")
    c.add("column_stats_v1", lambda s, d: D.column_stats(parsed(s, d), "v1"),
          f"with {TYPED}, {STATS_V1} select table_id, col_idx, 'unique: ' || uniq || ', only unique: ' || (case when only_unique then 'True' else 'False' end) || ', counts: ' || counts as stats from v1")
    c.add("table_features", lambda s, d: D.table_features(parsed(s, d), titles(s, d), "v2", True, True, True),
          f"""with {TYPED}, {STATS_V2}, {_typed_stats()}, f as (select table_id, col_idx, lower(col_name) as h, coltype, raw from ty where row_idx = 1),
l as (select f.table_id, f.col_idx, 'Column ' || h || '. Type: ' || coltype || '. Stats: ' || v2.stats || coalesce(', ' || typed_stats, '') || '. Value: ' || raw || '.' as t
  from f join v2 on f.table_id = v2.table_id and f.col_idx = v2.col_idx left join ts on f.table_id = ts.table_id and f.col_idx = ts.col_idx)
select l.table_id, 'Title: ' || c_name || '. ' || string_agg(t, ' ' order by col_idx) as input from l join customer on l.table_id = cast(c_custkey as varchar) group by l.table_id, c_name""")
    c.add("table_features_plain", lambda s, d: D.table_features(parsed(s, d), titles(s, d), include_stats=False),
          f"""with {TYPED}, l as (select table_id, col_idx, 'Column ' || lower(col_name) || '. Type: ' || coltype || '.' as t from ct)
select l.table_id, 'Title: ' || c_name || '. ' || string_agg(t, ' ' order by col_idx) as input from l join customer on l.table_id = cast(c_custkey as varchar) group by l.table_id, c_name""")
