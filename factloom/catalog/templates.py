"""Templates over orders per customer: every customer's table gets every template."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.catalog import Catalog, read
from factloom.catalog import sqltext as S
from factloom.catalog.sqltext import number_text, round_two
from factloom.operators import corpus as C
from factloom.operators import metrics as M
from factloom.operators import templates as T
from factloom.plans import fill as P
from factloom.session import stored

TEMPLATES = [
    "eq { count { filter_eq { all_rows ; status ; X } } ; X } = true",
    "only { filter_eq { all_rows ; status ; X } }",
    "eq { max { all_rows ; price } ; X }",
    "round_eq { sum { all_rows ; price } ; X }",
    "eq { hop { argmax { all_rows ; price } ; status } ; X }",
    "eq { nth_max { all_rows ; price ; X } ; X }",
    "eq { hop { nth_argmin { all_rows ; price ; X } ; day } ; X }",
    "most_greater_eq { all_rows ; price ; X }",
    "all_less_eq { all_rows ; day ; X }",
    "eq { count { filter_greater_eq { all_rows ; price ; X } } ; X }",
    "round_eq { avg { filter_eq { all_rows ; status ; X } ; price } ; X }",
    "eq { hop { filter_eq { all_rows ; day ; X } ; status } ; X }",
    "most_eq { filter_eq { all_rows ; status ; X } ; priority ; X }",
    "all_eq { all_rows ; status ; X }",
    "greater { hop { filter_eq { all_rows ; day ; X } ; price } ; hop { filter_eq { all_rows ; day ; X } ; price } }",
    "round_eq { avg { filter_not_eq { all_rows ; status ; X } ; price } ; X }",
    "eq { max { filter_greater { all_rows ; price ; X } ; price } ; X }",
    "eq { count { filter_eq { filter_eq { all_rows ; status ; X } ; priority ; X } } ; X }",
    "eq { count { all_rows } ; X }",
    "eq { count { filter_all { all_rows ; status } } ; X }",
    "greater { max { all_rows ; price } ; min { all_rows ; price } }",
    "eq { diff { max { all_rows ; price } ; min { all_rows ; price } } ; X }",
    "and { only { filter_eq { all_rows ; priority ; X } } ; eq { hop { filter_eq { all_rows ; priority ; X } ; status } ; X } }",
    "eq { hop { filter_eq { all_rows ; day ; X } ; status } ; hop { filter_eq { all_rows ; day ; X } ; status } }",
    "eq { diff { hop { filter_eq { all_rows ; day ; X } ; price } ; hop { filter_eq { all_rows ; day ; X } ; price } } ; X }",
    "less { hop { filter_eq { all_rows ; priority ; X } ; day } ; hop { filter_eq { all_rows ; status ; X } ; day } }",
    "most_less_eq { filter_less_eq { all_rows ; day ; X } ; price ; X }",
    "eq { hop { filter_not_eq { all_rows ; price ; X } ; status } ; X }",
    "all_greater_eq { filter_greater_eq { all_rows ; day ; X } ; price ; X }",
    "eq { hop { argmax { filter_less { all_rows ; price ; X } ; price } ; day } ; X }",
    "eq { count { filter_eq { filter_eq { filter_eq { filter_eq { all_rows ; status ; X } ; priority ; X } ; status ; X } ; priority ; X } } ; X }",
    "and { and { only { filter_eq { all_rows ; priority ; X } } ; eq { hop { filter_eq { all_rows ; priority ; X } ; status } ; X } } ; eq { hop { filter_eq { all_rows ; priority ; X } ; day } ; X } }",
    "greater { nth_max { all_rows ; price ; X } ; nth_min { all_rows ; price ; X } }",
    "and { most_eq { all_rows ; status ; X } ; most_greater_eq { all_rows ; price ; X } }",
    "and { less { hop { filter_eq { all_rows ; priority ; X } ; price } ; hop { filter_eq { all_rows ; status ; X } ; price } } ; and { eq { hop { filter_eq { all_rows ; priority ; X } ; status } ; X } ; eq { hop { filter_eq { all_rows ; status ; X } ; priority } ; X } } }",
]
# Templates that are read but not filled, and why.
DEEP = [
    "all_not_eq { all_rows ; status ; X }",
    "and { greater { nth_max { all_rows ; price ; X } ; nth_min { all_rows ; price ; X } } ; only { all_rows } }",
]
DEEP_REASONS = ["never has an option", "a pair of options inside another statement"]
BROKEN = [
    "eq { sum { all_rows ; status } ; X }",
    "eq { largest { all_rows ; price } ; X }",
    "eq { max { all_rows ; weight } ; X }",
    "eq { max { all_rows ; price ; X",
    "eq { max { all_rows ; price ; price } ; X }",
]
# Templates filled together, by their numbers.
GROUPS = {"scalars": [2, 3, 4, 5, 6], "counts": [0, 9], "single_rows": [1, 11], "claims": [7, 8, 13], "subsets": [10, 12], "inner": [15, 16, 17, 26, 28, 29], "sided": [18, 19, 20, 21, 22, 27], "deep": [30, 31]}
# Templates whose pairs stay factorised.
PAIRS = [14, 23, 24, 25, 32, 33, 34]
# Templates over one table of all orders.
LARGE = [9, 15, 16, 28, 29]
KINDS = {"status": "str", "priority": "str", "price": "num", "day": "date"}


def cells(s, d, one_table=False):
    """The orders of a customer as typed cells; or all orders as one table."""
    row = F.col("o_orderkey").cast("int") if one_table else F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    table = F.lit("orders") if one_table else F.col("o_custkey").cast("string")
    price = F.floor("o_totalprice")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = read(s, d, "orders").select(table.alias("table_id"), row.alias("row_idx"), "o_orderstatus", "o_orderpriority", price.alias("price"), day.alias("day"), "o_orderdate")
    null = lambda t: F.lit(None).cast(t)
    cell = lambda i, n, raw, num, ts, st: F.struct(F.lit(i).alias("col_idx"), F.lit(n).alias("col_name"), F.lit(KINDS[n]).alias("coltype"), raw.alias("raw"), num.alias("num"), ts.alias("ts"), st.alias("str"))
    each = F.array(
        cell(0, "status", F.col("o_orderstatus"), null("double"), null("timestamp_ntz"), F.col("o_orderstatus")),
        cell(1, "priority", F.col("o_orderpriority"), null("double"), null("timestamp_ntz"), F.col("o_orderpriority")),
        cell(2, "price", F.col("price").cast("string"), F.col("price").cast("double"), null("timestamp_ntz"), null("string")),
        cell(3, "day", F.col("day"), null("double"), F.col("o_orderdate").cast("timestamp_ntz"), null("string")))
    return rows.select("table_id", "row_idx", F.explode(each).alias("c")).select("table_id", "row_idx", "c.*")


def templates(s, d, texts):
    lists = F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("template_id", "lf")
    return read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("table_id"), lists)


def row_templates(s, d, texts):
    """A template for each order, over a column that has a name of its own in every table."""
    o = read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("table_id"), F.col("o_orderkey").alias("template_id"))
    text = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("template_id") % len(texts)).cast("int"))
    return o.select("table_id", "template_id", F.replace(text, F.lit("price"), F.concat(F.lit("price of "), "table_id")).alias("lf"))


def headers(s, d):
    name = lambda n: F.concat(F.lit("price of "), "table_id") if n == "price" else F.lit(n)
    types = F.create_map(*[x for n, k in KINDS.items() for x in (name(n), F.lit(k))])
    return read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("table_id")).distinct().select("table_id", types.alias("types"))


def _texts(texts) -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    return f"tl as (select * from (values {rows}) v(template_id, lf)), tt as (select cast(c_custkey as varchar) as table_id, template_id, lf from customer, tl)"


def _row_texts(texts) -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    return f"""tl as (select * from (values {rows}) v(pattern, form)),
tt as (select cast(o_custkey as varchar) as table_id, o_orderkey as template_id, pattern, replace(form, 'price', 'price of ' || o_custkey) as lf from orders join tl on o_orderkey % {len(texts)} = pattern)"""


BASE = """q as (select cast(o_custkey as varchar) as k, row_number() over (partition by o_custkey order by o_orderkey) as i, o_orderstatus as status,
  o_orderpriority as priority, cast(floor(o_totalprice) as bigint) as price, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderdate as ts from orders)"""


def _statements_sql() -> str:
    return f"""with {BASE}, {_statements_ctes()}"""


def _statements_ctes() -> str:
    return f"""r as (select k, cast(price as double) as v from q), cn as (select k, count(*) as c from q group by k), {S.step()}, s as (
select k, 0 as t, 'eq {{ count {{ filter_eq {{ all_rows ; status ; ' || status || ' }} }} ; ' || count(*) || ' }}' as x from q group by k, status having count(*) > 1
union all select k, 1, 'only {{ filter_eq {{ all_rows ; status ; ' || status || ' }} }}' from q group by k, status having count(*) = 1
union all select k, 2, 'eq {{ max {{ all_rows ; price }} ; ' || max(price) || ' }}' from q group by k
union all select k, 3, 'round_eq {{ sum {{ all_rows ; price }} ; ' || cast(sum(price) as bigint) || ' }}' from q group by k
union all select k, 4, 'eq {{ hop {{ argmax {{ all_rows ; price }} ; status }} ; ' || arg_max(status, (price, -i)) || ' }}' from q group by k
union all select k, 5, 'eq {{ nth_max {{ all_rows ; price ; ' || n || ' }} ; ' || price || ' }}' from
  (select *, row_number() over (partition by k order by price desc, i) as n, count(*) over (partition by k) as c from q) where n <= c // 2
union all select k, 6, 'eq {{ hop {{ nth_argmin {{ all_rows ; price ; ' || n || ' }} ; day }} ; ' || day || ' }}' from
  (select *, row_number() over (partition by k order by price, i) as n, count(*) over (partition by k) as c from q) where n <= c // 2
union all select k, 7, 'most_greater_eq {{ all_rows ; price ; ' || price || ' }}' from
  (select *, row_number() over (partition by k order by price) - 1 as n, count(*) over (partition by k) as c from q) where n >= 1 and n < c // 2
union all select k, 8, 'all_less_eq {{ all_rows ; day ; ' || max(day) || ' }}' from q group by k
union all select a.k, 9, 'eq {{ count {{ filter_greater_eq {{ all_rows ; price ; ' || a.price || ' }} }} ; ' || count(*) || ' }}' from
  (select distinct k, price from q where price < (select max(price) from q m where m.k = q.k)) a join q b on a.k = b.k and b.price >= a.price group by a.k, a.price having count(*) > 1
union all select k, 10, 'round_eq {{ avg {{ filter_eq {{ all_rows ; status ; ' || status || ' }} ; price }} ; ' || {number_text(round_two('avg(price)'))} || ' }}' from q group by k, status having count(*) > 1
union all select k, 11, 'eq {{ hop {{ filter_eq {{ all_rows ; day ; ' || day || ' }} ; status }} ; ' || min(status) || ' }}' from q group by k, day having count(*) = 1
union all select a.k, 12, 'most_eq {{ filter_eq {{ all_rows ; status ; ' || a.status || ' }} ; priority ; ' || priority || ' }}' from q a join
  (select k, status, count(*) as c from q group by all having count(*) > 1) g on a.k = g.k and a.status = g.status group by a.k, a.status, priority, c having count(*) > c / 2 and count(*) < c
union all select k, 13, 'all_eq {{ all_rows ; status ; ' || min(status) || ' }}' from q group by k having count(distinct status) = 1
union all select a.k, 15, 'round_eq {{ avg {{ filter_not_eq {{ all_rows ; status ; ' || a.status || ' }} ; price }} ; ' || {number_text(round_two('avg(b.price)'))} || ' }}' from
  (select distinct k, status from q) a join q b on a.k = b.k and b.status <> a.status group by a.k, a.status having count(*) > 1
union all select f.k, 16, 'eq {{ max {{ filter_greater {{ all_rows ; price ; ' || cast(bound as bigint) || ' }} ; price }} ; ' || max(b.price) || ' }}' from
  (select distinct r.k, {S.floor_to('v')} as bound from r join st on r.k = st.k) f join q b on f.k = b.k and b.price > bound join cn on cn.k = f.k group by f.k, bound, c having count(*) > 1 and count(*) < c
union all select a.k, 17, 'eq {{ count {{ filter_eq {{ filter_eq {{ all_rows ; status ; ' || status || ' }} ; priority ; ' || priority || ' }} }} ; ' || count(*) || ' }}' from
  (select *, count(*) over (partition by k, status) as c from q) a where c > 1 group by a.k, status, priority having count(*) > 1
union all select k, 18, 'eq {{ count {{ all_rows }} ; ' || c || ' }}' from cn
union all select k, 19, 'eq {{ count {{ filter_all {{ all_rows ; status }} }} ; ' || c || ' }}' from cn
union all select k, 20, 'greater {{ max {{ all_rows ; price }} ; min {{ all_rows ; price }} }}' from q group by k having max(price) > min(price)
union all select k, 21, 'eq {{ diff {{ max {{ all_rows ; price }} ; min {{ all_rows ; price }} }} ; ' || (max(price) - min(price)) || ' }}' from q group by k having max(price) > min(price)
union all select k, 22, 'and {{ only {{ filter_eq {{ all_rows ; priority ; ' || priority || ' }} }} ; eq {{ hop {{ filter_eq {{ all_rows ; priority ; ' || priority || ' }} ; status }} ; ' || min(status) || ' }} }}' from q group by k, priority having count(*) = 1
union all select k, 26, 'most_less_eq {{ filter_less_eq {{ all_rows ; day ; ' || d || ' }} ; price ; ' || price || ' }}' from
  (select a.k, a.ts as d, b.price, row_number() over (partition by a.k, a.ts order by b.price) - 1 as n, count(*) over (partition by a.k, a.ts) as c
   from (select distinct k, day as ts, (select min(day) from q m where m.k = q.k) as first from q) a join q b on a.k = b.k and b.day <= a.ts where a.ts <> a.first)
  where c > 1 and n between c - c // 2 and least(c - c // 2 + 1, c - 1)
union all select a.k, 27, 'eq {{ hop {{ filter_not_eq {{ all_rows ; price ; ' || a.price || ' }} ; status }} ; ' || min(b.status) || ' }}' from
  (select distinct k, price from q) a join q b on a.k = b.k and b.price <> a.price group by a.k, a.price having count(*) = 1
union all select a.k, 28, 'all_greater_eq {{ filter_greater_eq {{ all_rows ; day ; ' || a.day || ' }} ; price ; ' || min(b.price) || ' }}' from
  (select distinct k, day, (select max(day) from q m where m.k = q.k) as last from q) a join q b on a.k = b.k and b.day >= a.day where a.day <> a.last group by a.k, a.day having count(*) > 1
union all select f.k, 29, 'eq {{ hop {{ argmax {{ filter_less {{ all_rows ; price ; ' || cast(bound as bigint) || ' }} ; price }} ; day }} ; ' || arg_max(b.day, (b.price, -b.i)) || ' }}' from
  (select distinct r.k, {S.ceil_to('v')} as bound from r join st on r.k = st.k) f join q b on f.k = b.k and b.price < bound join cn on cn.k = f.k group by f.k, bound, c having count(*) > 1 and count(*) < c
union all select k, 30, 'eq {{ count {{ filter_eq {{ filter_eq {{ filter_eq {{ filter_eq {{ all_rows ; status ; ' || status || ' }} ; priority ; ' || priority || ' }} ; status ; ' || status || ' }} ; priority ; ' || priority || ' }} }} ; ' || count(*) || ' }}'
  from q group by k, status, priority having count(*) > 1
union all select k, 31, 'and {{ and {{ only {{ filter_eq {{ all_rows ; priority ; ' || priority || ' }} }} ; eq {{ hop {{ filter_eq {{ all_rows ; priority ; ' || priority || ' }} ; status }} ; ' || min(status) || ' }} }} ; eq {{ hop {{ filter_eq {{ all_rows ; priority ; ' || priority || ' }} ; day }} ; ' || min(day) || ' }} }}'
  from q group by k, priority having count(*) = 1)"""


def register(c: Catalog) -> None:
    both = TEMPLATES + BROKEN
    c.add("template_tokens", lambda s, d: T.add_tokens(row_templates(s, d, both)).select("table_id", "template_id", F.posexplode("tokens").alias("pos", "token")),
          f"""with {_row_texts(both)}, w as (select table_id, template_id, string_split(regexp_replace(regexp_replace(lf, ' = true$', ''), ' ([{{}};])', '|\\1|', 'g'), '|') as a from tt),
u as (select table_id, template_id, trim(unnest(a)) as token, generate_subscripts(a, 1) as p from w)
select table_id, template_id, (row_number() over (partition by table_id, template_id order by p) - 1)::int as pos, token from u where token <> ''""")
    c.add("template_nodes", lambda s, d: T.template_nodes(row_templates(s, d, both)).select("template_id", "node_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "arg_pos", "depth", "func", "leaf"),
          f"""with {_row_texts(both)}, w as (select template_id, string_split(regexp_replace(regexp_replace(lf, ' = true$', ''), ' ([{{}};])', '|\\1|', 'g'), '|') as a from tt),
u as (select template_id, trim(unnest(a)) as token, generate_subscripts(a, 1) as p from w),
v as (select template_id, token, row_number() over (partition by template_id order by p) - 1 as node_id from u where token <> ''),
x as (select *, lead(token) over (partition by template_id order by node_id) as nxt, coalesce(sum(case token when '{{' then 1 when '}}' then -1 else 0 end) over (partition by template_id order by node_id rows between unbounded preceding and 1 preceding), 0) as depth from v),
n as (select template_id, node_id, depth, case when nxt = '{{' then token end as func, case when coalesce(nxt, '') <> '{{' then token end as leaf from x where token not in ('{{', '}}', ';')),
h as (select n.*, (select max(p.node_id) from n p where p.template_id = n.template_id and p.node_id < n.node_id and p.func is not null and p.depth = n.depth - 1) as parent_id from n),
o as (select *, row_number() over (partition by template_id, parent_id order by node_id) - 1 as arg_pos from h)
select template_id, node_id::int as node_id, coalesce(parent_id, -1)::int as parent_id, arg_pos::int as arg_pos, depth::int as depth, func, leaf from o""")

    def swapped(s, d, columns):
        """Filled statements with their own literals, made into templates again."""
        forms = read(s, d, "orders").select("o_orderkey", F.concat(F.lit("eq { hop { filter_eq { all_rows ; status ; "), "o_orderstatus", F.lit(" } ; price } ; "), F.floor("o_totalprice").cast("string"), F.lit(" } = true")).alias("lf"))
        header = F.array(*[F.lit(n) for n in KINDS])
        return T.add_tokens(forms).select("o_orderkey", T.placeholders(F.col("tokens"), header, columns).alias("template"))

    c.add("canonical_text", lambda s, d: T.add_tokens(row_templates(s, d, TEMPLATES)).select("table_id", "template_id", T.canonical(F.col("tokens")).alias("form")),
          f"with {_row_texts(TEMPLATES)} select table_id, template_id, regexp_replace(lf, ' = true$', '') as form from tt")
    c.add("placeholders", lambda s, d: swapped(s, d, False), "select o_orderkey, 'eq { hop { filter_eq { all_rows ; status ; X } ; price } ; X }' as template from orders")
    c.add("skeletons", lambda s, d: swapped(s, d, True), "select o_orderkey, 'eq { hop { filter_eq { all_rows ; Y ; X } ; Y } ; X }' as template from orders")
    c.add("check_templates", lambda s, d: T.check(row_templates(s, d, both), headers(s, d)).select("table_id", "template_id", "syntax_ok"),
          f"with {_row_texts(both)} select table_id, template_id, pattern < {len(TEMPLATES)} as syntax_ok from tt")

    def filled(s, d, numbers):
        return P.fill(templates(s, d, TEMPLATES).where(F.col("template_id").isin(*numbers)), cells(s, d))

    for name, numbers in GROUPS.items():
        c.add(f"fill_{name}", lambda s, d, numbers=numbers: filled(s, d, numbers),
              f"{_statements_sql()} select distinct k as table_id, t as template_id, x as statement from s where t in ({', '.join(map(str, numbers))})")
    c.add("fill_sorted", lambda s, d: C.distinct_sorted(filled(s, d, GROUPS["scalars"]), "statement").select("table_id", "item"),
          f"{_statements_sql()} select distinct k as table_id, x as item from s where t in ({', '.join(map(str, GROUPS['scalars']))})")

    c.add("fill_all", lambda s, d: P.fill_all(templates(s, d, TEMPLATES), cells(s, d)),
          f"{_statements_sql()}, {_pairs_ctes()}, {_expanded_ctes()} select distinct k as table_id, t as template_id, x as statement from s union all select * from written")

    def pairs(s, d):
        given = templates(s, d, TEMPLATES).where(F.col("template_id").isin(*PAIRS))
        return P.fill_pairs(given, cells(s, d)).select("table_id", "template_id", "first", F.coalesce("claim", F.lit("")).alias("claim"), "partner_from", "partner_to", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("except_from", "except_to")], "n_pairs")

    c.add("fill_pairs", pairs, f"with {BASE}, {_pairs_ctes()} select * from found")

    def expanded(s, d):
        """All partners of every first part, written out."""
        given = templates(s, d, TEMPLATES).where(F.col("template_id").isin(*PAIRS))
        return P.expand_pairs(given, *P.pair_parts(given, cells(s, d)))

    c.add("expand_fillings", expanded, f"""with {BASE}, {_pairs_ctes()}, {_expanded_ctes()} select * from written""")

    def one_table(s, d):
        given = s.createDataFrame([("orders", i, TEMPLATES[i]) for i in LARGE], "table_id string, template_id int, lf string")
        return P.fill(given, cells(s, d, True))

    c.add("fill_large", one_table,
          f"with {BASE.replace('cast(o_custkey as varchar)', chr(39) + 'orders' + chr(39)).replace('row_number() over (partition by o_custkey order by o_orderkey)', 'o_orderkey')}, {_statements_ctes()} select distinct k as table_id, t as template_id, x as statement from s where t in ({', '.join(map(str, LARGE))})")
    reasons = ", ".join(f"({len(TEMPLATES) + i}, '{x}')" for i, x in enumerate(DEEP_REASONS))
    c.add("template_coverage", lambda s, d: P.coverage(row_templates(s, d, TEMPLATES + DEEP)),
          f"""with {_row_texts(TEMPLATES + DEEP)}, why as (select * from (values {reasons}) v(number, reason))
select table_id, tt.template_id, case when pattern in ({", ".join(map(str, PAIRS))}) then 'pairs' else coalesce(reason, 'statements') end as filled_by from tt left join why on pattern = number""")

    def executed(s, d):
        given = templates(s, d, both)
        plain = F.create_map(*[x for n, k in KINDS.items() for x in (F.lit(n), F.lit(k))])
        checked = stored(T.check(given, headers(s, d).withColumn("types", plain)), "fill-checked")
        good = checked.where("syntax_ok").select("table_id", "template_id", "lf")
        ready = P.answered(good, cells(s, d))
        return M.rates(P.execution_check(given, checked, P.fill(good, cells(s, d), ready), P.pair_parts(good, cells(s, d), ready)[0]))

    n = len(TEMPLATES)
    c.add("execution_rates", executed,
          f"""with {BASE}, {_statements_ctes()}, {_pairs_ctes()}, e as (select distinct k, t from s union select distinct table_id, template_id from found), tot as (select count(*) * {n + len(BROKEN)} as n from customer)
select round_even((select count(*) * {n} from (select distinct o_custkey from orders)) / (select n from tot), 3) as syntax, round_even((select count(*) from e) / (select n from tot), 3) as executability""")


def _pair_ctes(number: int, op: str, first: str, second: str, alike: bool = False) -> str:
    """Ranges of ranks of the second parts, as ``fill_pairs`` gives them; sides: queries of (k, v, lf, claim)."""
    own = "max(case when y.lf = x.lf then y.rk end)" if alike else "null"
    ranges = {
        "greater": ("1", "lo", "null", "null", "lo"), "less": ("hi + 1", "n", "null", "null", "n - hi"), "and": ("1", "n", "null", "null", "n"),
        "eq": ("lo + 1", "hi", "own", "own", "hi - lo - 1"), "diff": ("1", "n", "lo + 1", "hi", "n - (hi - lo)"),
    }[op]
    names = ("partner_from", "partner_to", "except_from", "except_to", "n_pairs")
    listed = ", ".join(f"cast(coalesce({r}, 0) as bigint) as {x}" for r, x in zip(ranges, names))
    return f"""a{number} as (select k, v, lf, claim from ({first})),
b{number} as (select k, v, lf, claim, row_number() over (partition by k order by v, concat_ws(' ', lf, nullif(claim, ''))) as rk from ({second})),
c{number} as (select x.k, x.lf, x.claim, x.v, count(*) filter (y.v < x.v) as lo, count(*) filter (y.v <= x.v) as hi, count(y.lf) as n, {own} as own from a{number} x left join b{number} y on x.k = y.k group by x.k, x.lf, x.claim, x.v),
f{number} as (select k as table_id, {number} as template_id, lf as first, claim, {listed} from c{number})"""


def _hop(col: str, hop: str, value: str, claim: str = "") -> str:
    """Cells of single rows; with a claim about another cell of the row."""
    text = lambda x: f"'hop {{ filter_eq {{ all_rows ; {col} ; ' || {col} || ' }} ; {x} }}'"
    said = f"'eq {{ ' || {text(claim)} || ' ; ' || min({claim}) || ' }}'" if claim else "''"
    return f"select k, min({value}) as v, {text(hop)} as lf, {said} as claim from q group by k, {col} having count(*) = 1"


def _nth(func: str, order: str) -> str:
    return f"""select k, price as v, '{func} {{ all_rows ; price ; ' || n || ' }}' as lf, '' as claim from
  (select *, row_number() over (partition by k order by {order}, i) as n, count(*) over (partition by k) as c from q) where n <= c // 2"""


def _pairs_ctes() -> str:
    most = "select k, 0 as v, 'most_eq {{ all_rows ; status ; ' || status || ' }}' as lf, '' as claim from q group by k, status having count(*) * 2 > (select count(*) from q m where m.k = q.k) and count(*) < (select count(*) from q m where m.k = q.k)".replace("{{", "{").replace("}}", "}")
    lower = """select distinct k, 0 as v, 'most_greater_eq { all_rows ; price ; ' || price || ' }' as lf, '' as claim from
  (select *, row_number() over (partition by k order by price) - 1 as n, count(*) over (partition by k) as c from q) where n >= 1 and n < c // 2"""
    day, status = _hop("day", "price", "price"), _hop("day", "status", "status")
    parts = [
        _pair_ctes(14, "greater", day, day), _pair_ctes(23, "eq", status, status, True),
        _pair_ctes(24, "diff", day, day), _pair_ctes(25, "less", _hop("priority", "day", "ts"), _hop("status", "day", "ts")),
        _pair_ctes(32, "greater", _nth("nth_max", "price desc"), _nth("nth_min", "price")), _pair_ctes(33, "and", most, lower),
        _pair_ctes(34, "less", _hop("priority", "price", "price", "status"), _hop("status", "price", "price", "priority")),
    ]
    union = " union all ".join(f"select * from f{n}" for n in PAIRS)
    return ", ".join(parts) + f", found as (select * from ({union}) where n_pairs > 0)"


def _expanded_ctes() -> str:
    """All partners of each first part."""
    ops = {14: "greater", 23: "eq", 24: "diff", 25: "less", 32: "greater", 33: "and", 34: "less"}
    each = []
    for n, op in ops.items():
        pair = f"'{op} {{ ' || x.lf || ' ; ' || y.lf || ' }}'"
        if op == "diff":
            pair = f"'eq {{ ' || {pair} || ' ; ' || (x.v - y.v) || ' }}'"
        elif n == 34:
            pair = f"'and {{ ' || {pair} || ' ; and {{ ' || x.claim || ' ; ' || y.claim || ' }} }}'"
        each.append(f"""e{n} as (select f.table_id, {n} as template_id, {pair} as statement
  from (select * from found where template_id = {n}) f join a{n} x on f.table_id = x.k and f.first = x.lf and f.claim = x.claim join b{n} y on x.k = y.k and y.rk between partner_from and partner_to and not (except_from > 0 and y.rk between except_from and except_to))""")
    union = " union all ".join(f"select table_id, template_id, statement from e{n}" for n in ops)
    return ", ".join(each) + f", written as ({union})"
