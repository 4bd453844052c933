"""Pieces of the SQL that registered queries are compared with."""

from __future__ import annotations

from factloom.functions.text import ALNUM_WORDS, STOP_WORDS


def number_text(x: str) -> str:
    return f"(case when {x} = trunc({x}) then cast(cast({x} as bigint) as varchar) else cast({x} as varchar) end)"


def round_two(x: str) -> str:
    return f"(round_even(({x}) * 100, 0) / 100)"


def values(source: str, k: str, v: str, text: str | None = None) -> str:
    """CTEs ``r`` (k, v, raw) and ``vc`` (k, v, cnt, raw, one_raw)."""
    raw = text or number_text("v")
    return (
        f"r as (select *, coalesce({raw}, '') as raw from (select {k} as k, {v} as v from {source})),\n"
        "vc as (select k, v, count(*) as cnt, min(raw) as raw, count(distinct raw) = 1 as one_raw from r group by k, v)"
    )


def step() -> str:
    """CTE ``st`` (k, step) over ``r``."""
    return """o as (select k, length(cast(cast(round_even(abs(v), 0) as bigint) as varchar)) - 1 as d, count(*) as c, max(abs(v)) as m
  from r where v is not null group by all),
st as (select k, case when d = 0 then 1.0 when floor(round_even(m, 0) / pow(10, d)) <= 5 then 5 * pow(10, d - 1) else pow(10, d) end as step
  from o qualify row_number() over (partition by k order by c desc, d desc) = 1)"""


def floor_to(v: str) -> str:
    return f"(case when {v} <> 0 and step * floor({v} / step) = {v} then {v} - step else step * floor({v} / step) end)"


def ceil_to(v: str) -> str:
    return f"(case when step * ceil({v} / step) = {v} then {v} + step else step * ceil({v} / step) end)"


def grams(source: str, k: str, text: str) -> str:
    """CTEs ``tx`` (k, txt, cnt), ``gc`` (gram counts), ``gf`` (cleaned) and ``ge`` (without explained)."""
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
    runs = " union all ".join(
        f"select k, txt, cnt, {n} as n, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n - 1}], ' '))) as gram from w"
        for n in (1, 2, 3)
    )
    return f"""tx as (select k, txt, count(*) as cnt from (select {k} as k, {text} as txt from {source}) group by all),
w as (select *, string_split(txt, ' ') as t from tx),
g as ({runs}),
gc as (select a.k, a.n, a.gram, a.freq, b.n_texts, b.n_rows from
  (select k, n, gram, sum(cnt)::bigint as freq from g group by all) a join
  (select k, n, gram, count(*) as n_texts, sum(cnt)::bigint as n_rows from (select distinct k, n, gram, txt, cnt from g) group by all) b
  on a.k = b.k and a.n = b.n and a.gram = b.gram),
gf as (select * from gc where freq >= 3 and n_texts > 1 and regexp_matches(gram, '{ALNUM_WORDS}')
  and not list_has_any(string_split(gram, ' '), [{stop}])),
ge as (select * from gf where not exists (select 1 from gf h where h.k = gf.k and h.n = gf.n + 1 and h.freq = gf.freq and contains(h.gram, gf.gram)))"""
