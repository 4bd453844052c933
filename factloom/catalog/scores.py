"""Sampling, balancing and metrics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import Catalog, read
from factloom.functions.text import tokens
from factloom.operators import metrics as M
from factloom.operators import sampling as B


def types(s, d):
    return read(s, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("l"), F.min("l_orderkey").alias("o")).select("l_partkey", "o", (F.col("l") % 9).alias("kind"))


KINDS = "t as (select l_partkey, min(l_orderkey) as o, count(*) % 9 as kind from lineitem group by all)"
BALANCED = """bc as (select kind, count(*) as count from t group by all),
bb as (select kind, count, cast(floor(pow((select max(count) from bc), 0.5) * pow(count, 0.5) + 1e-9) as bigint) as balanced from bc)"""
HASH = "cast('0x' || substring(md5('42|' || {0}), 1, 15) as bigint)"


def grouped(s, d):
    """Orders as predictions: customer, status group, order."""
    return read(s, d, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderstatus").alias("grp"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))


def _picked(limit, run="42"):
    return f"qualify row_number() over (partition by o_custkey, o_orderstatus order by md5('{run}|' || o_orderkey), o_orderkey) <= {limit}"


def conversation_preds(s, d):
    c = read(s, d, "conversations")
    preds = c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pred_id"), F.col("conv_id").alias("table_id"), "text")
    refs = c.where("role <> 'assistant'").select(F.col("conv_id").alias("table_id"), "text")
    return preds, refs


def _grams(source, keys, n_max):
    each = " union all ".join(
        f"select {keys}, {n} as n, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) as gram from {source}" for n in range(1, n_max + 1))
    return f"(select {keys}, n, gram, count(*) as c from ({each}) group by all)"


def _clipped(tokens_sql, n_max):
    return f"""p as (select conv_id * 1000 + turn as pred_id, conv_id as table_id, {tokens_sql} as w from conversations where role = 'assistant' and conv_id in (select conv_id from conversations where role <> 'assistant')),
r as (select row_number() over () as rid, conv_id as table_id, {tokens_sql} as w from conversations where role <> 'assistant'),
pg as {_grams('p', 'pred_id, table_id', n_max)}, rg as {_grams('r', 'rid, table_id', n_max)},
best as (select table_id, n, gram, max(c) as best from rg group by all),
m as (select pred_id, pg.n, sum(least(c, coalesce(best, 0)))::bigint as matches, sum(c)::bigint as total from pg left join best on pg.table_id = best.table_id and pg.n = best.n and pg.gram = best.gram group by all),
cl as (select pred_id, len(p.w) as len, arg_min(len(r.w), (abs(len(r.w) - len(p.w)), len(r.w))) as closest from p join r on p.table_id = r.table_id group by all)"""


LOWER = "string_split(lower(text), ' ')"


def _evaluation_tokens(text: str) -> str:
    """The evaluation tokenisation, one replacement around the other."""
    x = f"replace(replace({text}, '<skipped>', ''), '-' || chr(10), '')"
    x = f"replace({x}, chr(10), ' ')"
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = f"(' ' || {x} || ' ')"
    for pattern, new in ((r"([\{-\~\[-\x60 -\&\(-\+\:-@/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def _corpus_bleu_sql() -> str:
    count = lambda c, n: f"coalesce(max({c}) filter (n = {n}), 0)"
    halved = lambda n: " + ".join(f"(m{i} = 0 and t{i} > 0)::int" for i in range(1, n + 1))
    log = lambda n: f"case when t{n} > 0 then ln(case when m{n} = 0 then 1 / (pow(2.0, {halved(n)}) * t{n}) else m{n} / t{n} end) else -9999999999.0 end"
    return f"""with {_clipped(_evaluation_tokens("rtrim(text, ' ')"), 4)},
pooled as (select n, sum(matches) as matches, sum(total) as total from m group by n),
s as (select {", ".join(f"{count('matches', n)} as m{n}, {count('total', n)} as t{n}" for n in (1, 2, 3, 4))} from pooled),
l as (select sum(len)::bigint as sys_len, sum(closest)::bigint as ref_len from cl)
select round(case when m1 + m2 + m3 + m4 = 0 then 0.0 else 100 * exp(case when sys_len < ref_len then 1 - ref_len / sys_len else 0.0 end + ({" + ".join(log(n) for n in (1, 2, 3, 4))}) / 4) end, 6) as score, sys_len, ref_len from s, l"""


CORPUS_BLEU_SQL = _corpus_bleu_sql()


def register(c: Catalog) -> None:
    _sampling(c)
    _metrics(c)


def _sampling(c: Catalog) -> None:
    c.add("balanced_counts", lambda s, d: B.balanced_counts(types(s, d), "kind"), f"with {KINDS}, {BALANCED} select * from bb")
    pool = f"""{KINDS}, {BALANCED},
pl as (select *, row_number() over (partition by kind order by md5('42|' || l_partkey || '|' || copy), l_partkey, copy) as rk, count(*) over (partition by kind) as ps
  from (select *, 0 as copy from t union all select *, 1 from t)),
nd as (select kind, balanced - count as need from bb where balanced > count),
dr as (select kind, need, unnest(range(1, need + 1)) as draw from nd),
os as (select pl.l_partkey, pl.o, pl.kind, draw from dr join pl on pl.kind = dr.kind and pl.rk = case when ps < need then {HASH.format("dr.kind || '|' || draw")} % ps + 1 else draw end)"""
    c.add("oversample", lambda s, d: B.oversample(types(s, d), "kind", ["l_partkey"]), f"with {pool} select * from os")
    c.add("balance", lambda s, d: B.balance(types(s, d), "kind", ["l_partkey"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("o")),
          f"with {pool} select kind, count(*) as n, sum(o)::bigint as o from (select kind, o from t union all select kind, o from os) group by all")
    cols = "o_custkey as table_id, o_orderstatus as grp, o_orderkey as id, o_totalprice as x"
    c.add("select_all", lambda s, d: B.select_outputs(grouped(s, d), "all", ["id"]), f"select {cols} from orders")
    c.add("select_several", lambda s, d: B.select_outputs(grouped(s, d), "several", ["id"]), f"select {cols} from orders {_picked(5)}")
    c.add("select_single", lambda s, d: B.select_outputs(grouped(s, d), "single", ["id"]), f"select {cols} from orders {_picked(1)}")
    c.add("select_one", lambda s, d: B.select_outputs(grouped(s, d), "one", ["id"]),
          f"select table_id, grp, id, x from (select {cols} from orders {_picked(1)}) qualify row_number() over (partition by table_id order by md5('42|' || id), id) = 1")

    def repeated(s, d):
        runs = B.repeated_runs(grouped(s, d), "single", ["id"])
        scores = runs.groupBy("run").agg(F.count(F.lit(1)).cast("double").alias("total"), F.avg("id").alias("mean_id"))
        tidy = scores.select("run", F.explode(F.array(
            F.struct(F.lit("total").alias("metric"), F.col("total").alias("score")), F.struct(F.lit("mean_id").alias("metric"), F.col("mean_id").alias("score")))).alias("m"))
        return B.summarise_runs(tidy.select("run", "m.metric", "m.score")).select("metric", F.round("avg", 4).alias("avg"), F.round("std", 4).alias("std"))

    c.add("repeated_runs", repeated,
          """with k as (select run, o_orderkey as id from orders, (select unnest(range(0, 10)) as run)
  qualify row_number() over (partition by run, o_custkey, o_orderstatus order by md5((42 + run) || '|' || o_orderkey), o_orderkey) = 1),
s as (select run, cast(count(*) as double) as total, avg(id) as mean_id from k group by run)
select 'total' as metric, round(avg(total), 4) as avg, round(stddev_pop(total), 4) as std from s union all select 'mean_id', round(avg(mean_id), 4), round(stddev_pop(mean_id), 4) from s""")
    c.add("shuffle_predictions", lambda s, d: B.shuffle_predictions(read(s, d, "documents").select("doc_id", F.md5("text").alias("text")), "doc_id", "text"),
          """with a as (select doc_id, row_number() over (order by doc_id) as k from documents), b as (select md5(text) as text, row_number() over (order by md5('42|' || doc_id), doc_id) as k from documents)
select doc_id, text from a join b using (k)""")


def _metrics(c: Catalog) -> None:
    def customers(s, d):
        return read(s, d, "customer").select(F.col("c_custkey").alias("table_id"))

    def bad_orders(s, d):
        return read(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("table_id"), "o_orderkey")

    c.add("prediction_stats", lambda s, d: M.prediction_stats(customers(s, d), bad_orders(s, d)),
          """with u as (select * from orders where o_orderpriority = '1-URGENT') select (select count(*) from u) as total_preds,
(select count(*) from u) / (select count(*) from customer) as avg_preds_per_table, (select count(*) from customer where c_custkey not in (select o_custkey from u)) as tables_without_preds""")
    lg = lambda n: f"ln(case when coalesce(max(matches) filter (n = {n}), 0) = 0 then 2.2250738585072014e-308 else max(matches) filter (n = {n}) / max(total) filter (n = {n}) end)"
    score = lambda terms: f"case when coalesce(max(matches) filter (n = 1), 0) = 0 then 0.0 else exp(case when any_value(len) > any_value(closest) then 0 else 1 - any_value(closest) / any_value(len) end + {terms}) end"
    sent = f"""sb as (select m.pred_id, {score(lg(1))} as bleu_1, {score(f'0.5 * {lg(1)} + 0.5 * {lg(2)}')} as bleu_2, {score(f'0.33 * {lg(1)} + 0.33 * {lg(2)} + 0.33 * {lg(3)}')} as bleu_3
from m join cl on m.pred_id = cl.pred_id group by m.pred_id)"""
    c.add("sentence_bleu", lambda s, d: M.sentence_bleu(*conversation_preds(s, d)).select("pred_id", *[F.round(b, 9).alias(b) for b in M.BLEU_WEIGHTS]),
          f"with {_clipped(LOWER, 3)}, {sent} select pred_id, round(bleu_1, 9) as bleu_1, round(bleu_2, 9) as bleu_2, round(bleu_3, 9) as bleu_3 from sb")
    c.add("mean_sentence_bleu", lambda s, d: M.mean_sentence_bleu(*conversation_preds(s, d)).select(*[F.round(b, 9).alias(b) for b in M.BLEU_WEIGHTS]),
          f"with {_clipped(LOWER, 3)}, {sent} select round(avg(bleu_1), 9) as bleu_1, round(avg(bleu_2), 9) as bleu_2, round(avg(bleu_3), 9) as bleu_3 from sb")

    def clipped(s, d):
        preds, refs = conversation_preds(s, d)
        known = preds.join(refs.select("table_id").distinct(), "table_id", "left_semi")
        w = tokens(F.lower("text"))
        return M.clipped_matches(known.withColumn("w", w), refs.withColumn("w", w), 3)

    c.add("clipped_matches", clipped, f"with {_clipped(LOWER, 3)} select pred_id, n, matches, total from m")
    c.add("corpus_bleu", lambda s, d: M.corpus_bleu(*conversation_preds(s, d)).select(F.round("score", 6).alias("score"), "sys_len", "ref_len"), CORPUS_BLEU_SQL)
    judged = "j as (select source, case when d.doc_id % 11 = 0 then '' else lang end as prediction, quality as label from documents d join labels l on d.doc_id = l.doc_id)"

    def judgements(s, d):
        return read(s, d, "documents").join(read(s, d, "labels"), "doc_id").select(
            F.col("source").alias("table_id"), F.expr("case when doc_id % 11 = 0 then '' else lang end").alias("prediction"), F.col("quality").alias("label"), "toxic")

    c.add("judged_accuracy", lambda s, d: M.judged_accuracy(judgements(s, d)).select(F.round("judge_micro", 9).alias("judge_micro"), F.round("judge_macro", 9).alias("judge_macro")),
          f"""with {judged}, x as (select source, case when prediction = '' then 0 else label end as r from j)
select round((select avg(r) from x), 9) as judge_micro, round((select avg(a) from (select avg(r) as a from x group by source)), 9) as judge_macro""")
    c.add("error_free_share", lambda s, d: M.error_free_share(judgements(s, d).select(F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("errors")), "errors"),
          "select avg((toxic = 0)::int) as share from labels l join documents d on l.doc_id = d.doc_id")
    c.add("variability", lambda s, d: M.variability(customers(s, d), read(s, d, "orders").select(F.col("o_custkey").alias("table_id"), "o_orderpriority"), "o_orderpriority").select(F.round("variability", 9).alias("variability")),
          """select round(avg(case when n > 1 then (dn - 1) / (n - 1) else 1.0 end), 9) as variability from
(select c_custkey, count(o_orderkey) as n, count(distinct o_orderpriority) as dn from customer left join orders on c_custkey = o_custkey group by all)""")

    def checked(s, d):
        return read(s, d, "orders").select(F.expr("o_orderstatus <> 'P'").alias("syntax_ok"), F.expr("case when o_orderstatus = 'F' then o_orderkey % 3 else 0 end").alias("n_statements"), F.col("o_orderpriority").alias("skeleton"))

    ck = "k as (select o_orderstatus <> 'P' as ok, case when o_orderstatus = 'F' then o_orderkey % 3 else 0 end as n, o_orderpriority as sk from orders)"
    c.add("rates", lambda s, d: M.rates(checked(s, d)), f"with {ck} select round_even(avg(ok::int), 3) as syntax, round_even(avg((n > 0)::int), 3) as executability from k")
    c.add("combined_score", lambda s, d: M.combined_score(checked(s, d), "skeleton"),
          f"with {ck} select count(distinct case when n > 0 then sk end) as n_corpus_templates, round_even((count(distinct case when n > 0 then sk end) + avg((n > 0)::int) * 100) / 2, 1) as exec_var_mean from k")

    def runs(s, d):
        return read(s, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_quantity").alias("score")).select(F.concat(F.lit("checkpoint-"), "l_suppkey").alias("run"), F.lit("bleu").alias("metric"), "score")

    c.add("best_run", lambda s, d: M.best_run(runs(s, d), "bleu"),
          "select 'checkpoint-' || l_suppkey as run, max(l_quantity) as score from lineitem group by l_suppkey order by score desc, l_suppkey limit 1")
