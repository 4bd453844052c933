"""Corpus preparation, sources and linearisation over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.catalog import Catalog, read
from factloom.operators import corpus as C
from factloom.operators import linearise as L
from factloom.operators import metrics as M
from factloom.session import ensure_checkpoint_dir
from factloom.sources import readers, writers

# Orders of a customer as a table of text; after its orders every third customer repeats the header
# and every second customer has a total row.
ORDER_COLUMNS = {
    "Status": "case when o_orderstatus = 'P' then '-' else o_orderstatus end",
    "Price": "case when o_orderkey % 10 = 0 then 'n/a' else cast(cast(floor(o_totalprice) as bigint) as {s}) end",
    "Date": "substring(cast(o_orderdate as {s}), 1, 10)",
}


def order_cells(spark, sf):
    orders = read(spark, sf, "orders")
    columns = {n: F.expr(e.format(s="string")) for n, e in ORDER_COLUMNS.items()}
    body = C.wide_to_cells(orders, F.col("o_custkey").cast("string"), ["o_orderkey"], columns)
    tables = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("o_orderkey").alias("s"))

    def extra(where, after, values):
        cells = F.array(*[
            F.struct(F.lit(i).alias("col_idx"), F.lit(n).alias("col_name"), F.expr(v).alias("raw"))
            for i, (n, v) in enumerate(zip(ORDER_COLUMNS, values))])
        rows = tables.where(where).select(F.col("o_custkey").cast("string").alias("table_id"), (F.col("n") + after).alias("row_idx"), F.explode(cells).alias("c"))
        return rows.select("table_id", "row_idx", "c.*")

    header = extra("o_custkey % 3 = 0", 1, ["'status'", "'price'", "'date'"])
    total = extra("o_custkey % 2 = 0", 2, ["'T o t a l'", "cast(s as string)", "''"])
    return body.unionByName(header).unionByName(total)


def _cells_sql() -> str:
    e = [(n, x.format(s="varchar")) for n, x in ORDER_COLUMNS.items()]
    body = " union all ".join(
        f"select cast(o_custkey as varchar) as table_id, row_idx::int as row_idx, {i} as col_idx, '{n}' as col_name, {x} as raw from ro" for i, (n, x) in enumerate(e))
    header = " union all ".join(f"select cast(o_custkey as varchar), (n + 1)::int, {i}, '{n}', '{n.lower()}' from tb where o_custkey % 3 = 0" for i, (n, _) in enumerate(e))
    total = " union all ".join(
        f"select cast(o_custkey as varchar), (n + 2)::int, {i}, '{n}', {v} from tb where o_custkey % 2 = 0"
        for i, ((n, _), v) in enumerate(zip(e, ["'T o t a l'", "cast(s as varchar)", "''"])))
    return f"""ro as (select *, row_number() over (partition by o_custkey order by o_orderkey) as row_idx from orders),
tb as (select o_custkey, count(*) as n, sum(o_orderkey)::bigint as s from orders group by all),
cells as ({body} union all {header} union all {total}),
hd as (select table_id, row_idx from cells group by all having bool_and(raw = lower(col_name))),
lr as (select table_id, max(row_idx) as row_idx from cells group by all),
tt as (select c.table_id, c.row_idx from cells c join lr on c.table_id = lr.table_id and c.row_idx = lr.row_idx where col_idx = 0
  and not regexp_matches(raw, '^\\s*(|-|n\\s*[\\\\/]\\s*a)\\s*$') and regexp_matches(lower(raw), '\\b((o ?v ?e ?r ?)?a ?l ?l|t ?o ?t ?a ?l( ?s)?|s ?u ?m)\\b')),
clean as (select *, case when not regexp_matches(raw, '^\\s*(|-|n\\s*[\\\\/]\\s*a)\\s*$') then raw end as processed from cells
  where (table_id, row_idx) not in (select (table_id, row_idx) from hd) and (table_id, row_idx) not in (select (table_id, row_idx) from tt))"""


CELLS = _cells_sql()
ROWS = "table_id, row_idx, col_idx, col_name, raw"

# Documents as a corpus with splits: the labelled ones are held out by the other corpus.
SPLIT = "case when doc_id % 10 = 0 then 'dev' when doc_id % 10 = 1 then 'test' else 'train' end"


def documents(s, d):
    return read(s, d, "documents").select(F.col("doc_id").cast("string").alias("table_id"), "doc_id", "lang", "source", "text", F.expr(SPLIT).alias("split"))


def labelled(s, d):
    return read(s, d, "labels").select(
        F.col("doc_id").cast("string").alias("table_id"), F.expr("case when quality = 1 then 'train' when toxic = 1 then 'dev' else 'test' end").alias("split"))


DOCS = f"docs as (select cast(doc_id as varchar) as table_id, doc_id, lang, source, text, {SPLIT} as split from documents)"


def turns(s, d):
    return read(s, d, "conversations").select(F.col("conv_id").cast("string").alias("table_id"), F.col("turn").alias("pos"), "role", "text")


TURNS = "tn as (select cast(conv_id as varchar) as table_id, turn as pos, role, text from conversations)"


def register(c: Catalog) -> None:
    _cleaning(c)
    _dedupe(c)
    _sources(c)
    _text(c)


def _cleaning(c: Catalog) -> None:
    c.add("table_id_from_url", lambda s, d: read(s, d, "pages").select("page_id", C.table_id(F.col("url")).alias("table_id")),
          "select page_id, split_part(url, '/', -1) as table_id from pages")
    c.add("wide_to_cells", lambda s, d: order_cells(s, d), f"with {CELLS} select {ROWS} from cells")
    c.add("cells_to_wide", lambda s, d: C.cells_to_wide(order_cells(s, d), ["Status", "Date"]),
          f"with {CELLS} select table_id, row_idx, max(raw) filter (col_idx = 0) as Status, max(raw) filter (col_idx = 2) as Date from cells group by all")
    c.add("null_empty_cells", lambda s, d: C.null_empty_cells(order_cells(s, d)),
          f"with {CELLS} select {ROWS}, case when raw not in ('-', 'n/a', '') then raw end as processed from cells")
    c.add("drop_header_rows", lambda s, d: C.drop_header_rows(order_cells(s, d)),
          f"with {CELLS} select {ROWS} from cells where (table_id, row_idx) not in (select (table_id, row_idx) from hd)")
    c.add("drop_total_rows", lambda s, d: C.drop_total_rows(order_cells(s, d)),
          f"with {CELLS} select {ROWS} from cells where (table_id, row_idx) not in (select (table_id, row_idx) from tt)")
    c.add("clean_cells", lambda s, d: C.clean_cells(order_cells(s, d)), f"with {CELLS} select {ROWS}, processed from clean")


def _dedupe(c: Catalog) -> None:
    c.add("remove_leaks", lambda s, d: C.remove_leaks(documents(s, d), labelled(s, d)).select("table_id", "split", "source"),
          f"with {DOCS} select table_id, split, source from docs where split <> 'train' or doc_id not in (select doc_id from labels where quality <> 1)")
    c.add("restrict_splits", lambda s, d: C.restrict_splits(documents(s, d), ["dev", "test"]).select("table_id", "split"),
          f"with {DOCS} select table_id, split from docs where split in ('dev', 'test')")
    c.add("first_occurrence", lambda s, d: C.first_occurrence(turns(s, d), "pos", ["pos", "role", "text"]),
          f"with {TURNS} select table_id, pos, role, text from tn qualify row_number() over (partition by table_id order by pos) = 1")
    c.add("table_items", lambda s, d: C.table_items(turns(s, d), "pos", "text"),
          f"with {TURNS} select table_id, row_number() over (partition by table_id order by pos)::int as pos, text as item from tn")
    c.add("collect_items", lambda s, d: C.collect_items(turns(s, d), "pos", "role").select("table_id", F.array_join("items", "|").alias("items")),
          f"with {TURNS} select table_id, string_agg(role, '|' order by pos) as items from tn group by all")
    c.add("replace_references",
          lambda s, d: C.replace_references(
              turns(s, d).where("role = 'user'").select("table_id", "pos"),
              turns(s, d).select("table_id", "pos", F.col("text").alias("sentence"), F.expr("case when role = 'assistant' then 1 else 0 end").alias("label"))),
          f"""with {TURNS}, u as (select *, row_number() over (partition by table_id order by pos) as k from tn where role = 'user'),
a as (select *, row_number() over (partition by table_id order by pos) as k from tn where role = 'assistant')
select u.table_id, u.pos, a.text as ref from u left join a on u.table_id = a.table_id and u.k = a.k""")
    c.add("unique_predictions", lambda s, d: C.unique_predictions(read(s, d, "documents").select(F.col("source").alias("table_id"), "text", F.col("doc_id").alias("pos"))),
          "select source as table_id, text, min(doc_id) as pos from documents group by all")
    c.add("distinct_sorted", lambda s, d: C.distinct_sorted(read(s, d, "orders").withColumn("table_id", F.col("o_custkey").cast("string")), "o_orderpriority"),
          "select cast(o_custkey as varchar) as table_id, row_number() over (partition by o_custkey order by o_orderpriority)::int as pos, o_orderpriority as item from (select distinct o_custkey, o_orderpriority from orders)")
    c.add("tagged_union",
          lambda s, d: C.tagged_union(documents(s, d).select("table_id", F.col("lang").alias("lf")), labelled(s, d).select("table_id", F.col("split").alias("lf"))),
          "select cast(doc_id as varchar) as table_id, lang as lf, 'main' as source from documents union all "
          "select cast(doc_id as varchar), case when quality = 1 then 'train' when toxic = 1 then 'dev' else 'test' end, 'generated' from labels")
    c.add("attach_tables", lambda s, d: C.attach_tables(labelled(s, d).select("table_id", F.col("split").alias("held")), documents(s, d).select("table_id", "lang", "source")),
          "select cast(l.doc_id as varchar) as table_id, case when quality = 1 then 'train' when toxic = 1 then 'dev' else 'test' end as held, lang, source from labels l join documents d on l.doc_id = d.doc_id")

    def nested(s, d):
        sizes = read(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("m"))
        groups = sizes.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "m"))).alias("g"))
        return groups.select(F.col("o_custkey").cast("string").alias("table_id"), F.transform("g", lambda g: F.transform(g["m"], lambda m: m["o_orderpriority"])).alias("groups"))

    c.add("flatten_groups", lambda s, d: C.flatten_groups(nested(s, d), "groups"),
          """select cast(o_custkey as varchar) as table_id, (dense_rank() over (partition by o_custkey order by o_orderstatus) - 1)::int as grp,
(row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) - 1)::int as pos, o_orderpriority as item from orders""")
    c.add("regroup", lambda s, d: C.regroup(C.flatten_groups(nested(s, d), "groups")).select("table_id", F.array_join(F.transform("groups", lambda g: F.array_join(g, ",")), "|").alias("groups")),
          """select table_id, string_agg(m, '|' order by o_orderstatus) as groups from
(select cast(o_custkey as varchar) as table_id, o_orderstatus, string_agg(o_orderpriority, ',' order by o_orderkey) as m from orders group by all) group by all""")
    c.add("fill_missing", lambda s, d: C.fill_missing(documents(s, d), labelled(s, d).select("table_id", F.col("split").alias("text"))),
          "select cast(d.doc_id as varchar) as table_id, coalesce(case when l.doc_id is null then null when quality = 1 then 'train' when toxic = 1 then 'dev' else 'test' end, '') as text from documents d left join labels l on d.doc_id = l.doc_id")
    c.add("fix_spacing", lambda s, d: read(s, d, "events").select("event_id", C.fix_spacing(F.concat("props", F.lit("{  x}"), "event_type")).alias("text")),
          r"select event_id, regexp_replace(replace(replace(props || '{  x}' || event_type, '}', ' }'), '{', ' {'), ' +', ' ', 'g') as text from events")


def _sources(c: Catalog) -> None:
    c.add("read_corpus", lambda s, d: readers.read_corpus(s, f"{d}/orders.parquet").select("o_orderkey", "o_custkey"), "select o_orderkey, o_custkey from orders")

    def generated(s, d):
        """Lines of a generated file per event type, in the order of the events."""
        e = read(s, d, "events")
        line = lambda n, text: e.select(F.col("event_type").alias("file"), (F.col("event_id") * 2 + n).alias("line"), text.alias("value"))
        url = line(0, F.concat(F.lit('    "url": "http://x/'), F.col("user_id").cast("string"), F.lit('",')))
        form = line(1, F.concat(F.lit('    "logic_str": "'), F.col("value").cast("string"), F.lit('"')))
        return url.unionByName(form)

    c.add("pair_generated", lambda s, d: readers.pair_generated(generated(s, d)),
          """select cast(user_id as varchar) as table_id, event_type as file, event_id * 2 + 1 as pos, cast(value as varchar) as lf from events""")
    _round_trips(c)
    c.add("tidy_scores", lambda s, d: writers.tidy_scores(read(s, d, "lineitem").agg(F.count(F.lit(1)).alias("rows"), F.max("l_quantity").alias("most"))),
          "select 'rows' as metric, cast(count(*) as double) as score from lineitem union all select 'most', max(l_quantity) from lineitem")
    c.add("table_csv", lambda s, d: L.table_csv(order_cells(s, d)),
          f"""with {CELLS}, ln as (select table_id, row_idx, string_agg(raw, ',' order by col_idx) as t from cells group by all)
select table_id, 0 as part, 'Status,Price,Date' || chr(10) || string_agg(t, chr(10) order by row_idx) as csv from ln group by all""")
    c.add("read_table_csv", lambda s, d: writers.read_table_csv(L.table_csv(C.clean_cells(order_cells(s, d)).drop("processed")), ["Status", "Price", "Date"]),
          f"""with {CELLS}, w as (select table_id, row_idx, max(raw) filter (col_idx = 0) as Status, max(raw) filter (col_idx = 1) as Price, max(raw) filter (col_idx = 2) as Date from clean group by all)
select table_id, row_number() over (partition by table_id order by row_idx)::int as row_idx, Status, Price, Date from w""")


def _folder(s, name: str) -> str:
    return f"{ensure_checkpoint_dir(s).rstrip('/')}/query-{uuid.uuid4().hex}-{name}"


def _round_trips(c: Catalog) -> None:
    """What was written is read back."""
    def corpus(s, d):
        path = _folder(s, "corpus")
        writers.write_corpus(read(s, d, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderstatus").alias("split"), "o_orderkey", "o_totalprice"), path)
        return readers.read_corpus(s, path, ["F", "P"]).select("table_id", F.col("split").cast("string").alias("split"), "o_orderkey", "o_totalprice")

    c.add("write_corpus", corpus, "select o_custkey as table_id, o_orderstatus as split, o_orderkey, o_totalprice from orders where o_orderstatus in ('F', 'P')")

    def predictions(s, d):
        path = _folder(s, "predictions.jsonl")
        writers.write_predictions(read(s, d, "customer").orderBy("c_custkey").select(F.array(F.concat(F.col("c_name"), F.lit(' "é"\n')), F.lit("second")).alias("out")), path)
        return readers.read_predictions(s, path)

    c.add("write_predictions", predictions, "select row_number() over (order by c_custkey) - 1 as pos, c_name || ' \"é\"' || chr(10) as text from customer")

    def results(s, d):
        path = _folder(s, "results")
        writers.write_json(read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.struct("o_orderstatus", "o_orderpriority").alias("stage")), path)
        return s.read.schema("id long, stage struct<o_orderstatus: string, o_orderpriority: string>").json(path).select("id", "stage.*")

    c.add("write_json", results, "select o_orderkey as id, o_orderstatus, o_orderpriority from orders")

    def scores(s, d):
        path = _folder(s, "scores")
        runs = read(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(F.count(F.lit(1)).alias("rows"), F.max("l_quantity").alias("most"))
        writers.write_scores(runs, path)
        return readers.read_lines(s, path).select(F.substring_index("value", ": ", 1).alias("metric"), F.substring_index("value", ": ", -1).alias("scores"))

    c.add("write_scores", scores, "select l_returnflag as metric, count(*) || ' ' || max(l_quantity) as scores from lineitem group by 1")

    def objects(s, d, path):
        """A file for each of eight groups of customers: one JSON object with an entry for each customer, line by line."""
        o = read(s, d, "orders").withColumn("sentence", F.concat(F.lit('price "'), F.floor("o_totalprice").cast("string"), F.lit('\\" } ], [ {')))
        listed = F.array_sort(F.collect_list(F.struct("o_orderkey", "sentence", (F.col("o_orderkey") % 2).cast("int").alias("label"))))
        entries = o.groupBy(F.col("o_custkey").alias("place")).agg(listed.alias("l"))
        value = F.concat_ws(",", F.to_json(F.transform("l", lambda x: x["sentence"])), F.to_json(F.transform("l", lambda x: x["label"])), F.lit('"a caption: [{"'))
        group = (F.col("place") % 8).alias("file")
        lines = entries.select(group, "place", F.concat(F.lit(', "c\\"'), F.col("place").cast("string"), F.lit('": ['), value, F.lit("]")).alias("value"))
        ends = s.range(8).select(F.col("id").alias("file"), F.inline(F.array(*[F.struct(F.lit(at).cast("long").alias("place"), F.lit(text).alias("value")) for at, text in ((-1, '{ "none": [[], []]'), (2**62, "}"))])))
        lines.unionByName(ends).repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(path)

    def statements(s, d):
        path = _folder(s, "statements.json")
        objects(s, d, path)
        return readers.read_labelled_statements(s, path)

    c.add("read_labelled_statements", statements,
          """select 'c"' || o_custkey as table_id, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as pos,
  'price "' || cast(floor(o_totalprice) as bigint) || '\\" } ], [ {' as sentence, (o_orderkey % 2)::int as label from orders""")


def titles(s, d):
    return read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("table_id"), F.col("c_name").alias("title"))


TITLES = "ti as (select cast(c_custkey as varchar) as table_id, c_name as title from customer)"


def _text(c: Catalog) -> None:
    def style_sql(head, sep, row, inner, start):
        return f"""with {CELLS}, {TITLES}, ln as (select table_id, row_idx, any_value({start}) || {inner} || string_agg({row}, {inner} order by col_idx) as t from cells group by table_id, row_idx)
select ln.table_id, 0 as part, {head} || any_value(title) || {sep} || string_agg(t, {sep} order by row_idx) as input from ln join ti on ln.table_id = ti.table_id group by all"""

    c.add("linearise_nl", lambda s, d: L.linearise(order_cells(s, d), titles(s, d), "nl"),
          style_sql("'Title: '", "'. '", "col_name || ': ' || raw", "', '", "'Row'"))
    c.add("linearise_nl_idxs", lambda s, d: L.linearise(order_cells(s, d), titles(s, d), "nl_idxs"),
          style_sql("'Title: '", "'. '", "col_name || ': ' || raw", "', '", "'Row: ' || row_idx"))
    c.add("linearise_markers", lambda s, d: L.linearise(order_cells(s, d), titles(s, d), "markers"),
          style_sql("'<T> '", "' '", "'<H> ' || col_name || ' <C> ' || raw", "' '", "'<R> ' || row_idx"))

    def highlighted(s, d):
        return order_cells(s, d).withColumn("highlighted", F.expr("raw in ('F', 'O') or col_idx = 2"))

    c.add("linearise_highlighted", lambda s, d: L.linearise(highlighted(s, d), titles(s, d), "nl", highlighted_only=True),
          f"""with {CELLS}, {TITLES}, ln as (select table_id, row_idx, 'Row' || coalesce(string_agg(', ' || col_name || ': ' || raw, '' order by col_idx) filter (raw in ('F', 'O') or col_idx = 2), '') as t from cells group by all)
select ln.table_id, 0 as part, 'Title: ' || any_value(title) || '. ' || string_agg(t, '. ' order by row_idx) as input from ln join ti on ln.table_id = ti.table_id group by all""")
    c.add("headers", lambda s, d: L.headers(order_cells(s, d)).select("table_id", F.array_join("header", " | ").alias("header")),
          f"with {CELLS} select distinct table_id, 'status | price | date' as header from cells")

    def forms(s, d):
        e = read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("table_id"), F.col("o_orderkey").alias("pos"),
                                        F.concat(F.lit("eq { max { all_rows ; price } ; "), F.col("o_orderstatus"), F.lit(" } = true")).alias("lf"))
        return e

    def info(s, d):
        return titles(s, d).join(L.headers(order_cells(s, d)), "table_id").withColumn("split", F.lit("train"))

    lf = "'eq { max { all_rows ; price } ; ' || o_orderstatus || ' }'"
    made = f"'Title: ' || c_name || '. Header: status | price | date. Logical form: ' || {lf}"
    c.add("statement_records_predict", lambda s, d: L.statement_records(info(s, d), forms(s, d)),
          f"select cast(o_custkey as varchar) as table_id, 'train' as split, o_orderkey as pos, {made} as input, {lf} || ' = true' as lf from orders join customer on o_custkey = c_custkey")
    c.add("statement_records_train",
          lambda s, d: L.statement_records(info(s, d), forms(s, d), read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("table_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("ref"))),
          f"select cast(o_custkey as varchar) as table_id, 'train' as split, o_orderkey as pos, {made} as input, {lf} || ' = true' as lf, o_orderpriority as output from orders join customer on o_custkey = c_custkey")
    def baseline(s, d):
        """Records with hashes of the whole texts they refer to; only hashes go to the references."""
        texts, csv = L.linearise(order_cells(s, d), titles(s, d), "nl"), L.table_csv(order_cells(s, d))
        refs = read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("table_id"), F.col("o_orderpriority").alias("ref"))
        found = L.baseline_records(refs, texts, csv).join(L.whole_digests(texts, "input", ". "), "table_id").join(L.whole_digests(csv, "csv", "\n"), "table_id")
        return found.select("table_id", F.lit(0).alias("part"), "output", "input", F.col("csv").alias("table_csv"))

    c.add("baseline_records", baseline,
          f"""with {CELLS}, {TITLES}, ln as (select table_id, row_idx, string_agg(raw, ',' order by col_idx) as t, 'Row, ' || string_agg(col_name || ': ' || raw, ', ' order by col_idx) as l from cells group by all),
x as (select ln.table_id, md5('Status,Price,Date' || chr(10) || string_agg(t, chr(10) order by row_idx)) as table_csv, md5('Title: ' || any_value(title) || '. ' || string_agg(l, '. ' order by row_idx)) as input from ln join ti on ln.table_id = ti.table_id group by all)
select x.table_id, 0 as part, o_orderpriority as output, input, table_csv from x join orders on x.table_id = cast(o_custkey as varchar)""")

    def selection(mode):
        def query(s, d):
            made = read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("table_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("only { filter_eq { all_rows ; status ; "), "o_orderstatus", F.lit(" } }")).alias("output"), F.col("o_orderpriority").alias("source"))
            features = titles(s, d).select("table_id", F.concat(F.lit("Title: "), "title").alias("input"))
            found = L.selection_records(features, made, mode, L.headers(order_cells(s, d)) if mode == "eval" else None)
            return found if mode != "eval" else found.select("table_id", "part", "input", F.array_join("outputs", "|").alias("outputs"), F.array_join("header", " | ").alias("header"))
        return query

    said = "'only { filter_eq { all_rows ; status ; ' || o_orderstatus || ' } }'"
    kept = "from orders join customer on o_custkey = c_custkey"
    c.add("selection_records_train", selection("train"), f"select cast(o_custkey as varchar) as table_id, 'Title: ' || c_name as input, {said} as output, o_orderpriority as source {kept}")
    c.add("selection_records_eval", selection("eval"),
          f"""with k as (select cast(o_custkey as varchar) as table_id, 'Title: ' || c_name as input, {said} as output, o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // {L.ROWS_PER_PART} as part {kept})
select table_id, part::int as part, input, string_agg(output, '|' order by o_orderkey) as outputs, 'status | price | date' as header from k group by table_id, part, input""")
    c.add("selection_records_predict", selection("predict"), "select 'Title: ' || c_name as input, cast(c_custkey as varchar) as table_id from customer")
    c.add("token_health",
          lambda s, d: L.token_health(
              read(s, d, "documents").select(
                  F.slice(F.transform(F.split("text", " ", -1), lambda w: F.when(w.rlike("^[A-Za-z]+$"), 1).otherwise(0)), 1, 512).alias("i"),
                  F.transform(F.split("source", "src", -1), lambda w: F.length(w)).alias("o")), "i", "o", unknown=0),
          """with x as (select list_transform(string_split(text, ' ')[1:512], lambda w: case when regexp_matches(w, '^[A-Za-z]+$') then 1 else 0 end) as i, [0, length(source) - 3] as o from documents)
select round_even(avg((len(i) = 512)::int), 4) as truncated_inputs, round_even(avg((len(o) = 512)::int), 4) as truncated_outputs,
round_even(sum(len(list_filter(i, lambda t: t = 0))) / sum(len(i)), 4) as unknown_inputs, round_even(sum(len(list_filter(o, lambda t: t = 0))) / sum(len(o)), 4) as unknown_outputs from x""")
    c.add("pair_by_position",
          lambda s, d: M.pair_by_position(read(s, d, "documents").select(F.col("doc_id").alias("pos"), "lang"), read(s, d, "labels").select(F.col("doc_id").alias("pos"), "quality")),
          "select l.doc_id as pos, lang, quality from labels l join documents d on l.doc_id = d.doc_id")
