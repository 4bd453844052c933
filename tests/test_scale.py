"""Plans that must hold at size: what is shuffled, broadcast or kept together."""

import time

from pyspark.sql import functions as F

from factloom.keyed import KeyedTable
from factloom.operators import coltypes as T
from factloom.operators import ngrams
from factloom.operators import sampling as B
from factloom.plans import fill as P
from factloom.plans.ranking import join_on, running
from factloom.sources import readers


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_templates_are_never_broadcast(spark):
    """A text is parsed in its row: no join of its nodes, no broadcast of texts whatever the size of the input file."""
    lf = F.concat(F.lit("eq { max { all_rows ; price of "), F.col("id").cast("string"), F.lit(" } ; X }"))
    given = spark.range(50).select(F.col("id").cast("string").alias("table_id"), F.lit(0).alias("template_id"), lf.alias("lf"))
    got = P.coverage(given)
    assert "Broadcast" not in plan_of(got)
    assert "Join" not in plan_of(P._parsed(given))
    assert [r.filled_by for r in got.select("filled_by").distinct().collect()] == ["statements"]


def test_runs_are_repeated_behind_the_shuffle(spark):
    """Rows are shuffled once, not once for each of the ten runs; the choices are those of one run after the other."""
    preds = spark.range(300).select((F.col("id") % 7).alias("table_id"), (F.col("id") % 3).cast("string").alias("grp"), "id")
    for mode in ("single", "one", "several"):
        got = B.repeated_runs(preds, mode, ["id"])
        want = [(r, x.id) for r in range(B.RUNS) for x in B.select_outputs(preds, mode, ["id"], 42 + r).collect()]
        assert sorted((x.run, x.id) for x in got.collect()) == sorted(want)
        assert got.columns == ["table_id", "grp", "id", "run"]
    plan = plan_of(B.repeated_runs(preds, "single", ["id"]))
    assert "Window" not in plan and plan.rindex("Exchange") > plan.index("Generate")


def test_sides_of_fillings_are_merged(spark):
    """Selections and answers are read from small files, but their texts fill the driver where they are broadcast."""
    given = spark.createDataFrame([("a", 0, "eq { count { filter_eq { all_rows ; c ; X } } ; X }")], "table_id string, template_id int, lf string")
    rows = spark.createDataFrame([("a", 1, "c", "num", "1", 1.0, None, None)], "table_id string, row_idx int, col_name string, coltype string, raw string, num double, ts timestamp_ntz, str string")
    members = rows.select("table_id", F.lit(P.ALL).alias("sel"), "row_idx")
    wanted = members.select("table_id", "sel", F.lit("c").alias("col"), F.lit("count").alias("func"))
    for df in (P.expressions(given), P._looked_up(wanted, members, rows), join_on(rows, members, ["table_id"])):
        assert "SortMergeJoin" in plan_of(df) and "Broadcast" not in plan_of(df)
    assert [r.text for r in P.expressions(given).where("func = 'count'").collect()] == ["count { filter_eq { all_rows ; c ; X } }"]


def test_runs_of_long_candidates_travel_without_their_texts(spark):
    t = KeyedTable(spark.createDataFrame([(1, 1, "a b c d e")], "k int, i int, s string"), ["k"], ["i"])
    asked = spark.createDataFrame([(1, "b c d e")], "k int, candidate string")
    placed = [x for x in plan_of(ngrams.containment_counts(t, "s", asked)).splitlines() if "Generate posexplode" in x]
    assert placed and not any("candidate#" in x for x in placed)


def test_clean_tokens_before_grams(spark):
    texts = ["red hot one\n", "red hot two the\n", "the red hot three", "red, hot\n", "a hot\n"]
    t = KeyedTable(spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "k int, i int, s string"), ["k"], ["i"])
    found = ngrams.frequent_ngrams(t, "s")
    assert "arrays_overlap" not in plan_of(found)
    assert sorted((r.gram, r.freq) for r in found.collect()) == [("red hot", 3)]
    kept = ngrams.clean_ngrams(ngrams.ngram_counts(t, "s")).collect()
    assert sorted((r.gram, r.freq) for r in kept) == [("hot", 3), ("red", 3), ("red hot", 3)]
    broken = KeyedTable(spark.createDataFrame([(1, i, f"{x} hot\n") for i, x in enumerate("xyz")], "k int, i int, s string"), ["k"], ["i"])
    assert ngrams.frequent_ngrams(broken, "s").count() == 0 and ngrams.clean_ngrams(ngrams.ngram_counts(broken, "s")).count() == 0


def test_dates_are_parsed_only_where_asked_for_and_once(spark):
    cells = spark.createDataFrame([("t", 1, 0, "d", "7 march 1999", "7 march 1999"), ("t", 2, 0, "d", "on may 3 , 2001 in rome", "on may 3 , 2001 in rome"), ("t", 3, 0, "d", "13/2/2001", "13/2/2001"), ("t", 4, 0, "d", "may 41 2001", "may 41 2001")],
                                  "table_id string, row_idx int, col_idx int, col_name string, raw string, processed string")
    typed = T.parse_cells(cells, spark.createDataFrame([("t", 0, "date")], "table_id string, col_idx int, coltype string"))
    assert "wed(nes)" not in plan_of(typed.select("row_idx", "num")) and "Generate" not in plan_of(typed.select("row_idx", "num"))
    assert plan_of(typed.select("row_idx", "ts")).count("wed(nes)") == 1
    days = {r.row_idx: str(r.ts)[:10] for r in typed.collect()}
    assert days == {1: "1999-03-07", 2: "2001-05-03", 3: "2001-02-13", 4: "None"}


def test_rank_columns_meet_their_successors_without_a_join(spark):
    columns = {"up": "1 1 2 3", "gap": "1 2 4", "falls": "1 2 1", "one": "7 7", "large": f"1 2 {'9' * 40}", "mixed": "3 x 4"}
    rows = [(n, 0, i, x) for n, xs in columns.items() for i, x in enumerate(xs.split())]
    found = T.rank_columns(spark.createDataFrame(rows, "table_id string, col_idx int, row_idx int, raw string"))
    assert "Join" not in plan_of(found)
    assert sorted(r.table_id for r in found.collect()) == ["mixed", "one", "up"]


def test_borders_are_no_column_and_rows_are_dealt_once(spark):
    """Borders in a column would go into every row, which costs rows times borders; sums and windows read one shuffle."""
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), (F.col("id") % 7).alias("x"))
    plan = plan_of(running(rows, ["k"], ["i"], {"upto": F.col("x")}, {"n": ("sum", F.col("x"))}))
    carried = [x for x in plan.splitlines() if "Project [" in x and "scalar-subquery" in x and "transform(array(" not in x]
    assert "transform(array(" in plan and not carried
    got = {(r.k, r.i): (r.upto, r.n) for r in running(rows, ["k"], ["i"], {"upto": F.col("x")}, {"n": ("sum", F.col("x"))}).collect()}
    data = [(i % 3, i, i % 7) for i in range(100)]
    assert got == {(k, i): (sum(x for a, b, x in data if a == k and b <= i), sum(x for a, _, x in data if a == k)) for k, i, _ in data}


def test_entries_are_numbered_without_borders(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a\\\\": [["x"], [1]], "b": [["y { \\" ["], [0]]}')
    found = readers.read_entries(spark, str(tmp_path))
    assert "scalar-subquery" not in plan_of(found)
    assert sorted((r.entry, r.key, r.value) for r in found.collect()) == [(1, "a\\", '[["x"], [1]]'), (2, "b", '[["y { \\" ["], [0]]')]


def test_tables_of_one_text_go_to_many_tasks(spark):
    """A join by text alone brings all tables of a text to one task; so does one of members by table alone."""
    given = spark.range(300).select(F.col("id").cast("string").alias("table_id"), F.lit(0).alias("template_id"), F.lit("eq { max { all_rows ; c } ; X }").alias("lf"))
    for df in (P.expressions(given), P._form(given)):
        joins = [x for x in plan_of(df).splitlines() if "SortMergeJoin" in x]
        assert any("part#" in x for x in joins)
        assert df.select("table_id").distinct().count() == 300
    assert P._dealt(given).select("part").distinct().count() > 100
    rows = spark.range(P._TOGETHER * 2).select(F.lit("t").alias("table_id"), F.lit(P.ALL).alias("sel"), F.col("id").cast("int").alias("row_idx"))
    cells = rows.select("table_id", "row_idx", F.lit("c").alias("col_name"), F.lit("num").alias("coltype"), F.lit("1").alias("raw"), F.lit(1.0).alias("num"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("str"))
    found = P._cells_of(rows.select("table_id", "sel", F.lit("c").alias("col")).distinct(), rows, cells)
    assert any("block#" in x for x in plan_of(found).splitlines() if "SortMergeJoin" in x) and found.count() == P._TOGETHER * 2


def test_options_answer_only_what_a_column_asks_for(spark):
    cell = lambda col, i, num, text: ("t", P.ALL, col, ["filter_eq"] if col == "a" else ["filter_less_eq"], i, (num, None, None if num else text), text, num, num is None)
    rows = spark.createDataFrame([cell("a", i, None, x) for i, x in enumerate("xxy")] + [cell("b", i, float(i + 1), str(i + 1)) for i in range(3)],
                                 f"table_id string, sel string, col string, asked array<string>, row_idx int, v {P._VTYPE}, raw string, num double, is_text boolean")
    options, held = P._filter_answers(rows, {"filter_eq", "filter_less_eq"}, True)
    assert sorted((r.col, r.func, r.filled, r.cnt) for r in options.collect()) == [("a", "filter_eq", "x", 2), ("a", "filter_eq", "y", 1), ("b", "filter_less_eq", "2", 2), ("b", "filter_less_eq", "3", 3)]
    assert sorted((r.filled, r.row_idx) for r in held.collect()) == [("x", 0), ("x", 1), ("y", 2)]


def test_options_count_grams_once_and_read_rows_of_chosen_texts_only(spark, monkeypatch):
    names = []

    def noted(df, name):
        names.append((name, df))
        return df.localCheckpoint()

    monkeypatch.setattr(P, "stored", noted)
    cell = lambda t, i, x: (t, P.ALL, "c", ["filter_eq"], i, (None, None, x) if x else None, x or "", None, True)
    texts = {"t": ["red fox one", "red fox two", "red fox six", None], "u": ["a", "b", None]}
    rows = spark.createDataFrame([cell(t, i, x) for t, xs in texts.items() for i, x in enumerate(xs)],
                                 f"table_id string, sel string, col string, asked array<string>, row_idx int, v {P._VTYPE}, raw string, num double, is_text boolean")
    options, inside = P._options(rows, {"filter_eq"}, True)
    # The grams are counted in a plan of their own; the others read what it wrote.
    assert [n for n, _ in names] == ["fill-classes", "fill-grams", "fill-inside"]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" in plan(names[1][1]).lower() and "rlike" not in plan(names[2][1]).lower()
    got = {(r.table_id, r.filled, r.cnt, r.by_text) for r in options.collect()}
    assert got == {("t", "red fox", 3, True), *[("t", x, 1, True) for x in texts["t"][:3]], ("t", "", 1, False), ("u", "a", 1, True), ("u", "b", 1, True), ("u", "", 1, False)}
    assert {(r.table_id, r.candidate) for r in inside.collect()} == {(t, f) for t, f, _, by_text in got if by_text}
    # A column whose cells are texts and others, by two columns of one name, takes its values as texts.
    mixed = rows.unionByName(rows.limit(1).selectExpr("table_id", "sel", "col", "asked", "9 as row_idx", f"cast(struct(7.0D, null, null) as {P._VTYPE}) as v", "'7' as raw", "7.0D as num", "false as is_text"))
    assert {r.filled for r in P._options(mixed, {"filter_eq"}, True)[0].where("not by_text").collect()} == {""}


def test_stored_steps_leave_no_shuffle_files(spark):
    """only the written files of a step stay on the disk."""
    from factloom.session import stored

    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    shuffled = lambda: {str(files().apply(i)) for i in range(files().size())}
    before = shuffled()
    out = stored(spark.range(10_000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.sum("id").alias("s")), "test")
    for _ in range(50):
        left = {x for x in shuffled() - before if "shuffle_" in x}
        if not left:
            break
        time.sleep(0.1)
    assert not left and out.count() == 7


def test_no_step_of_filling_is_a_large_plan(spark, monkeypatch):
    """the driver plans a job anew after each shuffle, so no job has a hundred of them."""
    from test_fill import FUNCS, cells, given, tables

    seen = []
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    kept = P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: (seen.append((count(df), name)), kept(df, name))[1])
    data = tables(3)
    texts = [*FUNCS, "greater { nth_max { all_rows ; price ; X } ; nth_min { all_rows ; price ; X } }"]
    ready = P.answered(given(spark, data, texts), cells(spark, data))
    first, second = P.pair_parts(given(spark, data, texts), cells(spark, data), ready)
    seen += [(count(first), "first"), (count(P.expand_pairs(given(spark, data, texts), first, second)), "pairs")]
    assert max(seen)[0] < 60, sorted(seen)[-5:]


def test_types_are_told_by_small_jobs(spark):
    """steps of type inference are written apart, so their shuffles do not lie on the disk together; columns
    are summed up before they meet, and a column without a cell in its table's first row is not revised."""
    rows = [("t", 1, 0, "a", "7 km", "7 km"), ("t", 2, 0, "a", "8 km", "8 km"), ("t", 2, 1, "b", "9 km", "9 km"), ("u", 3, 0, "a", "1 to 2", "1 to 2"), ("u", 3, 1, "b", "-", None), ("u", 4, 1, "b", "x", "x")]
    cells = spark.createDataFrame(rows, "table_id string, row_idx int, col_idx int, col_name string, raw string, processed string")
    types = T.infer_types(cells)
    assert plan_of(types).count("Exchange ") <= 2
    typed = T.parse_cells(cells, types)
    got = T.revise_types(typed)
    assert {tuple(x) for x in got.collect()} == {("t", 0, "a", "num", True), ("u", 0, "a", "same_n_nums", False), ("u", 1, "b", "str", False)}


def test_features_of_a_table_come_from_its_first_row(spark):
    """no shuffle of cells by row, and statistics written apart; a column that starts later has no features."""
    from factloom.operators import profiles as D

    rows = [("t", 2, 0, "A", "7", "7"), ("t", 3, 0, "A", "9", "9"), ("t", 3, 1, "B", "x", "x"), ("u", 1, 0, "A", "x", "x"), ("u", 1, 1, "B", "2", "2")]
    cells = spark.createDataFrame(rows, "table_id string, row_idx int, col_idx int, col_name string, raw string, processed string")
    typed = T.parse_cells(cells, T.infer_types(cells))
    got = D.table_features(typed, spark.createDataFrame([("t", "one"), ("u", "two")], "table_id string, title string"), "v2", True, True, True)
    assert plan_of(got).count("Exchange ") <= 20
    found = {r.table_id: r.input for r in got.collect()}
    assert found["t"].startswith("Title: one. Column a. Type: num. Stats: ") and found["t"].endswith(" Value: 7.") and "Column b" not in found["t"]
    assert "Column a. Type: str." in found["u"] and found["u"].endswith(" Value: 2.")


def test_counts_of_frequent_ngrams_are_made_once(spark):
    """F8: the looks at all counts read what was written, not the texts again."""
    rows = [("t", f"red hot sea {i}") for i in range(4)] + [("u", "red hot")]
    got = ngrams.frequent_ngrams(KeyedTable(spark.createDataFrame(rows, "k string, text string"), ["k"]), "text")
    assert "sort_array" not in plan_of(got)
    assert {(r.k, r.gram, r.freq) for r in got.collect()} == {("t", "red hot sea", 4)}
