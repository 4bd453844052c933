"""Filled templates: the faults found before, every statement evaluated again by plain Python, pairs by brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from factloom import KeyedTable
from factloom.operators import selectors
from factloom.plans import fill as P

SCHEMA = "table_id string, row_idx int, col_idx int, col_name string, coltype string, raw string, num double, ts timestamp_ntz, str string"
TYPES = {"name": "str", "place": "str", "price": "num", "size": "num", "day": "date"}


def cells(spark, tables):
    """tables: id -> rows of (name, place, price, size, day); a cell is its text, None is an empty one."""
    out = []
    for t, rows in tables.items():
        for i, row in enumerate(rows):
            for j, (c, kind) in enumerate(TYPES.items()):
                x = row[j]
                num = float(x.replace("- ", "-")) if kind == "num" and x is not None else None
                out.append((t, i + 1, j, c, kind, x or "", num, x if kind == "date" else None, x if kind == "str" else None))
    raw = spark.createDataFrame(out, SCHEMA.replace("ts timestamp_ntz", "ts string"))
    return raw.withColumn("ts", F.to_timestamp_ntz("ts", F.lit("yyyy-MM-dd")))


def given(spark, tables, texts):
    return spark.createDataFrame([(t, i, x) for t in tables for i, x in enumerate(texts)], "table_id string, template_id int, lf string")


def parse(text):
    tokens = text.split(" ")

    def node(i):
        words = []
        while i < len(tokens) and tokens[i] not in ("{", "}", ";"):
            words.append(tokens[i])
            i += 1
        name = " ".join(words)
        if i < len(tokens) and tokens[i] == "{":
            args = []
            while tokens[i] != "}":
                arg, i = node(i + 1)
                args.append(arg)
            return (name, args), i + 1
        return name, i

    return node(0)[0]


class Table:
    """Evaluates a statement over one table."""

    def __init__(self, rows):
        self.rows = [dict(zip(TYPES, r)) for r in rows]

    def value(self, column, x):
        if x is None or x == "":
            return None
        return float(x.replace("- ", "-")) if TYPES[column] == "num" else x

    def run(self, node):
        if node == "all_rows":
            return self.rows
        f, a = node
        if f.startswith("filter_"):
            rows, c = self.run(a[0]), a[1]
            if f == "filter_all":
                return rows
            x = a[2]
            if f == "filter_eq":
                exact = [r for r in rows if (r[c] or "") == x or (x == "" and r[c] is None)]
                if x == "" or (TYPES[c] == "num" and exact):
                    v = self.value(c, x)
                    return [r for r in rows if self.value(c, r[c]) == v]
                return [r for r in rows if f" {x} " in f" {r[c] or ''} "]
            v = self.value(c, x)
            test = {"not_eq": lambda y: y != v, "greater": lambda y: y is not None and y > v, "less": lambda y: y is not None and y < v,
                    "greater_eq": lambda y: y is not None and y >= v, "less_eq": lambda y: y is not None and y <= v}[f[7:]]
            return [r for r in rows if test(self.value(c, r[c]))]
        if f == "count":
            return float(len(self.run(a[0])))
        if f == "only":
            return len(self.run(a[0])) == 1
        if f == "hop":
            row = self.run(a[0])
            row = row[0] if isinstance(row, list) and len(row) == 1 else row
            assert isinstance(row, dict)
            return self.value(a[1], row[a[1]])
        if f in ("eq", "round_eq", "not_eq", "greater", "less", "diff", "and"):
            x = self.run(a[0])
            y = self.run(a[1]) if isinstance(a[1], tuple) else a[1]
            if isinstance(y, str) and not isinstance(a[1], tuple):
                same = (x is None and y == "") or (float(y.replace("- ", "-")) == pytest.approx(x, abs=0.0051) if isinstance(x, float) else x == y)
                return same
            return {"eq": lambda: x == y, "not_eq": lambda: x != y, "greater": lambda: x > y, "less": lambda: x < y, "diff": lambda: x - y, "and": lambda: x and y}[f]()
        rows, c = self.run(a[0]), a[1]
        values = [(self.value(c, r[c]), r) for r in rows]
        some = [(v, r) for v, r in values if v is not None]
        if f in ("max", "min"):
            return (max if f == "max" else min)(v for v, _ in some)
        if f in ("sum", "avg"):
            return sum(v for v, _ in some) / (len(some) if f == "avg" else 1)
        if "nth_" in f or f.startswith("arg"):
            n = int(a[2]) if len(a) > 2 else 1
            order = sorted(some, key=lambda x: x[0], reverse="max" in f)
            return order[n - 1][1] if "arg" in f else order[n - 1][0]
        kind, _, test = f.partition("_")
        x = a[2]
        if test in ("eq", "not_eq"):
            hold = [(r[c] or "") == x or (x != "" and self.value(c, x) == v if TYPES[c] == "num" and x.replace("- ", "").replace(".", "").isdigit() else False) for v, r in values]
            if test == "eq" and not any(hold):
                hold = [f" {x} " in f" {r[c] or ''} " for _, r in values]
            hold = [h if test == "eq" else not h for h in hold]
        else:
            w = self.value(c, x)
            hold = [{"greater": v > w, "less": v < w, "greater_eq": v >= w, "less_eq": v <= w}[test] for v, _ in some]
        return all(hold) if kind == "all" else 2 * sum(hold) > len(hold) or (test.endswith("_eq") and 2 * sum(hold) >= len(hold))


FUNCS = """
eq { count { filter_eq { all_rows ; name ; X } } ; X }
eq { count { filter_not_eq { filter_greater { all_rows ; price ; X } ; place ; X } } ; X }
eq { avg { filter_eq { all_rows ; name ; X } ; price } ; X }
round_eq { sum { filter_less_eq { all_rows ; day ; X } ; size } ; X }
eq { max { filter_greater_eq { all_rows ; price ; X } ; size } ; X }
eq { min { filter_not_eq { all_rows ; place ; X } ; day } ; X }
eq { hop { filter_not_eq { all_rows ; price ; X } ; name } ; X }
eq { hop { filter_less { all_rows ; price ; X } ; day } ; X }
eq { hop { argmin { filter_eq { all_rows ; place ; X } ; price } ; name } ; X }
eq { nth_max { filter_eq { all_rows ; place ; X } ; price ; X } ; X }
eq { hop { nth_argmin { all_rows ; day ; X } ; place } ; X }
most_eq { filter_greater_eq { all_rows ; size ; X } ; place ; X }
most_greater { all_rows ; price ; X }
most_less_eq { filter_eq { all_rows ; place ; X } ; price ; X }
all_not_eq { all_rows ; place ; X }
all_eq { filter_eq { all_rows ; name ; X } ; place ; X }
all_greater { all_rows ; size ; X }
all_less_eq { filter_less { all_rows ; price ; X } ; size ; X }
only { filter_greater { all_rows ; price ; X } }
eq { count { all_rows } ; X }
eq { count { filter_all { all_rows ; name } } ; X }
greater { max { all_rows ; price } ; min { all_rows ; size } }
less { hop { argmax { all_rows ; day } ; price } ; avg { all_rows ; price } }
not_eq { hop { argmax { all_rows ; price } ; place } ; hop { argmin { all_rows ; price } ; place } }
eq { diff { max { all_rows ; price } ; min { all_rows ; price } } ; X }
greater { hop { filter_eq { all_rows ; name ; X } ; price } ; avg { all_rows ; price } }
and { only { filter_eq { all_rows ; place ; X } } ; eq { hop { filter_eq { all_rows ; place ; X } ; day } ; X } }
and { eq { max { all_rows ; price } ; X } ; most_greater { all_rows ; price ; X } }
""".strip().split("\n")


def tables(seed):
    r = random.Random(seed)
    out = {}
    for t in range(5):
        names = ["red", "red hot", "old red hot chilli pepper", "blue sea", "red hot chilli pepper", "grey"]
        out[f"t{t}"] = [
            (r.choice(names), r.choice(["a", "b", "b", "c d"]), r.choice(["5", "- 5", "7", "12.5", "40", None]), str(r.randint(1, 90)), f"2020-0{r.randint(1, 3)}-0{r.randint(1, 5)}")
            for _ in range(r.randint(2, 9))
        ]
    return out


def test_every_statement_is_true(spark):
    data = tables(3)
    got = P.fill(given(spark, data, FUNCS), cells(spark, data)).collect()
    for x in got:
        assert Table(data[x.table_id]).run(parse(x.statement)), (data[x.table_id], x.statement)
    found = {x.template_id for x in got}
    assert found >= set(range(len(FUNCS))) - {FUNCS.index("all_not_eq { all_rows ; place ; X }"), 9, 26, 7, 18}, sorted(set(range(len(FUNCS))) - found)


def test_faults_found_before(spark):
    data = {
        "p": [("a", "x", "5", "1", "1998-01-01"), ("b", "x", "5", "2", "1998-02-01"), ("c", "x", "9", "3", "1999-01-01")],
        "n": [("new york city hall", "x", "10", "1", "1998-01-01"), ("new york city hall", "x", "20", "2", "1998-02-01"), ("old new york city hall tower", "x", "60", "3", "1998-03-01")],
    }
    texts = ["eq { hop { filter_not_eq { all_rows ; price ; X } ; name } ; X }", "eq { avg { filter_eq { all_rows ; name ; X } ; price } ; X }", "eq { count { filter_eq { all_rows ; name ; X } } ; X }"]
    got = {(x.table_id, x.template_id, x.statement) for x in P.fill(given(spark, data, texts), cells(spark, data)).collect()}
    assert {s for t, i, s in got if t == "p" and i == 0} == {"eq { hop { filter_not_eq { all_rows ; price ; 5 } ; name } ; c }"}
    # The value and its frequent n-grams select the longer name too.
    for i, form in ((1, "eq {{ avg {{ filter_eq {{ all_rows ; name ; {} }} ; price }} ; 30 }}"), (2, "eq {{ count {{ filter_eq {{ all_rows ; name ; {} }} }} ; 3 }}")):
        assert {s for t, k, s in got if t == "n" and k == i} == {form.format(x) for x in ("new york city hall", "new york city", "york city hall")}


def test_pairs(spark):
    data = {"t": [("a", "x", "5", "1", "2020-01-01"), ("b", "y", "- 5", "2", "2020-01-02"), ("c", "z", "7", "3", "2020-01-02"), ("d", "z", "7", "9", "2020-02-01")]}
    hop = lambda c, v: f"hop {{ filter_eq {{ all_rows ; {c} ; X }} ; {v} }}"
    texts = [f"{f} {{ {hop('name', v)} ; {hop('name', v)} }}" for f in ("greater", "less", "not_eq", "eq") for v in ("price", "day")] + [f"eq {{ diff {{ {hop('name', 'price')} ; {hop('place', 'price')} }} ; X }}"]
    got = P.fill_pairs(given(spark, data, texts), cells(spark, data)).collect()
    n = {(x.template_id, x.first): x.n_pairs for x in got}
    value = {"price": {"a": 5, "b": -5, "c": 7, "d": 7}, "day": {"a": 1, "b": 2, "c": 2, "d": 3}}
    ops = {"greater": lambda x, y: x > y, "less": lambda x, y: x < y, "not_eq": lambda x, y: x != y, "eq": lambda x, y: x == y}
    want = {}
    for i, (f, v) in enumerate((f, v) for f in ops for v in value):
        for a in "abcd":
            k = sum(ops[f](value[v][a], value[v][b]) for b in "abcd" if b != a)
            if k:
                want[i, f"hop {{ filter_eq {{ all_rows ; name ; {a} }} ; {v} }}"] = k
    # Only x and y are places of one row: prices 5 and -5.
    want |= {(8, f"hop {{ filter_eq {{ all_rows ; name ; {a} }} ; price }}"): sum(value["price"][a] != p for p in (5, -5)) for a in "abcd"}
    assert n == want


def test_unfilled_templates_have_a_reason(spark):
    texts = ["eq { count { all_rows } ; X }", "largest { all_rows ; price ; X }", "eq { max { all_rows ; price ; X", "greater { nth_max { all_rows ; price ; X } ; nth_min { all_rows ; price ; X } }", "and { greater { nth_max { all_rows ; price ; X } ; nth_min { all_rows ; price ; X } } ; only { all_rows } }"]
    rows = {x.template_id: x.filled_by for x in P.coverage(given(spark, {"t": []}, texts)).collect()}
    assert rows == {0: "statements", 1: "unknown function largest", 2: "not readable", 3: "pairs", 4: "a pair of options inside another statement"}


RANGED = ["not_eq", "greater_eq", "less_eq", "greater", "less"]
ANSWERS = ["eq {{ max {{ {} ; {} }} ; X }}", "eq {{ min {{ {} ; {} }} ; X }}", "eq {{ sum {{ {} ; {} }} ; X }}", "eq {{ avg {{ {} ; {} }} ; X }}", "eq {{ hop {{ argmax {{ {} ; {} }} ; name }} ; X }}", "eq {{ hop {{ argmin {{ {} ; {} }} ; name }} ; X }}", "all_greater_eq {{ {} ; {} ; X }}", "all_less_eq {{ {} ; {} ; X }}"]


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_equal_lists_of_rows(spark, seed):
    """Every option of a range filter, with what plain lists of the rows it leaves say."""
    r = random.Random(seed)
    data = {f"t{t}": [(f"n{i}", "x", r.choice(["5", "- 5", "7", "7", "12.5", "40", "41", None]), r.choice(["3", "8", "8", "20", None]), "2020-01-01") for i in range(r.randint(3, 12))] for t in range(4)}
    texts = [a.format(f"filter_{f} {{ all_rows ; price ; X }}", "size") for f in RANGED for a in ANSWERS]
    frame = cells(spark, data)
    got = {(x.table_id, x.template_id): set() for x in P.fill(given(spark, data, texts), frame).collect()}
    for x in P.fill(given(spark, data, texts), frame).collect():
        got[x.table_id, x.template_id].add(x.statement)
    wide = spark.createDataFrame([(t, i, float(row[2].replace("- ", "-")) if row[2] else None, row[2] or "") for t, rows in data.items() for i, row in enumerate(rows)], "table_id string, i int, v double, raw string")
    table = KeyedTable(wide, ["table_id"], ["i"], raw={"v": "raw"})
    want = {}
    number = lambda x: float(x.replace("- ", "-"))
    shown = lambda x: str(int(x)) if x == int(x) else str(x)
    for k, f in enumerate(RANGED):
        for option in getattr(selectors, f"filter_{f}")(table, "v").collect():
            left = Table(data[option.table_id]).run((f"filter_{f}", ["all_rows", "price", option.filled]))
            assert len(left) == option.val_count
            some = [x for x in left if x["size"] is not None]
            if not some:
                continue
            values = [number(x["size"]) for x in some]
            text = lambda v: next(x["size"] for x in some if number(x["size"]) == v)
            first = lambda v: next(x["name"] for x in some if number(x["size"]) == v)
            mean = round(sum(values) / len(values) + 1e-12, 2)
            said = [text(max(values)), text(min(values)), shown(sum(values)), shown(mean), first(max(values)), first(min(values)), text(min(values)), text(max(values))]
            for j, (answer, form) in enumerate(zip(said, ANSWERS)):
                whole = form.format(f"filter_{f} {{ all_rows ; price ; {option.filled} }}", "size")
                want.setdefault((option.table_id, k * len(ANSWERS) + j), set()).add(whole.replace("; X }", f"; {answer} }}"))
    for key, statements in want.items():
        if "avg" in texts[key[1]]:
            assert len(got[key]) == len(statements), key
        else:
            assert got[key] == statements, key
    assert {k for k, v in got.items() if v} <= set(want) | {k for k in got if " sum " in texts[k[1]]}


def test_filters_as_deep_as_wanted(spark):
    rows = [("a", "x", "5", "1", "2020-01-01")] * 3 + [("a", "x", "7", "1", "2020-01-01"), ("b", "y", "9", "2", "2020-01-02")]
    inner = "all_rows"
    for c in ("name", "place", "size", "day", "name", "place"):
        inner = f"filter_eq {{ {inner} ; {c} ; X }}"
    texts = [f"eq {{ count {{ {inner} }} ; X }}", f"eq {{ max {{ filter_greater_eq {{ {inner} ; price ; X }} ; price }} ; X }}"]
    got = {x.statement for x in P.fill(given(spark, {"t": 0}, texts), cells(spark, {"t": rows})).collect()}
    full = "all_rows"
    for c, v in (("name", "a"), ("place", "x"), ("size", "1"), ("day", "2020-01-01"), ("name", "a"), ("place", "x")):
        full = f"filter_eq {{ {full} ; {c} ; {v} }}"
    assert got == {f"eq {{ count {{ {full} }} ; 4 }}", f"eq {{ max {{ filter_greater_eq {{ {full} ; price ; 5 }} ; price }} ; 7 }}"}


def test_and_inside_and(spark):
    rows = [("a", "x", "5", "1", "2020-01-01"), ("b", "x", "7", "2", "2020-01-02"), ("c", "y", "7", "3", "2020-01-03")]
    hop = lambda c: f"eq {{ hop {{ filter_eq {{ all_rows ; name ; X }} ; {c} }} ; X }}"
    texts = [f"and {{ and {{ {hop('place')} ; {hop('price')} }} ; {hop('day')} }}", f"and {{ {hop('place')} ; and {{ {hop('price')} ; {hop('day')} }} }}", "and { and { only { all_rows } ; only { all_rows } } ; only { all_rows } }"]
    got = P.fill(given(spark, {"t": 0}, texts), cells(spark, {"t": rows})).collect()
    for i in (0, 1):
        mine = {x.statement for x in got if x.template_id == i}
        assert len(mine) == 3 and all(Table(rows).run(parse(x)) for x in mine)
    assert {x.template_id for x in got} == {0, 1}
    assert {x.filled_by for x in P.coverage(given(spark, {"t": 0}, texts)).collect()} == {"statements"}


def test_pairs_of_any_scalars_written_out(spark):
    r = random.Random(5)
    data = {f"t{t}": [(f"n{i}", f"p{r.randint(0, 3)}", str(r.randint(1, 6)), str(r.randint(1, 6)), f"2020-01-0{r.randint(1, 4)}") for i in range(7)] for t in range(3)}
    hop = lambda c, v: f"hop {{ filter_eq {{ all_rows ; {c} ; X }} ; {v} }}"
    nth = lambda f: f"nth_{f} {{ all_rows ; price ; X }}"
    texts = [
        f"greater {{ {nth('max')} ; {nth('min')} }}", f"eq {{ {nth('max')} ; {hop('name', 'size')} }}", f"not_eq {{ {hop('name', 'price')} ; max {{ filter_eq {{ all_rows ; place ; X }} ; size }} }}",
        f"round_eq {{ diff {{ {nth('max')} ; {hop('name', 'size')} }} ; X }}", "and { most_greater_eq { all_rows ; price ; X } ; all_greater { all_rows ; size ; X } }",
        f"and {{ most_greater_eq {{ all_rows ; price ; X }} ; most_less_eq {{ all_rows ; size ; X }} }}",
        f"and {{ less {{ {hop('name', 'price')} ; {hop('place', 'price')} }} ; and {{ eq {{ {hop('name', 'day')} ; X }} ; eq {{ {hop('place', 'name')} ; X }} }} }}",
        f"eq {{ {hop('name', 'price')} ; {hop('name', 'price')} }}",
    ]
    assert {x.filled_by for x in P.coverage(given(spark, data, texts)).collect()} == {"pairs"}
    frame, asked = cells(spark, data), given(spark, data, texts)
    first, second = P.pair_parts(asked, frame)
    whole = P.expand_pairs(asked, first, second).collect()
    assert len(set(whole)) == len(whole) == first.agg(F.sum("n_pairs")).first()[0]
    for x in whole:
        assert Table(data[x.table_id]).run(parse(x.statement)), x.statement
    few = P.expand_pairs(asked, first, second, 2).collect()
    assert set(few) <= set(whole) and len(few) == first.agg(F.sum(F.least("n_pairs", F.lit(2)))).first()[0]
    # Every pair there is, from the lists of options.
    for t, rows in data.items():
        table, by = Table(rows), [float(x[2]) for x in rows]
        down, up = sorted(by, reverse=True)[:3], sorted(by)[:3]
        assert sum(x.table_id == t and x.template_id == 0 for x in whole) == sum(a > b for a in down for b in up)
        assert sum(x.table_id == t and x.template_id == 1 for x in whole) == sum(a == float(x[3]) for a in down for x in rows)
        assert sum(x.table_id == t and x.template_id == 3 for x in whole) == sum(a != float(x[3]) for a in down for x in rows)
        single = [x for x in rows if sum(y[1] == x[1] for y in rows) == 1]
        assert sum(x.table_id == t and x.template_id == 6 for x in whole) == sum(float(a[2]) < float(b[2]) for a in rows for b in single)
        assert table.rows


def test_one_table_of_many_rows(spark):
    """Ranges over 100,000 different values: as many options, and no list of rows for each of them."""
    n = 100_000
    num = lambda c: F.struct(F.lit(c).alias("col_name"), F.lit("num").alias("coltype"), F.col(c).cast("string").alias("raw"), F.col(c).cast("double").alias("num"))
    rows = spark.range(1, n + 1).select(F.lit("t").alias("table_id"), F.col("id").cast("int").alias("row_idx"), F.col("id").alias("price"), ((F.col("id") * 7919) % 100_003).alias("size"))
    frame = rows.select("table_id", "row_idx", F.posexplode(F.array(num("price"), num("size"))).alias("col_idx", "c")).select("table_id", "row_idx", "col_idx", "c.*", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("str"))
    texts = ["eq { max { filter_less_eq { all_rows ; price ; X } ; size } ; X }", "all_greater_eq { filter_not_eq { all_rows ; price ; X } ; size ; X }"]
    began = time.time()
    got = P.fill(given(spark, {"t": 0}, texts), frame)
    counts = {x.template_id: (x["n"], x.s) for x in got.groupBy("template_id").agg(F.count("*").alias("n"), F.count_distinct("statement").alias("s")).collect()}
    assert counts == {0: (n - 1, n - 1), 1: (n, n)}
    values = [(i * 7919) % 100_003 for i in range(1, n + 1)]
    best, top = {}, 0
    for i, v in enumerate(values, 1):
        top = max(top, v)
        best[i] = top
    picked = got.where("template_id = 0").select(F.regexp_extract("statement", r"price ; (\d+) ", 1).cast("int"), F.regexp_extract("statement", r" (\d+) \}$", 1).cast("int")).collect()
    assert all(best[a] == b for a, b in picked)
    assert time.time() - began < 300


def test_pairs_over_many_blocks_of_ranks(spark, monkeypatch):
    """every partner of a first part, however the ranks are dealt; a chosen number comes in order of rank."""
    data = {"t": [(f"n{i}", "x", str(i % 7), str(i), "2020-01-01") for i in range(20)], "u": [("a", "x", "1", "1", "2020-01-01"), ("b", "x", "2", "2", "2020-01-01")]}
    hop = lambda v: f"hop {{ filter_eq {{ all_rows ; name ; X }} ; {v} }}"
    texts = [f"{f} {{ {hop('price')} ; {hop('price')} }}" for f in ("greater", "eq", "not_eq")] + [f"round_eq {{ diff {{ {hop('price')} ; {hop('size')} }} ; X }}"]
    asked = given(spark, data, texts)
    first, second = P.pair_parts(asked, cells(spark, data))
    monkeypatch.setattr(P, "_RANKS", 3)
    whole = P.expand_pairs(asked, first, second).collect()
    price = {t: [int(r[2]) for r in rows] for t, rows in data.items()}
    for i, holds in enumerate((int.__gt__, int.__eq__, int.__ne__)):
        for t, rows in data.items():
            want = {(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and holds(price[t][a], price[t][b])}
            mine = [x.statement for x in whole if x.table_id == t and x.template_id == i]
            one = lambda k: f"hop {{ filter_eq {{ all_rows ; name ; {data[t][k][0]} }} ; price }}"
            assert sorted(mine) == sorted(f"{('greater', 'eq', 'not_eq')[i]} {{ {one(a)} ; {one(b)} }}" for a, b in want)
    assert all(Table(data[x.table_id]).run(parse(x.statement)) for x in whole)
    few = P.expand_pairs(asked, first, second, 5).collect()
    assert set(few) <= set(whole) and len(few) == first.agg(F.sum(F.least("n_pairs", F.lit(5)))).first()[0]


def test_whole_filling_has_statements_and_pairs(spark):
    """nothing that has two open sides is left out."""
    data = {"t": [("a", "x", "5", "1", "2020-01-01"), ("b", "y", "7", "2", "2020-01-02"), ("c", "z", "9", "3", "2020-01-03")]}
    texts = ["eq { max { all_rows ; price } ; X }", "greater { hop { filter_eq { all_rows ; name ; X } ; price } ; hop { filter_eq { all_rows ; name ; X } ; price } }"]
    got = [x.statement for x in P.fill_all(given(spark, data, texts), cells(spark, data)).collect()]
    one = lambda x: f"hop {{ filter_eq {{ all_rows ; name ; {x} }} ; price }}"
    assert sorted(got) == sorted(["eq { max { all_rows ; price } ; 9 }", *[f"greater {{ {one(a)} ; {one(b)} }}" for a, b in ("ba", "ca", "cb")]])


def test_written_out_pairs_have_no_cap(spark, tmp_path):
    """the query gives all partners of a first part, not the first few."""
    from factloom.catalog import build

    row = lambda i: (i, 1, "O", float(100 * i), f"2020-01-{i:02d}", "1-URGENT")
    orders = spark.createDataFrame([row(i) for i in range(1, 9)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string")
    orders.withColumn("o_orderdate", F.to_timestamp_ntz("o_orderdate", F.lit("yyyy-MM-dd"))).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = build().queries["expand_fillings"](spark, str(tmp_path)).where("template_id = 14").collect()
    assert len(got) == len(set(got)) == 8 * 7 // 2
