"""Filling templates: all literals that make a template true, over all tables at once.

A template is taken apart into expressions, once for each distinct text. What they ask of a table is a set of
requests (selection of rows, column, function), equal ones once however many templates share them:

* selections: all rows, and filters over them, inside each other as deep as the templates are. A filter's options
  come from the value profile of its column.
* options of a range filter (and of ``filter_not_eq``) are stretches of the sorted values, not lists of rows: what a
  function with one answer says of them is a figure over the rows before or after a place (``_of_ranges``). Rows are
  listed only below functions that give a statement for each listed row or value, and where one row is left.
* one profile of (selection, column) answers every function over it: scalars, claims, single rows. Only what the
  templates ask for is planned.
* statements join those answers back to the expressions, and two-sided ones join their sides.

Statements whose two sides have many options each are kept factorised: ``pair_parts`` gives both lists and ranges of
ranks, ``expand_pairs`` writes chosen ones out, ``fill_all`` all of them. ``coverage`` names the reason for every template that is filled by neither. Levels
build on each other and are read by several families, so each is written once to the shared folder while the plan
is built; the driver sees the names of the functions and the depth of the templates, nothing else. So is what has running
totals or is read more than once: the driver plans a job anew after each of its shuffles, so a job of a hundred of them takes
it more memory and time than ten jobs of ten.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.numbers import number_text, round_two
from factloom.keyed import KeyedTable
from factloom.operators import aggregates, ngrams
from factloom.operators.templates import add_tokens, canonical, step, text_nodes
from factloom.operators.values import lower_bounds, upper_bounds, value_counts, value_profile
from factloom.plans.ranking import cumulated, join_on, merged, running
from factloom.session import stored

FILTERS = "filter_eq filter_not_eq filter_greater filter_greater_eq filter_less filter_less_eq".split()
# Filters whose options are stretches of the sorted values, and functions that have one answer for each of them.
RANGES = FILTERS[1:]
ANSWERED = "max min sum avg argmax argmin all_greater_eq all_less_eq".split()
SCALARS = "max min avg sum nth_max nth_min".split()
PICKS = "argmax argmin nth_argmax nth_argmin".split()
CLAIMS = [f"{m}_{c}" for m in ("most", "all") for c in "eq not_eq greater greater_eq less less_eq".split()]
TWO_SIDED = "eq not_eq greater less".split()
KNOWN = [*FILTERS, "filter_all", *SCALARS, *PICKS, *CLAIMS, *TWO_SIDED, "count", "only", "hop", "diff", "and", "round_eq"]
ALL = "all_rows"
# A selection and a column of it.
KEY = ["table_id", "sel", "col"]
TEXT_TYPES = ["str", "mixed", "same_n_nums", "empty"]
# Tasks among which the tables of one template text are dealt, and rows of a table that stay together.
_TEXT_PARTS, _TOGETHER = 256, 50_000
# Ranks of second parts that first parts meet in one group of a join.
_RANKS = 1_000
_V = ["num", "ts", "str"]
_VTYPE = "struct<num:double,ts:timestamp_ntz,str:string>"


def _value() -> Column:
    """The typed value of a cell, whatever its type; null for an empty one."""
    parts = F.struct(F.col("num").cast("double").alias("num"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("str").alias("str"))
    return F.when(F.coalesce(*[F.col(c).cast("string") for c in _V]).isNotNull(), parts).cast(_VTYPE)


def _number(x: Column) -> Column:
    return F.struct(x.cast("double").alias("num"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("str")).cast(_VTYPE)


# ---- expressions ----


def _parsed(texts: DataFrame) -> DataFrame:
    """The expressions of each distinct text of ``lf``: see ``expressions``."""
    parsed = text_nodes(texts).where("balanced")
    tokens, nodes = F.col("tokens"), F.col("nodes")

    def text(n: Column) -> Column:
        """Tokens from a function to the brace that closes it."""
        def walk(acc: Column, t: Column) -> Column:
            level = acc["level"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
            done = acc["done"] | ((t == "}") & (level == 0))
            return F.when(acc["done"], acc).otherwise(F.struct(level.alias("level"), (acc["n"] + 1).alias("n"), done.alias("done")))

        start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        size = F.aggregate(F.slice(tokens, n["node_id"] + 1, F.size(tokens)), start, walk, lambda acc: acc["n"])
        return F.when(n["func"].isNull(), n["leaf"]).otherwise(F.array_join(F.slice(tokens, n["node_id"] + 1, size), " "))

    # A handful of nodes a text: parents and arguments are looked up inside its row, where nodes lie in order.
    written = step(parsed, written=F.transform(nodes, lambda n: F.struct(
        n["node_id"].alias("id"), n["parent_id"].alias("up"), n["func"].alias("func"), text(n).alias("text"))))
    each = written.select("lf", "written", F.explode(F.filter("written", lambda n: n["func"].isNotNull())).alias("n"))
    n = F.col("n")
    found = step(each, parent=F.get(F.filter("written", lambda x: x["id"] == n["up"]), F.lit(0))["func"], args=F.filter("written", lambda x: x["up"] == n["id"]))
    part = lambda i, f: F.get("args", F.lit(i))[f].alias(("arg" if f == "text" else "func") + str(i))
    level = F.size(F.split("n.text", "filter_")) - 1
    return found.where(F.size("args") > 0).select("lf", "n.func", "n.text", "parent", level.alias("level"), *[part(i, f) for i in range(3) for f in ("text", "func")])


def _dealt(templates: DataFrame) -> DataFrame:
    """Few texts may belong to all tables: the tables of a text fall into parts, which go to different tasks."""
    return templates.withColumn("part", F.pmod(F.xxhash64("table_id"), F.lit(_TEXT_PARTS)))


def expressions(templates: DataFrame) -> DataFrame:
    """(table_id, func, text, parent, level, arg0 .. arg2, func0 .. func2): the distinct expressions of each
    table's templates; ``arg`` are the texts of the arguments, ``func`` their functions, ``parent`` the function
    above. ``level`` is the number of filters inside the expression."""
    given = _dealt(templates.select("table_id", "lf"))
    parts = given.select("lf", "part").distinct().join(merged(_parsed(templates)), "lf")
    return given.distinct().join(merged(parts), ["lf", "part"]).drop("lf", "part").distinct()


# ---- answers about a selection and a column ----


def _cells_of(wanted: DataFrame, members: DataFrame, cells: DataFrame) -> DataFrame:
    """The wanted (KEY, any others) rows with the cells of their column in the rows of their selection."""
    typed = cells.select("table_id", "row_idx", F.col("col_name").alias("col"), "raw", *_V, F.col("coltype").isin(*TEXT_TYPES).alias("is_text"))
    others = [c for c in wanted.columns if c not in KEY]
    # The rows of a selection are dealt in blocks, for one table may have most of them.
    dealt = members.withColumn("block", F.floor(F.col("row_idx") / _TOGETHER))
    blocks = wanted.join(merged(dealt.select("table_id", "sel", "block").distinct()), ["table_id", "sel"])
    return blocks.join(merged(dealt), ["table_id", "sel", "block"]).join(merged(typed), ["table_id", "row_idx", "col"]).select(
        *KEY, *others, "row_idx", _value().alias("v"), "raw", F.col("num").cast("double").alias("num"), "is_text")


def _looked_up(wanted: DataFrame, members: DataFrame, cells: DataFrame) -> DataFrame:
    """(KEY, asked, row_idx, v, raw, num, is_text): cells of the wanted (KEY, func) columns in the rows of selections,
    with the functions that ask for them, a few dozen at most."""
    return _cells_of(wanted.groupBy(*KEY).agg(F.collect_set("func").alias("asked")), members, cells)


def _asking(rows: DataFrame, funcs: Collection[str], wanted: Collection[str]) -> DataFrame | None:
    """Rows of columns that some of ``wanted`` ask for; none if no template does."""
    some = [f for f in wanted if f in funcs]
    return rows.where(F.arrays_overlap("asked", F.array(*[F.lit(f) for f in some]))) if some else None


def _answers(profile: DataFrame, *each: tuple) -> DataFrame:
    """(KEY, func, filled, out, v, cnt) from rows of a profile: each is (function, condition, filled, out, v, count)."""
    none = F.lit(None)
    structs = [
        F.struct(F.lit(f).alias("func"), F.coalesce(ok, F.lit(False)).alias("ok"), (none if filled is None else filled).cast("string").alias("filled"),
                 (none if out is None else out).cast("string").alias("out"), (none if v is None else v).cast(_VTYPE).alias("v"), (none if cnt is None else cnt).cast("long").alias("cnt"))
        for f, ok, filled, out, v, cnt in each
    ]
    return profile.select(*KEY, F.inline(F.array(*structs))).where("ok").drop("ok")


def _profile(rows: DataFrame) -> DataFrame:
    """Distinct values of each column with the rows up to, below and in all: see ``values.value_profile``."""
    counts = value_counts(KeyedTable(rows, KEY, ["row_idx"], raw={"v": "raw"}), "v")
    filled = F.when(F.col("v").isNotNull(), F.col("cnt")).otherwise(F.lit(0))
    return running(counts, KEY, ["v"], {"upto": filled}, {"n": ("sum", filled), "total": ("sum", F.col("cnt"))}).withColumn("below", F.col("upto") - F.col("cnt"))


def _text_columns(rows: DataFrame) -> DataFrame:
    """(KEY, is_text) of the columns with texts."""
    return rows.where("is_text").select(*KEY, "is_text").distinct()


def _grams(t: KeyedTable) -> DataFrame:
    """``ngrams.frequent_ngrams`` of the values. The counts, of which the explained ones are told by several looks at
    all, are written once: each look would make them anew."""
    return ngrams.drop_explained(t.by, stored(ngrams.clean_counts(t, "v"), "fill-grams"))


def _bound_answers(rows: DataFrame, funcs: Collection[str], weight: str | None = None) -> list[DataFrame]:
    """Answers that are round bounds."""
    t = KeyedTable(rows.where("num is not null"), KEY, raw={"num": "raw"}, weight=weight)
    bound, half = number_text(F.col("bound")), F.floor(F.col("n") / 2)
    some, most = F.col("beyond") < F.col("n"), (F.col("beyond") > half) & (F.col("beyond") < F.col("n"))
    ways = {
        "filter_greater": (some, _number(F.col("bound")), F.col("beyond")), "filter_less": (some, _number(F.col("bound")), F.col("beyond")),
        "most_greater": (most & (F.col("lowest") < half), None, None), "all_greater": (F.col("lowest") == 0, None, None),
        "most_less": (most & (F.col("highest") < half), None, None), "all_less": (F.col("highest") == 0, None, None),
    }
    out = []
    for kind, bounds in (("greater", lower_bounds), ("less", upper_bounds)):
        mine = [f for f in ways if f.endswith(kind) and f in funcs]
        if mine:
            out.append(_answers(stored(bounds(t, "num"), "fill-bounds"), *[(f, ways[f][0], bound, None, *ways[f][1:]) for f in mine]))
    return out


def _options(rows: DataFrame, funcs: set[str], listed: bool) -> tuple[DataFrame, DataFrame]:
    """Options of every filter over the rows, and (KEY, candidate, txt_id) of the distinct texts that an option by text
    takes, which are read if ``listed``.

    ``filter_eq`` over texts takes the rows that contain the text as a run of whole tokens; frequent n-grams of
    any column are options too. Values with several original texts are no options."""
    v, raw, cnt, one = F.col("v"), F.col("raw"), F.col("cnt"), F.col("one_raw")
    found = []
    # Equal cells are one row with their number. Which functions ask goes with the key, as one number, so that none answers a
    # column that does not ask for it.
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    mask = reduce(lambda a, b: a + b, [F.array_contains("asked", f).cast("int") * bits[f] for f in FILTERS]).alias("mask")
    asks = lambda f: F.col("mask").bitwiseAND(F.lit(bits[f])) > 0
    classes = stored(rows.select("*", mask).groupBy(*KEY, "mask", "v", "raw").agg(F.count(F.lit(1)).alias("rows"), F.max("num").alias("num"), F.max("is_text").alias("is_text")), "fill-classes")
    asking = lambda *wanted: classes.where(reduce(lambda a, b: a | b, [asks(f) for f in wanted])) if funcs & set(wanted) else None
    keyed = lambda some, *by: KeyedTable(some, [*KEY, *by], raw={"v": "raw"}, weight="rows")
    equal, other = asking("filter_eq"), asking("filter_not_eq")
    if equal is not None:
        # Options of texts are told by containment below, so their values are not counted here.
        texts = _text_columns(equal)
        values = value_counts(keyed(equal.where(v.isNull() | ~F.col("is_text"))), "v")
        found.append(_answers(join_on(values, texts, KEY, "left_outer"), ("filter_eq", one & (v.isNull() | F.col("is_text").isNull()), raw, None, v, cnt)))
    if other is not None:
        sizes = other.groupBy(*KEY).agg(F.sum("rows").alias("total"))
        found.append(_answers(join_on(value_counts(keyed(other), "v"), sizes, KEY), ("filter_not_eq", one, raw, None, v, F.col("total") - cnt)))
    valued = asking("filter_greater_eq", "filter_less_eq")
    if valued is not None:
        found.append(_answers(
            value_profile(keyed(valued, "mask"), "v"),
            ("filter_greater_eq", asks("filter_greater_eq") & (F.col("upto") < F.col("n")), raw, None, v, F.col("n") - F.col("below")),
            ("filter_less_eq", asks("filter_less_eq") & (F.col("below") > 0), raw, None, v, F.col("upto")),
        ))
    bounded = asking("filter_greater", "filter_less")
    if bounded is not None:
        found += _bound_answers(bounded, [f for f in funcs if f in FILTERS], "rows")
    found = [x.withColumn("by_text", F.lit(False)) for x in found]
    inside = rows.select(*KEY, F.lit("").alias("candidate"), ngrams.text_id(F.col("raw")).alias("txt_id")).where(F.lit(False))
    if equal is not None:
        t = keyed(equal)
        named = value_counts(t, "v").join(merged(texts), KEY).where(one & v.isNotNull()).select(*KEY, F.col("v.str").alias("candidate"))
        inside = ngrams.containment(t, "v", named.unionByName(_grams(t).select(*KEY, F.col("gram").alias("candidate"))).distinct())
        inside = stored(inside, "fill-inside") if listed else inside
        found.append(inside.groupBy(*KEY, "candidate").agg(F.sum("cnt").alias("cnt")).select(
            *KEY, F.lit("filter_eq").alias("func"), F.col("candidate").alias("filled"), F.lit(None).cast("string").alias("out"), F.lit(None).cast(_VTYPE).alias("v"), F.col("cnt").cast("long").alias("cnt"), F.lit(True).alias("by_text")))
    return reduce(DataFrame.unionByName, found), inside


def _held(options: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a column whose text is one of those that options by text take: ``options`` (KEY, txt_id, any others)."""
    return join_on(options, rows.select(*KEY, "row_idx", ngrams.text_id(F.col("raw")).alias("txt_id")), [*KEY, "txt_id"]).drop("txt_id")


def _filter_answers(rows: DataFrame, funcs: set[str], listed: bool) -> tuple[DataFrame, DataFrame]:
    """Options of every filter over the rows, and (KEY, filled, row_idx) of the rows that options by text take."""
    options, inside = _options(rows, funcs, listed)
    return options, _held(inside.select(*KEY, F.col("candidate").alias("filled"), "txt_id"), rows)


def _ends(rows: DataFrame) -> DataFrame:
    """(KEY, lo, hi): the least and largest value, each with the least of its texts."""
    found = rows.where("v is not null").groupBy(*KEY, "v").agg(F.min("raw").alias("raw")).groupBy(*KEY).agg(F.min(F.struct("v", "raw")).alias("lo"), F.max(F.struct("v", "raw")).alias("hi"))
    return found


def _column_answers(rows: DataFrame, funcs: Collection[str]) -> list[DataFrame]:
    """Answers of scalars and claims."""
    v, raw, cnt, one, n, total = (F.col(c) for c in ("v", "raw", "cnt", "one_raw", "n", "total"))
    below, upto, some = F.col("below"), F.col("upto"), F.col("v").isNotNull()
    parts = []
    ends = _asking(rows, funcs, ["max", "min", "all_greater_eq", "all_less_eq"])
    if ends is not None:
        lo, hi, yes = F.col("lo"), F.col("hi"), F.lit(True)
        parts.append(_answers(_ends(ends), ("max", yes, None, hi["raw"], hi["v"], None), ("min", yes, None, lo["raw"], lo["v"], None), ("all_greater_eq", yes, lo["raw"], None, None, None), ("all_less_eq", yes, hi["raw"], None, None, None)))
    placed = _asking(rows, funcs, ["most_not_eq", "most_greater_eq", "most_less_eq"])
    if placed is not None:
        half = F.floor(n / 2)
        start = n - half
        first, last = F.when(n == 1, F.lit(0)).otherwise(start), F.when(n == 1, F.lit(0)).otherwise(F.least(start + 1, n - 1))
        parts.append(_answers(
            stored(_profile(placed), "fill-profile"),
            ("most_not_eq", one & (total - cnt > total / 2), raw, None, None, None),
            ("most_greater_eq", some & (F.greatest(below, F.lit(1)) <= F.least(upto, half) - 1), raw, None, None, None),
            ("most_less_eq", some & (F.greatest(below, first) <= F.least(upto - 1, last)), raw, None, None, None),
        ))
    equal = _asking(rows, funcs, ["most_eq", "all_eq"])
    if equal is not None:
        t = KeyedTable(equal, KEY, ["row_idx"], raw={"v": "raw"})
        sizes = equal.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total"), F.max("is_text").alias("is_text"))
        valued = stored(join_on(value_counts(t, "v"), sizes, KEY), "fill-valued")
        usual = (cnt > total / 2) & (cnt < total)
        values = _answers(valued, ("most_eq", one & usual, raw, None, None, None), ("all_eq", one & ~F.col("is_text") & (cnt == total), raw, None, None, None))
        grams = stored(join_on(_grams(t).select(*KEY, F.col("gram").alias("raw"), F.col("freq").alias("cnt")), sizes, KEY), "fill-frequent")
        settled = values.where("func = 'most_eq'").select(*KEY).distinct()
        mostly = join_on(_answers(grams, ("most_eq", usual, raw, None, None, None)), settled, KEY, "left_anti")
        # A text that is a value and an n-gram adds its two counts; other columns have values that are no texts.
        own = valued.where(one & some & F.col("is_text")).select(*KEY, "raw", "cnt", "total", "is_text")
        both = own.unionByName(grams).groupBy(*KEY, "raw").agg(F.sum("cnt").alias("cnt"), F.max("total").alias("total"))
        everywhere = _answers(both, ("all_eq", cnt == total, raw, None, None, None))
        parts += [values, mostly, everywhere]
    if "avg" in funcs:
        means = aggregates.col_avg(KeyedTable(_asking(rows, funcs, ["avg"]), KEY, ["row_idx"]), "num")
        parts.append(_answers(means, ("avg", F.lit(True), None, number_text(F.col("mean")), _number(F.col("mean")), None)))
    if "sum" in funcs:
        sums = aggregates.col_sum(KeyedTable(_asking(rows, funcs, ["sum"]), KEY, ["row_idx"]), "num")
        parts.append(_answers(sums, ("sum", F.lit(True), None, number_text(F.col("total")), _number(F.col("total")), None)))
    bounded = _asking(rows, funcs, ["most_greater", "all_greater", "most_less", "all_less"])
    return parts + (_bound_answers(bounded, [f for f in funcs if f in CLAIMS]) if bounded is not None else [])


def _row_answers(rows: DataFrame, funcs: Collection[str]) -> list[DataFrame]:
    """(KEY, func, filled, out, v, row_idx): extreme and n-th cells and their rows; ties in row order, n up to half."""
    parts = []
    nth = lambda names: [f for f in names if f in funcs]
    for down, names in ((["v"], ["nth_max", "nth_argmax"]), ([], ["nth_min", "nth_argmin"])):
        some = _asking(rows, funcs, names)
        if some is not None:
            one = F.lit(1).cast("long")
            every = running(some.where("v is not null").select(*KEY, "row_idx", "v", "raw"), KEY, ["v", "row_idx"], {"nth": one}, {"n": ("sum", one)}, down)
            ranked = stored(every.where(F.col("nth") <= F.floor(F.col("n") / 2)), "fill-nth")
            parts.append(ranked.select(*KEY, F.explode(F.array(*[F.lit(f) for f in nth(names)])).alias("func"), F.col("nth").cast("string").alias("filled"), F.col("raw").alias("out"), "v", "row_idx"))
    some = _asking(rows, funcs, ["argmax", "argmin"])
    if some is not None:
        # The first row of the extreme value: the value, then the row, in one ordering.
        cell, n = F.struct("raw", "row_idx"), F.col("row_idx")
        found = some.where("v is not null").groupBy(*KEY).agg(F.max(F.struct("v", (-n).alias("n"), cell.alias("c"))).alias("hi"), F.min(F.struct("v", n.alias("n"), cell.alias("c"))).alias("lo"))
        each = F.array(*[F.struct(F.lit(f).alias("func"), F.lit(None).cast("string").alias("filled"), x["c"]["raw"].alias("out"), x["v"].alias("v"), x["c"]["row_idx"].alias("row_idx")) for f, x in (("argmax", F.col("hi")), ("argmin", F.col("lo"))) if f in funcs])
        parts.append(found.select(*KEY, F.inline(each)))
    return parts


# ---- ranges ----

# Digits of hexadecimal text and what they become so that its order runs the other way.
_HEX, _TURNED = "0123456789ABCDEF", "FEDCBA9876543210"


def _turned(text: Column) -> Column:
    """A text whose order among others is the reverse one; ``_turned_back`` undoes it."""
    return F.concat(F.translate(F.hex(F.encode(text, "UTF-8")), _HEX, _TURNED), F.lit("~"))


def _turned_back(text: Column) -> Column:
    return F.decode(F.unhex(F.translate(F.rtrim(text, F.lit("~")), _TURNED, _HEX)), "UTF-8")


_FIGURES = {"s": "sum", "k": "sum", "lo": "min", "hi": "max", "first_lo": "min", "first_hi": "max"}


def _of_ranges(over: DataFrame, members: DataFrame, cells: DataFrame) -> DataFrame:
    """Answers over selections that are ranges: (columns of ``over``, filled, out, v, row_idx).

    over: (table_id, sel, col1, ranged, option) is the filter ``ranged`` of the selection ``sel`` on ``col1`` with the
    value ``option``; ``func`` and ``col`` ask for a function of ``ANSWERED`` over a column of what it leaves. The rows of
    ``sel`` are summed up by value of ``col1``; sums, extremes and first extreme rows before and after each value
    answer for every option, so work grows with rows and options, not with their product.
    """
    by = ["table_id", "sel", "col1", "col"]
    first = _cells_of(over.select("table_id", "sel", F.col("col1").alias("col")).distinct(), members, cells).select("table_id", "sel", F.col("col").alias("col1"), "row_idx", F.col("v").alias("at"))
    second = _cells_of(over.select(*by).distinct(), members, cells).select(*by, "row_idx", "v", "raw", "num")
    rows = first.join(merged(second), ["table_id", "sel", "col1", "row_idx"])
    some, n = F.col("v").isNotNull(), F.col("row_idx")
    classes = stored(rows.groupBy(*by, "at").agg(
        F.sum("num").alias("s"), F.count("num").alias("k"), F.min(F.when(some, F.struct("v", "raw"))).alias("lo"), F.max(F.when(some, F.struct("v", _turned(F.col("raw")).alias("raw")))).alias("hi"),
        F.min(F.when(some, F.struct("v", n.alias("n")))).alias("first_lo"), F.max(F.when(some, F.struct("v", (-n).alias("n")))).alias("first_hi")), "fill-classes")
    # A bound lies before the rows of its value for ``less`` and behind them for ``greater``.
    bounds = over.where(F.col("ranged").isin("filter_less", "filter_greater")).select(*by, F.col("option").alias("at"), F.when(F.col("ranged") == "filter_less", -1).otherwise(1).alias("side")).distinct()
    places = classes.where("at is not null").withColumn("side", F.lit(0)).unionByName(bounds, allowMissingColumns=True)
    told = cumulated(places, by, ["at", "side"], {f"{w}_{x}": (f, w, F.col(x)) for x, f in _FIGURES.items() for w in ("before", "after")})
    combine = {"sum": lambda *c: reduce(lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), c), "min": F.least, "max": F.greatest}
    empties = classes.where("at is null").select(*by, *[F.col(x).alias(f"none_{x}") for x in _FIGURES])
    both = join_on(told, empties, by, "left_outer")

    def figures(func: str, side: int, *parts: str) -> Column:
        of = lambda x, f: combine[f](*[F.col(p + x) for p in parts]) if len(parts) > 1 else F.col(parts[0] + x)
        return F.struct(F.lit(func).alias("ranged"), (F.col("side") == side).alias("ok"), F.col("at").alias("option"), *[of(x, f).alias(x) for x, f in _FIGURES.items()])

    listed = both.select(*by, F.inline(F.array(
        figures("filter_not_eq", 0, "before_", "after_", "none_"), figures("filter_greater_eq", 0, "", "after_"), figures("filter_less_eq", 0, "before_", ""),
        figures("filter_greater", 1, "after_", ), figures("filter_less", -1, "before_")))).where("ok").drop("ok")
    # Without the empty cells everything is left.
    total = classes.where("at is not null").groupBy(*by).agg(*[{"sum": F.sum, "min": F.min, "max": F.max}[f](x).alias(x) for x, f in _FIGURES.items()])
    whole = total.select(*by, F.lit("filter_not_eq").alias("ranged"), F.lit(None).cast(_VTYPE).alias("option"), *_FIGURES)
    found = join_on(over, listed.unionByName(whole), [*by, "ranged", "option"])
    func, none = F.col("func"), F.lit(None)
    hi_raw = F.when(F.col("hi").isNotNull(), _turned_back(F.col("hi.raw")))
    mean, total = round_two(F.col("s") / F.nullif(F.col("k"), F.lit(0))), round_two(F.coalesce("s", F.lit(0.0)))
    pick = lambda *pairs: reduce(lambda acc, p: acc.when(func == p[0], p[1]), pairs[1:], F.when(func == pairs[0][0], pairs[0][1]))
    answered = found.select(
        *over.columns,
        pick(("all_greater_eq", F.col("lo.raw")), ("all_less_eq", hi_raw)).alias("filled"),
        pick(("max", hi_raw), ("min", F.col("lo.raw")), ("sum", number_text(total)), ("avg", number_text(mean))).alias("out"),
        pick(("max", F.col("hi.v")), ("min", F.col("lo.v")), ("sum", _number(total)), ("avg", _number(mean))).cast(_VTYPE).alias("v"),
        pick(("argmax", -F.col("first_hi.n")), ("argmin", F.col("first_lo.n")), ("max", none)).cast("int").alias("row_idx"))
    return answered.where(F.coalesce("filled", "out", F.col("row_idx").cast("string")).isNotNull())


# ---- selections ----


def _rows_allowed(parent: Column, cnt: Column) -> Column:
    """One row below ``hop`` and ``only``, several below anything else."""
    return F.when(parent.isin("hop", "only"), cnt == 1).otherwise(cnt > 1)


class _Selections:
    """Options of all row expressions: ``named`` (table_id, text, one, sel, cnt), ``members`` (table_id, sel, row_idx) of
    those whose rows are looked into, and ``ranged`` (table_id, text, new, sel, col1, ranged, option) of ranges that are
    only summed up: ``new`` is the filter ``ranged`` over ``sel``."""

    def __init__(self, exprs: DataFrame, cells: DataFrame):
        rows = stored(cells.select("table_id", "row_idx").distinct(), "fill-rows")
        everything = rows.select("table_id", F.lit(ALL).alias("sel"), "row_idx")
        self.named = rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("cnt")).select(
            "table_id", F.lit(ALL).alias("text"), F.lit(False).alias("one"), F.lit(ALL).alias("sel"), "cnt")
        self.members, self.ranged = everything, None
        named, members = self.named, self.members
        filters = exprs.where(F.col("func").isin(*FILTERS, "filter_all"))
        deepest = filters.agg(F.max("level")).first()[0] or 0
        for level in range(1, deepest + 1):
            named, members, ranged = (stored(x, f"fill-{level}") for x in self._level(filters.where(F.col("level") == level), named, members, cells))
            self.named = self.named.unionByName(named)
            self.members = self.members.unionByName(members)
            self.ranged = ranged if self.ranged is None else self.ranged.unionByName(ranged)

    @staticmethod
    def _level(exprs: DataFrame, named: DataFrame, members: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        below = named.where("not one").select("table_id", F.col("text").alias("arg0"), F.col("sel").alias("sel"), F.col("cnt").alias("all_cnt"))
        asked = exprs.select("table_id", "func", "text", "parent", "arg0", F.col("arg1").alias("col")).join(merged(below), ["table_id", "arg0"])
        pairs = exprs.select("func", "parent").distinct().collect()
        funcs = {x.func for x in pairs}
        # Filters into whose rows something looks: not those that are counted or summed up as ranges.
        looked = {x.func for x in pairs if x.parent not in ("count", "only") and not (x.func in RANGES and x.parent in ANSWERED)}
        # The table itself, of any size; one row where a single one is needed.
        one = F.coalesce(F.col("parent").isin("hop", "only"), F.lit(False))
        whole = asked.where("func = 'filter_all'").where(~one | (F.col("all_cnt") == 1)).select(
            "table_id", "text", one.alias("one"), F.concat_ws("", F.lit("filter_all { "), "sel", F.lit(" ; "), "col", F.lit(" }")).alias("new"), F.col("all_cnt").alias("cnt"), "sel")
        passed = whole.select("table_id", "sel", "new").distinct().join(merged(members), ["table_id", "sel"]).select("table_id", F.col("new").alias("sel"), "row_idx")
        names = whole.select("table_id", "text", "one", F.col("new").alias("sel"), "cnt")
        none = asked.select("table_id", "text", F.lit("").alias("new"), "sel", F.col("col").alias("col1"), F.col("func").alias("ranged"), F.lit(None).cast(_VTYPE).alias("option")).where(F.lit(False))
        if funcs == {"filter_all"}:
            return names.distinct(), passed.distinct(), none

        rows = _looked_up(asked.where("func <> 'filter_all'"), members, cells)
        rows = stored(rows, "fill-cells") if looked - {"filter_all"} else rows
        options, inside = _options(rows, funcs, "filter_eq" in looked)
        options = stored(options, "fill-options")
        found = asked.join(merged(options), [*KEY, "func"]).where(_rows_allowed(F.col("parent"), F.col("cnt")))
        sel = F.concat_ws("", "func", F.lit(" { "), "sel", F.lit(" ; "), "col", F.lit(" ; "), "filled", F.lit(" }"))
        chosen = stored(found.select("table_id", "text", one.alias("one"), "parent", sel.alias("new"), "cnt", "sel", "col", "func", "filled", F.col("v").alias("option"), "by_text"), "fill-chosen")
        # Nothing looks into the rows below count and only, and ranges below functions of one answer are summed up.
        summed = F.col("func").isin(*RANGES) & F.col("parent").isin(*ANSWERED)
        ranged = chosen.where(summed).select("table_id", "text", "new", "sel", F.col("col").alias("col1"), F.col("func").alias("ranged"), "option").distinct()
        inner = chosen.where(~F.coalesce(F.col("parent"), F.lit("")).isin("count", "only") & ~F.coalesce(summed, F.lit(False))).select("table_id", "sel", "col", "func", "filled", "option", "by_text", "new").distinct()
        listed = [passed]
        if "filter_eq" in looked:
            equal = inner.where("func = 'filter_eq'")
            listed.append(join_on(equal.where("not by_text").withColumnRenamed("option", "v"), rows.select(*KEY, "v", "row_idx"), [*KEY, "v"]))
            # Options by text: their rows are those of the distinct texts that hold them.
            holding = join_on(equal.where("by_text").select(*KEY, "new", F.col("filled").alias("candidate")), inside, [*KEY, "candidate"])
            listed.append(_held(holding.select(*KEY, "new", "txt_id"), rows))
        if looked & set(RANGES):
            v, option = F.col("v"), F.col("option")
            holds = (
                F.when(F.col("func") == "filter_not_eq", ~v.eqNullSafe(option))
                .when(F.col("func") == "filter_greater_eq", v >= option).when(F.col("func") == "filter_less_eq", v <= option)
                .when(F.col("func") == "filter_greater", F.col("num") > option["num"]).otherwise(F.col("num") < option["num"]))
            listed.append(inner.where("func <> 'filter_eq'").join(merged(rows.select(*KEY, "row_idx", "v", "num")), KEY).where(holds))
        rows_of = reduce(DataFrame.unionByName, [passed, *[x.select("table_id", F.col("new").alias("sel"), "row_idx") for x in listed[1:]]])
        both = chosen.select("table_id", "text", "one", F.col("new").alias("sel"), "cnt").unionByName(names)
        return both.distinct(), rows_of.distinct(), ranged


# ---- statements ----


def _first_filter(sel: Column) -> Column:
    """A selection's text where it is a filter."""
    return F.when(sel != ALL, sel)


def _values_and_claims(exprs: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scalars (table_id, text, lf, out, v, filt, nth) and simple claims (table_id, text, lf, filt, nth).

    ``filt`` and ``nth`` are the outermost filter and n-th expression inside, which both sides of ``and`` share."""
    s = _Selections(exprs, cells)
    funcs = [x.func for x in exprs.where(F.col("func").isin(*KNOWN)).select("func").distinct().collect()]
    many = s.named.where("not one").select("table_id", F.col("text").alias("arg0"), "sel", "cnt")
    summed = F.col("func").isin(*ANSWERED) & F.coalesce(F.col("func0").isin(*RANGES), F.lit(False))
    asked = exprs.where(F.col("func").isin(*SCALARS, *PICKS, *CLAIMS))
    over = asked.where(~summed).select("table_id", "func", "text", "arg0", F.col("arg1").alias("col")).distinct().join(merged(many.drop("cnt")), ["table_id", "arg0"])
    none = F.lit(None).cast("string")
    columns, picked = [], []
    wanted = [f for f in funcs if f in (*SCALARS, *PICKS, *CLAIMS)]
    if wanted:
        rows = stored(_looked_up(over, s.members, cells), "fill-cells")
        for parts, out in ((_column_answers(rows, wanted), columns), (_row_answers(rows, wanted), picked)):
            if parts:
                out.append(stored(over.join(merged(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)), [*KEY, "func"]), "fill-answers"))
    if s.ranged is not None and set(wanted) & set(ANSWERED):
        of = asked.where(summed).select("table_id", "func", F.col("text").alias("whole"), F.col("arg0").alias("text"), F.col("arg1").alias("col")).distinct()
        ranged = _of_ranges(stored(of.join(merged(s.ranged), ["table_id", "text"]), "fill-over"), s.members, cells).drop("text", "sel").withColumnsRenamed({"whole": "text", "new": "sel"})
        ranged = stored(ranged, "fill-ranged")
        columns.append(ranged.where(~F.col("func").isin(*PICKS)))
        picked.append(ranged.where(F.col("func").isin(*PICKS)))
    filled = F.when(F.col("filled").isNotNull(), F.concat(F.lit(" ; "), "filled")).otherwise("")
    lf = F.concat_ws("", "func", F.lit(" { "), "sel", F.lit(" ; "), "col", filled, F.lit(" }"))
    filt = _first_filter(F.col("sel")).alias("filt")
    nothing = exprs.select("table_id", "func", "text", none.alias("lf"), none.alias("out"), F.lit(None).cast(_VTYPE).alias("v"), F.lit(None).cast("int").alias("row_idx"), none.alias("filt"), none.alias("nth")).where(F.lit(False))
    columns = reduce(DataFrame.unionByName, [x.select("table_id", "func", "text", lf.alias("lf"), "out", "v", filt, none.alias("nth")) for x in columns], nothing.drop("row_idx"))
    picked = reduce(DataFrame.unionByName, [x.select(
        "table_id", "func", "text", lf.alias("lf"), "out", "v", "row_idx", filt,
        F.when(F.col("filled").isNotNull(), F.regexp_replace(lf, "^nth_arg", "nth_")).alias("nth")) for x in picked], nothing)
    nths = picked.where(F.col("func").isin("nth_max", "nth_min"))

    scalar = ["table_id", "text", "lf", "out", "v", "filt", "nth"]
    found = [columns.where(F.col("func").isin(*SCALARS)).select(*scalar), nths.select(*scalar)]
    if "hop" in funcs:
        single = s.named.where("one").select("table_id", "text", F.col("sel").alias("lf"), F.col("sel").alias("filt"), none.alias("nth")).join(merged(
            s.members.withColumnRenamed("sel", "lf")), ["table_id", "lf"])
        at = single.unionByName(picked.where(F.col("func").isin(*PICKS)).select("table_id", "text", "lf", "filt", "nth", "row_idx"))
        hops = exprs.where("func = 'hop'").select("table_id", F.col("text").alias("whole"), F.col("arg0").alias("text"), F.col("arg1").alias("col_name")).distinct()
        hopped = hops.join(merged(at), ["table_id", "text"]).join(merged(cells.select("table_id", "row_idx", "col_name", "raw", *_V)), ["table_id", "row_idx", "col_name"]).select(
            "table_id", F.col("whole").alias("text"), F.concat_ws("", F.lit("hop { "), "lf", F.lit(" ; "), "col_name", F.lit(" }")).alias("lf"), F.col("raw").alias("out"), _value().alias("v"), "filt", "nth")
        found.append(hopped)

    counts = exprs.where("func = 'count'").select("table_id", F.col("text").alias("whole"), "arg0").distinct().join(merged(many), ["table_id", "arg0"]).select(
        "table_id", F.col("whole").alias("text"), F.concat(F.lit("count { "), "sel", F.lit(" }")).alias("lf"), F.col("cnt").cast("string").alias("out"),
        _number(F.col("cnt")).alias("v"),
        _first_filter(F.col("sel")).alias("filt"), none.alias("nth"))
    values = reduce(DataFrame.unionByName, [*found, *([counts] if "count" in funcs else [])])

    one_row = s.named.where((F.col("cnt") == 1) & (F.col("one") | (F.col("text") == ALL))).select("table_id", F.col("text").alias("arg0"), "sel")
    only = exprs.where("func = 'only'").select("table_id", "text", "arg0").distinct().join(merged(one_row), ["table_id", "arg0"]).select(
        "table_id", "text", F.concat(F.lit("only { "), "sel", F.lit(" }")).alias("lf"), _first_filter(F.col("sel")).alias("filt"), none.alias("nth"))
    claims = columns.where(F.col("func").isin(*CLAIMS)).select("table_id", "text", "lf", "filt", "nth")
    claims = claims.unionByName(only) if "only" in funcs else claims
    return values.distinct(), claims.distinct()


def _is_open(text: Column) -> Column:
    """May an expression have several options in one table? A literal to the right of ``eq`` follows from its left."""
    return F.regexp_replace(text, r"^(round_)?eq \{ (.*) ; X \}$", "$2").rlike(r" ; X \}")


def _side(values: DataFrame, i: int) -> DataFrame:
    return values.select("table_id", F.col("text").alias(f"arg{i}"), F.col("lf").alias(f"lf{i}"), F.col("v").alias(f"v{i}"), F.col("filt").alias(f"filt{i}"), F.col("nth").alias(f"nth{i}"))


def _difference(a: Column, b: Column) -> Column:
    """Difference of two values: whole days for timestamps."""
    days = F.floor((F.unix_micros(a["ts"].cast("timestamp")) - F.unix_micros(b["ts"].cast("timestamp"))) / F.lit(86_400_000_000)).cast("double")
    return F.coalesce(round_two(a["num"] - b["num"]), days)


def _two_sided(exprs: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims about two scalars and their differences, where one side at most has several options."""
    asked = exprs.where(F.col("func").isin(*TWO_SIDED, "diff") & F.col("func0").isNotNull() & F.col("func1").isNotNull() & ~_both_open())
    sides = asked.select("table_id", "func", "text", "arg0", "arg1").distinct().join(merged(_side(values, 0)), ["table_id", "arg0"]).join(merged(_side(values, 1)), ["table_id", "arg1"])
    a, b = F.col("v0"), F.col("v1")
    more = F.coalesce(a["num"] > b["num"], a["ts"] > b["ts"], F.lit(False))
    fewer = F.coalesce(a["num"] < b["num"], a["ts"] < b["ts"], F.lit(False))
    holds = (
        F.when(F.col("func") == "greater", more).when(F.col("func") == "less", fewer).when(F.col("func") == "eq", a.eqNullSafe(b) & a.isNotNull() & (F.col("lf0") != F.col("lf1")))
        .when(F.col("func") == "not_eq", ~a.eqNullSafe(b)).otherwise(_difference(a, b).isNotNull() & ~a.eqNullSafe(b)))
    true = sides.where(holds).withColumn("lf", F.concat_ws("", "func", F.lit(" { "), "lf0", F.lit(" ; "), "lf1", F.lit(" }")))
    key = [F.coalesce("filt0", "filt1").alias("filt"), F.coalesce("nth0", "nth1").alias("nth")]
    out = _difference(a, b)
    diffs = true.where("func = 'diff'").select("table_id", "text", "lf", number_text(out).alias("out"), _number(out).alias("v"), *key)
    return true.where("func <> 'diff'").select("table_id", "text", "lf", *key), diffs


def _equations(exprs: DataFrame, values: DataFrame) -> DataFrame:
    """``eq`` and ``round_eq`` of a scalar and a hole."""
    hole_last, hole_first = F.col("arg1") == "X", F.col("arg0") == "X"
    asked = exprs.where(F.col("func").isin("eq", "round_eq") & (hole_last | hole_first)).select(
        "table_id", "func", F.col("text").alias("whole"), F.when(hole_last, F.col("arg0")).otherwise(F.col("arg1")).alias("text"), hole_last.alias("last")).distinct()
    found = asked.join(merged(values), ["table_id", "text"])
    literal = F.when(F.col("func") == "round_eq", F.coalesce(number_text(round_two(F.col("v.num"))), F.col("out"))).otherwise(F.col("out"))
    inside = F.when(F.col("last"), F.concat_ws("", "lf", F.lit(" ; "), literal)).otherwise(F.concat_ws("", literal, F.lit(" ; "), "lf"))
    return found.where(literal.isNotNull()).select("table_id", F.col("whole").alias("text"), F.concat_ws("", "func", F.lit(" { "), inside, F.lit(" }")).alias("lf"), "filt", "nth")


def _shared() -> Column:
    """Do both sides of an ``and`` hold a filter, or an n-th expression, to meet at?"""
    both = lambda x: F.col("arg0").contains(x) & F.col("arg1").contains(x)
    return both("filter_") | both("nth_")


def _both_open() -> Column:
    """Two sides of which each may have several options: a list of pairs."""
    inner = F.col("func0").isNotNull() & F.col("func1").isNotNull() & _is_open(F.col("arg0")) & _is_open(F.col("arg1"))
    return inner & (F.col("func").isin(*TWO_SIDED, "diff") | ((F.col("func") == "and") & ~_shared()))


def _both(exprs: DataFrame, claims: DataFrame) -> DataFrame:
    """``and`` of two claims: filters and n-th expressions inside must be the same ones."""
    asked = exprs.where((F.col("func") == "and") & F.col("func0").isNotNull() & F.col("func1").isNotNull() & ~_both_open()).select("table_id", "text", "arg0", "arg1").distinct()
    side = lambda i: claims.select("table_id", F.col("text").alias(f"arg{i}"), F.col("lf").alias(f"lf{i}"), F.col("filt").alias(f"filt{i}"), F.col("nth").alias(f"nth{i}"))
    same = lambda c: F.col(f"{c}0").isNull() | F.col(f"{c}1").isNull() | (F.col(f"{c}0") == F.col(f"{c}1"))
    left = asked.join(merged(side(0)), ["table_id", "arg0"])
    # Where both sides have a filter, rows meet at it and not at the table alone.
    meet = lambda c: F.when(F.col("arg0").contains(c) & F.col("arg1").contains(c), F.col("filt0" if c == "filter_" else "nth0"))
    keyed = left.withColumn("at", F.coalesce(meet("filter_"), meet("nth_"), F.lit("")))
    right = side(1)
    by_filter = keyed.where("at <> ''").join(merged(right.withColumn("at", F.explode(F.array_compact(F.array("filt1", "nth1"))))), ["table_id", "arg1", "at"])
    free = keyed.where("at = ''").join(merged(right), ["table_id", "arg1"])
    lf = F.concat_ws("", F.lit("and { "), "lf0", F.lit(" ; "), "lf1", F.lit(" }"))
    pick = lambda df: df.where(same("filt") & same("nth")).select("table_id", "text", lf.alias("lf"), F.coalesce("filt0", "filt1").alias("filt"), F.coalesce("nth0", "nth1").alias("nth"))
    return pick(by_filter).unionByName(pick(free)).distinct()


def _conjunctions(exprs: DataFrame, simple: DataFrame) -> DataFrame:
    """Claims with all ``and`` over them, from the inmost out; as many rounds as the deepest template has."""
    depth = F.size(F.split("text", r"(^|\W)and \{")) - 1
    ands = exprs.where("func = 'and'").withColumn("depth", depth)
    claims = stored(simple, "fill-claims")
    for level in range(1, (ands.agg(F.max("depth")).first()[0] or 0) + 1):
        claims = claims.unionByName(stored(_both(ands.where(F.col("depth") == level), claims), "fill-and"))
    return claims


def _form(templates: DataFrame) -> DataFrame:
    given = _dealt(templates.select("table_id", "template_id", "lf"))
    forms = add_tokens(given.select("lf", "part").distinct()).select("lf", "part", canonical(F.col("tokens")).alias("text"))
    return given.join(merged(forms), ["lf", "part"]).select("table_id", "template_id", "text")


def _claims(exprs: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scalars with differences, and all claims without ``and``."""
    values, claims = (stored(x, "fill-values") for x in _values_and_claims(exprs, cells))
    sided, diffs = _two_sided(exprs, values)
    values = values.unionByName(stored(diffs, "fill-diffs"))
    return values, reduce(DataFrame.unionByName, [claims, sided, _equations(exprs, values)])


def answered(templates: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The expressions of templates, their scalars and their claims: what ``fill`` and ``pair_parts`` share."""
    # Each level and each kind of function reads its own expressions: they lie together in the files.
    exprs, cells = stored(expressions(templates).sortWithinPartitions("func", "level"), "fill-expressions"), stored(cells, "fill-given")
    values, claims = _claims(exprs, cells)
    return exprs, values, _conjunctions(exprs, claims)


def fill(templates: DataFrame, cells: DataFrame, given: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(table_id, template_id, statement): the distinct true statements of every template that ``coverage`` calls
    ``statements``.

    templates (table_id, template_id, lf), checked before; cells as ``query_cells`` gives them; ``given``: what
    ``answered`` says of both, if it is known.
    """
    whole = (given or answered(templates, cells))[2]
    return _form(templates).join(merged(whole), ["table_id", "text"]).select("table_id", "template_id", F.col("lf").alias("statement")).distinct()


def _paired() -> Column:
    """Two open sides that ``pair_parts`` gives: of the whole template, or of a difference that it equals."""
    return F.coalesce(F.when(F.col("func") == "diff", F.col("parent").isin("eq", "round_eq")).otherwise(F.col("parent").isNull()), F.lit(False))


def _in_comparison() -> Column:
    """A comparison of two open sides to which an ``and`` adds a claim about each side."""
    return F.col("func").isin(*TWO_SIDED) & F.col("parent").eqNullSafe(F.lit("and"))


def coverage(templates: DataFrame) -> DataFrame:
    """(table_id, template_id, filled_by): ``statements``, ``pairs``, or why a template is not filled."""
    # What lies around two open sides: the function above, and whether it is the comparison of a pair with claims.
    # The rows of a text come from one task, which keeps them together.
    claimed = F.max(F.when(_claimed(), F.col("arg0"))).over(W.partitionBy("lf"))
    above = _parsed(templates).withColumn("claimed", claimed == F.col("text"))
    outermost = F.col("parent").isNull() | (F.col("parent").isin("eq", "round_eq") & (F.col("func") == "diff")) | F.coalesce("claimed", F.lit(False))
    reason = (
        F.when(~F.col("func").isin(*KNOWN), F.concat(F.lit("unknown function "), "func"))
        .when(F.col("func") == "all_not_eq", F.lit("never has an option"))
        .when(_claimed(), F.lit("pairs"))
        .when(_both_open() & outermost & ((F.col("func") != "diff") | F.col("parent").isNotNull()), F.lit("pairs"))
        .when(_both_open(), F.lit("a pair of options inside another statement")))
    # What cannot be filled at all weighs more than pairs.
    worst = F.struct((F.col("reason") != "pairs").alias("w"), F.col("reason"))
    found = above.select("lf", reason.alias("reason")).groupBy("lf").agg(F.max(F.when(F.col("reason").isNotNull(), worst)).alias("r"), F.lit(True).alias("read"))
    # Texts take many times the room of the files they are made from, by which the planner would broadcast them.
    read = templates.join(merged(found), "lf", "left_outer")
    return read.select("table_id", "template_id", F.when(F.col("read").isNull(), "not readable").otherwise(F.coalesce("r.reason", F.lit("statements"))).alias("filled_by"))


def _claimed() -> Column:
    """``and`` of a comparison whose sides are open and of an ``and`` of a claim about each side, at the top."""
    sides = F.regexp_extract("arg0", r"^\w+ \{ (.*) \}$", 1)
    # Both sides are open where a hole lies on either side of the separator between them.
    return (F.col("func") == "and") & F.col("parent").isNull() & F.col("func0").isin(*TWO_SIDED) & (F.col("func1") == "and") & sides.rlike(r"; X \}.* \} ; .*; X \}")


def pair_parts(templates: DataFrame, cells: DataFrame, given: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Fillings of templates whose two sides have many options each, as two lists.

    first (table_id, template_id, func, around, first, v, claim, partner_from, partner_to, except_from, except_to, n_pairs):
    a first part and the ranks of its second parts, ``partner_from..partner_to`` outside ``except_from..except_to``;
    ``around`` is the outermost function, which an equation has around its difference.
    second (table_id, template_id, rank, second, v, claim): the second parts ranked by value, then text.

    Such are ``greater``, ``less``, ``eq`` and ``not_eq`` of any two scalars, ``eq`` or ``round_eq`` of a difference and a hole,
    ``and`` of two claims that share nothing (any two are partners), and ``and { comparison ; and { one ; two } }``
    where ``one`` is a claim about the filter of the first side and ``two`` about that of the second: ``claim``. An option of
    ``eq`` is no partner of itself. Empty cells take part in ``not_eq`` only, where they differ from all others;
    ``greater``, ``less`` and differences are of numbers and times.
    """
    exprs, values, claims = given or answered(templates, cells)
    names = ["table_id", "func", "text", "whole", "arg0", "arg1", "claim0", "claim1"]
    none = F.lit(None).cast("string")
    plain = exprs.where(_both_open() & _paired()).select("table_id", "func", "text", F.when(F.col("func") == "diff", F.lit(None)).otherwise(F.col("text")).cast("string").alias("whole"), "arg0", "arg1", none.alias("claim0"), none.alias("claim1"))
    # The equation around a difference is the whole template.
    equations = exprs.where("func in ('eq', 'round_eq') and func0 = 'diff' and arg1 = 'X' and parent is null").select("table_id", F.col("text").alias("around"), F.col("arg0").alias("text")).distinct()
    plain = plain.join(merged(equations), ["table_id", "text"], "left_outer").withColumn("whole", F.coalesce("whole", "around")).where("whole is not null")
    compared = exprs.where(_both_open() & _in_comparison()).select("table_id", "func", F.col("text").alias("sides"), "arg0", "arg1").distinct()
    told = exprs.where("func = 'and' and func0 is not null and func1 is not null").select("table_id", F.col("text").alias("claims"), F.col("arg0").alias("claim0"), F.col("arg1").alias("claim1")).distinct()
    outer = exprs.where("func = 'and' and func1 = 'and' and parent is null").select("table_id", "text", F.col("arg0").alias("sides"), F.col("arg1").alias("claims")).distinct()
    with_claims = outer.join(merged(compared), ["table_id", "sides"]).join(merged(told), ["table_id", "claims"]).withColumn("whole", F.col("text"))
    asked = stored(plain.select(*names).distinct().unionByName(with_claims.select(*names).distinct()), "fill-asked")

    said = claims.select("table_id", "text", "lf", F.lit(None).cast(_VTYPE).alias("v"), "filt", "nth")
    options = values.select("table_id", "text", "lf", "v", "filt", "nth")
    about = claims.select("table_id", F.col("text").alias("claim_text"), F.col("lf").alias("claim"), F.explode(F.array_compact(F.array("filt", "nth"))).alias("at"))
    by = ["table_id", "func", "whole"]

    def side(i: int) -> DataFrame:
        """Options of a side with the claims about them."""
        of = asked.select(*by, F.col(f"arg{i}").alias("text"), F.col(f"claim{i}").alias("claim_text"))
        found = of.where("func <> 'and'").join(merged(options), ["table_id", "text"]).unionByName(of.where("func = 'and'").join(merged(said), ["table_id", "text"]))
        free = found.where("claim_text is null").withColumn("claim", none)
        met = found.where("claim_text is not null").withColumn("at", F.explode(F.array_compact(F.array("filt", "nth")))).join(merged(about), ["table_id", "claim_text", "at"])
        out = free.select(*by, "lf", "v", "claim").unionByName(met.select(*by, "lf", "v", "claim")).distinct()
        ordered = F.col("v.num").isNotNull() | F.col("v.ts").isNotNull()
        usable = F.when(F.col("func").isin("greater", "less", "diff"), ordered).when(F.col("func") == "eq", F.col("v").isNotNull()).otherwise(F.lit(True))
        return out.where(F.coalesce(usable, F.lit(False)))

    one = F.lit(1).cast("long")
    # Written once: both are read again, and the ranks of all templates are a plan of their own.
    first = stored(side(0).withColumnRenamed("lf", "first"), "fill-first")
    second = stored(running(stored(side(1), "fill-side").withColumn("key", F.concat_ws(" ", "lf", "claim")), by, ["v", "key"], {"rank": one}, {}), "fill-second")
    # Options of equal value lie side by side; a value that only first parts have lies between two of them.
    classes = first.select(*by, "v", F.lit(0).cast("long").alias("c")).unionByName(second.select(*by, "v", one.alias("c"))).groupBy(*by, "v").agg(F.sum("c").alias("c"))
    ranked = stored(running(classes, by, ["v"], {"upto": F.col("c")}, {"n": ("sum", F.col("c"))}), "fill-ranks").withColumn("below", F.col("upto") - F.col("c"))
    own = second.where("func = 'eq'").groupBy(*by, F.col("lf").alias("first")).agg(F.min("rank").alias("own_from"), F.max("rank").alias("own_to"))
    rows = join_on(join_on(first, ranked, [*by, "v"]), own, [*by, "first"], "left_outer")
    below, upto, n, start = F.col("below"), F.col("upto"), F.col("n"), one
    case = lambda **by_func: reduce(lambda acc, x: acc.when(F.col("func") == x[0], x[1]), list(by_func.items())[1:], F.when(F.col("func") == list(by_func)[0], list(by_func.values())[0]))
    apart, itself = n - (upto - below), F.coalesce(F.col("own_to") - F.col("own_from") + 1, F.lit(0))
    cases = {
        "partner_from": {"greater": start, "less": upto + 1, "eq": below + 1, "not_eq": start, "diff": start, "and": start},
        "partner_to": {"greater": below, "less": n, "eq": upto, "not_eq": n, "diff": n, "and": n},
        "except_from": {"eq": F.col("own_from"), "not_eq": below + 1, "diff": below + 1}, "except_to": {"eq": F.col("own_to"), "not_eq": upto, "diff": upto},
        "n_pairs": {"greater": below, "less": n - upto, "eq": upto - below - itself, "not_eq": apart, "diff": apart, "and": n},
    }
    forms = _form(templates).withColumnRenamed("text", "whole")
    ranges = rows.select(*by, "first", "v", "claim", *[case(**c).cast("long").alias(x) for x, c in cases.items()])
    out = forms.join(merged(ranges.where("n_pairs > 0")), ["table_id", "whole"]).withColumn("around", F.regexp_extract("whole", r"^(\w+)", 1))
    return out.drop("whole"), forms.join(merged(second), ["table_id", "whole"]).select("table_id", "template_id", "rank", F.col("lf").alias("second"), "v", "claim")


def fill_pairs(templates: DataFrame, cells: DataFrame) -> DataFrame:
    """The first parts of ``pair_parts``."""
    return pair_parts(templates, cells)[0]


def expand_pairs(templates: DataFrame, first: DataFrame, second: DataFrame, most: int | None = None) -> DataFrame:
    """(table_id, template_id, statement): statements of the first parts given, ``most`` for each of them or all.

    There are ``n_pairs`` statements for a first part, so choose first parts or ``most`` by it. The first partners come
    in order of their rank. A first part is dealt once for each block of ranks that it has partners in, and meets the
    second parts there: no pair is shuffled.
    """
    keys = ["table_id", "template_id"]
    rank, block = F.col("rank"), lambda x: F.floor(F.col(x) / _RANKS)
    skipped = F.coalesce(F.col("except_to") - F.col("except_from") + 1, F.lit(0))
    last = F.col("partner_to") if most is None else F.least("partner_to", F.col("partner_from") + skipped + most - 1)
    asked = first.select(*keys, "func", "around", "first", F.col("v").alias("v0"), F.col("claim").alias("claim0"), "partner_from", last.alias("partner_to"), "except_from", "except_to")
    dealt = asked.withColumn("block", F.explode(F.sequence(block("partner_from"), block("partner_to"))))
    options = second.select(*keys, block("rank").alias("block"), "rank", "second", F.col("v").alias("v1"), F.col("claim").alias("claim1"))
    both = dealt.join(merged(options), [*keys, "block"]).where(rank.between(F.col("partner_from"), F.col("partner_to")))
    wanted = both.where(F.col("except_from").isNull() | ~rank.between(F.col("except_from"), F.col("except_to")))
    if most is not None:
        before = F.col("except_from").isNull() | (rank < F.col("except_from"))
        wanted = wanted.where(rank - F.col("partner_from") - F.when(before, F.lit(0)).otherwise(skipped) < most)
    pair = F.concat_ws("", "func", F.lit(" { "), "first", F.lit(" ; "), "second", F.lit(" }"))
    away = number_text(_difference(F.col("v0"), F.col("v1")))
    statement = (
        F.when(F.col("func") == "diff", F.concat_ws("", "around", F.lit(" { "), pair, F.lit(" ; "), away, F.lit(" }")))
        .when(F.col("claim0").isNotNull(), F.concat_ws("", F.lit("and { "), pair, F.lit(" ; and { "), "claim0", F.lit(" ; "), "claim1", F.lit(" } }")))
        .otherwise(pair))
    return wanted.select(*keys, statement.alias("statement"))


def fill_all(templates: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_id, template_id, statement): all true statements of every template that ``coverage`` calls ``statements``
    or ``pairs``. Pairs are written out, so the rows grow with the product of the options of two sides."""
    ready = answered(templates, cells)
    return fill(templates, cells, ready).unionByName(expand_pairs(templates, *pair_parts(templates, cells, ready)))


def execution_check(templates: DataFrame, checked: DataFrame, statements: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(table_id, template_id, syntax_ok, n_statements) of every template; one that fails has none. A first part of
    ``pairs`` stands for as many statements as it has partners."""
    keys = ["table_id", "template_id"]
    # Each part is a plan of its own: together they would fill a small driver.
    counted = lambda rows, n: stored(rows.groupBy(*keys).agg(F.sum(n).alias("n")), "fill-counted")
    counts = counted(statements, F.lit(1).cast("long"))
    if pairs is not None:
        counts = counts.unionByName(counted(pairs, F.col("n_pairs").cast("long"))).groupBy(*keys).agg(F.sum("n").alias("n"))
    return templates.select(*keys).join(merged(checked.select(*keys, "syntax_ok")), keys, "left_outer").join(merged(counts), keys, "left_outer").select(
        *keys, F.coalesce("syntax_ok", F.lit(False)).alias("syntax_ok"), F.coalesce("n", F.lit(0)).alias("n_statements"))
