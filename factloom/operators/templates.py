"""Templates of statements as data: tokens, nodes, skeletons and validity, for a relation of templates.

A template is a text ``func { arg ; arg }`` whose arguments are column names, ``all_rows``, the hole
``X`` or further functions. A text is taken apart inside its row, and once however many tables it
belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERED = ["num", "date", "rank", "year", "time"]
UNRANKED = ["num", "date", "year", "time"]
# What every function needs besides its hole, and the column types it takes.
ARITY = {
    **{f: 2 for f in (
        "filter_eq filter_not_eq filter_greater filter_greater_eq filter_less filter_less_eq filter_all max min argmax argmin "
        "nth_max nth_min nth_argmax nth_argmin avg sum diff hop and not_eq greater less most_eq most_not_eq most_greater "
        "most_greater_eq most_less most_less_eq all_eq all_not_eq all_greater all_greater_eq all_less all_less_eq").split()},
    **{f: 1 for f in "count only eq round_eq".split()},
}
TYPES = {
    **{f: ["num", "rank"] for f in ("filter_greater", "filter_less")},
    **{f: ORDERED for f in (
        "filter_greater_eq filter_less_eq max min argmax argmin nth_max nth_min nth_argmax nth_argmin diff greater less").split()},
    **{f: ["num", "time"] for f in ("avg", "sum", "round_eq")},
    **{f: ["num"] for f in ("most_greater", "most_less", "all_greater", "all_less")},
    **{f: UNRANKED for f in ("most_greater_eq", "most_less_eq", "all_greater_eq", "all_less_eq")},
}


def token_array(lf: Column) -> Column:
    """Delimiters and the texts between them; a trailing `` = true`` is dropped and a missing column
    name is an empty text."""
    body = F.when(lf.endswith("true"), F.substring(lf, F.lit(1), F.length(lf) - 7)).otherwise(lf)
    named = F.regexp_replace(body, r"; (?=[};])", "; [None] ")
    marked = F.regexp_replace(F.concat(F.lit(" "), named), r" ([{};])(?= |\z)", "\u0001$1\u0001")
    pieces = F.filter(F.transform(F.split(marked, "\u0001", -1), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(pieces, lambda p: F.when(p == "[None]", "").otherwise(p))


def add_tokens(templates: DataFrame) -> DataFrame:
    return templates.withColumn("tokens", token_array(F.col("lf")))


def _is_mark(t: Column) -> Column:
    return t.isin("{", "}", ";")


def step(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator of one row: what follows cannot pull their expressions into its
    own lambdas, where they would be computed again for every element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def add_nodes(templates: DataFrame) -> DataFrame:
    """Adds ``tokens``, ``nodes``: (node_id, parent_id, arg_pos, depth, func, leaf) of every function and
    leaf, and ``balanced``. The depth of a token is the number of braces open before it. Every distinct
    text is taken apart once and joined back to its tables."""
    return templates.join(text_nodes(templates), "lf")


def text_nodes(templates: DataFrame) -> DataFrame:
    """(lf, tokens, nodes, balanced) of every distinct text: see ``add_nodes``."""
    texts = step(templates.select("lf").distinct(), tokens=token_array(F.col("lf")))
    tokens = F.col("tokens")
    opened = lambda i: F.aggregate(
        F.slice(tokens, 1, i - 1), F.lit(0), lambda a, t: a + F.when(t == "{", 1).when(t == "}", -1).otherwise(0))
    depths = step(texts, __d=F.transform(F.sequence(F.lit(1), F.size(tokens) + 1), opened))
    d = F.col("__d")
    item = lambda t, i: F.struct(i.alias("i"), t.alias("t"), F.get(tokens, i + 1).eqNullSafe(F.lit("{")).alias("f"), F.get(d, i).alias("d"))
    items = step(depths, __i=F.filter(F.transform(tokens, item), lambda x: ~_is_mark(x["t"])))
    parent = lambda x: F.array_max(F.transform(
        F.filter("__i", lambda y: (y["i"] < x["i"]) & y["f"] & (y["d"] == x["d"] - 1)), lambda y: y["i"]))
    with_parent = step(items, __n=F.transform("__i", lambda x: F.struct(
        x["i"].alias("node_id"), parent(x).alias("parent_id"), x["d"].alias("depth"),
        F.when(x["f"], x["t"]).alias("func"), F.when(~x["f"], x["t"]).alias("leaf"))))
    position = lambda x: F.size(F.filter("__n", lambda y: (y["node_id"] < x["node_id"]) & y["parent_id"].eqNullSafe(x["parent_id"])))
    nodes = F.transform("__n", lambda x: F.struct(
        x["node_id"].alias("node_id"), x["parent_id"].alias("parent_id"), position(x).alias("arg_pos"),
        x["depth"].alias("depth"), x["func"].alias("func"), x["leaf"].alias("leaf")))
    balanced = (F.element_at(d, -1) == 0) & (F.array_min(d) >= 0) & F.array_contains(tokens, "{")
    return step(with_parent, nodes=nodes, balanced=balanced).select("lf", "tokens", "nodes", "balanced")


def template_nodes(templates: DataFrame) -> DataFrame:
    """One row per node: (template_id, node_id, parent_id, arg_pos, depth, func, leaf)."""
    return add_nodes(templates).select("template_id", F.explode("nodes").alias("n")).select("template_id", "n.*")


def canonical(tokens: Column) -> Column:
    """``func { a ; b }`` with single spaces."""
    return F.array_join(tokens, " ")


def placeholders(tokens: Column, header: Column, columns: bool = False) -> Column:
    """Text with values replaced by X and, for the skeleton, column names by Y."""
    name = F.lit("Y") if columns else None
    replaced = F.transform(tokens, lambda t, i: (
        F.when(_is_mark(t) | F.get(tokens, i + 1).eqNullSafe(F.lit("{")) | (t == "all_rows"), t)
        .when(F.array_contains(header, t), t if name is None else name)
        .otherwise("X")))
    return F.array_join(replaced, " ")


def check(templates: DataFrame, headers: DataFrame) -> DataFrame:
    """Adds ``syntax_ok``: balanced, known functions and words, types that fit, the right number of
    arguments and at most one hole each. headers (table_id, types MAP<column, type>).

    A text is checked once against each set of columns and types that its tables have."""
    known = F.create_map(*[x for f, n in ARITY.items() for x in (F.lit(f), F.lit(n))])
    typed = F.create_map(*[x for f, ts in TYPES.items() for x in (F.lit(f), F.array(*[F.lit(t) for t in ts]))])
    kind = F.md5(F.to_json(F.array_sort(F.map_entries("types"))))
    heads = headers.select("table_id", kind.alias("__kind"), "types")
    given = templates.join(heads.drop("types"), "table_id")
    kinds = heads.groupBy("__kind").agg(F.first(F.map_entries("types")).alias("types")).withColumn("types", F.map_from_entries("types"))
    rows = add_nodes(given.select("lf", "__kind").distinct()).join(kinds, "__kind")
    nodes = F.col("nodes")
    parent = lambda x: F.get(F.filter(nodes, lambda y: y["node_id"] == x["parent_id"]), F.lit(0))
    leaf_ok = lambda x: F.when(x["leaf"].isin("all_rows", "X"), F.lit(True)).otherwise(
        F.map_contains_key("types", x["leaf"]) & _type_fits(typed, F.try_element_at("types", x["leaf"]), parent(x), parent))

    def func_ok(x: Column) -> Column:
        args = F.filter(nodes, lambda y: y["parent_id"] == x["node_id"])
        holes = F.size(F.filter(args, lambda y: y["leaf"].eqNullSafe(F.lit("X"))))
        needed = F.try_element_at(known, x["func"]) + F.when((x["func"] == "eq") & (holes == 0), 1).otherwise(0)
        return F.coalesce((F.size(args) - holes == needed) & (holes <= 1), F.lit(False))

    ok = F.col("balanced") & F.forall(nodes, lambda x: F.when(x["func"].isNotNull(), func_ok(x)).otherwise(F.coalesce(leaf_ok(x), F.lit(False))))
    return given.join(rows.withColumn("syntax_ok", ok).drop("types"), ["lf", "__kind"]).drop("__kind")


def _type_fits(typed: Column, coltype: Column, node: Column, parent) -> Column:
    """A column fits the types of its function; below ``hop`` those of the function above it."""
    func = F.when(node["func"] == "hop", parent(node)["func"]).otherwise(node["func"])
    allowed = F.try_element_at(typed, func)
    return func.isNotNull() & (allowed.isNull() | F.array_contains(allowed, coltype))
