"""Hand-made cases of operators whose work must not grow with a group: near copies, distinct rows, trees with many children, long section lists."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import context, ordering, outline, structure


def test_near_copies(spark):
    rows = [("a", 1, ["x", "y", "z"]), ("a", 2, ["z", "y", "x", "x"]), ("a", 3, ["x", "q", "r"]), ("a", 4, ["q", "r", "x", "s"]), ("a", 5, []), ("a", 6, []), ("a", 7, None), ("b", 8, ["x", "y", "z"])]
    d = spark.createDataFrame(rows, "scope string, i int, w array<string>")
    assert sorted(r.i for r in context.without_near_copies(d, "scope", "i", "w").collect()) == [1, 3, 5, 6, 7, 8]
    assert context.without_near_copies(d.limit(0), "scope", "i", "w").count() == 0


def test_many_equal_rows_are_one_set(spark):
    d = spark.range(200_000).select(F.lit("a").alias("scope"), F.col("id").alias("i"), F.array(F.lit("x"), (F.col("id") % 3).cast("string")).alias("w"))
    assert sorted(r.i for r in context.without_near_copies(d, "scope", "i", "w", 0.6).collect()) == [0, 1, 2]


def test_distinct_in_order(spark):
    d = spark.createDataFrame([("a", 2, "X"), ("a", 1, " x"), ("a", 3, "y"), ("a", 4, ""), ("a", 5, None), ("b", 6, "x")], "scope string, i int, v string")
    assert sorted((r.scope, r.i) for r in ordering.distinct_in_order(d, "scope", "i", F.trim(F.lower("v"))).collect()) == [("a", 1), ("a", 3), ("b", 6)]


def test_trees_drop_what_hangs_on_surplus_children(spark):
    rows = [(1, i, [f"c{i}", "leaf"]) for i in range(9)] + [(1, 20, ["c8", "leaf", "deep"]), (1, 21, ["c0", "leaf", "deep"]), (2, 0, ["c8"])]
    got = {(r.doc_id, r.node) for r in outline.heading_tree(spark.createDataFrame(rows, "doc_id int, section int, path array<string>"), 7).collect()}
    assert got == {(1, f"c{i}") for i in range(7)} | {(1, f"c{i} > leaf") for i in range(7)} | {(1, "c0 > leaf > deep"), (2, "c8")}


def test_sections_of_long_texts(spark):
    text = "Before\n" + "".join(f"# Part {i}\n## Piece\nIt has words number {i}.\n\n" for i in range(1500)) + "# Empty"
    d = spark.createDataFrame([(1, "a_b.md", text), (2, "c.md", None), (3, "d_e.md", ""), (4, "d_e.md", "just this. and")], "doc_id int, filename string, text string")
    start = time.time()
    got = structure.sections(d).orderBy("doc_id", "section").collect()
    assert [(r.doc_id, r.section, r.path) for r in got[:2]] == [(1, 0, ["Part 0"]), (1, 1, ["Part 0", "Piece"])]
    assert (got[-2].section, got[-2].path, got[-2].text) == (1500, ["Part 1499", "Piece"], "It has words number 1499.") and (got[-1].doc_id, got[-1].path) == (4, ["d e"])
    assert len(got) == 1502 and time.time() - start < 30


def test_sections_are_worked_out_once(spark):
    """An explode that is no outer one asks for its array's size below it, where the whole split is worked out again."""
    d = spark.createDataFrame([(1, "a.md", "# A\nIt is so.")], "doc_id int, filename string, text string")
    plan = structure.sections(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "Filter (size(" not in plan and plan.count("#{1,6}") == structure.sections(d)._jdf.queryExecution().analyzed().toString().count("#{1,6}")


def test_sections_take_time_in_proportion(spark):
    """The split runs in tests over all lines of a batch, not in a column's functions line by line; odd lines give what the SQL's patterns do."""
    odd = "\r\n".join(["Before it", " 12 / 40 ", "## B ## ", "1.2.3 Deep part", "x is so.", "IV. Fourth", "Plain Title Here", "y|z", "March 3, 2020", "Ends here:", "# Été", "ok.", "NOT $x$"])
    rows = [(1, "a_b.c.md", odd), (2, None, "it is so."), (3, "x.md", "Only Title"), (None, "n.md", "# N\nit is.")]
    d = spark.createDataFrame(rows, "doc_id int, filename string, text string")
    got = sorted(structure.sections(d).collect(), key=lambda r: (r.doc_id or 9, r.section))
    want = [
        (1, 0, 2, "Deep part", ["Deep part"], "x is so."), (1, 1, 2, "Plain Title Here", ["Fourth", "Plain Title Here"], "y|z\nEnds here:"), (1, 2, 1, "Été", ["Été"], "ok.\nNOT $x$"),
        (2, 0, 1, None, [None], "it is so."), (None, 0, 1, "N", ["N"], "it is."),
    ]
    assert [tuple(r) for r in got] == want, got
    started = time.time()
    lines = ["# Part", "## Piece", "It has words, and 1 number.", "", "A line that says more of it."] * 200_000
    assert len(structure.split_texts(pa.array(["\n".join(lines)] + [None]), pa.array(["a", "b"]))[0]) == 200_000 and time.time() - started < 30
    plan = structure.sections(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_dependent_steps_work_sections_out_once(spark):
    s = structure.sections(spark.createDataFrame([(1, "a.md", "# A\nIt is $$x$$ so.\n# B\nAnd so on.")], "doc_id int, filename string, text string"))
    count = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    assert count(outline.fallback_outline(s)) == 1 and count(context.citations(s, F.contains("text", F.lit("$$")), "doc_id", "section")) == 1
    assert [tuple(r)[:3] for r in context.citations(s, F.contains("text", F.lit("$$")), "doc_id", "section").collect()] == [(1, 0, 1)]


def test_units_of_strings_are_those_of_columns(spark):
    texts = ["", "a b. C d! e", "One.\n\nTwo (x).  \"Three\"\n\n\n - a\n- b", "x | t\n y", "a\n$$ x $$\nb. C", "a\r- b\nc. D", "1. x\n1. y. Z", " \n\n\t"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in d.select("text", structure.units(F.col("text")).alias("u"), F.transform(structure.units(F.col("text")), structure.approx_tokens).alias("n")).collect():
        assert structure.units_of(r.text) == r.u and [structure.tokens_of(u) for u in r.u] == r.n
