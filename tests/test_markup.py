"""Hand-made cases of markup, and its time on long texts without ends."""

import html
import time

from pyspark.sql import functions as F

from corpusloom.operators import markup as M


def one(spark, f, *texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.x for r in d.select("i", f(F.col("text")).alias("x")).orderBy("i").collect()]


def test_tables_become_markdown(spark):
    ragged = "a<table><tr><td>1</td><td>x<br>y</td></tr><tr></tr><tr><td>p|q</td></tr></table>b"
    headed = "<TABLE class='t'>\n<thead><tr><th> A </th><TH><b>B</b></th></tr></thead><tr><td>1</td><td>&lt;2&gt;</td></tr></TABLE>"
    partly = "<table><tr><th>A</th><td>1</td></tr></table>"
    assert one(spark, M.normalised_markup, ragged, headed, partly) == [
        "a\n\n| Column 1 | Column 2 |\n| --- | --- |\n| 1 | x y |\n| p\\|q |  |\n\nb",
        "| A | B |\n| --- | --- |\n| 1 | <2> |",
        "| Column 1 | Column 2 |\n| --- | --- |\n| A | 1 |",
    ]


def test_page_marks_and_ends(spark):
    texts = ("x<page_header lang='en'>\nHead\n</ page_header >y", "x<page_break/>text<page_number>3</page_number>y", "x</page_footer>y<table>z", "<table></table>", "", None, "\r\na\r\rb ")
    assert one(spark, M.normalised_markup, *texts) == ["x\ny", "x\ntext\ny", "x</page_footer>y<table>z", "", "", None, "a\n\nb"]


def test_references_as_the_standard_library_has_them(spark):
    texts = ("&amp;&lt;&eacute;&nbsp;&hellip;", "&#65;&#x1F600;&#xe9;", "&unknown; & a && b &", "&amp;amp;", "plain", "&NotEqualTilde;", "&#0;&#xD800;")
    assert one(spark, M.unescaped, *texts) == [html.unescape(t) for t in texts]


def test_prose_and_tables(spark):
    text = "Before\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |\nAfter\n| no | table |\nEnd\n<table><tr><th>h</th><th>k</th></tr><tr><td>x</td><td>y|z</td></tr></table>"
    assert one(spark, M.prose_text, text, None, "", "| a | b |\n| --- | --- |") == ["Before\nAfter\n| no | table |\nEnd", None, "", ""]
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "| a | b |\n| --- | --- |")], "doc_id int, text string")
    got = [(r.doc_id, r.table, r.headers, r.rows) for r in M.markup_tables(d).orderBy("doc_id", "table").collect()]
    assert got == [(1, 0, ["a", "b"], [["1", "2"], ["3", ""]]), (1, 1, ["h", "k"], [["x", "y|z"]])]


def test_cleaner_keeps_table_lines(spark):
    text = "Title ()\n\n\ntitle\n| 12 / 40 | . . . . . . |\n|  |\nlogo\nlogo of it\nThe end.\nthe  end.\n\nMore | \n"
    assert one(spark, M.source_text, text, None, "") == ["Title\n\n| 12 / 40 | . . . . . . |\n|  |\n\nThe end.\n\nMore", None, ""]


def test_time_follows_length(spark):
    n = 60_000
    texts = ("<table>" * n, "<table><tr>" + "<td>a" * n + "</tr></table>", "<page_header>" * n, "&amp" * n, "</table>" * n)
    start = time.time()
    got = one(spark, F.length, *texts) and one(spark, lambda c: F.length(M.normalised_markup(c)), *texts)
    assert got == [7 * n, 0, 13 * n, 4 * n, 8 * n] and time.time() - start < 60
