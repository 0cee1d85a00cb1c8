"""Routes and contexts of requests by hand; the query is held to SQL with all others."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dispatch as D
from corpusloom.plans import dispatch, registry  # noqa: F401


@pytest.mark.parametrize(
    ("output", "topic", "message", "want"),
    [("quiz", "t", "m", "full"), ("mindmap", None, None, "full"), ("podcast", " ", "tell me", "sample"), ("podcast", "cells", None, "fused"), ("report", None, "", "sample"),
     ("report", None, "cells", "fused"), ("text", None, "Can you summarize this course?", "sample"), ("chart", None, "", "fused"), ("other", None, "x", "fused")],
)
def test_routes(spark, output, topic, message, want):
    d = spark.createDataFrame([(output, topic, message)], "o string, t string, m string")
    assert d.select(D.route(F.col("o"), F.col("t"), F.col("m")).alias("r")).first().r == want


def test_contexts(spark):
    chunks = [(1, 10 + k, k, k // 3, k == 4) for k in range(6)] + [(2, 20, 0, 0, True), (2, 21, 1, 0, True)]
    c = spark.createDataFrame(chunks, "scope bigint, chunk_id bigint, at bigint, section bigint, low boolean")
    asked = [(1, 1, "quiz", None, None), (2, 1, "podcast", None, None), (3, 1, "text", "x", None), (4, 2, "text", "y", None), (5, 9, "quiz", None, None), (None, 1, "quiz", None, None), (7, None, "quiz", None, None), (8, 1, None, None, None)]
    r = D.dispatched(spark.createDataFrame(asked, "request_id bigint, scope bigint, output_type string, topic string, message string"))
    ranked = lambda *rows: spark.createDataFrame([*rows], "request_id bigint, chunk_id bigint, rank int")
    got = D.contexts(r, c, [ranked((3, 11, 1), (3, 15, 2)), ranked((3, 11, 1), (1, 14, 1))], ranked((1, 12, 1), (3, 13, 1), (3, 12, 2)), 8, 2, 1).orderBy("request_id", "pos").collect()
    of = lambda k: [(x.chunk_id, x.origin) for x in got if x.request_id == k]
    assert of(1) == [(k, "full") for k in range(10, 16)]
    assert of(2) == [(10, "sample"), (13, "sample")]
    assert of(3) == [(13, "graph"), (11, "list"), (15, "list"), (10, "neighbour"), (12, "neighbour")]
    assert of(4) == [(20, "sample"), (21, "sample")]  # no list answers, and all chunks say nothing
    assert {x.request_id for x in got} == {1, 2, 3, 4}


def test_every_origin_occurs():
    duckdb.sql("CREATE OR REPLACE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    found = duckdb.sql(f"SELECT DISTINCT route || ' ' || origin FROM ({registry.SQL['output_contexts']})").fetchall()
    assert {x for (x,) in found} >= {"full full", "sample sample", "fused sample", "fused graph", "fused list", "fused neighbour"}
