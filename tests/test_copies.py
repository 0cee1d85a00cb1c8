"""Operators on pairs where many rows are alike: each wording is compared once, and frequent words make no pairs."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.operators import build, outline, retrieval

QUERIES = entry.queries()


def test_overlap_of_many_copies(spark):
    words = "red ring big plate old bolt".split()
    text = lambda k: F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, words)), ((F.col("id") * 7 + i * i) % k % 6 + 1).cast("int")) for i in range(3)])
    d, q = spark.range(60).select(F.col("id").alias("doc_id"), text(11).alias("text")), spark.range(40).select(F.col("id").alias("query_id"), text(5).alias("text"))
    want = retrieval.top_k(retrieval.overlap_scores(retrieval.postings(d), q), 7).select("query_id", "doc_id", "score", "rank")
    assert sorted(retrieval.overlap_top(d, q, 7).collect()) == sorted(want.collect()) != []
    many = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("red ring of steel").alias("text"))
    start = time.time()
    asked = spark.range(20_000).select(F.col("id").alias("query_id"), F.lit("a red ring").alias("text"))
    assert retrieval.overlap_top(many, asked, 3).agg(F.count(F.lit(1)), F.max("doc_id")).first() == (60_000, 2) and time.time() - start < 60


def test_best_match_of_many_copies(spark):
    d = spark.range(100_000).select("id", F.array(F.lit("x"), F.lit("y"), (F.col("id") % 3).cast("string")).alias("words"))
    start = time.time()
    got = outline.best_match(d.withColumnRenamed("id", "item"), d.where("id >= 10").withColumnRenamed("id", "target"))
    assert {tuple(r) for r in got.groupBy((F.col("item") % 3).alias("k"), "target", "overlap").count().collect()} == {(0, 12, 3, 33334), (1, 10, 3, 33333), (2, 11, 3, 33333)}
    assert time.time() - start < 60


def test_similar_titles_with_a_frequent_word(spark):
    rng = random.Random(5)
    rows = [(i % 2, i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 6)))) for i in range(120)] + [(0, 500, None), (None, 501, "a b")]
    sets = {i: (k, set(t.split()) or {""}) for k, i, t in rows if t is not None and k is not None}
    for least in (0.5, 0.75, 1.0):
        want = {(x, y) for x in sets for y in sets if x < y and sets[x][0] == sets[y][0] and len(sets[x][1] & sets[y][1]) >= least * max(len(sets[x][1]), len(sets[y][1]))}
        got = [(r.a, r.b) for r in build.similar_titles(spark.createDataFrame(rows, "scope int, k int, title string"), "scope", "k", "title", least).collect()]
        assert sorted(got) == sorted(want)
    wide = spark.range(30_000).select(F.lit(1).alias("scope"), F.col("id").alias("k"), F.concat_ws(" ", F.lit("the"), *[F.concat(F.lit(x), "id") for x in "abc"]).alias("title"))
    start = time.time()
    assert build.similar_titles(wide, "scope", "k", "title").count() == 0 and time.time() - start < 60


def test_blocks_of_texts_and_queries(spark, monkeypatch):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choices("red ring big plate old bolt ünï x1 a b c".split(), k=rng.randint(0, n)))
    d = spark.createDataFrame([(i * 3 - 90, text(40)) for i in range(150)] + [(1000, None), (None, "red ring")], "doc_id bigint, text string")
    q = spark.createDataFrame([(i, text(6)) for i in range(90)] + [(200, None), (201, "other words")], "query_id bigint, text string")
    monkeypatch.setattr(retrieval, "TEXT_BLOCK", 16)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", 40)
    want = retrieval.top_k(retrieval.overlap_scores(retrieval.postings(d.where("doc_id IS NOT NULL")), q), 5).select("query_id", "doc_id", "score", "rank")
    for held in (1 << 20, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", held)
        assert sorted(retrieval.overlap_top(d, q, 5).collect()) == sorted(want.collect()) != []
    assert retrieval.overlap_top(d.limit(0), q, 5).count() == retrieval.overlap_top(d, q.limit(0), 5).count() == 0
    x = [0.0000005, 1 / 128, 0.1234565, 2 / 3]
    assert retrieval._millionths(np.array(x)).tolist() == [1, 7813, 123457, 666667]


def test_every_comparison_is_answered(spark):
    folder = "/root/testdata/sf0.001"
    asked = {r.id for r in QUERIES["comparison_terms"](spark, folder).collect()}
    assert {r.query_id for r in QUERIES["comparison_retrieval"](spark, folder).collect()} == asked and any(i % 20 for i in asked)


def test_similar_titles_send_nothing_through_the_driver(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i % 2, i % 150, " ".join(rng.choices("abcd", k=rng.randint(0, 4)))) for i in range(180)]
    sets = [(k, i, set(t.split()) or {""}) for k, i, t in rows]
    want = sorted((k, x, y) for k, x, v in sets for m, y, w in sets if k == m and x < y and len(v & w) >= 0.75 * max(len(v), len(w)))
    monkeypatch.setattr(build, "MEMBERS", 3, raising=False)
    got = build.similar_titles(spark.createDataFrame(rows, "scope int, k int, title string"), "scope", "k", "title")
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    few = spark.read.parquet("/root/testdata/sf0.001/part.parquet")  # a small file, whose rows the planner would send
    assert "Broadcast" not in build.similar_titles(few, "p_brand", "p_partkey", "p_name")._jdf.queryExecution().executedPlan().toString()
