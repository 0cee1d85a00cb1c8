"""Every query with SQL against DuckDB on the smallest tables, and hand-made cases of the operators."""

import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import acronym, sentences, tokens
from corpusloom.operators import learning, ordering, retrieval
from corpusloom.plans import (  # noqa: F401
    allocate, architecture, build, concepts, course, dispatch, generate, intake, learn, maps, markup, player, registry, retrieve, scalars, segment, sinks, streams, study,
)
from corpusloom.streaming.mastery import fold_assessments_stream

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, (tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_rank_fusion_by_hand(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, doc_id string, rank int")
    got = {r.doc_id: r.score for r in retrieval.reciprocal_rank_fusion(a, b).collect()}
    assert got == {"x": round(1 / 61, 9), "y": round(1 / 62 + 1 / 61, 9), "z": round(1 / 62, 9)}


def test_ranking_metrics_by_hand(spark):
    ranking = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(["c2", "c9", "c5", "c1"])], "case_id int, doc_id string, rank int")
    gold = spark.createDataFrame([(1, "c2"), (1, "c5")], "case_id int, doc_id string")
    got = retrieval.ranking_metrics(ranking, gold, (1, 3)).first()
    assert (got.hit_rate_1, got.precision_3, got.recall_3, got.mrr_3) == (1.0, round(2 / 3, 6), 1.0, 1.0)
    assert got.ndcg_3 == round(1.5 / (1 + 1 / math.log2(3)), 6)


def test_folds_by_hand(spark):
    chat = spark.createDataFrame([(1, "a", i, op) for i, op in enumerate(["demonstrated"] * 3 + ["struggled"])], "learner int, concept string, seq int, op string")
    assert learning.fold_chat(chat).first().mastery == pytest.approx(0.3416)
    exam = spark.createDataFrame([(1, "a", i, s, i == 0) for i, s in enumerate([0.9, 0.7, 0.1])], "learner int, concept string, seq int, score double, applied boolean")
    assert learning.fold_assessments(exam.where("seq < 2")).first().mastery == pytest.approx(0.325)
    assert learning.fold_assessments(exam).first().mastery == pytest.approx(0.195)


def test_streaming_fold_equals_batch(spark, tmp_path):
    schema = "learner bigint, concept string, seq bigint, score double, applied boolean"
    events = [(1, "a", i, s, i % 2 == 0) for i, s in enumerate([0.9, 0.7, 0.1, 0.95, 0.3])]
    spark.createDataFrame(events[:3], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    spark.createDataFrame(events[3:], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = fold_assessments_stream(stream).writeStream.format("memory").queryName("folded").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = spark.table("folded").orderBy(F.col("n_events").desc()).first()
    want = learning.fold_assessments(spark.createDataFrame(events, schema)).first()
    assert got.n_events == 5 and got.mastery == pytest.approx(want.mastery)


def test_windows_and_picks_by_hand(spark):
    d = spark.createDataFrame([(1, i) for i in range(23)], "k int, i int")
    got = ordering.count_windows(d, "k", "i").collect()
    assert [(r.window, r.n, r.pending) for r in sorted(got)] == [(0, 10, 3), (1, 10, 3)]
    picked = ordering.spread_pick(d.where("i < 10"), "k", "i", 4).collect()
    assert sorted(r.i for r in picked) == [0, 3, 6, 9]
    t = spark.createDataFrame([(1, 8)], "k int, total int")
    shares = ordering.largest_remainder(t, "k", "total", {"struggling": 0.6, "review": 0.3, "stretch": 0.1})
    assert {r.slot: r.n for r in shares.collect()} == {"struggling": 5, "review": 2, "stretch": 1}


def test_equal_fractions_of_different_shares(spark):
    t = spark.range(1, 3000).selectExpr("id AS k", "id AS total")
    got = ordering.largest_remainder(t, "k", "total", {"struggling": 0.6, "review": 0.3, "stretch": 0.1}).collect()

    def want(n):
        parts = [(n * s // 10, -(n * s % 10), i) for i, s in enumerate((6, 3, 1))]
        extra = {i for _, _, i in sorted(parts, key=lambda p: p[1:])[: n - sum(p[0] for p in parts)]}
        return {name: low + (i in extra) for name, (low, _, i) in zip(("struggling", "review", "stretch"), parts)}

    by_key = {}
    for r in got:
        by_key.setdefault(r.k, {})[r.slot] = r.n
    assert by_key == {n: want(n) for n in range(1, 3000)}


def test_jobs_near_the_bound(spark, tmp_path):
    """599 to 601 seconds before the last one, in steps of some microseconds."""
    at = pd.Timestamp("2024-01-31 12:00:00.250000")
    steps = [pd.Timedelta(microseconds=600_000_000 + x) for x in (-1_000_000, -250_001, -1, 0, 1, 249_999, 250_001, 749_999, 750_001, 1_000_000)]
    e = pd.DataFrame({"event_id": [4 * i for i in range(len(steps) + 1)], "ts": [at] + [at - x for x in steps]})
    e["ts"] = e["ts"].astype("datetime64[us]")
    os.mkdir(tmp_path / "events.parquet")
    e.to_parquet(tmp_path / "events.parquet" / "a.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(r[0] for r in c.execute(registry.SQL["interrupted_jobs"]).fetchall())
    got = sorted(r.event_id for r in registry.QUERIES["interrupted_jobs"](spark, str(tmp_path)).collect())
    assert got == want == [20, 24, 28, 32, 36, 40]


def test_text_functions(spark):
    d = spark.createDataFrame([("Élan vital, one_two! Then 3.5 more. End", "Singular Value Decomposition")], "t string, n string")
    r = d.select(tokens(F.col("t")).alias("t"), sentences(F.col("t")).alias("s"), acronym(F.col("n")).alias("a")).first()
    assert r.t[:3] == ["élan", "vital", "one_two"] and r.s == ["Élan vital, one_two!", "Then 3.5 more.", "End"] and r.a == "SVD"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame([], "query_id bigint, text string")
    assert retrieval.bm25(retrieval.postings(none), none, asked).count() == 0
    assert learning.fold_chat(spark.createDataFrame([], "learner int, concept string, seq int, op string")).count() == 0


def test_replies_grades_and_statements_by_hand(spark):
    said = [("I'm lost", True, 5), ("I'm lost", True, 0), ("can you rephrase", True, 0), ("so it is 4, right?", False, 0), ("ok", True, 0), (None, False, 0)]
    m = spark.createDataFrame(said, "text string, has_history boolean, turns_since_progress int")
    got = [(r.intent, r.mode) for r in study.S.reply_mode(m).collect()]
    assert got == [("confusion", "explain"), ("confusion", "guide"), ("clarification", "explain"), ("confirmation", "quiz_back"), ("follow_up", "explain"), ("new_question", "explain")]
    g = spark.createDataFrame(
        [("mcq", "2", "2"), ("mcq", "x", "2"), ("true_false", " YES", "true"), ("true_false", "perhaps", "true"), ("fill_blank", "The-Cell!", "the cell"), ("fill_blank", None, "a")],
        "kind string, answer string, expected string",
    )
    assert [r[0] for r in g.select(study.S.grade(F.col("kind"), F.col("answer"), F.col("expected"))).collect()] == [1, 0, 1, 0, 1, 0]
    long = "word " * 60
    d = spark.createDataFrame([(1, f"1.2 Cells divide in two equal parts. Do all cells divide this way too? cells divide in two equal parts. {long}"), (2, None), (3, "")], "doc_id int, text string")
    got = {(r.doc_id, r.pos): r.statement for r in study.S.statements(d).collect()}
    assert got[1, 0] == "Cells divide in two equal parts." and set(got) == {(1, 0), (1, 1)} and len(got[1, 1]) <= 180


def test_distractors_fall_back_outside_the_band(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "doc_id int, embedding array<double>")
    asked = v.where("doc_id = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    assert [(r.doc_id, r["rank"]) for r in study.S.distractors(v, asked, 2).orderBy("rank").collect()] == [(2, 1), (3, 2)]
