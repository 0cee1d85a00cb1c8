"""Hard negatives against brute force and the query's SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import negatives

SCHEMA = "id bigint, label int, v array<bigint>, mark string, slot int"


def brute(rows, positives=5, k=10):
    """Rows (id, label, v); repeated rows and a null id as the operator defines them."""
    sound = {(i, c, tuple(v)) for i, c, v, *_ in rows if c is not None and v is not None and None not in v}
    out = []
    for a, label, v in (r for r in sound if r[0] is not None and r[0] % 10 == 0):
        met = {(-sum(x * y for x, y in zip(v, w)), i is None, i, c == label) for i, c, w in sound if i != a and len(w) == len(v)}
        order = sorted(met, key=lambda r: (r[0], r[1], r[2] or 0))
        for s, _, p, _ in [r for r in order if r[3]][:positives]:
            fit = list(dict.fromkeys(r[:3] for r in order if not r[3] and 30 * -s <= 100 * -r[0] <= 90 * -s))[:k]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, _, i) in enumerate(fit)]
    return sorted(map(repr, out))


def check(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    assert sorted(repr(tuple(r)) for r in negatives.hard_negatives(d, F.col("id") % 10 == 0).collect()) == brute(rows)


def made(rng, n, dim=6, most=5):
    return [(i, rng.randrange(3), [rng.randint(-most, most) for _ in range(dim)], "m", 1) for i in range(n)]


def test_negatives_equal_brute_force(spark):
    rng = random.Random(4)
    rows = made(rng, 300)
    rows += rows[:20]  # repeated
    rows += [(i, 2, [1] * 6, None, None) for i in range(1000, 1090)]  # ties, and one label with a large share
    rows += [(None, 1, [3] * 6, None, None), (7, None, [1] * 6, None, None), (8, 1, None, None, None), (9, 1, [1, None, 1, 1, 1, 1], None, None)]
    rows += [(2000, 0, [1, 2], None, None), (2001, 0, [2, 1], None, None), (2002, 1, [1, 1], None, None), (2010, 1, [], None, None), (30, 1, [2] * 6, None, None)]
    check(spark, rows)


def test_small_blocks_in_cells(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 7)
    monkeypatch.setattr(negatives, "BROADCAST_BYTES", 500)
    check(spark, made(random.Random(5), 200))


def test_empty_and_alone(spark):
    check(spark, [])
    check(spark, [(10, 1, [1, 2], None, None)])
    check(spark, [(10, 1, [1, 2], None, None), (11, 1, [-1, -2], None, None), (12, 2, [0, 0], None, None), (13, 1, [0, 0], None, None)])


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 29, 1 << 40):
        a, b = (rng.integers(-top, top, (4, 5)) for _ in "ab")
        want = [[max(min(sum(int(x) * int(y) for x, y in zip(r, s)), 2**63 - 1), -(2**63) + 1) for s in b] for r in a]
        assert negatives.scores(a, b).tolist() == want


def test_vectors_become_whole_numbers(spark):
    rows = [([0.5, -0.001, 1.0],), ([float("nan")],), ([float("inf"), 1.0],), ([None, 1.0],), (None,), ([],)]
    got = spark.createDataFrame(rows, "e array<float>").select(negatives.whole_numbers(F.col("e")).alias("v")).collect()
    assert [r.v for r in got] == [[128, -1, 256], None, None, None, None, []]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, folder):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = duckdb.sql(negatives.SQL["op11_hard_negatives"])
    got = negatives.op11_hard_negatives(spark, folder)
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
