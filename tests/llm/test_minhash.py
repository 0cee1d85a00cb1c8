"""MinHash near-dedup against brute force."""

import random

import numpy as np
import pytest
from test_llm import SCHEMA, brute_components, docs, edge  # noqa: F401  fixtures

from corpusloom.llm import minhash


def check(frame, n, percent):
    got = sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame, n, percent).collect())))
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    of = brute_components([(k, t) for k, (_, t) in enumerate(rows)], n, percent)  # by rows, as ids may be null or stand twice
    least = {}
    for k, _, c in of:
        least[c] = min(least.get(c, float("inf")), float("inf") if rows[k][0] is None else rows[k][0])
    ids = {c: None if x == float("inf") else x for c, x in least.items()}
    assert got == sorted(repr((rows[k][0], s, ids[c], rows[k][0] == ids[c])) for k, s, c in of)


@pytest.mark.parametrize(("n", "percent"), [(2, 80), (5, 80)])
def test_components_equal_brute_force(spark, edge, docs, n, percent):  # noqa: F811
    check(edge, n, percent)
    check(docs, n, percent)


def test_chains_of_near_copies_in_one_bucket(spark):
    """Texts that differ from their neighbour only: the ends of a chain don't link, and buckets hold several components."""
    rng = random.Random(3)
    rows = []
    for g in range(6):
        words = [f"g{g}w{k}" for k in range(60)]
        for step in range(40):
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(60)] = f"g{g}s{step}x{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 80)


def test_pairs_at_the_threshold(spark):
    """90 of 110 to 110 of 130 shared pairs of words, on both sides of 0.8."""
    rows = []
    for k in range(200):
        shared = [f"k{k}w{j}" for j in range(9 + k % 3 * 4 + 1)]
        rows += [(2 * k, " ".join([*shared, f"k{k}y"])), (2 * k + 1, " ".join([f"k{k}z", *shared]))]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 80)


def test_empty_table_and_blocks(spark, monkeypatch):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 63, 1 + 40 * i, np.uint64)) for i in range(30)]
    want = np.array(list(minhash.signatures(sets)))
    monkeypatch.setattr(minhash, "BLOCK_GRAMS", 64)
    assert (np.array(list(minhash.signatures(sets))) == want).all()


def test_chance_of_a_miss():
    assert (1 - 0.8**minhash.ROWS) ** (minhash.HASHES / minhash.ROWS) < 1e-9
    below = sum(np.random.default_rng(5).binomial(minhash.HASHES, 0.8, 1_000_000) < minhash.least_equal(80))
    assert below == 0
