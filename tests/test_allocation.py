"""Allocation in rounds against taking turns one after the other, and placing against all pairs."""

import random

from corpusloom.operators import allocation as A


def turns(pairs, capacity):
    used, out = set(), set()
    for lesson in sorted({p[0] for p in pairs}):
        free = sorted(((-s, c, r) for x, c, s, r in pairs if x == lesson and (r or c not in used)))[:capacity]
        for rank, (_, chunk, reusable) in enumerate(free, 1):
            out.add((lesson, chunk, rank))
            if not reusable:
                used.add(chunk)
    return out


def test_rounds_equal_turns(spark):
    rng = random.Random(1)
    for capacity in (1, 3):
        reusable = {c: rng.random() < 0.2 for c in range(60)}
        pairs = [(x, c, rng.randrange(4), reusable[c]) for x in range(25) for c in rng.sample(range(60), 15)]
        pairs += [(100 + k, 200, 1, False) for k in range(300)]  # one chunk that all want
        rows = [*pairs, *pairs[:20], (None, 1, 1, False), (1, None, 1, False)]
        got = A.allocated(spark.createDataFrame(rows, "lesson bigint, chunk bigint, score bigint, reusable boolean"), capacity).collect()
        assert {(r.lesson, r.chunk, r.rank) for r in got} == turns(pairs, capacity) and len(got) == len(turns(pairs, capacity))


def test_every_chunk_is_placed(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    chunks = [(k, rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.sample(words, rng.randrange(0, 4))) for k in range(150)]
    lessons = [(x, rng.sample(words, 4)) for x in range(10)]
    given = [(rng.randrange(3, 10), k) for k in range(0, 150, 5)]
    got = A.placed_chunks(
        spark.createDataFrame(chunks, "chunk bigint, source string, root string, words array<string>"), spark.createDataFrame(lessons, "lesson bigint, words array<string>"),
        spark.createDataFrame(given, "lesson bigint, chunk bigint"),
    ).collect()
    facts = {c[0]: c for c in chunks}
    want = set()
    for k, source, root, own in chunks:
        if k % 5:
            def fit(x, w):
                has = [facts[c] for g, c in given if g == x]
                return 2 * len(set(own) & set(w)) + 0.25 * any(f[1] == source and source for f in has) + 0.5 * any(f[2] == root and root for f in has)  # noqa: B023
            best = max(lessons, key=lambda lw: (fit(*lw), -lw[0]))
            want.add((k, best[0], fit(*best)))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
