"""Conversation repair against brute force."""

import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from corpusloom.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, state string, at int, segment string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def brute_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(key.encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def brute(original, damaged):
    """One row for each conversation, by a backward program over whole strings."""
    found = []
    for conv in {r[0] for r in original}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        rows, faults, seen = [r[2:] for r in own], [], set()
        for role, text in rows:
            last = SOLID.findall(text)[-1:]
            faults.append("b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else "")
            seen.add((role, text))

        @functools.cache
        def best(i, q, ins=0):
            options = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
            role = "assistant" if q == 2 else "user"
            to = 3 if q == 2 else 2
            if ins < 4:
                c, a, t = best(i, to, ins + 1)
                options.append((c + 5, "I" + a, ((role, ""), *t)))
            if i < len(rows):
                c, a, t = best(i + 1, q)
                options.append((c + 2, "D" + a, t))
                if faults[i] not in ("b", "d"):
                    more = 5 * (faults[i] == "t")
                    if (q, rows[i][0][:1]) in STEP:
                        c, a, t = best(i + 1, STEP[q, rows[i][0][:1]])
                        options.append((c + more, "K" + a, (rows[i], *t)))
                    c, a, t = best(i + 1, to)
                    options.append((c + more + 1, "R" + a, ((role, rows[i][1]), *t)))
            return min(options, default=(10**9, "", ()))

        cost, audit, after = best(0, 0) if rows else (0, "", ())
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[0][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in after).encode()).hexdigest()
        found.append((conv, gaps, *map(faults.count, "bdt"), illegal, cost, audit, digest))
    return sorted(map(repr, found))


def check(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op12_conversation_repair(spark, str(tmp_path))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, brute_damage(rows))


def made(rng, conversations, most):
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "unknown", None])
            text = rng.choice(["Yes.", "No", "Why?", "", " \n", None, f"Word {t}.", f"word {t}", "Yes.", "fin!\t ", "ü."])
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, t + 3, 0]), role, text, "x", 1, "s"))
    rng.shuffle(rows)
    return rows


def test_repairs_equal_brute_force(spark, tmp_path):
    rows = made(random.Random(1), 250, 9)
    rows += rows[:30] + [(None, 0, "user", "Hi.", None, None, None), (None, None, None, None, None, None, None), (5000, 2, "user", "x" * 60_000 + ".", None, None, None)]
    check(spark, tmp_path, rows)


def test_long_conversations_in_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 3)
    check(spark, tmp_path, made(random.Random(2), 40, 40))
    same = [(1, t, "user", "Same.", None, None, None) for t in range(60)] + [(2, t, "user", f"Other {t}.", None, None, None) for t in range(80)]
    check(spark, tmp_path, same)


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, [])


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Why?"), (1, 4, "user", "Because.")]
    found, after = repair.repair_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    first = found.collect()[0]
    assert (first.audit, first.cost, first.duplicate, first.illegal) == ("RKDKR", 4, 1, 3)
    roles = [r.role for r in after.orderBy("at", "part").collect()]
    assert re.fullmatch("s?(ua)+", "".join(r[0] for r in roles))


@pytest.mark.parametrize("seed", range(5))
def test_ties_and_collisions(seed, monkeypatch):
    """The order of audits by longest common prefixes is that of their letters, with hashes that collide all the time, too."""
    if seed % 2:
        monkeypatch.setattr(repair, "_P", 2)
    rng = random.Random(seed)
    made_ = {"": repair.Node()}
    for _ in range(400):
        text = rng.choice(list(made_))
        for letter in rng.sample("DIKR", 2):
            made_.setdefault(text + letter, repair.Node(made_[text], letter))
    for _ in range(3000):
        a, b = rng.choice(list(made_)), rng.choice(list(made_))
        assert repair.less(made_[a], made_[b]) == (a < b)
    assert all("".join(n.pieces()) == t for t, n in made_.items())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force_on_given_rows(spark, folder):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet'").fetchall()
    got = repair.op12_conversation_repair(spark, folder)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, brute_damage(rows))
