"""Course intake by hand and against plain second versions."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import intake

MERGED = """Systemes de Recommandation
Semaine 1 : Fondements des Systèmes de Recommandation Pr. Teacher
Plan de la séance
1.Le probleme de la surcharge informationnelle :Pourquoi avons-nous besoin de recommandations?
2.Definition et objectifs d'un systeme de recommandation

Body for week one.
Semaine 1 : Fondements des Systèmes de Recommandation
Week two - Voisins et
Modeles latents 3/40
Vector Spaces And Bases
plain words that are no title at all here
Lecture IV: Fondements des Systemes de Recommandation
Chapter 60: too large
Module 5
Guide for Students
References
Chapter 7: after the guide
"""


def test_units_of_a_merged_course(spark):
    docs = spark.createDataFrame([(1, "rs_course.pdf", MERGED), (2, "a/student guide.v2.md", "no units\nhere"), (3, "x.md", "no units"), (4, None, ""), (5, "y.md", None)], "doc_id bigint, filename string, text string")
    lines = intake.lines_of(docs)
    units = intake.course_units(lines)
    got = {d: [(r.number, r.title, r.role, r.first_line, r.end_line) for r in sorted(units.collect(), key=lambda r: (r.doc_id, r.unit)) if r.doc_id == d] for d in range(1, 6)}
    assert got[1] == [
        (1, "Semaine 1 : Fondements des Systèmes de Recommandation", "primary", 1, 8), (2, "Week two - Voisins et Modeles latents", "primary", 8, 12),
        (4, "Lecture IV: Fondements des Systemes de Recommandation", "primary", 12, 14), (5, "Module 5", "primary", 14, 15),
        (None, "Guide for Students", "supplemental", 15, 17), (7, "Chapter 7: after the guide", "primary", 17, 19),
    ]
    assert [x[0] for x in got[1]] == [1, 2, 4, 5, None, 7]
    assert got[2] == [(None, "student guide.v2", "supplemental", 0, 2)] and got[3] == got[4] == got[5] == []
    parts = {(r.doc_id, r.unit, r.part): r.title for r in intake.subchapters(units, lines).collect()}
    assert [parts[1, 0, k] for k in range(2)] == ["Le probleme de la surcharge informationnelle", "Definition et objectifs d'un systeme de recommandation"]
    assert parts[1, 1, 0] == "Vector Spaces And Bases" and parts[1, 3, 0] == "Module 5" and (1, 4, 1) not in parts
    text = [r.line for r in sorted(intake.rendered(lines, units, intake.subchapters(units, lines)).where("doc_id = 1").collect(), key=lambda r: (r.unit, r.step, r.at))]
    assert text[:7] == ["# rs course", "", "## Semaine 1 : Fondements des Systèmes de Recommandation", "", "### Le probleme de la surcharge informationnelle", "Source plan item: Le probleme de la surcharge informationnelle", ""]
    assert [x for x in MERGED.split("\n")[1:] if x] == [x for x in text if x in MERGED.split("\n") and x]


def test_repeated_title_slides_give_one_unit(spark):
    text = "Semaine 1 : Foundations\nPlan de la seance\n1. Intro\nSemaine 1 : Foundations\nfooter\nSemaine 2 : Retrieval\nPlan\n1. Search"
    units = intake.course_units(intake.lines_of(spark.createDataFrame([(1, "c.pdf", text)], "doc_id bigint, filename string, text string")))
    assert sorted((r.number, r.first_line, r.end_line) for r in units.collect()) == [(1, 0, 5), (2, 5, 8)]


def test_spans_meet_by_bins(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(d, a) for d in range(3) for a in range(2000)]
    spans = [(d, s, s + rng.randrange(0, 900)) for d in range(4) for s in rng.sample(range(1900), 6)]
    got = intake.inside(spark.createDataFrame(rows, "d int, at int"), spark.createDataFrame(spans, "d int, s int, e int"), "d", "at", "s", "e")
    assert sorted(map(tuple, got.select("d", "at", "s", "e").collect())) == sorted((d, a, s, e) for d, a in rows for k, s, e in spans if k == d and s <= a < e)


def plain_pools(chunks):
    out = {}
    for scope in {c[0] for c in chunks}:
        own = [c for c in chunks if c[0] == scope]
        key = lambda t: "".join(ch for ch in (t or "").lower() if ch.isalnum())
        for chapter in {key(c[4]) for c in own if c[5] == "primary"} - {""}:
            primary = [c for c in own if c[5] == "primary" and key(c[4]) == chapter]
            window = []
            for doc in {c[1] for c in primary}:
                first = min((c for c in primary if c[1] == doc), key=lambda c: c[2])
                ends = [c[2] for c in own if c[1] == doc and c[5] == "primary" and key(c[4]) and c[2] > first[2] and key(c[4]) != chapter and not (first[3] and c[3] and c[3] <= first[3])]
                window += [c for c in own if c[1] == doc and c[2] >= first[2] and (not ends or c[2] < min(ends)) and (not c[4] or key(c[4]) == chapter)]
            for origin, found in (("supplemental", [c for c in own if c[5] == "supplemental"]), ("window", window), ("primary", primary)):
                for c in found:
                    out[scope, chapter, c[1], c[2]] = origin
    return out


def test_pools_equal_the_plain_version(spark):
    rng = random.Random(2)
    chunks = []
    for scope in range(4):
        for doc in range(3):
            for at in range(60):
                role = rng.choice([None, None, None, "primary", "supplemental"])
                unit = rng.randrange(1, 6)
                chunks.append((scope, scope * 10 + doc, at, unit if role == "primary" else None, f"Unit {unit}" if role == "primary" else None, role))
    got = intake.unit_pools(spark.createDataFrame(chunks, "scope bigint, doc_id bigint, at bigint, unit int, title string, role string")).collect()
    assert {(r.scope, r.chapter, r.doc_id, r.at): r.origin for r in got} == plain_pools(chunks) and len(got) == len(plain_pools(chunks))


def test_boundaries_are_looked_for_by_their_rarest_pattern_first(spark):
    """Few lines begin as a supplement does; only those are asked for a unit's number, and no line is compacted before it meets a title that goes on."""
    lines = spark.createDataFrame([(1, "a.md", 0, "Chapter 1: Sums of"), (1, "a.md", 1, "  long   things "), (1, "a.md", 2, "Guide for all"), (1, "a.md", 3, None)], "doc_id int, filename string, at int, line string")
    units = intake.course_units(lines)
    assert [(r.number, r.title, r.first_line, r.end_line) for r in units.orderBy("unit").collect()] == [(1, "Chapter 1: Sums of long things", 0, 2), (None, "Guide for all", 2, 4)]
    asked = [x for x in units._jdf.queryExecution().optimizedPlan().toString().split("\n") if "semaine" in x and "^(guide" in x and "Filter" in x]
    assert asked and all(x.index("^(guide") < x.index("semaine") for x in asked)


def test_units_go_on_over_batches_and_lines_are_not_gathered(spark):
    rng = random.Random(9)
    words = "Agenda Outline 1. 2) 12 Sums of Things and Professor page 4 WEEK Sémaine Große Wörter problem x²".split()
    lines = [(d, at, None if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randint(1, 7)))) for d in range(5) for at in range(400)]
    units = [(d, u, "primary" if u % 2 else "supplemental", f"Unit {u}", u * 40, (u + 1) * 40 if u < 3 else 400) for d in range(5) for u in range(4)]
    spans = spark.createDataFrame(units, "doc_id int, unit int, role string, title string, first_line int, end_line int")
    found = intake.subchapters(spans, spark.createDataFrame(lines, "doc_id int, at int, line string"))
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    try:
        spark.conf.set(key, "7")
        got = sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.set(key, held)
    text, want = {(d, at): line for d, at, line in lines}, []
    for d, u, role, title, low, high in units:
        parts = intake.parts_of([text[d, at] for at in range(low, min(high, low + intake.LOOK_AHEAD))]) or [title] * (role == "primary")
        want += [(d, u, k, t) for k, t in enumerate(parts)]
    assert got == sorted(want) and len(want) > 20
    assert intake.subchapters(spans.limit(0), spark.createDataFrame(lines[:3], "doc_id int, at int, line string")).count() == 0


def test_lines_that_name_units_in_any_letters(spark):
    names = ["WEEK 3: Sums of all", "Sémaine 4 : Les sommes", "Unité 5 - Les unités", "lECTURE IV. More sums", "Ｗeek 9: Other letters", "a weekly 3 note", None, "Module two  Graphs"]
    lines = spark.createDataFrame([(1, "a.md", i, x) for i, x in enumerate(names)], "doc_id int, filename string, at int, line string")
    numbered = {r.at: r.n for r in lines.select("at", intake._number(intake.compact(F.col("line"))).alias("n")).where("n IS NOT NULL").collect()}
    assert numbered == {r.at: r.n for r in lines.where(intake.may_hold(F.col("line"), intake.UNIT_WORDS)).select("at", intake._number(intake.compact(F.col("line"))).alias("n")).where("n IS NOT NULL").collect()}
    assert {0, 1, 2, 7} <= set(numbered)
    bounds = spark.createDataFrame([("  Guide for all", "a"), ("the guide", "a"), ("ＡＮＮＥＸ", "a"), ("Références", None), ("GUIDE", None), ("see the guide", "Appendix.md")], "line string, filename string")
    assert [r[0] for r in bounds.select(intake.may_bound(F.col("line"), F.col("filename"))).collect()] == [True, False, True, True, True, True]
