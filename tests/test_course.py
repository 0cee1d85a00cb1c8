"""Structure, chunks, concepts, order of chapters and readers against hand-made cases and brute force."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import concept_key, term_counts
from corpusloom.operators import components, concepts, content, context, learning, outline, progress, retrieval, structure, study
from corpusloom.sources import tables

COURSE = """Before all.

# Week 1: Basics #
Intro text here. It goes on.

## 1.1 Limits
**Limit**: the value that a function nears.
12 / 40
$$ y = x $$ and $a_1 + b$.

| a | b |
|---|---|
| 1 | 2 |

March 3, 2021
In 2021 we met.

III. Outlook and more
Short Plain Title
Last words."""


def test_sections_by_hand(spark):
    d = spark.createDataFrame([(1, "my_file.md", COURSE), (2, "no_heading.md", "just some text, nothing else."), (3, "e.md", ""), (4, "n.md", None)], "doc_id bigint, filename string, text string")
    got = [(r.doc_id, r.section, r.level, r.title, list(r.path)) for r in structure.sections(d).orderBy("doc_id", "section").collect()]
    assert got == [
        (1, 0, 1, "Week 1: Basics", ["Week 1: Basics"]), (1, 1, 1, "Week 1: Basics", ["Week 1: Basics"]), (1, 2, 2, "1.1 Limits", ["Week 1: Basics", "1.1 Limits"]),
        (1, 3, 2, "Short Plain Title", ["Outlook and more", "Short Plain Title"]), (2, 0, 1, "no heading", ["no heading"]),
    ]
    s = structure.sections(d).where("doc_id = 1 AND section = 2")
    r = s.select(structure.equations(F.col("text")).alias("e"), structure.key_concepts(F.col("text")).alias("c"), structure.dated_lines(F.col("text")).alias("d")).first()
    assert (r.e, r.c, r.d) == (["$$ y = x $$", "$a_1 + b$"], ["Limit"], ["In 2021 we met."])
    assert [tuple(x) for x in structure.tables(s).collect()] == [(1, 2, 0, 2, "a / b", 1)]
    plain = structure.sections(d, infer=False)
    assert "Short Plain Title" not in {r.title for r in plain.collect()}
    assert structure.sections(d.limit(0)).count() == 0


def brute_chunks(sizes, budget, overlap):
    made, held, fresh = [], [], False

    def carry(units):
        kept = []
        for u in reversed(units):
            if kept and sum(sizes[k] for k in kept) + sizes[u] > overlap:
                break
            kept.insert(0, u)
            if sum(sizes[k] for k in kept) >= overlap:
                break
        return kept if overlap > 0 else []

    for i, n in enumerate(sizes):
        if n >= budget:
            if held:
                made.append(held)
            made.append([i])
            held = carry([i])
        else:
            if held and sum(sizes[k] for k in held) + n > budget:
                made.append(held)
                held = carry(held)
            held = held + [i]
    return made + [held] if held else made


def test_chunks_equal_brute_force(spark):
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.choice([1, 3, 8, 20, 45]) for _ in range(rng.randint(0, 25))]
        budget, overlap = rng.choice([20, 40]), rng.choice([0, 5, 12])
        assert [list(range(a, b + 1)) for a, b in structure.pack(sizes, budget, overlap)] == brute_chunks(sizes, budget, overlap)
    text = "One sentence here. Two of them now! Is that three? Yes.\n\n- a list\n- of items\n\nAnd the end of it all."
    s = spark.createDataFrame([(1, 0, text), (2, 0, ""), (3, 0, None)], "doc_id bigint, section int, text string")
    units = s.where("doc_id = 1").select(structure.units(F.col("text")).alias("u")).first().u
    assert units == ["One sentence here.", "Two of them now!", "Is that three?", "Yes.", "- a list\n- of items", "And the end of it all."]
    one, two = ([(r.chunk, r.chunk_id, r.text) for r in structure.chunks(s, 9, 4).orderBy("doc_id", "chunk").collect()] for _ in range(2))
    assert one == two and len({i for _, i, _ in one}) == len(one) and one[0][2] == "One sentence here.\n\nTwo of them now!"[: len(one[0][2])]


def test_term_counts(spark):
    d = spark.createDataFrame([(["b", "a", "b", "c", "a", "b"],), ([],)], "w array<string>")
    got = [[(x.term, x.n, x["at"]) for x in r.c] for r in d.select(term_counts(F.col("w")).alias("c")).collect()]
    assert got == [[("a", 2, 1), ("b", 3, 0), ("c", 1, 3)], []]


def test_concept_resolution_equals_brute_force(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randint(3, 14))).strip() or "abcd" for _ in range(60)]
    labels = []
    for n in names * 3:
        k = rng.randrange(len(n))
        labels.append(rng.choice([n, n.upper(), n[:k] + n[k + 1 :], n[:k] + "x" + n[k:], n + "s", n[:k] + "d" + n[k + 1 :]]))
    c = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "concept bigint, name string")
    got = {r.label: (r.concept, round(r.score, 9)) for r in concepts.resolve(spark.createDataFrame([(x,) for x in labels], "label string"), c).collect()}
    key = lambda x: " ".join("".join(ch if ch.isalnum() else " " for ch in x.lower()).split())
    index = {}
    for i, n in enumerate(names):
        index.setdefault(key(n), i)
    want = {}
    for label in labels:
        k = key(label)
        if k in index:
            want[label] = (index[k], 1.0)
            continue
        scored = []
        for a, i in index.items():
            inside = len(k) >= 4 and len(a) >= 4 and (k in a or a in k)
            s = min(len(k), len(a)) / max(len(k), len(a)) if inside else SequenceMatcher(a=k, b=a).ratio()
            if s >= 0.92:
                scored.append((-s, i))
        if scored:
            want[label] = (min(scored)[1], round(-min(scored)[0], 9))
    assert {x: v for x, v in got.items() if x.strip()} == want
    assert spark.createDataFrame([("Élan  Vital-2",)], "t string").select(concept_key(F.col("t"))).first()[0] == "elan vital 2"


def test_merged_concepts_by_hand(spark):
    rows = [(1, "Singular Value", ["SV"], 0.5, 1), (1, "SV", [], 0.9, 2), (1, "singular value", ["other"], 0.2, 3), (1, "Other", [], 0.1, 3), (1, "Alone", [], 0.3, 4), (2, "SV", [], 0.4, 5)]
    d = spark.createDataFrame(rows, "scope int, name string, aliases array<string>, importance double, source int")
    assert {tuple(r) for r in concepts.merge(d).collect()} == {(1, "SV", 0.9, 4, 3), (1, "Alone", 0.3, 1, 1), (2, "SV", 0.4, 1, 1)}


def test_marginal_relevance_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefghij") for _ in range(6))) for i in range(12)]
    pool = spark.createDataFrame([(1, i, i + 1, t) for i, t in docs], "query_id bigint, doc_id bigint, rank int, text string")
    got = [r.doc_id for r in retrieval.marginal_relevance(pool, spark.createDataFrame([(1, "a b c d")], "query_id bigint, text string"), 6).orderBy("pos").collect()]
    jac = lambda a, b: len(a & b) / len(a | b)
    rest, chosen, q = [(i, set(t.split())) for i, t in docs], [], set("abcd")
    while len(chosen) < 6:
        best = max(rest, key=lambda x: (round(0.7 * jac(q, x[1]) - 0.3 * max((jac(x[1], c[1]) for c in chosen), default=0), 12), -x[0]))
        rest.remove(best)
        chosen.append(best)
    assert got == [i for i, _ in chosen]


def test_chapters_in_order(spark):
    rng = random.Random(4)
    nodes = [(1, i, rng.randint(0, 3)) for i in range(30)] + [(2, 1, 0), (2, 2, 0), (2, 3, 0)]
    edges = [(1, a, b) for a, b in (sorted(rng.sample(range(30), 2)) for _ in range(40))] + [(2, 1, 2), (2, 2, 1), (2, 2, 3), (2, 3, 3), (2, 9, 1)]
    got = outline.topological(spark.createDataFrame(nodes, "scope bigint, node bigint, rank int"), spark.createDataFrame(edges, "scope bigint, source bigint, target bigint"))
    pos = {(r.scope, r.node): r.pos for r in got.collect()}
    assert len(pos) == 33 and all(pos[1, a] < pos[1, b] for s, a, b in edges if s == 1)
    assert [n for _, n in sorted((p, n) for (s, n), p in pos.items() if s == 2)] == [1, 2, 3]


def test_trimmed_tree_equals_leaf_by_leaf(spark):
    rng = random.Random(5)
    nodes = {"r": ("", 1)}
    for i in range(25):
        up = rng.choice(list(nodes))
        nodes[f"{up} > n{i}" + "x" * rng.randint(0, 4)] = (up, nodes[up][1] + 1)
    d = spark.createDataFrame([(1, n, u, n.split(" > ")[-1], k) for n, (u, k) in nodes.items()], "doc_id bigint, node string, parent string, label string, depth int")
    left = dict(nodes)
    while len(left) > 9:
        leaves = [n for n in left if not any(u == n for u, _ in left.values())]
        del left[max(leaves, key=lambda n: (left[n][1], len(n.split(" > ")[-1]), n))]
    assert {r.node for r in outline.trim_tree(d, 9).collect()} == set(left)


def test_comparisons_by_hand(spark):
    asked = ["What is the difference between SVD and PCA in this course?", "compare apples, pears with plums", "Cats vs. dogs?", "Quelle différence entre le chat et le chien ?", "Explain SVD", None]
    d = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "id int, q string")
    got = [r.t for r in d.orderBy("id").select(context.comparison_terms(F.col("q")).alias("t")).collect()]
    assert got[:5] == [["SVD", "PCA"], ["apples", "pears", "plums"], ["Cats", "dogs"], ["chat", "chien"], []]


def test_questions_and_dates_that_the_tables_lack(spark):
    said = [("How does a cell divide", True), ("thanks", False), ("is it?", True), ("I like it.", False), ("Explique la photosynthèse", True)]
    d = spark.createDataFrame(said, "t string, asks boolean")
    assert all(r[0] == r[1] for r in d.select(study.is_learning_question(F.col("t")), "asks").collect())
    from corpusloom.operators import documents

    t = spark.createDataFrame([(1, "In 1999 it began.\nno year 12345\n  ends 2020"), (2, None)], "doc_id int, text string")
    assert {(r.line_no, r.year, r.line) for r in documents.timeline(t).collect()} == {(0, "1999", "In 1999 it began."), (2, "2020", "ends 2020")}


def test_cleaned_lines_by_hand(spark):
    from corpusloom.operators import documents

    text = "Keep this line.\n\nkeep  THIS line.\nProfessor Smith, University 12 / 30\nslide navigation icons\nChapter one ......... 12\n![x](y.png) Kept <!-- no\n --> too\n---- **** ----\nThe end (,) page_3_image.png here"
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    assert [r.line for r in documents.clean_lines(d).orderBy("line_no").collect()] == ["Keep this line.", "Chapter one 12", "Kept too", "The end here"]
    assert {r.doc_id: (r.n_lines, r.n_kept) for r in documents.clean_stats(d).collect()}[1] == (9, 4)


def test_learner_and_content_edge_cases(spark):
    e = [(1, 1, i, op) for i, op in enumerate(["covered", "struggled", "demonstrated", "struggled"])] + [(1, 2, 0, "covered"), (1, 2, 1, "struggled"), (2, 1, 0, "demonstrated")]
    got = {(r.learner, r.concept): (r.mastery, r.understood, r.struggling) for r in progress.local_state(spark.createDataFrame(e, "learner int, concept int, seq int, op string")).collect()}
    assert got == {(1, 1): (0.35, True, True), (1, 2): (0.15, False, True), (2, 1): (0.75, True, False)}
    long = [(1, "a", i, "demonstrated" if i % 3 else "struggled") for i in range(9000)]  # several spans
    m = 0.0
    for *_, op in long:
        m = m + 0.2 * (1 - m) if op == "demonstrated" else m * 0.7
    r = learning.fold_chat(spark.createDataFrame(long, "learner int, concept string, seq int, op string")).first()
    assert r.mastery == pytest.approx(m, abs=1e-8) and (r.n_events, r.n_struggled) == (9000, 3000)
    d = spark.createDataFrame([("a", 1), ("b", 2)], "source string, doc_id int")
    assert content.scan(d, "source", None).count() == 2 and content.scan(d, "source", []).count() == 0 and content.scan(d, "source", [" b "]).count() == 1
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert components.connected_components(none).count() == 0


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.md").write_text("# A\ntext")
    (tmp_path / "t" / "b.txt").write_text("")
    assert sorted((r.path.rsplit("/", 1)[1], r.text) for r in tables.text_files(spark, str(tmp_path / "t")).collect()) == [("a.md", "# A\ntext")]
    cases = {"conversation_id": "c", "cases": [{"id": "1", "query": "q", "relevant_chunk_ids": ["x"]}, {"id": "2", "query": "q", "expected_source_document": "s"}]}
    (tmp_path / "ok.json").write_text(json.dumps(cases))
    assert tables.evaluation_cases(spark, str(tmp_path / "ok.json")).count() == 2
    (tmp_path / "bad.json").write_text(json.dumps({"conversation_id": "c", "cases": [{"id": "1", "query": "q"}]}))
    with pytest.raises(Exception, match="a case needs a query and evidence"):
        tables.evaluation_cases(spark, str(tmp_path / "bad.json")).collect()
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    tables.write_partition(rows, str(tmp_path / "p"), "k")
    tables.write_partition(rows.where("k = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "p"), "k")
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("a", 9), ("b", 2)}
    held = {"generators": [{"id": "q", "output_type": "quiz"}, {"id": "off", "output_type": "x", "enabled": False}]}
    (tmp_path / "g.json").write_text(json.dumps(held))
    assert [r.id for r in tables.generator_registry(spark, str(tmp_path / "g.json")).collect()] == ["q"]
    made = tables.write_artifacts(spark.createDataFrame([("x", "{}")], "k string, payload string"), str(tmp_path / "art"), "k", "payload").first()
    assert made.n_bytes == 2 and spark.read.json(made.path).count() == 1
    tables.write_report(spark.createDataFrame([("bm25", 0.5), ("dense", 0.7)], "variant string, recall double"), str(tmp_path / "rep"), "variant", "recall")
    assert 'x-axis ["bm25", "dense"]' in "\n".join(r.value for r in spark.read.text(str(tmp_path / "rep" / "mermaid")).collect())


def test_course_building_by_hand(spark):
    from corpusloom.operators import build

    s = spark.createDataFrame([(1, 0, "A cell is a small unit of life. It divides because it grows large."), (1, 1, "A cell is a small unit of life. Plants are greener than animals are."), (2, 0, None)], "doc_id int, section int, text string")
    got = {(r.kind, r.answer): r.section for r in build.knowledge_items(s).collect()}
    assert got == {("definition", "A cell is a small unit of life."): 0, ("cause", "It divides because it grows large."): 0, ("definition", "Plants are greener than animals are."): 1}
    u = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.9, 0.2, 0.8, 0.1, 0.1, None])], "k int, i int, s double")
    assert [r.chunk for r in build.valleys(u, "k", "i", "s", 0.3).orderBy("i").collect()] == [0, 0, 1, 1, 2, 3]
    t = spark.createDataFrame([(1, 1, "Linear maps"), (1, 2, "maps, linear!"), (1, 3, "Other"), (2, 4, "Linear maps")], "scope int, k int, title string")
    assert [(r.a, r.b) for r in build.similar_titles(t, "scope", "k", "title").collect()] == [(1, 2)]
    old = spark.createDataFrame([("SVD",)], "name string")
    assert sorted(r.name for r in build.keep_names(spark.createDataFrame([("svd",), ("PCA",)], "name string"), old, "name", "name").collect()) == ["PCA", "SVD"]


def test_node_scores_of_very_long_words(spark):
    nodes = spark.createDataFrame([(1, "concept", "x" * 100_000 + "gradient"), (2, "document", "ungradiented words"), (3, "document", "grad")], "node_id int, type string, text string")
    terms = spark.createDataFrame([(7, "gradient"), (7, "grad"), (7, "gradient")], "query_id int, term string")
    got = {(r.node_id, r.score) for r in study.node_scores(nodes, terms).collect()}
    assert got == {(1, 1.5), (2, 1.0), (3, 3.0)}


def test_means_of_halves_go_up_in_any_order(spark):
    from corpusloom.operators.progress import mean, millionths

    d = spark.createDataFrame([(0.000001, 1), (0.000002, 1), (0.1, 2), (0.2, 2), (0.300001, 2)], "m double, g int")
    got = d.groupBy("g").agg(mean(F.sum(millionths(F.col("m"))), F.count(F.lit(1))).alias("m")).orderBy("g").collect()
    assert [r.m for r in got] == [0.000002, 0.2]
