"""Hand-made cases of course kinds and of the rules for what is shown."""

from pyspark.sql import functions as F

from corpusloom.operators import architecture as A

CHUNK = "course int, heading string, concepts string, text string, n_equations int"


def test_kinds_of_courses(spark):
    rows = [(1, "History of the empire", None, "In 1453 the war ended.", 0)] * 3 + [(2, None, None, "The reaction of an acid and a base", 0)] * 9
    rows += [(3, None, "atom", "2H_2 + O_2 -> 2H_2O", 1), (4, None, None, "A recommender ranks by machine learning software; an algorithm.", 0)]
    rows += [(5, None, None, "theorem proof lemma", 0), (5, None, None, "cell dna rna", 0), (6, None, None, None, None), (6, "", "", "", 0)]
    rows += [(7, None, None, "Follow the operating procedure step by step; une histoire", 0), (8, None, None, "Physique: v = a t", 4), (9, None, None, "prehistory cells", 0)]
    got = {r.course: (r.architecture, r.best, r.score) for r in A.course_architecture(spark.createDataFrame(rows, CHUNK)).collect()}
    assert got[1] == ("historical", "historical", 9 + 8 + 4)
    assert got[2][0] == "conceptual"  # no anchor
    assert got[3] == ("chemistry", "chemistry", 1 + 2 + 3)
    assert got[4][0] == "conceptual" and got[5][0] == "mixed" and got[6] == ("conceptual", "historical", 0) and got[9][2] == 0
    assert got[7] == ("procedural", "procedural", 3 + 2)  # a phrase and the word in it both count
    assert got[8] == ("physics", "physics", 2 + 1)  # one chunk with formulas
    assert A.course_architecture(spark.createDataFrame([], CHUNK)).count() == 0


def test_reactions(spark):
    texts = ["2H_2 + O_2 -> 2H_2O", "x\n  $NaCl <=> Na^+ + Cl^-$\ny", r"\ce {H2O}", "A -> b", "if a -> B", "Ab+C→D", None, "A" * 100_000 + " -> "]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.x for r in d.select("i", F.col("t").rlike(A.REACTION).alias("x")).orderBy("i").collect()] == [True, True, True, False, False, True, None, False]


def test_titles_and_concepts(spark):
    titles = ["Limits of growth", "  Summary ", "3.1", "a", "<b>x</b>", None, "!!", "1) Start", "Doc 4", "x" * 100, "Résumé"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    got = d.select("i", A.valid_phase_title(F.col("t")).alias("v"), A.too_granular(F.col("t")).alias("g")).orderBy("i").collect()
    assert [r.v for r in got] == [True, False, False, False, False, False, False, True, True, True, False]
    assert [r.g for r in got] == [False, False, True, True, True, False, False, True, True, True, False]
    c = spark.createDataFrame([(1, None, ["a"]), (2, True, ["a"]), (3, False, []), (4, False, None)], "i int, off boolean, ids array<string>")
    assert [r.i for r in c.where(A.active_concept(F.col("off"), F.col("ids"))).collect()] == [1]
    phases = spark.createDataFrame([(1, None), (2, True)], "phase int, inactive boolean")
    objectives = spark.createDataFrame([(1, False), (1, True), (2, False), (3, None)], "phase int, inactive boolean")
    p, o = A.active_map(phases, objectives)
    assert [r.phase for r in p.collect()] == [1] and o.count() == 1


def test_routes(spark):
    said = [("Thank  you", ""), ("Explain it", ""), ("best dinner?", "about cells"), ("a dinner in plan", "Dinner plans"), (None, None), ("nice", None), ("legal advice please?", None)]
    d = spark.createDataFrame([(i, *s) for i, s in enumerate(said)], "i int, m string, s string")
    route = A.guarded_route(F.lit("conversational_reply"), F.col("m"), F.col("s"))
    assert [r.r for r in d.select("i", route.alias("r")).orderBy("i").collect()] == [
        "conversational_reply", "retrieve", "outside_files", "retrieve", "conversational_reply", "conversational_reply", "outside_files",
    ]


def test_scope_of_nodes(spark):
    nodes = spark.createDataFrame(
        [(1, "course", None, None, None), (2, "chunk", "c1", None, None), (3, "file", "f1", [], []), (4, "concept", "c1", ["c2"], ["f1"]), (5, "concept", "c1", ["c1", "c1"], None), (6, "file", "c1", None, None)],
        "node int, kind string, ref string, chunk_ids array<string>, file_ids array<string>",
    )
    chunks, files = spark.createDataFrame([("c1",)], "chunk string"), spark.createDataFrame([("f1",)], "file string")
    ids = lambda d: sorted(r.node for r in d.collect())
    assert ids(A.in_source_scope(nodes, None, None)) == [1, 2, 3, 4, 5, 6] and ids(A.in_source_scope(nodes, chunks, files)) == [1, 2, 3, 4, 5]
    assert ids(A.in_source_scope(nodes, chunks, None)) == [1, 2, 5] and ids(A.in_source_scope(nodes, chunks.limit(0), files.limit(0))) == [1]
