"""Outlines, trees, quizzes and plans made from course texts and parts, with DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import outline as O
from corpusloom.operators import progress as P
from corpusloom.operators import structure as S

from corpusloom.plans.course import FEATURES, TEXTS, _sections, course_texts
from corpusloom.plans.course import R as SECT
from corpusloom.plans.registry import TOKENS, _docs, _edges, EDGES, query, table

TREE = f"""{SECT}, st AS (SELECT doc_id, section, path, unnest(range(1, len(path) + 1)) AS k FROM se),
nd AS (SELECT doc_id, array_to_string(path[1:k], ' > ') AS node, array_to_string(path[1:k - 1], ' > ') AS parent, path[k] AS label, CAST(k AS INT) AS depth, min(section) AS first FROM st GROUP BY ALL),
np AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, parent ORDER BY first, node) AS INT) AS pos FROM nd),
tr AS (SELECT * FROM np a WHERE NOT EXISTS (SELECT 1 FROM np b WHERE b.doc_id = a.doc_id AND b.pos > 7 AND (a.node = b.node OR starts_with(a.node, b.node || ' > '))))"""


def _tree(spark, sf):
    return O.heading_tree(_sections(spark, sf))


@query(f"{TREE} SELECT * FROM tr")
def heading_tree(spark, sf):
    return _tree(spark, sf)


@query(f"{TREE} SELECT doc_id, count(*) AS n_nodes, max(depth) AS depth, count(*) FILTER (NOT EXISTS (SELECT 1 FROM tr b WHERE b.doc_id = a.doc_id AND b.parent = a.node)) AS n_leaves FROM tr a GROUP BY doc_id")
def tree_counts(spark, sf):
    return O.tree_counts(_tree(spark, sf))


@query(f"{TREE} SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth, length(label), node) <= 5")
def tree_trim(spark, sf):
    return O.trim_tree(_tree(spark, sf), 5)


@query(f"""{TREE} SELECT doc_id, string_agg(repeat('  ', depth - 1) || '- ' || label, chr(10) ORDER BY first, depth, node, label) AS markdown,
  'mindmap' || chr(10) || string_agg(repeat('  ', depth) || regexp_replace(label, '[()\\[\\]{{}}"]', '', 'g'), chr(10) ORDER BY first, depth, node, label) AS mermaid FROM tr GROUP BY doc_id""")
def tree_render(spark, sf):
    return O.render_tree(_tree(spark, sf))


OUT = f"""{SECT}, oc AS (SELECT doc_id, path[1] AS chapter_title, min(section) AS at_, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(section)) AS INT) AS chapter FROM se GROUP BY doc_id, path[1] QUALIFY chapter <= 10),
ol AS (SELECT doc_id, path[1] AS chapter_title, title AS lesson_title, CAST(row_number() OVER (PARTITION BY doc_id, path[1] ORDER BY min(section)) AS INT) AS lesson FROM se GROUP BY doc_id, path[1], title QUALIFY lesson <= 12),
ou AS (SELECT doc_id, chapter, chapter_title, lesson, lesson_title FROM ol JOIN oc USING (doc_id, chapter_title))"""


def _outline(spark, sf):
    return O.fallback_outline(_sections(spark, sf))


@query(f"{OUT} SELECT * FROM ou")
def fallback_outline(spark, sf):
    return _outline(spark, sf)


@query(f"""{OUT}, p AS (SELECT doc_id, chapter, count(*) AS n FROM ou GROUP BY ALL)
SELECT doc_id, count(*) AS n_chapters, CAST(sum(n) AS BIGINT) AS n_lessons, count(*) FILTER (n > 1) AS n_multi, CAST(2 * count(*) + sum(n) + count(*) FILTER (n > 1) AS BIGINT) AS score FROM p GROUP BY doc_id""")
def structure_scores(spark, sf):
    return O.structure_score(_outline(spark, sf))


@query(f"""WITH {TEXTS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM ct),
m AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^# (Chapter \\d+)') THEN regexp_extract(line, '^# (Chapter \\d+)', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS chapter FROM l WHERE regexp_matches(line, '^# (Chapter \\d+)|^## (\\d+\\. .+)$'))
SELECT doc_id, CAST(n AS INT) AS line_no, chapter, regexp_extract(line, '^## (\\d+\\. .+)$', 1) AS lesson FROM m WHERE starts_with(line, '## ')""")
def toc_outline(spark, sf):
    lines = course_texts(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return O.toc_outline(lines, r"^# (Chapter \d+)", r"^## (\d+\. .+)$")


_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{p}') THEN '{n}'" for n, p in O.ROLES) + " ELSE 'core_concept' END"
_LABEL = "CASE lesson % 5 WHEN 1 THEN 'Overview of ' || lesson_title WHEN 2 THEN 'Example: ' || lesson_title WHEN 3 THEN lesson_title || ' recap' WHEN 4 THEN 'Steps for ' || lesson_title ELSE lesson_title END"


def _roles(spark, sf):
    t, k = F.col("lesson_title"), F.col("lesson") % 5
    title = (
        F.when(k == 1, F.concat(F.lit("Overview of "), t)).when(k == 2, F.concat(F.lit("Example: "), t)).when(k == 3, F.concat(t, F.lit(" recap")))
        .when(k == 4, F.concat(F.lit("Steps for "), t)).otherwise(t)
    )
    return _outline(spark, sf).select("doc_id", "chapter", "lesson", O.role(title).alias("role"))


@query(f"{OUT} SELECT doc_id, chapter, lesson, {_ROLE.format(f'({_LABEL})')} AS role FROM ou")
def lesson_roles(spark, sf):
    return _roles(spark, sf)


@query(f"""{OUT}, r AS (SELECT doc_id, chapter, lesson, {_ROLE.format(f'({_LABEL})')} AS role FROM ou),
g AS (SELECT doc_id, chapter, min(lesson) FILTER (role = 'introduction') AS i, max(lesson) FILTER (role = 'conclusion') AS e, max(lesson) AS l FROM r GROUP BY ALL)
SELECT doc_id, chapter, lesson, CASE WHEN lesson = i THEN 'introduction' WHEN lesson = e THEN 'conclusion' ELSE 'content' END AS stage, false AS made FROM r JOIN g USING (doc_id, chapter)
UNION ALL SELECT doc_id, chapter, 0, 'introduction', true FROM g WHERE i IS NULL UNION ALL SELECT doc_id, chapter, l + 1, 'conclusion', true FROM g WHERE e IS NULL""")
def chapter_arcs(spark, sf):
    return O.with_arcs(_roles(spark, sf))


@query()
def chapter_order(spark, sf):
    n = table(spark, sf, "part").select((F.col("p_partkey") % 20).alias("scope"), F.col("p_partkey").alias("node"), F.col("p_size").cast("int").alias("rank"))
    e = _edges(spark, sf).where((F.col("source") % 20) == (F.col("target") % 20)).select((F.col("source") % 20).alias("scope"), "source", "target")
    return O.topological(n, e)


_W = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"


@query(f"""WITH i AS (SELECT p_partkey AS item, unnest({_W.format("p_name || ' ' || p_type")}) AS w FROM part), t AS (SELECT n_nationkey AS target, unnest({_W.format("(SELECT p_name || ' ' || p_type FROM part WHERE p_partkey = n_nationkey * 3)")}) AS w FROM nation),
n AS (SELECT item, target, count(*) AS overlap FROM i JOIN t USING (w) GROUP BY ALL) SELECT item, target, overlap FROM n QUALIFY row_number() OVER (PARTITION BY item ORDER BY overlap DESC, target) = 1""")
def best_branch_match(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", tokens(F.concat_ws(" ", "p_name", "p_type")).alias("words"))
    targets = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 3).cast("bigint").alias("p_partkey")).join(p, "p_partkey")
    return O.best_match(p.select(F.col("p_partkey").alias("item"), "words"), targets.select(F.col("n_nationkey").alias("target"), "words"))


@query(f"""WITH c AS (SELECT doc_id AS chunk, unnest(list_distinct({TOKENS})) AS w FROM documents), l0 AS (SELECT item_id AS lesson, list_slice(list_filter({TOKENS}, lambda x: length(x) >= 7), 1, 3) AS t FROM benchmark),
l AS (SELECT lesson, len(list_distinct(t)) AS n, unnest(list_distinct(t)) AS w FROM l0), h AS (SELECT lesson, chunk, n, count(*) AS hits FROM c JOIN l USING (w) GROUP BY ALL) SELECT lesson, chunk, hits FROM h WHERE hits >= least(2, n)""")
def lexical_support(spark, sf):
    words = F.slice(F.filter(tokens(F.col("text")), lambda x: F.length(x) >= 7), 1, 3)
    lessons = table(spark, sf, "benchmark").select(F.col("item_id").alias("lesson"), words.alias("words"))
    return O.supported(_docs(spark, sf).select(F.col("doc_id").alias("chunk"), tokens(F.col("text")).alias("words")), lessons)


@query("""WITH w AS (SELECT p_brand, p_name, unnest(list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}]{4,}'))) AS word FROM part) SELECT p_brand, word, count(DISTINCT p_name) AS n_titles FROM w GROUP BY ALL HAVING count(DISTINCT p_name) >= 2""")
def repeated_title_words(spark, sf):
    return O.repeated_words(table(spark, sf, "part"), "p_brand", "p_name")


@query("""WITH g AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) = 1""")
def title_mode(spark, sf):
    return O.mode(table(spark, sf, "part"), "p_brand", "p_name")


QUIZ = """qz AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'Is a ' || p_name || ' made?' ELSE 'Which kind is it?' END AS question,
  [p_name, p_type, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand END, CASE WHEN p_partkey % 11 = 0 THEN 'All of the above' ELSE 'other' END][1:CASE WHEN p_partkey % 13 = 0 THEN 3 ELSE 4 END] AS options,
  CAST(p_size % 5 AS INT) AS correct, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE 'because' END AS why FROM part)"""
_K = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_LOW = "list_transform(options, lambda o: lower(trim(o)))"


def _choices(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_name")
    q = F.when(k % 7 == 0, F.concat(F.lit("Is a "), n, F.lit(" made?"))).otherwise("Which kind is it?")
    options = F.array(n, F.col("p_type"), F.when(k % 5 == 0, F.col("p_type")).otherwise(F.col("p_brand")), F.when(k % 11 == 0, "All of the above").otherwise("other"))
    options = F.slice(options, 1, F.when(k % 13 == 0, 3).otherwise(4))
    return table(spark, sf, "part").select(k.alias("id"), q.alias("question"), options.alias("options"), (F.col("p_size") % 5).cast("int").alias("correct"), F.when(k % 17 == 0, " ").otherwise("because").alias("why"))


@query(f"""WITH {QUIZ}, a AS (SELECT *, {_K.format('coalesce(options[correct + 1], chr(0))')} AS a, string_split({_K.format('coalesce(options[correct + 1], chr(0))')}, ' ') AS w, {_K.format('question')} AS k FROM qz),
v AS (SELECT id, len(options) >= 4 AND correct BETWEEN 0 AND len(options) - 1 AND NOT list_contains({_LOW}, '') AND len(list_distinct({_LOW})) = len(options) AND trim(question) <> '' AND trim(why) <> ''
  AND len(list_filter(options, lambda o: regexp_matches(lower(o), '^(all|none|both|any) of the (above|these)'))) = 0
  AND NOT (length(a) >= 4 AND (contains(k, a) OR (len(w) >= 2 AND len(list_filter(w, lambda x: length(x) > 3 AND list_contains(string_split(k, ' '), x))) >= greatest(2, len(w) - 1)))) AS ok FROM a)
SELECT id, coalesce(ok, false) AS valid, CASE WHEN coalesce(ok, false) THEN NULL ELSE 'failed_quality_validation' END AS reason FROM v""")
def question_validity(spark, sf):
    ok = O.valid_choice(F.col("question"), F.col("options"), F.col("correct"), F.col("why"))
    return _choices(spark, sf).select("id", ok.alias("valid")).withColumn("reason", F.when(~F.col("valid"), "failed_quality_validation"))


@query("""SELECT p_partkey AS id, (length(q) - length(replace(q, '____', ''))) / 4 = 1 AND trim(a) <> '' AS valid FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'A ____ is sold' WHEN 1 THEN 'A ____ is a ____' ELSE 'no blank' END AS q, CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_name END AS a FROM part)""")
def blank_validity(spark, sf):
    k = F.col("p_partkey")
    q = F.when(k % 3 == 0, "A ____ is sold").when(k % 3 == 1, "A ____ is a ____").otherwise("no blank")
    return table(spark, sf, "part").select(k.alias("id"), O.valid_blank(q, F.when(k % 4 == 0, " ").otherwise(F.col("p_name"))).alias("valid"))


@query("""WITH b AS (SELECT p_brand, ['remember', 'understand', 'apply', 'analyze'][p_size % 4 + 1] AS level FROM part)
SELECT p_brand, count(*) FILTER (level = 'remember') AS remember, count(*) FILTER (level = 'understand') AS understand, count(*) FILTER (level = 'apply') AS apply, count(*) FILTER (level = 'analyze') AS analyze FROM b GROUP BY ALL""")
def bloom_distribution(spark, sf):
    bloom = F.get(F.array(*map(F.lit, P.BLOOM)), (F.col("p_size") % 4).cast("int"))
    g = table(spark, sf, "part").select("p_brand", bloom.alias("level")).groupBy("p_brand").pivot("level", list(P.BLOOM)).agg(F.count(F.lit(1)))
    return g.na.fill(0)


@query(f"""{SECT}, z AS (SELECT doc_id, section, length(text) AS n FROM se), r AS (SELECT doc_id, list(n ORDER BY section) AS l, list(section ORDER BY section) AS s FROM z GROUP BY doc_id),
f AS (SELECT doc_id, s, list_reduce(list_prepend({{'b': [0::BIGINT], 'u': 0::BIGINT}}, list_transform(l, lambda x: {{'b': [0::BIGINT], 'u': x}})), lambda a, x: {{'b': list_append(a.b, CASE WHEN a.u > 0 AND a.u + x.u > 400 THEN a.b[-1] + 1 ELSE a.b[-1] END), 'u': CASE WHEN a.u > 0 AND a.u + x.u > 400 THEN 0 ELSE a.u END + x.u}}).b[2:] AS b FROM r),
u AS (SELECT doc_id, unnest(s) AS section, unnest(b) AS batch FROM f) SELECT doc_id, section, CAST(batch AS INT) AS batch FROM u WHERE batch < 6""")
def outline_batches(spark, sf):
    return O.batches(_sections(spark, sf).select("doc_id", "section", F.length("text").cast("bigint").alias("n")), "doc_id", "section", "n", 400, 6)


@query(r"""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '# ' || text || ' `x = 1` https://a.example/b' WHEN 1 THEN '- **' || text || '**' || chr(10) || '2. [site](http://x.example)' ELSE text END AS t FROM conversations),
a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)```.*?```', ' ', 'g'), '`([^`]*)`', '\1', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+', ' ', 'g') AS t FROM t)
SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^\s*#{1,6}\s*', '', 'g'), '[*_~|>]+', ' ', 'g'), '(?m)^\s*(?:[-•]|\d+\.)\s+', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM a""")
def spoken_text(spark, sf):
    c, k = table(spark, sf, "conversations"), F.col("turn") % 3
    t = (
        F.when(k == 0, F.concat(F.lit("# "), "text", F.lit(" `x = 1` https://a.example/b")))
        .when(k == 1, F.concat(F.lit("- **"), "text", F.lit("**\n2. [site](http://x.example)"))).otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", F.md5(O.spoken(t)).alias("digest"))


@query("""SELECT user_id, count(*) AS n_words, string_agg(event_type, ',' ORDER BY md5(user_id || ':' || event_id || ':seed')) AS shuffled FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5) GROUP BY user_id""")
def seeded_shuffle(spark, sf):
    e = table(spark, sf, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("r <= 5")
    key = F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.lit("seed")))
    lists = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), "event_type"))), lambda x: x["event_type"])
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_words"), F.array_join(lists, ",").alias("shuffled"))


@query("""WITH c AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part), n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY ALL),
s AS (SELECT p_brand, n, unnest(range(0, 10)) AS slot FROM n)
SELECT s.p_brand, CAST(slot AS INT) AS slot, CASE WHEN slot < 6 THEN 'struggling' WHEN slot < 9 THEN 'coverage' ELSE 'stretch' END AS kind, ['mcq', 'mcq', 'true_false', 'fill_blank'][slot % 4 + 1] AS type, p_partkey AS concept
FROM s JOIN c ON c.p_brand = s.p_brand AND c.i = (CASE WHEN slot < 6 THEN slot WHEN slot < 9 THEN slot - 6 ELSE slot - 9 END) % n""")
def quiz_plan(spark, sf):
    w = Window.partitionBy("p_brand")
    c = table(spark, sf, "part").select("p_brand", "p_partkey", (F.row_number().over(w.orderBy("p_partkey")) - 1).alias("i"))
    n = c.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    s = n.select("p_brand", "n", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("slot"))
    at = F.when(F.col("slot") < 6, F.col("slot")).when(F.col("slot") < 9, F.col("slot") - 6).otherwise(F.col("slot") - 9)
    kind = F.when(F.col("slot") < 6, "struggling").when(F.col("slot") < 9, "coverage").otherwise("stretch")
    kinds = F.get(F.array(*map(F.lit, ("mcq", "mcq", "true_false", "fill_blank"))), F.col("slot") % 4)
    s = s.select("p_brand", "slot", kind.alias("kind"), kinds.alias("type"), (at % F.col("n")).cast("int").alias("i"))
    return s.join(c, ["p_brand", "i"]).select("p_brand", "slot", "kind", "type", F.col("p_partkey").alias("concept"))


@query(f"""{FEATURES}, c AS (SELECT doc_id, section, unnest(concepts) AS name, generate_subscripts(concepts, 1) AS p FROM fe), f AS (SELECT doc_id, name, min(section * 100 + p) AS f FROM c GROUP BY ALL)
SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1 AS INT) AS pos, ['remember', 'understand', 'apply', 'analyze'][(row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1) % 4 + 1] AS bloom FROM f QUALIFY pos < 40""")
def concept_cards(spark, sf):
    c = _sections(spark, sf).select("doc_id", "section", F.posexplode(S.key_concepts(F.col("text"))).alias("p", "name"))
    f = c.groupBy("doc_id", "name").agg(F.min(F.struct("section", "p")).alias("f"))
    f = f.select("doc_id", "name", (F.row_number().over(Window.partitionBy("doc_id").orderBy("f")) - 1).alias("pos")).where("pos < 40")
    return f.withColumn("bloom", F.get(F.array(*map(F.lit, P.BLOOM)), F.col("pos") % 4))


@query("""WITH s AS (SELECT doc_id, source, md5(text) AS s FROM documents), p AS (SELECT a.doc_id, b.doc_id AS other, b.s, row_number() OVER (PARTITION BY a.doc_id, b.s ORDER BY b.doc_id) AS k FROM s a JOIN s b ON b.doc_id BETWEEN a.doc_id + 1 AND a.doc_id + 6 AND b.s <> a.s)
SELECT doc_id, other, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY other) AS INT) AS pos FROM p WHERE k = 1 QUALIFY pos <= 3""")
def distractor_statements(spark, sf):
    s = _docs(spark, sf).select("doc_id", F.md5("text").alias("s"))
    near = s.select("doc_id", F.col("s").alias("own"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.col("doc_id") + i)).alias("other"))
    p = near.join(s.select(F.col("doc_id").alias("other"), "s"), "other").where("s != own")
    first = p.groupBy("doc_id", "s").agg(F.min("other").alias("other"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("other"))
    return first.select("doc_id", "other", pos.alias("pos")).where("pos <= 3")


@query(f"""WITH {EDGES}, b AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e) SELECT a AS chunk, count(*) AS n, min(b) AS first, max(b) AS last FROM b GROUP BY ALL""")
def chunk_adjacency(spark, sf):
    e = _edges(spark, sf)
    both = e.select(F.col("source").alias("chunk"), F.col("target").alias("b")).unionByName(e.select(F.col("target").alias("chunk"), F.col("source").alias("b"))).distinct()
    return both.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("first"), F.max("b").alias("last"))


@query(f"""WITH {EDGES}, m AS (SELECT p_partkey AS node, CAST(regexp_extract(p_brand, '\\d+', 0) AS INT) AS chapter FROM part),
x AS (SELECT DISTINCT a.chapter AS chapter, b.chapter AS requires FROM e JOIN m a ON a.node = e.source JOIN m b ON b.node = e.target WHERE relation = 'requires' AND confidence >= 0.06 AND a.chapter <> b.chapter) SELECT * FROM x""")
def chapter_prerequisites(spark, sf):
    m = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.regexp_extract("p_brand", r"\d+", 0).cast("int").alias("chapter"))
    e = _edges(spark, sf).where("relation = 'requires' AND confidence >= 0.06")
    a, b = m.toDF("source", "chapter"), m.toDF("target", "requires")
    return e.join(a, "source").join(b, "target").where("chapter != requires").select("chapter", "requires").distinct()


@query(f"""WITH {EDGES}, r AS (SELECT DISTINCT source, target FROM e WHERE relation = 'requires'), s AS (SELECT DISTINCT source, target FROM e WHERE relation = 'supports'),
n AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 20 = 0)
SELECT node, (SELECT count(*) FROM r WHERE r.source = node) AS n_prerequisites, (SELECT count(*) FROM r WHERE r.target = node) AS n_next, (SELECT count(*) FROM s WHERE s.source = node) AS n_related, coalesce((SELECT min(target) FROM r WHERE r.source = node), -1) AS first_prerequisite FROM n""")
def lesson_hints(spark, sf):
    e = _edges(spark, sf)
    r, s = (e.where(F.col("relation") == k).select("source", "target").distinct() for k in ("requires", "supports"))
    n = table(spark, sf, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("node"))
    count = lambda d, by, name: d.groupBy(F.col(by).alias("node")).agg(F.count(F.lit(1)).alias(name))
    first = r.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("first_prerequisite"))
    for d in (count(r, "source", "n_prerequisites"), count(r, "target", "n_next"), count(s, "source", "n_related")):
        n = n.join(d, "node", "left")
    n = n.na.fill(0).join(first, "node", "left")
    return n.withColumn("first_prerequisite", F.coalesce("first_prerequisite", F.lit(-1)))


@query(f"""{SECT}, f AS (SELECT doc_id, sha256(string_agg(section || ':' || length(text), ';' ORDER BY section)) AS now, sha256(string_agg(section || ':' || CASE WHEN doc_id % 3 = 0 THEN 0 ELSE length(text) END, ';' ORDER BY section)) AS old FROM se GROUP BY doc_id)
SELECT doc_id, now AS fingerprint, now = old AS kept FROM f""")
def progress_fingerprints(spark, sf):
    s = _sections(spark, sf).select("doc_id", "section", F.length("text").alias("n"))
    mark = lambda n: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", n.alias("n")))), lambda x: F.concat_ws(":", x["section"].cast("string"), x["n"].cast("string"))), ";"), 256)
    g = s.groupBy("doc_id").agg(mark(F.col("n")).alias("fingerprint"), mark(F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("n"))).alias("old"))
    return g.select("doc_id", "fingerprint", (F.col("fingerprint") == F.col("old")).alias("kept"))


@query(f"""{FEATURES}, t AS (SELECT doc_id, array_to_string(list(title ORDER BY section)[1:8], '; ') AS labels, count(*) AS n, CAST(sum(len(equations)) AS BIGINT) AS n_equations FROM fe GROUP BY doc_id)
SELECT doc_id, n AS n_sections, n_equations, 'Sections: ' || CASE WHEN length(labels) > 120 THEN regexp_replace(substr(labels, 1, 120), ' [^ ]*$', '') ELSE labels END AS summary FROM t""")
def course_summaries(spark, sf):
    s = _sections(spark, sf).select("doc_id", "section", "title", F.size(S.equations(F.col("text"))).alias("e"))
    labels = F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("section", "title"))), lambda x: x["title"]), 1, 8), "; ")
    g = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("e").alias("n_equations"), labels.alias("l"))
    cut = F.when(F.length("l") > 120, F.regexp_replace(F.substring("l", 1, 120), " [^ ]*$", "")).otherwise(F.col("l"))
    return g.select("doc_id", "n_sections", "n_equations", F.concat(F.lit("Sections: "), cut).alias("summary"))


@query(f"""{SECT}, f AS (SELECT doc_id, section, regexp_extract(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^(.{{40,220}}?[.!?])(?:\\s|$)', 1) AS s, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 180) AS c FROM se),
p AS (SELECT doc_id, section, CASE WHEN s <> '' THEN s ELSE c END AS point FROM f), d AS (SELECT doc_id, lower(point) AS k, min_by(point, section) AS point, min(section) AS at_ FROM p GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY at_) AS INT) AS pos, point FROM d QUALIFY pos <= 8""")
def narrative_points(spark, sf):
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    first = F.regexp_extract(flat, r"^(.{40,220}?[.!?])(?:\s|$)", 1)
    p = _sections(spark, sf).select("doc_id", "section", F.when(first != "", first).otherwise(F.substring(flat, 1, 180)).alias("point"))
    d = p.groupBy("doc_id", F.lower("point").alias("k")).agg(F.min_by("point", "section").alias("point"), F.min("section").alias("at"))
    return d.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).alias("pos"), "point").where("pos <= 8")


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
b AS (SELECT o_custkey AS course, o_orderkey AS lesson, i // 3 AS chapter, unnest(['definition', 'explanation', 'example', 'summary']) AS block, unnest(range(0, 4)) AS pos FROM r WHERE i < 36)
SELECT course, CAST(chapter AS INT) AS chapter, lesson, CAST(pos AS INT) AS pos, block FROM b""")
def fallback_course_plan(spark, sf):
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("course"), F.col("o_orderkey").alias("lesson"), i.alias("i")).where("i < 36")
    blocks = F.array(*map(F.lit, ("definition", "explanation", "example", "summary")))
    return r.select("course", F.floor(F.col("i") / 3).cast("int").alias("chapter"), "lesson", F.posexplode(blocks).alias("pos", "block"))


