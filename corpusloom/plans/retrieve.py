"""Retrieval modes and contexts on the driver's tables and on course texts, with DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.text import STOPWORDS
from corpusloom.operators import context as X
from corpusloom.operators import retrieval as R
from corpusloom.operators import structure as S
from corpusloom.plans.course import FEATURES, R as SECT, _sections, path
from corpusloom.plans.registry import BM25, OVERLAP, TOKENS, _bm25, _bm25_top, _docs, _overlap_top, _questions, _vectors, query, stage, table

QUESTIONS = """qs AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'What is the difference between ' || p_name || ' and ' || p_type || '?'
  WHEN 1 THEN 'Compare the ' || p_name || ' with ' || p_brand || ', ' || p_type || ' in this course' WHEN 2 THEN p_name || ' vs. ' || p_type
  WHEN 3 THEN 'How do I calculate the price of a ' || p_name || '?' WHEN 4 THEN 'Can you summarize this course about ' || p_name || '?' ELSE 'Tell me of the ' || p_name END AS q FROM part)"""


def _asked_questions(spark, sf):
    n, t, b = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    j = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    k = F.col("p_partkey") % 6
    q = (
        F.when(k == 0, j("What is the difference between ", n, " and ", t, "?")).when(k == 1, j("Compare the ", n, " with ", b, ", ", t, " in this course"))
        .when(k == 2, j(n, " vs. ", t)).when(k == 3, j("How do I calculate the price of a ", n, "?"))
        .when(k == 4, j("Can you summarize this course about ", n, "?")).otherwise(j("Tell me of the ", n))
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), q.alias("q"))


_N = tuple(X.NAMELESS)
_WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_+/#.-]*"


def _pattern(i: int) -> str:
    return X.COMPARED[i].replace("'", "''")


_CASES = " ".join(f"WHEN regexp_matches(f, '{_pattern(i)}') THEN [regexp_extract(f, '{_pattern(i)}', 1), regexp_extract(f, '{_pattern(i)}', 2)]" for i in range(len(X.COMPARED)))
TERMS = f"""{QUESTIONS}, q1 AS (SELECT id, q, trim(regexp_replace(q, '\\s+', ' ', 'g'), ' ?!.') AS f FROM qs),
q2 AS (SELECT id, flatten(list_transform(CASE {_CASES} ELSE [] END, lambda x: string_split_regex(x, '\\s*,\\s*|\\s*/\\s*'))) AS p FROM q1 WHERE regexp_matches(q, '{X.COMPARES}')),
q3 AS (SELECT id, list_transform(p, lambda x: list_filter(list_transform(regexp_extract_all(x, '{_WORD}'), lambda w: trim(w, '.,;:?!()[]{{}}"''')), lambda w: w <> '' AND lower(w) NOT IN {_N})) AS p FROM q2),
q4 AS (SELECT id, list_transform(p, lambda x: array_to_string(x[greatest(len(x) - 4, 1):], ' ')) AS p FROM q3),
q5 AS (SELECT id, list_filter(p, lambda n, i: n <> '' AND list_position(list_transform(p, lambda z: lower(z)), lower(n)) = i) AS p FROM q4)"""


@query(f"WITH {TERMS} SELECT id, CAST(unnest(range(0, len(p))) AS INT) AS pos, unnest(p) AS term FROM q5 WHERE len(p) >= 2")
def comparison_terms(spark, sf):
    return _asked_questions(spark, sf).select("id", F.posexplode(X.comparison_terms(F.col("q"))).alias("pos", "term"))


#: A question as a whole, after its terms' numbers.
WHOLE = (1 << 16) - 1


@query(f"""WITH {TERMS}, tt AS (SELECT id AS query_id, unnest(range(0, len(p))) AS term_no, unnest(p) AS text FROM q5 WHERE len(p) >= 2),
pd AS (SELECT p_partkey AS doc_id, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part),
pw AS (SELECT doc_id, len({TOKENS}) AS dl, unnest({TOKENS}) AS term FROM pd), pt AS (SELECT doc_id, dl, term, count(*) AS tf FROM pw GROUP BY ALL),
qw AS (SELECT query_id, term_no, term, count(*) AS qtf FROM (SELECT query_id, term_no, unnest({TOKENS}) AS term FROM tt) GROUP BY ALL),
th AS (SELECT query_id, term_no, doc_id, round(sum(least(tf, qtf)) / sqrt(greatest(max(dl), 1)), 6) AS score FROM pt JOIN qw USING (term) GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id, term_no ORDER BY score DESC, doc_id) AS rank FROM th QUALIFY rank <= 10),
fw AS (SELECT id AS query_id, term, count(*) AS qtf FROM (SELECT id, unnest(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM qs WHERE id IN (SELECT query_id FROM tt)) GROUP BY ALL),
fh AS (SELECT query_id, doc_id, round(sum(least(tf, qtf)) / sqrt(greatest(max(dl), 1)), 6) AS score FROM pt JOIN fw USING (term) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fh QUALIFY rank <= 10),
al AS (SELECT query_id, doc_id, 0 AS part, rank AS r, term_no FROM tr UNION ALL SELECT query_id, doc_id, 1, rank, -1 FROM fr),
fi AS (SELECT query_id, doc_id, min(struct_pack(p := part, r := r, t := term_no)) AS f FROM al GROUP BY ALL)
SELECT query_id, doc_id, CAST(f.t AS INT) AS term, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, doc_id) AS INT) AS pos FROM fi QUALIFY pos <= 10""")
def comparison_retrieval(spark, sf):
    """Equal questions have equal answers, so each wording is answered once; its terms and the whole of it are looked for together."""
    asked = _asked_questions(spark, sf)
    first = stage(asked.where("q IS NOT NULL").groupBy("q").agg(F.min("id").alias("id")), "questions")
    terms = first.select("id", F.posexplode(X.comparison_terms(F.col("q"))).alias("no", "text"))
    whole = first.join(terms.select("id").distinct(), "id", "left_semi").select("id", F.lit(WHOLE).alias("no"), F.col("q").alias("text"))
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    hits = R.overlap_top(docs, terms.unionByName(whole).select((F.col("id") * (1 << 16) + F.col("no")).alias("query_id"), "text"), 10)
    no = F.pmod("query_id", F.lit(1 << 16)).cast("int")
    hits = hits.select(F.shiftright("query_id", 16).alias("query_id"), no.alias("term_no"), "doc_id", "rank")
    merged = X.balanced_merge(hits.where(F.col("term_no") < WHOLE), hits.where(F.col("term_no") == WHOLE), 10)
    return asked.join(first.select("q", F.col("id").alias("query_id")), "q").join(merged, "query_id").select(F.col("id").alias("query_id"), "doc_id", "term", "pos")


@query(f"""WITH {QUESTIONS}, n AS (SELECT id, q, trim(regexp_replace(regexp_replace(strip_accents(lower(q)), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM qs),
w AS (SELECT id, q, string_split(t, ' ') AS w, t FROM n),
h AS (SELECT *, list_has_any(w, {X.OVERVIEW_INTENTS}) AS i, list_has_any(w, {X.COURSE_WORDS}) AS c, list_has_any(w, ['this', 'that', 'it', 'all', 'everything', 'these', 'ce', 'cette', 'tout']) AS v FROM w)
SELECT id, regexp_matches(q, '{X.FORMULA}') AS formula, t <> '' AND ((i AND c) OR ((i OR (list_contains(w, 'about') AND c)) AND v AND len(w) <= 8)) AS overview FROM h""")
def question_kinds(spark, sf):
    return _asked_questions(spark, sf).select("id", F.col("q").rlike(X.FORMULA).alias("formula"), X.overview_question(F.col("q")).alias("overview"))


_TERMS = "list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', 'calculate y of the', title)), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 2))"


@query(f"""{SECT}, f AS (SELECT doc_id, section, text, {_TERMS} AS t FROM se WHERE regexp_matches(text, '{X.MATH}')),
o AS (SELECT doc_id, section, len(list_filter(t, lambda w: contains(lower(text), w))) AS o, least(len(regexp_extract_all(text, '{X.MATH}')), 6) AS d FROM f),
s AS (SELECT doc_id, section, round((o * 4 + d) * CASE WHEN o = 0 THEN 0.35::DOUBLE ELSE 1 END, 6) AS score FROM o)
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, section) AS INT) AS rank FROM s QUALIFY rank <= 4""")
def formula_sections(spark, sf):
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", F.lit("calculate y of the"), "title")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    terms = F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))
    s = _sections(spark, sf).select("doc_id", "section", X.formula_score(F.col("text"), terms).cast("double").alias("score")).where("score IS NOT NULL")
    return R.top_k(s, 4, per="doc_id", item="section")


@query(f"""{FEATURES} SELECT doc_id, section, md5(concat_ws(chr(10), text, array_to_string(path, ' > '), title, CASE WHEN len(concepts) > 0 THEN array_to_string(concepts, chr(10)) END)) AS lexical,
  md5(concat_ws(chr(10) || chr(10), text, 'Section path: ' || array_to_string(path, ' > '), CASE WHEN len(concepts) > 0 THEN 'Key concepts: ' || array_to_string(concepts, ', ') END,
  'Likely student questions:' || chr(10) || '- What does ' || title || ' explain?')) AS labelled,
  md5(concat_ws(chr(10), text, array_to_string(path, ' > '), CASE WHEN len(equations) > 0 THEN array_to_string(equations, chr(10)) END)) AS local FROM fe""")
def searchable_texts(spark, sf):
    t, nl = F.col("text"), F.lit("\n")
    s = _sections(spark, sf).withColumn("c", S.key_concepts(t)).withColumn("e", S.equations(t)).withColumn("p", path())
    lines = lambda c: F.when(F.size(c) > 0, F.array_join(c, "\n"))
    named = F.when(F.size("c") > 0, F.concat(F.lit("Key concepts: "), F.array_join("c", ", ")))
    asked = F.concat(F.lit("Likely student questions:"), nl, F.lit("- What does "), F.col("title"), F.lit(" explain?"))
    return s.select(
        "doc_id", "section", F.md5(F.concat_ws("\n", t, "p", "title", lines("c"))).alias("lexical"),
        F.md5(F.concat_ws("\n\n", t, F.concat(F.lit("Section path: "), "p"), named, asked)).alias("labelled"), F.md5(F.concat_ws("\n", t, "p", lines("e"))).alias("local"),
    )


DENSE = """dn AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings d),
dnr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM dn QUALIFY rank <= 10)"""


def _dense_top(spark, sf, k=10):
    v = _vectors(spark, sf)
    asked = v.join(_questions(spark, sf).select(F.col("query_id").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("query_id"), "embedding")
    return R.top_k(R.dense(v, asked, k), k)


#: Candidates of each list before they are fused.
CANDIDATES = 80


@query(f"""WITH {BM25}, {DENSE},
b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, 0 AS l FROM dn QUALIFY rank <= {CANDIDATES}
  UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, 1 FROM bm QUALIFY rank <= {CANDIDATES}),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(struct_pack(l := l, r := rank)) AS m FROM b GROUP BY ALL)
SELECT query_id, doc_id, score, m.l AS first_list, m.r AS first_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_retrieval(spark, sf):
    return R.top_k(R.reciprocal_rank_fusion(_dense_top(spark, sf, CANDIDATES), R.top_k(_bm25(spark, sf), CANDIDATES)), 10)


@query(f"""WITH {BM25}, {OVERLAP}, {DENSE}, gold AS (SELECT query_id, doc_id FROM orr WHERE rank <= 3),
b AS (SELECT query_id, doc_id, rank, 0 AS l FROM dnr UNION ALL SELECT query_id, doc_id, rank, 1 FROM bmr),
f0 AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s FROM b GROUP BY ALL),
f AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM f0),
v AS (SELECT 'semantic' AS variant, query_id, doc_id FROM dnr WHERE rank <= 5 UNION ALL SELECT 'bm25', query_id, doc_id FROM bmr WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, doc_id FROM f WHERE rank <= 5),
h AS (SELECT variant, query_id, count(gold.doc_id)::DOUBLE / 3 AS recall, count(gold.doc_id)::DOUBLE / 5 AS prec FROM v LEFT JOIN gold USING (query_id, doc_id) GROUP BY ALL)
SELECT variant, count(*) AS n_cases, round(avg(recall), 4) AS recall_5, round(avg(prec), 4) AS precision_5 FROM h GROUP BY ALL""")
def hybrid_comparison(spark, sf):
    dense, bm = _dense_top(spark, sf), _bm25_top(spark, sf)
    both = {"semantic": dense, "bm25": bm, "hybrid": R.top_k(R.reciprocal_rank_fusion(dense, bm), 5)}
    rows = [d.where("rank <= 5").select(F.lit(name).alias("variant"), "query_id", "doc_id") for name, d in both.items()]
    gold = _overlap_top(spark, sf).where("rank <= 3").select("query_id", "doc_id", F.lit(1).alias("hit"))
    per = rows[0].unionByName(rows[1]).unionByName(rows[2]).join(gold, ["query_id", "doc_id"], "left").groupBy("variant", "query_id").agg(F.count("hit").alias("h"))
    return per.groupBy("variant").agg(F.count(F.lit(1)).alias("n_cases"), F.round(F.avg(F.col("h") / 3), 4).alias("recall_5"), F.round(F.avg(F.col("h") / 5), 4).alias("precision_5"))


_SUM = "CASE WHEN contains(sm, chr(1)) THEN replace(sm, chr(1), ' ') ELSE sm END"


@query(f"""{FEATURES}, w AS (SELECT doc_id, section, array_to_string(path, ' > ') AS p, {_SUM} AS s, text, lag(text) OVER (PARTITION BY doc_id ORDER BY section) AS b, lead(text) OVER (PARTITION BY doc_id ORDER BY section) AS a FROM fe),
x AS (SELECT doc_id, section, list_filter(['Section path: ' || p, 'Section summary: ' || s, b, a, 'Focused chunk:' || chr(10) || text], lambda z: z IS NOT NULL) AS l FROM w),
y AS (SELECT doc_id, section, list_filter(l, lambda z, i: list_position(list_transform(l, lambda q: trim(regexp_replace(q, '\\s+', ' ', 'g'))), trim(regexp_replace(z, '\\s+', ' ', 'g'))) = i) AS l FROM x),
z AS (SELECT doc_id, section, len(l) AS n, array_to_string(list_transform(l, lambda q: trim(q, ' ' || chr(10) || chr(9))), chr(10) || chr(10)) AS t FROM y)
SELECT doc_id, section, CAST(n AS INT) AS n_parts, md5(CASE WHEN length(t) > 300 THEN regexp_replace(substr(t, 1, 300), ' [^ ]*$', '') ELSE t END) AS digest FROM z""")
def expanded_context(spark, sf):
    s = _sections(spark, sf).select("doc_id", "section", path().alias("path"), S.summary(F.col("text")).alias("summary"), "text")
    return X.expanded(s, 300).select("doc_id", "section", "n_parts", F.md5("text").alias("digest"))


@query(f"""{SECT}, m AS (SELECT doc_id, section, text, regexp_matches(text, '\\$\\$') AS i FROM se), n AS (SELECT *, count(*) FILTER (i) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS r FROM m)
SELECT doc_id, section, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section) AS INT) AS pos, md5(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 360)) AS digest FROM n WHERE (n > 0 AND i) OR (n = 0 AND r <= 2) QUALIFY pos <= 4""")
def section_citations(spark, sf):
    s = _sections(spark, sf).select("doc_id", "section", "text")
    found = X.citations(s, F.contains("text", F.lit("$$")), "doc_id", "section")
    return found.select("doc_id", "section", "pos", F.md5("snippet").alias("digest"))


_F = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_NW = f"len(list_filter(string_split({_F}, ' '), lambda w: w <> ''))"
_LNS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""{SECT}, p AS (SELECT doc_id, section, title, array_to_string(path, ' > ') AS path, text, {_F} AS f, lower({_F}) AS l FROM se)
SELECT doc_id, section,
  regexp_matches(lower(path), 'contents|index') OR f = '' OR contains(l, '*index*') OR starts_with(l, 'index ') OR (contains(substr(l, 1, 120), 'contents') AND length(f) < 1200)
    OR (starts_with(f, '- ') AND length(f) < 500 AND len(regexp_extract_all(f, '\\b\\d{{1,4}}\\b')) >= 2) OR (len(regexp_extract_all(f, '\\b[A-Z][A-Za-z''(),.\\- ]{{3,80}}\\s+\\d{{1,4}}\\b')) >= 3 AND length(f) < 1600) AS navigation,
  {_NW} <= 4 OR l = lower(title) OR (len({_LNS}) >= 3 AND len(list_filter({_LNS}, lambda x: len(string_split_regex(x, '\\s+')) <= 8 AND NOT regexp_matches(x, '[.!?:;]$'))) >= 0.7 * len({_LNS})) AS structure_only,
  {_NW} < 85 OR l = lower(title) OR (len(regexp_extract_all(f, '[.!?](?:\\s|$)')) < 3 AND {_NW} < 130) AS thin,
  lower(trim(title)) = '' OR regexp_matches(lower(trim(title)), '^(contents?|index|references|bibliography|questions?|thank you|merci|agenda|plan|outline|slide \\d+|page \\d+)$') OR regexp_matches(lower(path), '\\b(plan de|agenda|table of contents|contents)\\b')
    OR regexp_matches(lower(path), '\\b(university|universite|ecole|school|college|faculty|faculte|professor|enseignant)\\b') OR regexp_matches(lower(trim(title)), '^(master|degree|program) ') OR length(f) < 24 OR length(title) > 140 AS noisy FROM p""")
def section_predicates(spark, sf):
    p, title, text = path(), F.col("title"), F.col("text")
    return _sections(spark, sf).select(
        "doc_id", "section", X.navigation(p, text).alias("navigation"), X.structure_only(title, text).alias("structure_only"), X.thin(title, text).alias("thin"),
        X.noisy_section(p, title, text).alias("noisy"),
    )


FILES = """fl AS (SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'lecture_' || s_suppkey || '.pdf' WHEN 1 THEN 'Chapter ' || ['I', 'IV', 'IX', 'XII', 'XL'][s_suppkey % 5 + 1] || '.pdf' WHEN 2 THEN 'notes 2024-0' || (s_suppkey % 9 + 1) || '-12.md'
  WHEN 3 THEN 'exercise ' || s_suppkey || '.pdf' WHEN 4 THEN 'intro.md' ELSE 'b' || s_suppkey || '_text.txt' END AS filename, s_name AS title FROM supplier)"""


@query(rf"""WITH {FILES}, b AS (SELECT *, filename || ' file' AS b FROM fl),
t AS (SELECT *, regexp_extract(b, '{X.SEQUENCE}', 1) AS t FROM b),
s AS (SELECT *, CASE WHEN regexp_matches(b, '{X.SUPPLEMENT}') THEN 1 ELSE 0 END AS sup,
  coalesce(CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '^[0-9]+$') THEN CAST(t AS INT) ELSE CASE lower(t) WHEN 'i' THEN 1 WHEN 'iv' THEN 4 WHEN 'ix' THEN 9 WHEN 'xii' THEN 12 WHEN 'xl' THEN 40 END END,
  CASE WHEN regexp_matches(b, '{X.ISO_DATE}') THEN CAST(regexp_extract(b, '{X.ISO_DATE}', 1) AS INT) * 10000 + CAST(regexp_extract(b, '{X.ISO_DATE}', 2) AS INT) * 100 + CAST(regexp_extract(b, '{X.ISO_DATE}', 3) AS INT) END,
  CASE WHEN regexp_matches(filename, '[0-9]') THEN CAST(regexp_extract(filename, '([0-9]{{1,8}})', 1) AS INT) END) AS n FROM t)
SELECT id, sup AS supplemental, n AS sequence, CAST(row_number() OVER (PARTITION BY sup ORDER BY n IS NULL, n, lower(filename), id) AS INT) AS pos FROM s""")
def document_order(spark, sf):
    k = F.col("s_suppkey")
    s = lambda x: x.cast("string")
    numeral = F.get(F.array(*map(F.lit, ("I", "IV", "IX", "XII", "XL"))), (k % 5).cast("int"))
    name = (
        F.when(k % 6 == 0, F.concat(F.lit("lecture_"), s(k), F.lit(".pdf"))).when(k % 6 == 1, F.concat(F.lit("Chapter "), numeral, F.lit(".pdf")))
        .when(k % 6 == 2, F.concat(F.lit("notes 2024-0"), s(k % 9 + 1), F.lit("-12.md"))).when(k % 6 == 3, F.concat(F.lit("exercise "), s(k), F.lit(".pdf")))
        .when(k % 6 == 4, "intro.md").otherwise(F.concat(F.lit("b"), s(k), F.lit("_text.txt")))
    )
    f = table(spark, sf, "supplier").select(k.alias("id"), name.alias("filename"))
    keys = X.document_order(F.col("filename"), F.lit("file"))
    f = f.withColumn("supplemental", keys[0]).withColumn("_none", keys[1]).withColumn("sequence", keys[2]).withColumn("_name", keys[3])
    pos = F.row_number().over(Window.partitionBy("supplemental").orderBy("_none", "sequence", "_name", "id"))
    return f.select("id", "supplemental", "sequence", pos.alias("pos"))


@query(f"""{SECT}, i AS (SELECT doc_id, section, level, row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM se),
t AS (SELECT *, CASE WHEN level <= 2 THEN row_number() OVER (PARTITION BY doc_id, level <= 2 ORDER BY section) END AS top FROM i),
k AS (SELECT *, count(*) FILTER (top <= 3) OVER (PARTITION BY doc_id) AS k FROM t),
r AS (SELECT doc_id, section, CASE WHEN n <= 6 OR coalesce(top <= 3, false) THEN 0 WHEN i % greatest(1, n // greatest(1, 6 - k)) = 0 THEN 1 ELSE 2 END AS tier FROM k)
SELECT doc_id, section, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tier, section) AS INT) AS pos FROM r QUALIFY pos <= 6""")
def section_selection(spark, sf):
    return X.select_sections(_sections(spark, sf), 6)


@query(f"""{SECT} SELECT doc_id, count(*) AS n_sections, CAST(CASE WHEN count(*) <= 10 THEN greatest(4, count(*)) WHEN count(*) <= 30 THEN 10 ELSE 14 END AS BIGINT) AS budget FROM se GROUP BY doc_id""")
def section_budgets(spark, sf):
    g = _sections(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"))
    return g.withColumn("budget", X.section_budget(F.col("n_sections")).cast("bigint"))


@query("""WITH c AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1 AS f FROM documents),
t AS (SELECT source, doc_id, CASE WHEN f THEN 0 WHEN i % greatest(1, n // 12) = 0 THEN 1 END AS tier FROM c)
SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY tier, doc_id) AS INT) AS pos FROM t WHERE tier IS NOT NULL QUALIFY pos <= 12""")
def broad_sample(spark, sf):
    return X.broad_sample(_docs(spark, sf), "source", "lang", "doc_id", 12)


@query("""WITH n AS (SELECT p_partkey AS node, p_partkey * 10 AS chunk FROM part), s AS (SELECT n_nationkey AS query_id, s_suppkey AS node, round(s_acctbal, 2) AS score FROM supplier JOIN nation ON n_nationkey = s_nationkey),
b AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS r FROM s QUALIFY r <= 8),
e AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target, l_suppkey * 100000 + l_partkey AS chunk FROM lineitem), x AS (SELECT source AS node, target AS far, chunk FROM e UNION ALL SELECT target, source, chunk FROM e),
a AS (SELECT query_id, chunk, 0 AS p, r FROM b JOIN n USING (node) UNION ALL SELECT query_id, chunk, 1, r FROM b JOIN x USING (node) UNION ALL SELECT query_id, n.chunk, 2, r FROM b JOIN x USING (node) JOIN n ON n.node = x.far),
f AS (SELECT query_id, chunk, min(struct_pack(p := p, r := r)) AS f FROM a GROUP BY ALL)
SELECT query_id, chunk, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, chunk) AS INT) AS pos, round(greatest(0.65::DOUBLE, 1 - 0.03::DOUBLE * (row_number() OVER (PARTITION BY query_id ORDER BY f, chunk) - 1)), 6) AS score FROM f""")
def graph_chunk_ranking(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") * 10).alias("chunk"))
    scores = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("node"), F.round("s_acctbal", 2).alias("score"))
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    return X.graph_chunks(scores, nodes, e.withColumn("chunk", F.col("source") * 100000 + F.col("target")))


_STOP = tuple(STOPWORDS)


def _ct(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda z: z NOT IN {_STOP})"


@query(f"""WITH a AS (SELECT c.conv_id * 1000 + c.turn AS answer_id, c.text AS response, b.text AS evidence FROM conversations c JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1 WHERE c.role = 'assistant'),
s AS (SELECT answer_id, list_distinct({_ct('evidence')}) AS known, list_filter(list_transform(string_split(regexp_replace(response, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda p: {_ct('p')}), lambda p: len(p) > 0) AS said FROM a),
g AS (SELECT answer_id, CASE WHEN len(said) = 0 THEN 0.0::DOUBLE ELSE round(list_sum(list_transform(said, lambda p: len(list_filter(p, lambda w: list_contains(known, w)))::DOUBLE / len(p))) / len(said), 6) END AS groundedness,
  CASE WHEN len(known) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS coverage FROM s),
c AS (SELECT *, round(0.7::DOUBLE * groundedness + 0.3::DOUBLE * coverage, 3) AS confidence FROM g)
SELECT *, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS label FROM c""")
def groundedness_confidence(spark, sf):
    c = table(spark, sf, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    rows = c.where("role = 'assistant'").join(before, ["conv_id", "turn"])
    return R.groundedness(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.col("text").alias("response"), "evidence", F.col("evidence").alias("query")))


@query(f"""WITH {BM25}, {OVERLAP}, gold AS (SELECT query_id, doc_id FROM orr WHERE rank <= 3),
sx AS (SELECT query_id, doc_id, rank, source FROM bmr JOIN documents USING (doc_id)),
rr AS (SELECT query_id, doc_id FROM gold UNION SELECT query_id, doc_id FROM sx WHERE contains(source, 'src1')),
nn AS (SELECT query_id, count(*) AS n FROM rr GROUP BY ALL),
h AS (SELECT sx.query_id, count(rr.doc_id) FILTER (rank <= 5) AS h, bool_or(contains(source, 'src1')) AS hit FROM sx LEFT JOIN rr USING (query_id, doc_id) GROUP BY ALL)
SELECT query_id, n AS n_relevant, round(coalesce(h, 0)::DOUBLE / n, 6) AS recall_5, CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS source_hit, coalesce(h, 0) = 0 AS failed FROM nn LEFT JOIN h USING (query_id)""")
def resolved_relevance(spark, sf):
    gold = _overlap_top(spark, sf).where("rank <= 3").select("query_id", "doc_id")
    found = _bm25_top(spark, sf).join(_docs(spark, sf).select("doc_id", "source"), "doc_id")
    return R.resolved_metrics(found, gold, "src1", 5)


@query("""WITH m AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'text' WHEN 1 THEN 'chat' WHEN 2 THEN 'quiz' WHEN 3 THEN 'report' WHEN 4 THEN 'presentation' WHEN 5 THEN 'podcast' WHEN 6 THEN 'chart' WHEN 7 THEN 'diagram' ELSE 'mindmap' END AS o FROM events)
SELECT o AS output, CASE WHEN o IN ('text', 'chat') THEN 'semantic_topk' WHEN o = 'quiz' THEN 'coverage_broad' WHEN o = 'podcast' THEN 'narrative_arc' WHEN o IN ('chart', 'diagram') THEN 'relationship_dense' ELSE 'topic_clusters' END AS mode, count(*) AS n FROM m GROUP BY ALL""")
def output_policy(spark, sf):
    output = F.get(F.array(*map(F.lit, X.MODES)), (F.col("event_id") % len(X.MODES)).cast("int"))
    mode = F.element_at(F.create_map(*[F.lit(x) for kv in X.MODES.items() for x in kv]), F.col("output"))
    return table(spark, sf, "events").select(output.alias("output")).groupBy("output").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", mode)


@query(f"""{FEATURES}, h AS (SELECT doc_id, section, text FROM se WHERE contains(text, 'Total cost')),
u AS (SELECT doc_id, section, 'summary' AS kind, 0 AS l, {_SUM} AS t FROM fe WHERE (doc_id, section) IN (SELECT doc_id, section FROM h) UNION ALL SELECT doc_id, section, 'hit', 1, text FROM h)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l, section) AS INT) AS pos, section, kind, md5(t) AS digest FROM u""")
def topic_context(spark, sf):
    hits = _sections(spark, sf).where(F.contains("text", F.lit("Total cost")))
    rows = hits.select("doc_id", "section", F.explode(F.array(
        F.struct(F.lit(0).alias("l"), F.lit("summary").alias("kind"), S.summary(F.col("text")).alias("t")), F.struct(F.lit(1).alias("l"), F.lit("hit").alias("kind"), F.col("text").alias("t")))).alias("x"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("x.l", "section"))
    return rows.select("doc_id", pos.alias("pos"), "section", "x.kind", F.md5("x.t").alias("digest"))


@query(f"""{SECT}, c AS (SELECT doc_id, section, CAST(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY section) AS BIGINT) AS used FROM se) SELECT doc_id, count(*) FILTER (used <= 650) AS n_sections, max(used) FILTER (used <= 650) AS n_chars FROM c GROUP BY doc_id""")
def module_packs(spark, sf):
    running = F.sum(F.length("text") + 2).over(Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, 0))
    used = _sections(spark, sf).select("doc_id", running.alias("used"))
    fits = F.when(F.col("used") <= 650, F.col("used"))
    return used.groupBy("doc_id").agg(F.count(fits).alias("n_sections"), F.max(fits).alias("n_chars"))


@query(f"""{SECT} SELECT count(DISTINCT doc_id) AS n_files, count(*) AS n_sections, CAST(sum(length(text)) AS BIGINT) AS n_chars, array_to_string(list_sort(list(DISTINCT CAST(level AS VARCHAR))), ',') AS levels FROM se""")
def context_inspection(spark, sf):
    return _sections(spark, sf).agg(
        F.countDistinct("doc_id").alias("n_files"), F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("text")).alias("n_chars"),
        F.array_join(F.array_sort(F.collect_set(F.col("level").cast("string"))), ",").alias("levels"),
    )

