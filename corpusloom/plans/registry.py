"""The library's operators bound to the driver's tables, with DuckDB SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import acronym, cosine, low_information
from corpusloom.operators import documents as D
from corpusloom.operators import learning as L
from corpusloom.operators import ordering as O
from corpusloom.operators import retrieval as R
from corpusloom.session import files_of, stage
from corpusloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_WRITTEN: dict[tuple[str, tuple], DataFrame] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("learner"), F.col("event_type").alias("concept"), F.col("event_id").alias("seq"),
        (F.col("value") / 100).alias("score"), (F.col("event_id") % 2 == 0).alias("applied"),
        F.when(F.col("value") >= 60, "demonstrated").when(F.col("value") < 25, "struggled").otherwise("covered").alias("op"),
    )


TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
BM25 = f"""
d AS (SELECT doc_id, {TOKENS} AS t FROM documents),
p0 AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM p0 GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
i0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, s GROUP BY term, n),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i0) ELSE raw END AS idf FROM i0),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM p JOIN i USING (term) JOIN q USING (term), s GROUP BY ALL),
bmr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM bm QUALIFY rank <= 10)"""
OVERLAP = f"""
o AS (
  SELECT query_id, doc_id, round(sum(least(tf, qtf)) / sqrt(greatest(max(dl), 1)), 6) AS score
  FROM p JOIN q USING (term) GROUP BY ALL),
orr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM o QUALIFY rank <= 10)"""


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    """Written once for each application and state of the documents' files: every list of a query is ranked from it."""
    key = (spark.sparkContext.applicationId, files_of(spark, f"{sf}/documents.parquet"))
    if key not in _WRITTEN:
        _WRITTEN[key] = stage(R.postings(_docs(spark, sf)), "postings")
    return _WRITTEN[key]


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(_postings(spark, sf), _docs(spark, sf), _questions(spark, sf))


def _bm25_top(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(_bm25(spark, sf), 10)


def _overlap_top(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(R.overlap_scores(_postings(spark, sf), _questions(spark, sf)), 10)


@query(f"WITH {BM25} SELECT * FROM bmr")
def bm25_topk(spark, sf):
    return _bm25_top(spark, sf)


@query(f"WITH {BM25} SELECT * FROM bmr WHERE score > 0")
def bm25_local_positive(spark, sf):
    return R.top_k(_bm25(spark, sf).where("score > 0"), 10)


@query(f"WITH {BM25}, {OVERLAP} SELECT * FROM orr")
def bm25_fallback_overlap(spark, sf):
    return _overlap_top(spark, sf)


@query(f"""WITH {BM25}, {OVERLAP},
b AS (SELECT query_id, doc_id, rank, 0 AS l FROM bmr UNION ALL SELECT query_id, doc_id, rank, 1 FROM orr),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(struct_pack(l := l, r := rank)) AS m FROM b GROUP BY ALL)
SELECT query_id, doc_id, score, m.l AS first_list, m.r AS first_rank,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM f QUALIFY rank <= 10""")
def rrf_fusion(spark, sf):
    return R.top_k(R.reciprocal_rank_fusion(_bm25_top(spark, sf), _overlap_top(spark, sf)), 10)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM embeddings, q)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 10""")
def dense_topk(spark, sf):
    return R.top_k(R.dense(_vectors(spark, sf), _asked(spark, sf), 10), 10)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM embeddings, q WHERE label = 3)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""")
def dense_filtered_by_label(spark, sf):
    return R.top_k(R.dense(_vectors(spark, sf).where("label = 3"), _asked(spark, sf), 10, low=0.0), 10)


@query("""SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf):
    v = _vectors(spark, sf)
    a = v.select(F.col("doc_id").alias("left_id"), F.col("embedding").alias("a"), (F.col("doc_id") + 1).alias("right_id"))
    b = v.select(F.col("doc_id").alias("right_id"), F.col("embedding").alias("b"))
    return a.join(b, "right_id").select("left_id", "right_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("score"))


@query()
def mmr_coverage(spark, sf):
    pool = R.top_k(_bm25(spark, sf), 30)
    return R.marginal_relevance(pool.join(_docs(spark, sf).select("doc_id", "text"), "doc_id"), _questions(spark, sf), 10)


@query(f"""WITH {BM25}, {OVERLAP},
gold AS (SELECT query_id, doc_id FROM orr WHERE rank <= 3), n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY ALL),
h AS (SELECT bmr.query_id, rank, CASE WHEN gold.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM bmr LEFT JOIN gold USING (query_id, doc_id)),
k AS (SELECT unnest([1, 3, 5]) AS k),
e AS (SELECT query_id, k, sum(CASE WHEN rank <= k THEN hit ELSE 0 END) AS h, count(*) FILTER (rank <= k) AS m,
        coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (rank <= k AND hit = 1), 0) AS d, min(rank) FILTER (rank <= k AND hit = 1) AS f
      FROM h, k GROUP BY ALL),
z AS (SELECT e.*, n, list_sum(list_transform(range(1, least(n, m) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS ideal FROM e JOIN n USING (query_id))
SELECT query_id AS case_id, {', '.join(f'''max(CAST(h > 0 AS DOUBLE)) FILTER (k = {k}) AS hit_rate_{k},
  max(round(h::DOUBLE / k, 6)) FILTER (k = {k}) AS precision_{k}, max(round(h::DOUBLE / n, 6)) FILTER (k = {k}) AS recall_{k},
  max(round(coalesce(1.0::DOUBLE / f, 0), 6)) FILTER (k = {k}) AS mrr_{k}, max(round(d / ideal, 6)) FILTER (k = {k}) AS ndcg_{k}''' for k in (1, 3, 5))}
FROM z GROUP BY ALL""")
def eval_case_metrics(spark, sf):
    gold = _overlap_top(spark, sf).where("rank <= 3").select(F.col("query_id").alias("case_id"), "doc_id")
    ranking = _bm25_top(spark, sf).select(F.col("query_id").alias("case_id"), "doc_id", "rank")
    return R.ranking_metrics(ranking, gold)


_METRICS = [f"{name}_{k}" for k in (1, 3, 5) for name in ("hit_rate", "precision", "recall", "mrr", "ndcg")]


@query(f"SELECT {', '.join(f'round(avg({c}), 4) AS {c}' for c in _METRICS)} FROM ({SQL['eval_case_metrics']})")
def eval_summary(spark, sf):
    per = QUERIES["eval_case_metrics"](spark, sf)
    return per.agg(*[F.round(F.avg(c), 4).alias(c) for c in per.columns if c != "case_id"])


@query(f"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents)
SELECT doc_id FROM t WHERE NOT (length(text) < 18 OR len({TOKENS}) <= 3
  OR regexp_matches(lower(text), '^(page|slide)?\\s*\\d+(\\s*(/|of)\\s*\\d+)?$|^(thank you|questions)[.!?]*$')
  OR (length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) < 8 AND length(text) < 80)
  OR (len(list_distinct({TOKENS})) <= 2 AND length(text) < 80))""")
def low_information_filter(spark, sf):
    return _docs(spark, sf).where(~low_information(F.col("text"))).select("doc_id")


#: Phrases of slide furniture, and words of footers.
_DROP = " OR ".join(f"contains(norm, '{p}')" for p in D.NOISE_PHRASES)


def clean_sql(source: str, key: str = "doc_id") -> str:
    step = "raw"
    for pattern, by in D.LINE_RULES:
        step = f"regexp_replace({step}, '{pattern}', '{by}', 'g')"
    step = f"trim(regexp_replace(trim({step.replace('raw', 'trim(raw)', 1)}), '[ \\t]{{2,}}', ' ', 'g'), ' |•' || chr(9))"
    return f"""
k0 AS (SELECT {key} AS doc_id, regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?s)<!--.*?-->', ' ', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)|(?i:<img\\b[^>]*>)', ' ', 'g') AS text FROM {source}),
k1 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM k0),
k2 AS (SELECT doc_id, i, {step} AS line FROM k1),
k3 AS (SELECT doc_id, i, line, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS norm FROM k2 WHERE line <> ''),
k4 AS (SELECT *, (length(line) - length(replace(line, '|', ''))) + (length(line) - length(replace(line, ' - ', ''))) / 3 + (length(line) - length(replace(line, ' / ', ''))) / 3 AS seps FROM k3
  WHERE norm <> '' AND NOT ({_DROP}) AND NOT regexp_matches(line, '{D.DOT_LEADER}') AND NOT regexp_matches(line, '{D.IMAGE_FILE}')
  AND NOT (length(line) >= 8 AND length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 0.25 * length(line))),
k5 AS (SELECT * FROM k4 WHERE NOT (length(line) <= 180 AND regexp_matches(line, '{D.FOOTER_WORD}') AND (regexp_matches(line, '{D.COUNTER}') OR regexp_matches(line, '{D.MONTH_DATE}') OR seps >= 2 OR len(string_split(norm, ' ')) <= 10))),
k6 AS (SELECT doc_id, i, line, lag(norm) OVER (PARTITION BY doc_id ORDER BY i) AS b, norm FROM k5),
k7 AS (SELECT doc_id, CAST(i AS INT) AS line_no, line FROM k6 WHERE b IS NULL OR b <> norm)"""


@query(f"WITH {clean_sql('documents')} SELECT * FROM k7")
def clean_lines(spark, sf):
    return D.clean_lines(_docs(spark, sf))


@query(f"""WITH {clean_sql('documents')}, z AS (SELECT doc_id, count(*) AS n FROM k7 GROUP BY ALL)
SELECT doc_id, CAST(len(string_split(k0.text, chr(10))) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_kept,
       CAST(len(string_split(k0.text, chr(10))) AS BIGINT) - coalesce(n, 0) AS n_removed FROM k0 LEFT JOIN z USING (doc_id)""")
def clean_stats(spark, sf):
    return D.clean_stats(_docs(spark, sf))


@query(f"""WITH w AS (SELECT doc_id, unnest({TOKENS}) AS term, generate_subscripts({TOKENS}, 1) AS pos FROM documents),
c AS (SELECT doc_id, term, count(*) AS n_uses, min(pos) AS pos FROM w WHERE length(term) >= 5 GROUP BY ALL)
SELECT doc_id, term, n_uses, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n_uses DESC, pos) AS INT) AS rank FROM c QUALIFY rank <= 8""")
def key_terms_top8(spark, sf):
    return D.key_terms(_docs(spark, sf))


@query("""SELECT p_partkey, a AS acronym FROM (
  SELECT p_partkey, upper(array_to_string(list_transform(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+'), lambda w: w[1]), '')) AS a FROM part)
WHERE length(a) BETWEEN 2 AND 8""")
def acronyms(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", acronym(F.col("p_name")).alias("acronym"))
    return p.where("acronym IS NOT NULL")


@query("""SELECT a.conv_id, a.turn, b.turn AS near FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 AND a.turn <> b.turn""")
def neighbour_interval_join(spark, sf):
    return O.neighbours(table(spark, sf, "conversations"), "conv_id", "turn", 2)


@query("""SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def prev_next_link(spark, sf):
    return O.previous_and_next(table(spark, sf, "conversations"), "conv_id", "turn")


@query(f"""WITH {BM25}, {OVERLAP}, b AS (SELECT query_id, doc_id, 0 AS l, rank FROM bmr UNION ALL SELECT query_id, doc_id, 1, rank FROM orr),
f AS (SELECT query_id, doc_id, min(l * 100 + rank) AS m FROM b GROUP BY ALL)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m, doc_id) AS INT) AS pos FROM f""")
def ordered_union_dedupe(spark, sf):
    return O.ordered_union(_bm25_top(spark, sf), _overlap_top(spark, sf), key="query_id", item="doc_id")


EVENTS = """a AS (SELECT user_id AS learner, event_type AS concept, event_id AS seq, value / 100 AS score, event_id % 2 = 0 AS applied,
  CASE WHEN value >= 60 THEN 'demonstrated' WHEN value < 25 THEN 'struggled' ELSE 'covered' END AS op FROM events)"""
CHAT = EVENTS + """,
st AS (SELECT learner, concept, round(list_reduce(list_prepend(0.0::DOUBLE, list(CASE op WHEN 'demonstrated' THEN 1.0::DOUBLE WHEN 'struggled' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY seq)),
  lambda m, o: CASE WHEN o > 0.5 THEN m + 0.2 * (1 - m) WHEN o < -0.5 THEN m * 0.7 ELSE m END), 9) AS mastery,
  count(*) FILTER (op = 'struggled') AS n_struggled, count(*) AS n_events FROM a GROUP BY ALL)"""


@query(f"WITH {CHAT} SELECT * FROM st")
def mastery_fold_chat(spark, sf):
    return L.fold_chat(_answers(spark, sf))


@query(f"""WITH {EVENTS},
s AS (SELECT learner, concept, list(CASE WHEN score >= 0.85 THEN CASE WHEN applied THEN 4.0::DOUBLE ELSE 3.0::DOUBLE END WHEN score >= 0.6 THEN 2.0::DOUBLE WHEN score >= 0.25 THEN 1.5::DOUBLE ELSE 1.2::DOUBLE END ORDER BY seq) AS e, count(*) AS n_events FROM a GROUP BY ALL)
SELECT learner, concept, round(list_reduce(list_prepend(0.0::DOUBLE, e), lambda m, o: greatest(0.0, least(1.0,
  CASE WHEN o = 4.0 THEN m + 0.25 * (1 - m) WHEN o = 3.0 THEN m + 0.16 * (1 - m) WHEN o = 2.0 THEN m + 0.10 * (1 - m) WHEN o = 1.5 THEN m * 0.75 ELSE m * 0.60 END))), 9) AS mastery, n_events FROM s""")
def mastery_fold_assessment(spark, sf):
    return L.fold_assessments(_answers(spark, sf))


@query(f"""WITH {CHAT} SELECT learner, coalesce(string_agg(concept, ',' ORDER BY concept) FILTER (mastery >= 0.7), '') AS understood,
  coalesce(string_agg(concept, ',' ORDER BY concept) FILTER (mastery <= 0.3 AND n_struggled > 0), '') AS struggling FROM st GROUP BY ALL""")
def understood_lists(spark, sf):
    return L.understood_and_struggling(L.fold_chat(_answers(spark, sf)))


@query(f"""WITH {CHAT}, n AS (SELECT count(DISTINCT concept) AS n FROM a)
SELECT learner, round(sum(mastery) / n, 6) AS mean_mastery, count(*) FILTER (mastery >= 0.7) AS n_mastered, n AS n_concepts, CAST(sum(n_struggled) AS BIGINT) AS n_struggled FROM st, n GROUP BY learner, n""")
def progress_rollup(spark, sf):
    a = _answers(spark, sf)
    return L.progress(L.fold_chat(a), a.select("concept"))


@query(f"""WITH {CHAT} SELECT *, CAST(row_number() OVER (PARTITION BY learner ORDER BY mastery, n_events, concept) AS INT) AS rank FROM st QUALIFY rank <= 3""")
def weakest_concepts(spark, sf):
    return L.weakest(L.fold_chat(_answers(spark, sf)), 3)


@query("""WITH w AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS "window" FROM events),
g AS (SELECT user_id, "window", count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM w GROUP BY ALL)
SELECT user_id, "window", n, first, last, CAST(pending AS BIGINT) AS pending FROM (SELECT *, coalesce(sum(n) FILTER (n < 10) OVER (PARTITION BY user_id), 0) AS pending FROM g) WHERE n = 10""")
def review_count_windows(spark, sf):
    return O.count_windows(table(spark, sf, "events"), "user_id", "event_id", 10)


@query("""WITH i AS (SELECT user_id AS learner, event_id AS seq, sum(CASE WHEN value >= 85 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT learner, seq, row_number() OVER (PARTITION BY learner, g ORDER BY seq) - CASE WHEN g > 0 THEN 1 ELSE 0 END AS turns FROM i""")
def turns_since_progress(spark, sf):
    e = table(spark, sf, "events")
    return L.turns_since_progress(e.select(F.col("user_id").alias("learner"), F.col("event_id").alias("seq"), (F.col("value") >= 85).alias("progressed")))


@query("""WITH b AS (SELECT user_id AS learner, event_id % 7 AS chapter, max(value / 100) AS best FROM events GROUP BY ALL)
SELECT learner, chapter, best, CASE WHEN best >= 0.7 THEN 'completed' WHEN p IS NULL OR p >= 0.7 THEN 'available' ELSE 'locked' END AS state
FROM (SELECT *, lag(best) OVER (PARTITION BY learner ORDER BY chapter) AS p FROM b)""")
def chapter_unlock_lag(spark, sf):
    e = table(spark, sf, "events")
    return L.chapter_locks(e.select(F.col("user_id").alias("learner"), (F.col("event_id") % 7).alias("chapter"), (F.col("value") / 100).alias("score")))


@query("""SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS pos
FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20)""")
def last_n_tail(spark, sf):
    return O.last_n(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", 20)


@query("SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf):
    return O.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
WHERE n <= 7 OR i IN (SELECT CAST(round_even(j * (n - 1) / 6.0, 0) AS BIGINT) FROM range(0, 7) r(j))""")
def spread_pick(spark, sf):
    return O.spread_pick(_docs(spark, sf).select("source", "doc_id"), "source", "doc_id", 7)


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
WHERE i % greatest(1, n // 12) = 0 AND i / greatest(1, n // 12) < 12""")
def stride_sample(spark, sf):
    return O.stride_sample(_docs(spark, sf).select("source", "doc_id"), "source", "doc_id", 12)


@query("""SELECT source, doc_id, ((i + 1) * 5 - 1) // n AS "group" FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)""")
def even_groups(spark, sf):
    return O.even_groups(_docs(spark, sf).select("source", "doc_id"), "source", "doc_id", 5)


@query("""WITH t AS (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS turn FROM documents)
SELECT *, CAST(row_number() OVER (ORDER BY turn, source) AS INT) AS pos FROM t ORDER BY turn, source LIMIT 60""")
def round_robin(spark, sf):
    return O.round_robin(_docs(spark, sf).select("source", "doc_id"), "source", "doc_id", 60)


@query("""SELECT source, doc_id, n_chars, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 9000""")
def running_char_budget(spark, sf):
    return O.char_budget(_docs(spark, sf).select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 9000)


@query("""WITH t AS (SELECT source, count(*) AS total FROM documents GROUP BY ALL),
e AS (SELECT source, total, pos, slot, round(total * share, 9) AS x FROM t, (VALUES (0, 'struggling', 0.6), (1, 'review', 0.3), (2, 'stretch', 0.1)) v(pos, slot, share)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY x - floor(x) DESC, pos) AS k, total - sum(floor(x)) OVER (PARTITION BY source) AS l FROM e)
SELECT source, slot, CAST(floor(x) + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS n FROM r""")
def largest_remainder(spark, sf):
    totals = _docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    return O.largest_remainder(totals, "source", "total", {"struggling": 0.6, "review": 0.3, "stretch": 0.1})


#: Parts are nodes: parts of one order, next to each other by line, are linked.
EDGES = """e0 AS (SELECT l_orderkey, l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target,
  CASE WHEN l_linenumber = 1 THEN 'requires' ELSE 'supports' END AS relation, l_discount AS confidence FROM lineitem),
e AS (SELECT source, target, relation, confidence, l_orderkey AS evidence FROM e0 WHERE target IS NOT NULL AND source <> target)"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("source"), after.alias("target"), F.when(F.col("l_linenumber") == 1, "requires").otherwise("supports").alias("relation"),
        F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("evidence"),
    )
    return rows.where("target IS NOT NULL AND source != target")


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every part whose key is divisible by 20."""
    return table(spark, sf, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("node"))


@query(f"""WITH {EDGES} SELECT source, target, relation, max(confidence) AS confidence, string_agg(DISTINCT CAST(evidence AS VARCHAR), ',' ORDER BY CAST(evidence AS VARCHAR)) AS evidence FROM e GROUP BY ALL""")
def edge_dedupe_agg(spark, sf):
    return L.merge_edges(_edges(spark, sf))


@query(f"""WITH {EDGES}, b AS (SELECT source AS a, target AS b, confidence FROM e UNION ALL SELECT target, source, confidence FROM e)
SELECT a AS seed, b AS node, max(confidence) AS strength, CAST(row_number() OVER (PARTITION BY a ORDER BY max(confidence) DESC, b) AS INT) AS rank FROM b
WHERE a % 20 = 0 GROUP BY a, b QUALIFY rank <= 4""")
def one_hop(spark, sf):
    return L.one_hop(_edges(spark, sf), _seeds(spark, sf), 4)


@query(f"""WITH {EDGES}, r AS (SELECT DISTINCT source, target FROM e WHERE relation = 'requires'),
d1 AS (SELECT source AS seed, target AS node, 1 AS depth FROM r WHERE source % 20 = 0),
d2 AS (SELECT DISTINCT d1.seed, r.target AS node, 2 AS depth FROM d1 JOIN r ON r.source = d1.node)
SELECT seed, node, CAST(min(depth) AS INT) AS depth FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2) WHERE seed <> node GROUP BY ALL""")
def bfs_prereq_depth2(spark, sf):
    return L.prerequisites(_edges(spark, sf), _seeds(spark, sf), 2)


@query("""WITH d AS (SELECT o_custkey AS k, count(*) % 5 AS v FROM orders GROUP BY ALL), x AS (SELECT user_id AS k, count(*) % 5 AS v FROM events GROUP BY ALL)
SELECT k, CASE WHEN x.k IS NULL THEN 'insert' WHEN d.k IS NULL THEN 'deactivate' WHEN d.v = x.v THEN 'keep' ELSE 'update' END AS action FROM d FULL JOIN x USING (k)""")
def reconcile_full_outer(spark, sf):
    counted = lambda name, c: table(spark, sf, name).groupBy(F.col(c).cast("bigint").alias("k")).agg((F.count(F.lit(1)) % 5).alias("v"))
    return L.reconcile(counted("orders", "o_custkey"), counted("events", "user_id"), "k", "v")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_pending(spark, sf):
    return _docs(spark, sf).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_sections(spark, sf):
    return _docs(spark, sf).select("doc_id", "lang").join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def left_join_coalesce(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    q = F.coalesce("quality", F.lit(-1).cast(labels.schema["quality"].dataType))
    return _docs(spark, sf).select("doc_id").join(labels, "doc_id", "left").select("doc_id", q.alias("quality"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props_decode(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type""")
def snapshot_change_stream(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.withColumn("p", before).where("p IS NULL OR p != event_type").drop("p")


@query("""SELECT event_type AS kind, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'none', 0""")
def bloom_histogram(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return e.unionByName(spark.range(1).select(F.lit("none").alias("kind"), F.lit(0).cast("bigint").alias("n")))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))")
def question_dedupe(spark, sf):
    norm = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    return _docs(spark, sf).groupBy(F.sha2(norm, 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("h")


@query("SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY ALL ORDER BY last_turn DESC, conv_id LIMIT 50 OFFSET 10")
def paginated_list(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max("turn").alias("last_turn"))
    return c.orderBy(F.col("last_turn").desc(), "conv_id").offset(10).limit(50)
