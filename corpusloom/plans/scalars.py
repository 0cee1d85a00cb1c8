"""Text and vector functions, predicates and small rankings on the driver's tables, with DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import context as X
from corpusloom.operators import ordering as O
from corpusloom.operators import structure as S
from corpusloom.plans.course import FEATURES, R, _sections, path
from corpusloom.plans.registry import TOKENS, _docs, query, table

_FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _cut(expr: str, n: int) -> str:
    return f"CASE WHEN length({expr}) > {n} THEN regexp_replace(substr({expr}, 1, {n}), ' [^ ]*$', '') ELSE {expr} END"


@query(f"""WITH t AS (SELECT doc_id, {_FLAT.format('text')} AS f, text FROM documents)
SELECT doc_id, md5(f) AS compact, {_cut('f', 90)} AS short, CAST(CASE WHEN text = '' THEN 0 ELSE greatest(1, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 13 // 10) END AS INT) AS approx_tokens,
  CASE WHEN regexp_extract(f, '^(.{{40,220}}?[.!?])(?:\\s|$)', 1) <> '' THEN regexp_extract(f, '^(.{{40,220}}?[.!?])(?:\\s|$)', 1) ELSE substr(f, 1, 180) END AS first_sentence, substr(sha1(f), 1, 24) AS short_id FROM t""")
def text_measures(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text", T.flat(F.col("text")).alias("f"))
    first = F.regexp_extract("f", r"^(.{40,220}?[.!?])(?:\s|$)", 1)
    return d.select(
        "doc_id", F.md5("f").alias("compact"), T.shortened(F.col("f"), 90).alias("short"), S.approx_tokens(F.col("text")).alias("approx_tokens"),
        F.when(first != "", first).otherwise(F.substring("f", 1, 180)).alias("first_sentence"), F.substring(F.sha1("f"), 1, 24).alias("short_id"),
    )


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
SELECT vec_id, round(e[1] / n, 6) AS first, round(list_sum(list_transform(e, lambda x: x / n * (x / n))), 6) AS norm FROM v""")
def normalised_vectors(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", T.normalised_vector(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x), 6).alias("norm"))


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct({TOKENS}) AS t FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a.t, b.t))::DOUBLE / least(len(a.t), len(b.t)), 6) END AS score FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def overlap_pairs(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("t"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", T.overlap_coefficient(F.col("t"), F.col("u")).alias("score"))


@query("""SELECT o_orderkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(TRY_CAST(v AS DOUBLE), 0.0))) AS score, j AS json_part FROM (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey % 7 AS VARCHAR) || '.5' WHEN 1 THEN '0.' || (o_custkey % 10) WHEN 2 THEN 'none' END AS v,
  regexp_extract(CASE WHEN o_orderkey % 3 = 0 THEN 'Sure: ```json' || chr(10) || '{"a": ' || o_custkey || ', "b": {"c": 1}}' || chr(10) || '``` done' ELSE 'no answer' END, '(?s)\\{.*\\}', 0) AS j FROM orders)""")
def coerced_values(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    v = F.when(k % 4 == 0, F.concat((F.col("o_custkey") % 7).cast("string"), F.lit(".5"))).when(k % 4 == 1, F.concat(F.lit("0."), (F.col("o_custkey") % 10).cast("string"))).when(k % 4 == 2, "none")
    j = F.when(k % 3 == 0, F.concat(F.lit("Sure: ```json\n{\"a\": "), c, F.lit(", \"b\": {\"c\": 1}}\n``` done"))).otherwise("no answer")
    return table(spark, sf, "orders").select("o_orderkey", T.unit_number(v).alias("score"), T.json_part(j).alias("json_part"))


@query(f"""WITH t AS (SELECT doc_id, lang, {TOKENS} AS w FROM documents), s AS (SELECT doc_id, lang, {', '.join(f"len(list_filter(w, lambda x: x IN {tuple(k)})) AS {c}" for c, k in T.MARKERS.items())} FROM t)
SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'en' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS guess, lang FROM s""")
def language_guesses(spark, sf):
    return _docs(spark, sf).select("doc_id", T.language_guess(F.col("text")).alias("guess"), "lang")


@query(f"""{R}, l AS (SELECT doc_id, section, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM se),
c AS (SELECT doc_id, section, i, list_concat(list_transform(string_split(regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', ''), '|'), lambda c: trim(c)), ['', '', ''])[1:3] AS c FROM l WHERE regexp_matches(line, '^\\s*\\|.+\\|\\s*$'))
SELECT doc_id, section, CAST(i AS INT) AS line_no, c[1] AS a, c[2] AS b, c[3] AS c FROM c""")
def padded_table_cells(spark, sf):
    lines = _sections(spark, sf).select("doc_id", "section", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(S.TABLE_ROW))
    c = T.table_cells(F.col("line"), 3)
    return lines.select("doc_id", "section", "line_no", F.get(c, F.lit(0)).alias("a"), F.get(c, F.lit(1)).alias("b"), F.get(c, F.lit(2)).alias("c"))


@query(f"""{R}, p AS (SELECT doc_id, section, title, text, regexp_replace(text, '(?m)^\\s*\\|.+\\|\\s*$|^\\s*\\|?\\s*:?-{{3,}}:?\\s*(?:\\|\\s*:?-{{3,}}:?\\s*)+\\|?\\s*$', '', 'g') AS prose FROM se)
SELECT doc_id, section, md5(trim(regexp_replace(prose, '\\s+', ' ', 'g'))) AS prose, length(regexp_replace(text, '\\s', '', 'g')) >= 24 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 10 AS usable,
  CASE regexp_replace(trim(lower(title)), '[\\s-]+', '_', 'g') WHEN 'total_cost' THEN 'total_cost' WHEN '1._low_orders' THEN '1._low_orders' ELSE 'text' END AS kind FROM p""")
def prose_and_kinds(spark, sf):
    prose = F.regexp_replace("text", r"(?m)^\s*\|.+\|\s*$|^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$", "")
    return _sections(spark, sf).select(
        "doc_id", "section", F.md5(T.flat(prose)).alias("prose"), X.usable(F.col("text")).alias("usable"), X.one_of(F.col("title"), ("total_cost", "1._low_orders"), "text").alias("kind")
    )


@query(f"""WITH q0 AS (SELECT conv_id, turn, list_filter({TOKENS}, lambda w: length(w) >= 5) AS l FROM conversations), q AS (SELECT conv_id, turn, list_filter(l, lambda w, i: list_position(l, w) = i)[1:4] AS q FROM q0), c AS (SELECT conv_id, turn, {TOKENS} AS w, length(text) % 9 - 6 AS s FROM conversations),
e AS (SELECT q.conv_id, q.turn, len(q) > 0 AND len(list_intersect(q, w)) >= least(2, len(q)) AS e, s FROM q JOIN c ON c.conv_id = q.conv_id AND c.turn = q.turn + 1) SELECT conv_id, turn, e AS evidence, s < -2.0 AND NOT e AS refused FROM e""")
def context_evidence(spark, sf):
    terms = F.slice(F.array_distinct(F.filter(T.tokens(F.col("text")), lambda w: F.length(w) >= 5)), 1, 4)
    c = table(spark, sf, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    e = c.select("conv_id", "turn", terms.alias("q")).join(after, ["conv_id", "turn"]).withColumn("evidence", X.evidence(F.col("q"), F.col("after")))
    return e.select("conv_id", "turn", "evidence", X.off_topic(F.length("after") % 9 - 6, F.col("evidence")).alias("refused"))


_LT = "list_filter(regexp_extract_all(lower(array_to_string(path, ' ')), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 3)"


@query(f"""{R}, s AS (SELECT doc_id AS lesson, section AS chunk, round((CASE WHEN contains(lower(text), lower(path[1])) THEN 6.0::DOUBLE ELSE 0 END) + (CASE WHEN contains(lower(text), 'total cost') THEN 8.0::DOUBLE ELSE 0 END)
  + len(list_filter({_LT}, lambda t: contains(lower(text), t))) + least(3.0::DOUBLE, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) / 90.0::DOUBLE), 6) AS score FROM se)
SELECT lesson, chunk, score, CAST(row_number() OVER (PARTITION BY lesson ORDER BY score DESC, chunk) AS INT) AS rank FROM s QUALIFY rank <= 5""")
def lesson_ranking(spark, sf):
    s = _sections(spark, sf).select(F.col("doc_id").alias("lesson"), F.col("section").alias("chunk"), "path", "text")
    terms = F.filter(T.tokens(F.array_join("path", " ")), lambda w: F.length(w) > 3)
    return X.lesson_rank(s, terms, F.get("path", F.lit(0)), F.lit("Total cost"), 5).select("lesson", "chunk", "score", "rank")


@query(f"""{R} SELECT doc_id, section, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN regexp_matches(lower(text || CASE WHEN section % 4 = 1 THEN ' for instance' ELSE '' END), '\\b(example|for instance|e\\.g\\.|case study|exemple|par exemple)') THEN 0 ELSE 1 END, section) AS INT) AS pos FROM se""")
def examples_first(spark, sf):
    s = _sections(spark, sf).withColumn("text", F.concat("text", F.when(F.col("section") % 4 == 1, " for instance").otherwise("")))
    return X.examples_first(s, "doc_id", "section").select("doc_id", "section", "pos")


@query(f"""WITH p AS (SELECT p_brand, p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM part),
l AS (SELECT p_brand, list(struct_pack(k := p_partkey, w := w) ORDER BY p_partkey) AS l FROM p GROUP BY p_brand),
f AS (SELECT p_brand, list_reduce(list_prepend([]::STRUCT(k BIGINT, w VARCHAR[])[], list_transform(l, lambda x: [x])), lambda a, x: CASE WHEN len(list_filter(a, lambda z: len(list_intersect(z.w, x[1].w)) >= 0.55 * least(len(z.w), len(x[1].w)))) > 0 THEN a ELSE list_concat(a, x) END) AS r FROM l)
SELECT p_brand, unnest(list_transform(r, lambda z: z.k)) AS p_partkey FROM f""")
def near_copy_branches(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", T.tokens(F.concat_ws(" ", "p_name", "p_type")).alias("w"))
    return X.without_near_copies(p, "p_brand", "p_partkey", "w")


@query("""WITH t AS (SELECT p_brand, list(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END ORDER BY p_partkey) AS l FROM part GROUP BY p_brand)
SELECT p_brand, len(list_filter(l, lambda v, i: list_position(list_transform(l, lambda z: trim(lower(z))), trim(lower(v))) = i)) AS n, l[1] AS first FROM t""")
def ordered_name_dedupe(spark, sf):
    v = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name"))
    named = O.distinct_in_order(table(spark, sf, "part").select("p_brand", "p_partkey", v.alias("v")), "p_brand", "p_partkey", F.trim(F.lower("v")))
    return named.groupBy("p_brand").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min_by("v", "p_partkey").alias("first"))


@query("""SELECT user_id, event_id, '{"k":' || (CAST(json_extract(props, '$.k') AS INT) + 1) || ',"source":"' || event_type || '"}' AS merged FROM events""")
def merged_metadata(spark, sf):
    """The right map's keys win."""
    kind = "map<string,string>"
    left = F.from_json("props", kind)
    right = F.map_from_arrays(F.array(F.lit("k"), F.lit("source")), F.array((F.from_json("props", "k int")["k"] + 1).cast("string"), F.col("event_type")))
    merged = F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)
    k, src = F.element_at(merged, F.lit("k")), F.element_at(merged, F.lit("source"))
    text = F.concat(F.lit('{"k":'), k, F.lit(',"source":"'), src, F.lit('"}'))
    return table(spark, sf, "events").select("user_id", "event_id", text.alias("merged"))


@query(f"""{FEATURES} SELECT doc_id, section, array_to_string(path, ' > ') AS heading_path, doc_id || ':' || section AS chunk_id,
  md5(concat_ws(chr(10), array_to_string(path, ' > '), CASE WHEN length(text) > 700 THEN regexp_replace(substr(text, 1, 700), ' [^ ]*$', '') ELSE text END, CASE WHEN len(concepts) > 0 THEN array_to_string(concepts[1:8], ', ') END, CASE WHEN len(equations) > 0 THEN array_to_string(equations[1:4], '; ') END)) AS digest FROM fe""")
def section_chunk_rows(spark, sf):
    t = F.col("text")
    s = _sections(spark, sf).withColumn("c", F.slice(S.key_concepts(t), 1, 8)).withColumn("e", F.slice(S.equations(t), 1, 4))
    parts = F.concat_ws("\n", path(), T.shortened(t, 700), F.when(F.size("c") > 0, F.array_join("c", ", ")), F.when(F.size("e") > 0, F.array_join("e", "; ")))
    return s.select("doc_id", "section", path().alias("heading_path"), F.concat_ws(":", F.col("doc_id").cast("string"), F.col("section").cast("string")).alias("chunk_id"), F.md5(parts).alias("digest"))


@query("""WITH p AS (SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS phases, bool_or(p_size > 49) AS noisy FROM part GROUP BY ALL), g AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
s AS (SELECT p_brand, count(*) FILTER (n <= 1) AS single, count(*) AS total FROM g GROUP BY ALL)
SELECT p_brand, single, total, single >= 0.75 * total AS compact FROM s""")
def map_compaction(spark, sf):
    g = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    s = g.groupBy("p_brand").agg(F.count_if(F.col("n") <= 1).alias("single"), F.count(F.lit(1)).alias("total"))
    return s.withColumn("compact", F.col("single") >= 0.75 * F.col("total"))


@query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT conv_id, turn, role, CASE WHEN i % 2 = 0 THEN 'host' ELSE 'guest' END AS speaker FROM t""")
def speaker_alternation(spark, sf):
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.when(i % 2 == 0, "host").otherwise("guest").alias("speaker"))


@query("""WITH w AS (SELECT conv_id, turn, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) AS n FROM conversations), r AS (SELECT conv_id, turn, n, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used FROM w)
SELECT conv_id, count(*) AS n_turns, max(used) AS words, max(used) BETWEEN 85 AND 115 AS balanced FROM r WHERE used <= 115 GROUP BY ALL""")
def podcast_balance(spark, sf):
    n = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != ""))
    used = F.sum(n).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    r = table(spark, sf, "conversations").select("conv_id", used.alias("used")).where("used <= 115")
    return r.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max("used").alias("words")).withColumn("balanced", F.col("words").between(85, 115))
