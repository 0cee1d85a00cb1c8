"""Structure operators on course texts that Spark derives from orders and customers, with DuckDB SQL for the same results.

A customer is a course file; each of its orders, in order, gives a section with headings, prose, and now and then a
definition, an equation, a table, a repeated line or noise such as slides have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import documents as D
from corpusloom.operators import structure as S
from corpusloom.plans.registry import clean_sql, query, table


def course_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, filename, text)."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    k, key = F.col("k"), F.col("o_orderkey")
    s = lambda x: x.cast("string")
    capital = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 40)))
    rows = o.join(c, "o_custkey").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    segment, price, day = capital(F.col("c_mktsegment")), s(F.round("o_totalprice").cast("bigint")), F.date_format("o_orderdate", "yyyy-MM-dd")
    when = lambda m, *parts: F.when(key % m == 0, F.concat(*parts))
    lit = F.lit
    text = F.concat_ws(
        "\n",
        F.when(k % 3 == 1, F.concat(lit("# Chapter "), s(F.floor((k + 2) / 3)), lit(": "), segment, lit(" planning"))),
        F.concat(lit("## "), s(k), lit(". "), capital(F.substring("o_orderpriority", 3, 40)), lit(" orders")),
        F.concat(lit("On "), day, lit(" the total was "), price, lit(". Therefore the **"), segment, lit(" plan** depends on it. It is the first of the open parts.")),
        when(3, lit("Total cost: the amount that an order in state "), F.col("o_orderstatus"), lit(" requires.")),
        when(4, lit("\n$$ y = "), s(k), lit(" x + "), price, lit(" $$\n")),
        when(5, lit("| part | price |\n| --- | --- |\n| a"), s(k), lit(" | "), price, lit(" |")),
        when(6, lit("Slide navigation icons "), s(k)),
        when(7, lit("12 / 40")),
        when(11, lit("University of Orders, Department 1998")),
        when(2, lit("See the summary below.\nSee  the summary below.")),
        when(9, lit("Why does the "), F.lower(segment), lit(" plan matter?")),
        lit(""),
    )
    texts = F.array_join(F.sort_array(F.collect_list(F.struct("k", text.alias("t"))))["t"], "\n")
    name = F.concat(lit("course_"), s(F.col("o_custkey")), lit(".md"))
    return rows.groupBy("o_custkey").agg(texts.alias("text")).select(F.col("o_custkey").alias("doc_id"), name.alias("filename"), "text")


CAP = "upper(substr({0}, 1, 1)) || lower(substr({0}, 2, 40))"
TEXTS = f"""
co AS (SELECT o.*, {CAP.format('c_mktsegment')} AS seg, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k,
  CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS price FROM orders o JOIN customer ON c_custkey = o_custkey),
cl AS (SELECT o_custkey, k, concat_ws(chr(10),
  CASE WHEN k % 3 = 1 THEN '# Chapter ' || ((k + 2) // 3) || ': ' || seg || ' planning' END,
  '## ' || k || '. ' || {CAP.format('substr(o_orderpriority, 3, 40)')} || ' orders',
  'On ' || strftime(o_orderdate, '%Y-%m-%d') || ' the total was ' || price || '. Therefore the **' || seg || ' plan** depends on it. It is the first of the open parts.',
  CASE WHEN o_orderkey % 3 = 0 THEN 'Total cost: the amount that an order in state ' || o_orderstatus || ' requires.' END,
  CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || '$$ y = ' || k || ' x + ' || price || ' $$' || chr(10) END,
  CASE WHEN o_orderkey % 5 = 0 THEN '| part | price |' || chr(10) || '| --- | --- |' || chr(10) || '| a' || k || ' | ' || price || ' |' END,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Slide navigation icons ' || k END,
  CASE WHEN o_orderkey % 7 = 0 THEN '12 / 40' END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'University of Orders, Department 1998' END,
  CASE WHEN o_orderkey % 2 = 0 THEN 'See the summary below.' || chr(10) || 'See  the summary below.' END,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Why does the ' || lower(seg) || ' plan matter?' END, '') AS t FROM co),
ct AS (SELECT o_custkey AS doc_id, 'course_' || o_custkey || '.md' AS filename, string_agg(t, chr(10) ORDER BY k) AS text FROM cl GROUP BY o_custkey)"""
_NOISE = f"(regexp_matches(line, '{S.PAGE_COUNTER}') OR regexp_matches(line, '{S.MONTH_DATE}') OR regexp_matches(line, '{S.NOISY_TITLE}'))"
_TITLE = "regexp_replace(trim({}, ' -*#' || chr(9)), '\\s+', ' ', 'g')"
_WORDS = "string_split_regex(trim(line), '\\s+')"
_LETTERS, _UPPERS = "length(regexp_replace(line, '[^\\p{L}]', '', 'g'))", "length(regexp_replace(line, '[^\\p{Lu}]', '', 'g'))"
_PLAIN = f"""(NOT regexp_matches(line, '[|$\\\\]') AND trim(line) <> '' AND NOT regexp_matches(trim(line), '[.:;,!?]$') AND len({_WORDS}) BETWEEN 2 AND 12
  AND {_LETTERS} > 0 AND ({_UPPERS} > 0.55 * {_LETTERS} OR len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= greatest(2, len({_WORDS}) // 2)
  OR (len({_WORDS}) <= 8 AND regexp_matches(trim(line), '^\\p{{Lu}}') AND NOT regexp_matches(line, '\\d'))))"""
_MARK = f"regexp_extract(line, '{S.NUMBERED_HEADING}', 1)"
SECTIONS = f"""{TEXTS},
ln0 AS (SELECT doc_id, filename, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM ct),
ln AS (SELECT doc_id, filename, i, rtrim(line) AS line FROM ln0),
lk AS (SELECT * FROM ln WHERE NOT {_NOISE}),
lh AS (SELECT *, CASE WHEN regexp_matches(line, '{S.MARKDOWN_HEADING}') THEN length(regexp_extract(line, '{S.MARKDOWN_HEADING}', 1))
    WHEN regexp_matches(line, '{S.NUMBERED_HEADING}') THEN greatest(1, length({_MARK}) - length(replace({_MARK}, '.', ''))) WHEN {_PLAIN} THEN 2 END AS level,
  CASE WHEN regexp_matches(line, '{S.MARKDOWN_HEADING}') THEN {_TITLE.format(f"regexp_extract(line, '{S.MARKDOWN_HEADING}', 2)")}
    WHEN regexp_matches(line, '{S.NUMBERED_HEADING}') THEN {_TITLE.format(f"regexp_extract(line, '{S.NUMBERED_HEADING}', 2)")} ELSE {_TITLE.format('line')} END AS title FROM lk),
hd AS (SELECT h.doc_id, h.i, h.level, h.title, (SELECT max(b.i) FROM lh b WHERE b.doc_id = h.doc_id AND b.level < h.level AND b.i < h.i) AS up FROM lh h WHERE h.level IS NOT NULL),
hp AS (SELECT doc_id, i, level, title, [title] AS path FROM hd WHERE up IS NULL
  UNION ALL SELECT d.doc_id, d.i, d.level, d.title, list_append(p.path, d.title) FROM hp p JOIN hd d ON d.doc_id = p.doc_id AND d.up = p.i),
lo AS (SELECT doc_id, filename, i, line, level, coalesce(max(CASE WHEN level IS NOT NULL THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), -1) AS h FROM lh),
dt AS (SELECT doc_id, min_by(title, i) AS title FROM hd GROUP BY doc_id),
tx AS (SELECT doc_id, h, min(filename) AS filename, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(9) || chr(10)) AS text FROM lo WHERE level IS NULL GROUP BY doc_id, h),
se AS (SELECT tx.doc_id, CAST(row_number() OVER (PARTITION BY tx.doc_id ORDER BY h) - 1 AS INT) AS section, CAST(coalesce(hp.level, 1) AS INT) AS level,
  coalesce(hp.title, dt.title, trim(replace(regexp_replace(filename, '\\.[^.]*$', ''), '_', ' '))) AS title,
  coalesce(hp.path, [coalesce(dt.title, trim(replace(regexp_replace(filename, '\\.[^.]*$', ''), '_', ' ')))]) AS path, text
  FROM tx LEFT JOIN hp ON hp.doc_id = tx.doc_id AND hp.i = tx.h LEFT JOIN dt ON dt.doc_id = tx.doc_id WHERE text <> '')"""
R = f"WITH RECURSIVE {SECTIONS}"


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    return S.sections(course_texts(spark, sf))


def path(column: str = "path"):
    return F.array_join(column, " > ")


@query(f"{R} SELECT doc_id, section, level, title, array_to_string(path, ' > ') AS path, md5(text) AS digest, length(text) AS n_chars FROM se")
def course_sections(spark, sf):
    s = _sections(spark, sf)
    return s.select("doc_id", "section", "level", "title", path().alias("path"), F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars"))


def first_once(values: str, key: str) -> str:
    return f"list_filter({values}, lambda v, i: {key.format('v')} <> '' AND list_position(list_transform({values}, lambda z: {key.format('z')}), {key.format('v')}) = i)"


_SPACED = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_EQ = f"list_transform(list_concat(regexp_extract_all(text, '{S.DISPLAY_EQUATION}'), regexp_extract_all(regexp_replace(text, '{S.DISPLAY_EQUATION}', '', 'g'), '{S.INLINE_EQUATION}')), lambda q: trim(q))"
_CONCEPTS = f"""list_filter(list_concat(list_transform(regexp_extract_all(text, '{S.BOLD}', 1), lambda q: trim(q)), list_transform(list_filter(string_split(text, chr(10)),
  lambda x: regexp_matches(x, '{S.DEFINITION}')), lambda x: trim(regexp_extract(x, '{S.DEFINITION}', 1), ' -*'))), lambda c: length(c) BETWEEN 2 AND 90)"""
_FLAT = "list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))"
_DATED = f"list_filter({_FLAT}, lambda x: regexp_matches(x, '{S.DATED}'))"
FEATURES = f"""{R}, fe AS (SELECT *, {first_once(_EQ, _SPACED)}[1:30] AS equations, {first_once(_CONCEPTS, _SPACED)}[1:20] AS concepts, {first_once(_DATED, _SPACED)}[1:30] AS dated,
  regexp_replace(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+([A-Z0-9"(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1) || '([^' || chr(1) || ']*)' || chr(1) || '.*$', ' \\1') AS sm FROM se)"""


@query(f"{FEATURES} SELECT doc_id, section, CAST(unnest(range(0, len(equations))) AS INT) AS pos, unnest(equations) AS equation, 'equation' AS kind FROM fe WHERE len(equations) > 0")
def section_equations(spark, sf):
    e = T.unrolled(_sections(spark, sf).select("doc_id", "section", F.posexplode_outer(S.equations(F.col("text"))).alias("pos", "equation")), "pos")
    return e.withColumn("kind", S.formula_kind(F.col("equation")))


@query(f"{FEATURES} SELECT doc_id, section, array_to_string(concepts, ' / ') AS concepts, CAST(len(concepts) AS INT) AS n_concepts, CAST(len(equations) AS INT) AS n_equations, CAST(len(dated) AS INT) AS n_dated FROM fe")
def section_features(spark, sf):
    t, f = F.col("text"), _sections(spark, sf)
    c = f.select("doc_id", "section", S.key_concepts(t).alias("c"), S.equations(t).alias("e"), S.dated_lines(t).alias("d"))
    return c.select("doc_id", "section", F.array_join("c", " / ").alias("concepts"), F.size("c").alias("n_concepts"), F.size("e").alias("n_equations"), F.size("d").alias("n_dated"))


@query(f"{FEATURES} SELECT doc_id, section, CAST(unnest(range(0, len(dated))) AS INT) AS pos, unnest(dated) AS line FROM fe WHERE len(dated) > 0")
def section_timeline(spark, sf):
    return T.unrolled(_sections(spark, sf).select("doc_id", "section", F.posexplode_outer(S.dated_lines(F.col("text"))).alias("pos", "line")), "pos")


@query(f"{FEATURES} SELECT doc_id, section, CASE WHEN contains(sm, chr(1)) THEN replace(sm, chr(1), ' ') ELSE sm END AS summary FROM fe")
def section_summaries(spark, sf):
    return _sections(spark, sf).select("doc_id", "section", S.summary(F.col("text")).alias("summary"))


_ISROW = f"(regexp_matches(line, '{S.TABLE_ROW}') OR regexp_matches(line, '{S.TABLE_RULE}'))"


@query(f"""{R}, tl AS (SELECT doc_id, section, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM se),
tr AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, section ORDER BY i) AS g FROM tl WHERE {_ISROW}),
tg AS (SELECT doc_id, section, g, min_by(trim(line), i) AS head, count(*) AS n, count(*) FILTER (NOT regexp_matches(line, '{S.TABLE_RULE}')) AS body FROM tr GROUP BY ALL HAVING count(*) >= 2),
tc AS (SELECT *, list_transform(string_split(trim(head, '| '), '|'), lambda c: trim(c)) AS cells FROM tg)
SELECT doc_id, section, CAST(row_number() OVER (PARTITION BY doc_id, section ORDER BY g) - 1 AS INT) AS "table", CAST(len(cells) AS INT) AS n_columns, array_to_string(cells, ' / ') AS header, CAST(body - 1 AS INT) AS n_rows FROM tc""")
def section_tables(spark, sf):
    return S.tables(_sections(spark, sf))


@query()
def section_chunks(spark, sf):
    return S.chunks(_sections(spark, sf), budget=40, overlap=12)


@query()
def token_budget_chunks(spark, sf):
    whole = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("section"), "text")
    return S.chunks(whole).select("doc_id", "chunk", "n_tokens", F.md5("text").alias("digest"))


@query(f"""{R}, us AS (SELECT doc_id, section, level, title, path, (section * 3) % 7 AS z FROM se),
lv AS (SELECT doc_id, section, level, title, path FROM us)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sections, string_agg(repeat('  ', level - 1) || '- ' || title, chr(10) ORDER BY section) AS outline FROM lv GROUP BY doc_id""")
def course_outline(spark, sf):
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), F.col("title"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("section", line.alias("l")))), lambda x: x["l"])
    return _sections(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.array_join(lines, "\n").alias("outline"))


@query(f"WITH {TEXTS}, {clean_sql('ct')} SELECT doc_id, line_no, line FROM k7")
def clean_markdown(spark, sf):
    return D.clean_lines(course_texts(spark, sf))


@query(f"""WITH {TEXTS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM ct)
SELECT doc_id, CAST(n AS INT) AS line_no, regexp_extract(line, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)', 1) AS year, substr(trim(line), 1, 240) AS line
FROM l WHERE regexp_matches(line, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)')""")
def timeline_lines(spark, sf):
    return D.timeline(course_texts(spark, sf))
