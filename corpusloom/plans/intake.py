"""Course intake on course texts that Spark derives from orders and customers, with plans and guides put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import intake as I
from corpusloom.plans.course import TEXTS, course_texts
from corpusloom.plans.registry import query, stage

UNITS = f"""{TEXTS}, it AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '(^|\\n)# (Chapter ([0-9]+): [^\\n]*)', '\\1# \\2' || chr(10) || 'Agenda' || chr(10) || '1. Orders of part \\3' || chr(10) || '2. Totals and plans', 'g') ELSE text END
  || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Guide for buyers' || chr(10) || 'Read it first.' ELSE '' END AS text FROM ct),
li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM it),
pu AS (SELECT doc_id, pos, CAST(regexp_extract(line, 'Chapter ([0-9]+)', 1) AS INT) AS number, regexp_extract(line, 'Chapter .*') AS title, 'primary' AS role FROM li WHERE regexp_matches(line, 'Chapter [0-9]+') AND
  CAST(regexp_extract(line, 'Chapter ([0-9]+)', 1) AS INT) BETWEEN 1 AND 50 QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY pos) = 1),
su AS (SELECT doc_id, min(pos) AS pos, NULL::INT AS number, arg_min(line, pos) AS title, 'supplemental' AS role FROM li JOIN (SELECT doc_id, min(pos) AS f FROM pu GROUP BY ALL) USING (doc_id)
  WHERE pos > f AND starts_with(line, 'Guide') GROUP BY doc_id),
un AS (SELECT a.doc_id, CAST(row_number() OVER w - 1 AS INT) AS unit, number, title, role, CAST(pos AS INT) AS first_line, CAST(coalesce(lead(pos) OVER w, n) AS INT) AS end_line
  FROM (SELECT * FROM pu UNION ALL SELECT * FROM su) a JOIN (SELECT doc_id, count(*) AS n FROM li GROUP BY ALL) USING (doc_id) WINDOW w AS (PARTITION BY a.doc_id ORDER BY pos))"""


def _lines(spark, sf):
    t, custom = F.col("text"), F.lit("\nGuide for buyers\nRead it first.")
    plan = F.regexp_replace(t, r"(^|\n)# (Chapter ([0-9]+): [^\n]*)", "$1# $2\nAgenda\n1. Orders of part $3\n2. Totals and plans")
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, plan).otherwise(t), F.when(F.col("doc_id") % 3 == 0, custom).otherwise(""))
    return stage(I.lines_of(course_texts(spark, sf).select("doc_id", "filename", text.alias("text"))), "lines")


@query(f"WITH {UNITS} SELECT doc_id, unit, number, title, role, first_line, end_line FROM un")
def course_units(spark, sf):
    return I.course_units(_lines(spark, sf)).drop("filename")


@query()
def unit_subchapters(spark, sf):
    lines = _lines(spark, sf)
    return I.subchapters(I.course_units(lines), lines)


@query()
def rendered_courses(spark, sf):
    lines = _lines(spark, sf)
    units = stage(I.course_units(lines), "units")
    return I.rendered(lines, units, stage(I.subchapters(units, lines), "parts"))


@query(f"""WITH {UNITS}, ck AS (SELECT DISTINCT doc_id // 4 AS scope, doc_id, pos // 4 AS place FROM li),
cm AS (SELECT doc_id, first_line // 4 AS place, arg_min(unit, first_line) AS unit, arg_min(title, first_line) AS title, arg_min(role, first_line) AS role FROM un GROUP BY ALL),
cs AS (SELECT DISTINCT doc_id, unnest(range(first_line // 4, (end_line - 1) // 4 + 1)) AS place FROM un WHERE role = 'supplemental'),
ch AS (SELECT k.scope, k.doc_id, k.place, m.unit, m.title, CASE WHEN m.role IS NOT NULL THEN m.role WHEN s.place IS NOT NULL THEN 'supplemental' END AS role,
  CASE WHEN m.role = 'primary' THEN regexp_replace(lower(m.title), '[^a-z0-9]+', '', 'g') END AS chapter FROM ck k LEFT JOIN cm m USING (doc_id, place) LEFT JOIN cs s USING (doc_id, place)),
st AS (SELECT scope, doc_id, chapter, min(place) AS start, arg_min(unit, place) AS unit FROM ch WHERE chapter IS NOT NULL GROUP BY ALL),
sp AS (SELECT s.scope, s.doc_id, s.chapter, s.start, min(o.place) AS stop FROM st s LEFT JOIN ch o ON o.doc_id = s.doc_id AND o.chapter <> s.chapter AND o.unit > s.unit AND o.place > s.start GROUP BY ALL),
pl AS (SELECT scope, chapter, doc_id, place, 0 AS o FROM ch WHERE chapter IS NOT NULL
  UNION ALL SELECT p.scope, p.chapter, c.doc_id, c.place, 1 FROM sp p JOIN ch c ON c.doc_id = p.doc_id AND c.place >= p.start AND (p.stop IS NULL OR c.place < p.stop)
    WHERE c.title IS NULL OR regexp_replace(lower(c.title), '[^a-z0-9]+', '', 'g') = p.chapter
  UNION ALL SELECT c.scope, k.chapter, c.doc_id, c.place, 2 FROM ch c JOIN (SELECT DISTINCT scope, chapter FROM st) k USING (scope) WHERE c.role = 'supplemental')
SELECT scope, chapter, doc_id, place, ['primary', 'window', 'supplemental'][min(o) + 1] AS origin FROM pl GROUP BY scope, chapter, doc_id, place""")
def intake_pools(spark, sf):
    """A chunk is four lines; the unit that begins in it gives it its metadata."""
    lines = _lines(spark, sf)
    units = stage(I.course_units(lines), "units")
    place = F.floor(F.col("at") / 4)
    chunks = lines.select("doc_id", place.alias("at")).distinct()
    heads = units.groupBy("doc_id", F.floor(F.col("first_line") / 4).alias("at")).agg(F.min_by(F.struct("unit", "title", "role"), "first_line").alias("m"))
    extra = units.where(F.col("role") == I.SUPPLEMENTAL)
    extra = extra.select("doc_id", F.explode(F.sequence(F.floor(F.col("first_line") / 4), F.floor((F.col("end_line") - 1) / 4))).alias("at"), F.lit(I.SUPPLEMENTAL).alias("other")).distinct()
    rows = chunks.join(heads, ["doc_id", "at"], "left").join(extra, ["doc_id", "at"], "left")
    rows = rows.select(F.floor(F.col("doc_id") / 4).alias("scope"), "doc_id", "at", "m.unit", "m.title", F.coalesce("m.role", "other").alias("role"))
    return I.unit_pools(rows).withColumnRenamed("at", "place")
