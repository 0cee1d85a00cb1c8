"""Parser output that Spark derives from orders and their lines, normalised and cleaned, with DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import markup as M
from corpusloom.plans.registry import query, table


def parsed_texts(spark, sf):
    """One text for each order, as a parser gives it: marks of pages, an HTML table of the order's lines, with or without a head, ragged, with references."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")  # noqa: E741
    s, key, n = lambda x: F.col(x).cast("string"), F.col("o_orderkey"), F.col("l_linenumber")
    last = F.when(n % 3 != 1, F.concat(F.lit("<td class='f'>"), s("l_returnflag"), F.lit("&amp;<b>"), s("l_linestatus"), F.lit("</b><br/>a|b &#x41;&nope;</td>"))).otherwise("")
    row = F.concat(F.lit("<TR><td>"), s("l_partkey"), F.lit("</td>\n<TD>"), s("l_suppkey"), F.lit("</TD>"), last, F.lit("</tr>"))
    rows = l.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    o = o.join(rows, o.o_orderkey == rows.l_orderkey, "left")
    text = F.concat(
        F.lit("## Order "), s("o_orderkey"), F.lit("\r\n<page_number>"), s("o_custkey"), F.lit("</page_number>\r\n"),
        F.when(key % 2 == 0, "<page_break/>Parts &amp; prices\n\n\n\nSlide navigation 3\n").otherwise("Parts\nparts\n12 / 40\n"),
        F.when(key % 7 == 0, "<table></table>").otherwise(""), F.lit('<table border="1">'),
        F.when(key % 3 == 0, "<tr><th>part</th><th>from</th><th>flag</th></tr>").otherwise(""), F.coalesce("rows", F.lit("")), F.lit("</table>"),
        F.when(key % 5 == 0, "\n| a | b |\n| --- | --- |\n| 1 | 2 |\n").otherwise(" after </table> <table>open"),
    )
    return o.select(key.alias("doc_id"), text.alias("text"))


_ROW = """'<TR><td>' || l_partkey || '</td>' || chr(10) || '<TD>' || l_suppkey || '</TD>' ||
  CASE WHEN l_linenumber % 3 <> 1 THEN '<td class=''f''>' || l_returnflag || '&amp;<b>' || l_linestatus || '</b><br/>a|b &#x41;&nope;</td>' ELSE '' END || '</tr>'"""
_MARKS = "page_number|page_header|page_footer|page_break"
_TABLE, _TR, _CELL = r"(?is)<table\b[^>]*>.*?</table\s*>", r"(?is)<tr\b[^>]*>(.*?)</tr\s*>", r"(?is)<t[hd]\b[^>]*>.*?</t[hd]\s*>"
PARSED = f"""
pr AS (SELECT l_orderkey, string_agg(r, '' ORDER BY l_linenumber, r) AS rows FROM (SELECT l_orderkey, l_linenumber, {_ROW} AS r FROM lineitem) GROUP BY l_orderkey),
pt AS (SELECT o_orderkey AS doc_id, '## Order ' || o_orderkey || chr(13) || chr(10) || '<page_number>' || o_custkey || '</page_number>' || chr(13) || chr(10) ||
  CASE WHEN o_orderkey % 2 = 0 THEN '<page_break/>Parts &amp; prices' || repeat(chr(10), 4) || 'Slide navigation 3' || chr(10) ELSE 'Parts' || chr(10) || 'parts' || chr(10) || '12 / 40' || chr(10) END ||
  CASE WHEN o_orderkey % 7 = 0 THEN '<table></table>' ELSE '' END || '<table border="1">' ||
  CASE WHEN o_orderkey % 3 = 0 THEN '<tr><th>part</th><th>from</th><th>flag</th></tr>' ELSE '' END || coalesce(rows, '') || '</table>' ||
  CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10) ELSE ' after </table> <table>open' END AS text
  FROM orders LEFT JOIN pr ON l_orderkey = o_orderkey),
p1 AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13), ''), '(?i)<(?:{_MARKS})\\b[^>]*/>', chr(10), 'g'), '(?is)<(?:{_MARKS})\\b[^>]*>.*?</(?:{_MARKS})>', chr(10), 'g') AS t FROM pt),
tb AS (SELECT doc_id, i, regexp_extract_all(t, '{_TABLE}')[i] AS tab FROM p1, unnest(range(1, len(regexp_extract_all(t, '{_TABLE}')) + 1)) AS x(i)),
tr AS (SELECT doc_id, i, j, regexp_extract_all(regexp_extract_all(tab, '{_TR}', 1)[j], '{_CELL}') AS cells FROM tb, unnest(range(1, len(regexp_extract_all(tab, '{_TR}', 1)) + 1)) AS x(j)),
tc AS (SELECT doc_id, i, j, starts_with(lower(cells[1]), '<th') AS head, list_transform(cells, lambda c: replace(replace(replace(
  trim(regexp_replace(regexp_replace(c, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '&amp;', '&'), '&#x41;', 'A'), '|', '\\|')) AS w FROM tr WHERE len(cells) > 0),
tw AS (SELECT *, max(len(w)) OVER (PARTITION BY doc_id, i) AS width, min(j) OVER (PARTITION BY doc_id, i) = j AS first FROM tc),
tl AS (SELECT doc_id, i, j, width, first, head, '| ' || array_to_string(list_transform(range(1, width + 1), lambda k: coalesce(w[k], '')), ' | ') || ' |' AS line,
  '| ' || array_to_string(list_transform(range(1, width + 1), lambda k: '---'), ' | ') || ' |' AS rule,
  '| ' || array_to_string(list_transform(range(1, width + 1), lambda k: 'Column ' || k), ' | ') || ' |' AS made FROM tw),
tm AS (SELECT doc_id, i, string_agg(CASE WHEN first AND head THEN line || chr(10) || rule WHEN first THEN made || chr(10) || rule || chr(10) || line ELSE line END, chr(10) ORDER BY j) AS md FROM tl GROUP BY ALL),
tx AS (SELECT p1.doc_id, k, string_split_regex(t, '{_TABLE}')[k] AS piece, coalesce(md, '') AS md, k <= len(regexp_extract_all(t, '{_TABLE}')) AS more
  FROM p1, unnest(range(1, len(string_split_regex(t, '{_TABLE}')) + 1)) AS x(k) LEFT JOIN tm ON tm.doc_id = p1.doc_id AND tm.i = k),
nm AS (SELECT doc_id, regexp_replace(regexp_replace(string_agg(piece || CASE WHEN more THEN chr(10) || chr(10) || md || chr(10) || chr(10) ELSE '' END, '' ORDER BY k), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM tx GROUP BY doc_id)"""


@query(f"WITH {PARSED} SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM nm")
def normalised_markup(spark, sf):
    d = parsed_texts(spark, sf).select("doc_id", M.normalised_markup(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


#: Of these texts every rule of the cleaner that acts is said here: a page counter and slide furniture go, a line that says the same as the one before goes.
@query(f"""WITH {PARSED}, ls AS (SELECT doc_id, i, trim(string_split(t, chr(10))[i]) AS line FROM nm, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS x(i)),
lk AS (SELECT doc_id, i, CASE WHEN line = '12 / 40' THEN '' ELSE line END AS line FROM ls),
ld AS (SELECT *, lower(line) AS norm, line <> '' AND NOT contains(lower(line), 'slide navigation') AS stays FROM lk),
lp AS (SELECT *, lag(norm) OVER w AS before, i - row_number() OVER w AS lost FROM ld WHERE stays WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
lq AS (SELECT doc_id, i, line, lost, lag(lost) OVER (PARTITION BY doc_id ORDER BY i) AS lost_before FROM lp WHERE before IS DISTINCT FROM norm)
SELECT doc_id, md5(string_agg(CASE WHEN lost_before IS NULL THEN '' WHEN lost_before < lost THEN chr(10) || chr(10) ELSE chr(10) END || line, '' ORDER BY i)) AS digest, count(*) AS n_lines FROM lq GROUP BY doc_id""")
def cleaned_source_texts(spark, sf):
    d = parsed_texts(spark, sf).select("doc_id", M.source_text(F.col("text")).alias("t"))
    kept = F.filter(F.split("t", "\n"), lambda x: x != "")
    return d.select("doc_id", F.md5("t").alias("digest"), F.size(kept).cast("bigint").alias("n_lines"))


@query(f"""WITH {PARSED}, made AS (SELECT doc_id, i, count(*) - CAST(bool_or(first AND head) AS INT) AS n, max(width) AS width, max(CASE WHEN first THEN CASE WHEN head THEN replace(w[1], '\\|', '|') ELSE 'Column 1' END END) AS h FROM tw GROUP BY ALL),
found AS (SELECT doc_id, i, n, width, h FROM made WHERE n > 0 AND width > 1 UNION ALL SELECT doc_id, 99, 1, 2, 'a' FROM pt WHERE doc_id % 5 = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS "table", CAST(width AS INT) AS n_columns, CAST(n AS INT) AS n_rows, h AS first_header FROM found""")
def markup_tables(spark, sf):
    return M.markup_tables(parsed_texts(spark, sf)).select("doc_id", "table", "n_columns", F.size("rows").alias("n_rows"), F.get("headers", F.lit(0)).alias("first_header"))
