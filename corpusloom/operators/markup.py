"""Markup that parsers leave in texts, as Markdown: marks of pages go, HTML tables become Markdown tables, and a cleaner that leaves table lines as
they are. A text is worked out in its row by built-in functions, in time that follows its length: it is split at closing tags, and each part is cut at
its first opening tag.

Defined results: null stays null and an empty text empty; a closing tag without an opening one stays as text, so does an opening one without an end; a
table without a whole cell is empty; short rows are filled with empty cells; character references end in a semicolon, unknown ones stay.
"""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let, table_cells, unrolled
from corpusloom.operators.documents import cleaned_text

#: Elements that mark pages, and the name of a column without a head.
PAGE_MARKS = ("page_number", "page_header", "page_footer", "page_break")
COLUMN = "Column "
_PAGE = rf"(?:{'|'.join(PAGE_MARKS)})"
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
SEPARATOR = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"


def unescaped(text: Column) -> Column:
    """A text with its character references as characters; numbers that are no characters become U+FFFD."""
    frequent = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0"}
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")})), "map<string,string>")

    def character(mark: Column) -> Column:
        name = F.substring(mark, 2, F.length(mark) - 2)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.regexp_extract(name, r"^#(\d+)$", 1)).try_cast("int")
        good = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        decoded = F.decode(F.unhex(F.lpad(F.hex(F.when(good, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        known = F.when(name.startswith("#"), decoded)
        for k, v in frequent.items():  # the map of all names is looked through from its start
            known = known.when(name == k, F.lit(v))
        return known.otherwise(F.coalesce(F.try_element_at(names, name), mark))

    def decoded(t: Column) -> Column:
        marks = F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))
        parts = let(marks, lambda m: F.array_join(F.transform(F.split(t, REFERENCE), lambda p, i: F.when(F.get(m, i).isNull(), p).otherwise(F.concat(p, character(F.get(m, i))))), ""))
        return F.when(t.contains("&"), parts).otherwise(t)

    return let(text, decoded)


def _replaced(text: Column, opening: str, closing: str, by: Callable[[Column], Column]) -> Column:
    """text with by(inside) for what stands from an opening tag to the next closing one."""

    def part(p: Column, end: Column) -> Column:
        before, inside = F.regexp_extract(p, rf"(?s)^(.*?){opening}", 1), F.regexp_extract(p, rf"(?s)^.*?{opening}(.*)$", 1)
        return F.when(end.isNull(), p).when(p.rlike(opening), F.concat(before, let(inside, by))).otherwise(F.concat(p, end))

    def whole(t: Column) -> Column:
        ends = F.regexp_extract_all(t, F.lit(closing), F.lit(0))
        joined = let(ends, lambda e: F.array_join(F.transform(F.split(t, closing), lambda p, i: part(p, F.get(e, i))), ""))
        return F.when(t.rlike(closing), joined).otherwise(t)

    return let(text, whole)


def _inside(text: Column, opening: str, closing: str) -> Column:
    """What stands inside each element, after its opening tag; the group that `opening` has comes first."""
    return let(F.split(text, closing), lambda parts: F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.rlike(opening)))


def table_lines(inside: Column) -> Column:
    """The Markdown lines of an HTML table from what stands in it, as one text; empty without cells."""
    row, cell = r"(?i)<tr\b[^>]*>", r"(?i)<t([hd])\b[^>]*>"

    def words(c: Column) -> Column:
        plain = unescaped(F.regexp_replace(F.regexp_extract(c, rf"(?s){cell}(.*)$", 2), r"<[^>]+>", " "))
        return F.replace(F.btrim(F.regexp_replace(plain, r"[\s ]+", " ")), F.lit("|"), F.lit("\\|"))

    rows = F.transform(_inside(inside, row, r"(?i)</tr\s*>"), lambda r: F.transform(
        _inside(F.regexp_extract(r, rf"(?s){row}(.*)$", 1), cell, r"(?i)</t[hd]\s*>"),
        lambda c: F.struct((F.lower(F.regexp_extract(c, cell, 1)) == "h").alias("head"), words(c).alias("text")),
    ))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def drawn(rows: Column, width: Column) -> Column:
        filled = lambda r: F.slice(F.concat(F.transform(r, lambda c: c["text"]), F.array_repeat(F.lit(""), width)), 1, width)
        made = F.transform(F.sequence(F.lit(1), width), lambda k: F.concat(F.lit(COLUMN), k.cast("string")))
        named = F.forall(F.get(rows, 0), lambda c: c["head"])
        first = F.when(named, filled(F.get(rows, 0))).otherwise(made)
        body = F.when(named, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
        rule = line(F.array_repeat(F.lit("---"), width))
        return F.array_join(F.concat(F.array(line(first), rule), F.transform(body, lambda r: line(filled(r)))), "\n")

    kept = F.filter(rows, lambda r: F.size(r) > 0)
    return let(kept, lambda k: F.when(F.size(k) > 0, drawn(k, F.array_max(F.transform(k, lambda r: F.size(r))))).otherwise(""))


def normalised_markup(text: Column) -> Column:
    """Plain line ends, no marks of pages, Markdown for HTML tables, at most one empty line in a row. A mark of a page that closes itself ends at once,
    also where another one's end follows."""
    plain = F.regexp_replace(text, "\r\n?", "\n")
    plain = F.regexp_replace(plain, rf"(?i)<\s*{_PAGE}\b[^>]*/\s*>", "\n")
    plain = _replaced(plain, rf"(?i)<\s*{_PAGE}\b[^>]*>", rf"(?i)<\s*/\s*{_PAGE}\s*>", lambda _: F.lit("\n"))
    plain = _replaced(plain, r"(?i)<table\b[^>]*>", r"(?i)</table\s*>", lambda t: F.concat(F.lit("\n\n"), table_lines(t), F.lit("\n\n")))
    return F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def source_text(text: Column) -> Column:
    """Normalised markup without slide furniture, footers, dates and repeated lines; table lines stay as they are, gaps are one empty line."""
    return cleaned_text(normalised_markup(text))


def _runs(text: Column) -> Column:
    """Array of runs of lines: each is (line, row, rule) of neighbouring lines that are all table lines or all none."""
    row = lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) >= 2)
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), row(F.trim(x)).alias("row"), x.rlike(SEPARATOR).alias("rule")))
    is_ = lambda x: x["row"] | x["rule"]

    def cut(l: Column) -> Column:  # noqa: E741
        starts = F.filter(F.transform(l, lambda x, i: F.when((i == 0) | (is_(F.get(l, i - 1)) != is_(x)), i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda at, k: F.slice(l, at + 1, F.coalesce(F.get(s, k + 1), F.size(l)) - at)))

    return let(lines, cut)


def _head(run: Column) -> Column:
    """The place, from 1, of the first line of a run that a separator follows; 0 without one."""
    return F.array_position(F.transform(run, lambda x, i: x["row"] & F.coalesce(F.get(run, i + 1)["rule"], F.lit(False))), True)


def prose_text(text: Column) -> Column:
    """Normalised markup without its tables."""
    kept = F.flatten(F.transform(_runs(normalised_markup(text)), lambda r: let(_head(r), lambda at: F.when(at == 0, r).otherwise(F.slice(r, 1, F.greatest(at - 1, F.lit(0)).cast("int"))))))
    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def markup_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, table, n_columns, headers, rows) of documents (doc_id, text): every table with a line below its separator, HTML or Markdown."""
    found = F.filter(F.transform(_runs(normalised_markup(F.col("text"))), lambda r: let(_head(r), lambda at: F.when(
        at > 0, F.transform(F.slice(r, at.cast("int"), F.size(r)), lambda x: x["line"])))), lambda t: F.size(t) > 2)
    each = unrolled(docs.select("doc_id", F.posexplode_outer(found).alias("table", "lines")), "table")
    inner = F.btrim(F.trim(F.get("lines", F.lit(0))), F.lit("|"))
    each = each.withColumn("n_columns", F.size(F.split(inner, r"(?<!\\)\|")))
    rows = F.transform(F.slice("lines", 3, F.size("lines")), lambda x: table_cells(x, F.col("n_columns")))
    return each.select("doc_id", "table", "n_columns", table_cells(F.get("lines", F.lit(0)), F.col("n_columns")).alias("headers"), rows.alias("rows"))
