"""Markdown as courses: headings, sections with their paths, equations, tables, dated lines, outlines and chunks.

What one document gives is worked out within its row, sections by Arrow arrays over a batch; rows leave it by one explode at the end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let, unrolled
from corpusloom.session import ship

#: Patterns by which headings, noise, tables, equations and dates are known.
MARKDOWN_HEADING = r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
NUMBERED_HEADING = r"^\s*((?:\d+\.)+\d*|[IVXLC]+\.)\s+(.{3,140})$"
TABLE_ROW, TABLE_RULE = r"^\s*\|.+\|\s*$", r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"
PAGE_COUNTER = r"^\s*\d{1,3}\s*/\s*\d{1,3}\s*$"
MONTHS = (
    "january|february|march|april|may|june|july|august|september|october|november|december|"
    "janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre"
)
MONTH_DATE = rf"(?i)^\s*(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\s*$"
NOISY_TITLE = r"(?i)^\s*(?:figure|fig\.?|image|table\s+des\s+mati[eè]res|table\s+of\s+contents|contents?)\s*[:#-]"
DISPLAY_EQUATION, INLINE_EQUATION = r"(?s)\$\$.*?\$\$|\\\[.*?\\\]", r"\$[^$\n]{2,160}\$|\\\([^)]{2,160}\\\)"
DATED = rf"(?i)\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}|{MONTHS})\b"
BOLD, DEFINITION = r"\*\*([^*\n]{2,80})\*\*", r"^\s*(?:[-*]\s*)?([A-Z0-9][^:]{2,80})\s*:\s+(.{10,})$"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])"
#: For units of chunks: white space is that of ASCII, lines end as those of Java's patterns.
WORD, PARAGRAPH, ENDED = re.compile(r"[^ \t\n\x0B\f\r]+"), re.compile(r"\n{2,}"), re.compile(SENTENCE_END, re.ASCII)
ITEM = re.compile(r"(?:^|(?<=[\n\r\u0085\u2028\u2029]))\s*(?:\||[-*] |1\. )", re.ASCII)


#: What split_texts() gives for a text.
SECTIONS = "array<struct<level:int,title:string,path:array<string>,text:string>>"


def _np(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _matches(lines: pa.Array, *patterns: str) -> np.ndarray:
    """Which lines one of the patterns is found in."""
    return np.logical_or.reduce([_np(pc.match_substring_regex(lines, p)) for p in patterns])


def _groups(lines: pa.Array, pattern: str) -> list[pa.Array]:
    """The two groups of a pattern, of lines that it matches."""
    for name in "ab":
        pattern = re.sub(r"(?<!\\)\((?!\?)", f"(?P<{name}>", pattern, count=1)
    found = pc.extract_regex(lines, pattern)
    return [pc.struct_field(found, name) for name in "ab"]


def plain_headings(lines: pa.Array) -> np.ndarray:
    """Places of lines that look like titles: two to twelve words, no end mark, capitals as titles have them."""
    v = pc.utf8_trim(lines, " \t\r")
    at = np.flatnonzero(~_matches(v, r"[.:;,!?]$|[|$\\]|^$"))  # most lines end like sentences
    v = v.take(pa.array(at))
    words = pc.split_pattern_regex(v, r"\s+")
    n = _np(pc.list_value_length(words))
    ends, titles = np.cumsum(n), np.append(0, np.cumsum(_matches(words.flatten(), r"^\p{Lu}")))
    titled = titles[ends] - titles[ends - n]
    letters, upper = (_np(pc.utf8_length(pc.replace_substring_regex(v, other, ""))) for other in (r"[^\p{L}]+", r"[^\p{Lu}]+"))
    short = (n <= 8) & _matches(v, r"^\p{Lu}") & ~_matches(v, r"\d")
    return at[(n >= 2) & (n <= 12) & (letters > 0) & (short | (titled >= np.maximum(2, n // 2)) | (upper > 0.55 * letters))]


def headings(lines: pa.Array, infer: bool = True) -> tuple[np.ndarray, list[int], pa.Array]:
    """Places of the headings among lines that are no noise, their levels and titles."""
    known = _matches(lines, MARKDOWN_HEADING)
    places = [np.flatnonzero(known)]
    marks, title = _groups(lines.take(pa.array(places[0])), MARKDOWN_HEADING)
    levels, titles = [_np(pc.utf8_length(marks))], [title]
    if infer:
        rest = np.flatnonzero(~known)
        others = lines.take(pa.array(rest))
        known = _matches(others, NUMBERED_HEADING)
        marks, title = _groups(others.take(pa.array(np.flatnonzero(known))), NUMBERED_HEADING)
        other = np.flatnonzero(~known)
        plain = other[plain_headings(others.take(pa.array(other)))]
        places += [rest[known], rest[plain]]
        levels += [np.maximum(1, _np(pc.count_substring(marks, "."))), np.full(len(plain), 2)]
        titles += [title, others.take(pa.array(plain))]
    at = np.concatenate(places)
    order = np.argsort(at)
    cleaned = pc.replace_substring_regex(pc.utf8_trim(pa.concat_arrays(titles), " -*\t#"), r"\s+", " ")
    return at[order], np.concatenate(levels)[order].tolist(), cleaned.take(pa.array(order))


def split_texts(texts: pa.Array, stems: pa.Array, infer: bool = True) -> pa.Array:
    """The sections of each text, by one pass of each test over all lines of a batch; only paths are followed heading by heading."""
    split = pc.split_pattern(pc.replace_substring_regex(texts.cast(pa.large_string()), "\r\n?", "\n"), "\n")
    lines, owner = pc.utf8_rtrim(split.flatten(), " "), _np(pc.list_parent_indices(split))
    kept = np.flatnonzero(~_matches(lines, PAGE_COUNTER, MONTH_DATE, NOISY_TITLE))
    lines, owner = lines.take(pa.array(kept)), owner[kept]
    at, levels, titles = headings(lines, infer)
    opens = np.flatnonzero(np.diff(owner, prepend=-1))  # a text's first line, before which a section with its title begins
    place = np.concatenate([opens, at])
    order = np.argsort(place, kind="stable")
    owners, place = owner[place[order]], place[order]

    pool = pa.concat_arrays([titles.cast(pa.string()), stems.cast(pa.string())])
    first = np.searchsorted(at, opens)
    headed = np.append(owner[at], -1)[first] == owner[opens]
    own = np.where(headed, first, len(at) + owner[opens]).tolist()  # its first heading's title, else that of its name
    level, name, path, ends, stack = [], [], [], [0], []
    for k in order.tolist():
        if k < len(opens):
            stack = []
            level.append(1)
            path.append(own[k])
        else:
            k -= len(opens)
            while stack and levels[stack[-1]] >= levels[k]:
                stack.pop()
            stack.append(k)
            level.append(levels[k])
            path += stack
        name.append(path[-1])
        ends.append(len(path))

    said = np.ones(len(lines), bool)
    said[at] = False
    before = np.append(0, np.cumsum(said))
    bodies = pa.LargeListArray.from_arrays(pa.array(np.append(before[place], before[-1])), lines.filter(pa.array(said)))
    text = pc.utf8_trim(pc.binary_join(bodies, pa.scalar("\n", pa.large_string())), " \t\n")
    full = np.flatnonzero(_np(pc.binary_length(text)))
    rows = pa.array(full)
    paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pool.take(pa.array(path, pa.int64())))
    found = pa.StructArray.from_arrays(
        [pa.array(level, pa.int32()).take(rows), pool.take(pa.array(name, pa.int64()).take(rows)), paths.take(rows), text.take(rows).cast(pa.string())], ["level", "title", "path", "text"]
    )
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owners[full], minlength=len(texts)))), pa.int32()), found)


def sections(docs: DataFrame, infer: bool = True) -> DataFrame:
    """(doc_id, section, level, title, path, text) of documents (doc_id, filename, text).

    A heading opens a section and closes those of its level or below on the path to it. Sections without text are left out
    and not counted; text before the first heading belongs to a section with the document's title.
    """
    stem = F.trim(F.translate(F.regexp_replace("filename", r"\.[^.]*$", ""), "_", " "))

    def made(texts: pa.Array, stems: pa.Array) -> pa.Array:
        return split_texts(texts, stems, infer)

    ship(docs.sparkSession)
    found = docs.select("doc_id", F.arrow_udf(made, SECTIONS)("text", stem).alias("s"))
    return unrolled(found.select("doc_id", F.posexplode_outer("s").alias("section", "s")), "section").select("doc_id", "section", "s.*")


def distinct_by_key(values: Column, key) -> Column:
    """The first of values with equal keys, in their order; those with an empty key go."""
    kept = lambda held, k: F.filter(held, lambda v, i: (F.get(k, i) != "") & (F.array_position(k, F.get(k, i)) == i + 1))
    return let(values, lambda held: let(F.transform(held, key), lambda k: kept(held, k)))


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def equations(text: Column) -> Column:
    """Display equations, then inline ones, each wording once, 30 at most."""
    none, may = F.array().cast("array<string>"), F.contains(text, F.lit("$")) | F.contains(text, F.lit("\\")) | text.isNull()
    shown = F.regexp_extract_all(text, F.lit(DISPLAY_EQUATION), F.lit(0))
    inside = F.regexp_extract_all(F.regexp_replace(text, DISPLAY_EQUATION, ""), F.lit(INLINE_EQUATION), F.lit(0))
    return F.when(may, F.slice(distinct_by_key(F.transform(F.concat(shown, inside), lambda x: F.trim(x)), spaced), 1, 30)).otherwise(none)


def formula_kind(equation: Column) -> Column:
    """matrix, chemical or equation."""
    return (
        F.when(equation.rlike(r"\\begin\{[bpv]?matrix\}|\[\s*\["), "matrix")
        .when(equation.rlike(r"->|→|\\rightarrow|\\ce\{"), "chemical").otherwise("equation")
    )


def key_concepts(text: Column) -> Column:
    """Bold terms, then the terms that lines define, each once, 20 at most."""
    bold = F.transform(F.regexp_extract_all(text, F.lit(BOLD), F.lit(1)), lambda x: F.trim(x))
    defined = F.transform(
        F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(":")) & x.rlike(DEFINITION)), lambda x: F.btrim(F.regexp_extract(x, DEFINITION, 1), F.lit(" -*"))
    )
    return F.slice(distinct_by_key(F.filter(F.concat(bold, defined), lambda c: F.length(c).between(2, 90)), spaced), 1, 20)


def dated_lines(text: Column, most: int = 240) -> Column:
    """Lines that name a date, of up to `most` characters cut at a word, each once, 30 at most."""
    flat = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    short = F.transform(flat, lambda x: F.when(F.length(x) > most, F.regexp_replace(F.substring(x, 1, most), r"\s+\S*$", "")).otherwise(x))
    return F.slice(distinct_by_key(F.filter(short, lambda x: x.rlike(DATED)), spaced), 1, 30)


def summary(text: Column, most: int = 700) -> Column:
    """The first two sentences, cut at a word."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    two = F.array_join(F.slice(F.split(flat, SENTENCE_END), 1, 2), " ")
    return F.when(F.length(two) > most, F.regexp_replace(F.substring(two, 1, most), r"\s+\S*$", "")).otherwise(two)


def tables(found: DataFrame) -> DataFrame:
    """(doc_id, section, table, n_columns, header, n_rows) of sections: two lines or more between bars on end, 20 a section."""
    line = F.transform(F.split("text", "\n"), lambda x: F.struct(F.trim(x).alias("line"), (x.rlike(TABLE_ROW) | x.rlike(TABLE_RULE)).alias("is")))
    d = found.select("doc_id", "section", line.alias("l"))
    edge = lambda i: (i == 0) | (F.get(F.col("l"), i - 1)["is"] != F.get(F.col("l"), i)["is"])
    d = d.withColumn("starts", F.filter(F.transform("l", lambda x, i: F.when(edge(i), i)), lambda i: i.isNotNull()))
    runs = F.transform("starts", lambda s, i: F.slice("l", s + 1, F.coalesce(F.get(F.col("starts"), i + 1), F.size("l")) - s))
    runs = F.slice(F.filter(runs, lambda r: F.get(r, F.lit(0))["is"] & (F.size(r) >= 2)), 1, 20)
    each = unrolled(d.select("doc_id", "section", F.posexplode_outer(runs).alias("table", "r")), "table").withColumn("r", F.transform("r", lambda x: x["line"]))
    cells = F.transform(F.split(F.btrim(F.get("r", F.lit(0)), F.lit("| ")), r"(?<!\\)\|"), lambda x: F.trim(x))
    body = F.filter("r", lambda x: ~x.rlike(TABLE_RULE))
    return each.select("doc_id", "section", "table", F.size(cells).alias("n_columns"), F.array_join(cells, " / ").alias("header"), (F.size(body) - 1).alias("n_rows"))


def approx_tokens(text: Column) -> Column:
    """Words times 1.3, one at least; an empty text has none."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n * 13 / 10)).cast("int"))


def units(text: Column) -> Column:
    """What chunks are made of: paragraphs with tables, lists or display equations whole, others by sentences."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: F.btrim(p, F.lit(" \t\n"))), lambda p: p != "")
    whole = lambda p: p.contains("\n") & (p.rlike(r"(?m)^\s*(?:\||[-*] |1\. )") | p.contains("$$") | p.contains("\\["))
    parts = F.transform(paragraphs, lambda p: F.when(whole(p), F.array(p)).otherwise(F.transform(F.split(p, SENTENCE_END), lambda s: F.btrim(s, F.lit(" \t\n")))))
    return F.filter(F.flatten(parts), lambda u: u != "")


def tokens_of(text: str) -> int:
    """approx_tokens() of a string."""
    return max(1, len(WORD.findall(text)) * 13 // 10) if text else 0


def units_of(text: str) -> list[str]:
    """units() of a string, for tasks that go on with it: as columns, each sentence's split has its pattern compiled again."""
    found: list[str] = []
    for p in (p.strip(" \t\n") for p in PARAGRAPH.split(text)):
        whole = "\n" in p and ("$$" in p or "\\[" in p or ITEM.search(p))
        found += [p] if whole else [s.strip(" \t\n") for s in ENDED.split(p)]
    return [u for u in found if u]


def pack(sizes: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) units of each chunk: units in order up to the budget; the next chunk begins with units of the last one that hold
    up to `overlap` tokens, one at least; a unit of the budget or more is a chunk of its own."""
    made: list[tuple[int, int]] = []
    first, used = 0, 0

    def carry(low: int, high: int) -> tuple[int, int]:
        total, at = 0, high
        while overlap > 0 and at > low and not (at < high and total + sizes[at - 1] > overlap) and total < overlap:
            at -= 1
            total += sizes[at]
        return at, total

    for i, n in enumerate(sizes):
        if n >= budget:
            if used:
                made.append((first, i - 1))
            made.append((i, i))
            first, used = carry(i, i + 1)
        else:
            if used and used + n > budget:
                made.append((first, i - 1))
                first, used = carry(first, i)
            used += n
    if used:
        made.append((first, len(sizes) - 1))
    return made


def chunks(found: DataFrame, budget: int = 512, overlap: int = 50) -> DataFrame:
    """(doc_id, section, chunk, chunk_id, n_tokens, text) of sections.

    Ids come from the section's place and the text alone, so another run gives the same. Units and the fold over them run in Arrow batches, one section at a time.
    """
    schema = "doc_id bigint, section int, chunk int, chunk_id string, n_tokens int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, section, whole in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "section", "text"))):
                parts = units_of(whole or "")
                sizes = [tokens_of(u) for u in parts]
                for k, (a, b) in enumerate(pack(sizes, budget, overlap)):
                    text = "\n\n".join(parts[a : b + 1])
                    name = f"{doc}:{section}:{k}:{hashlib.sha1(text.encode()).hexdigest()[:16]}"
                    rows.append((doc, section, k, hashlib.sha1(name.encode()).hexdigest()[:24], sum(sizes[a : b + 1]), text))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in schema.split(", ")])

    ship(found.sparkSession)
    return found.select("doc_id", "section", "text").mapInArrow(run, schema)
