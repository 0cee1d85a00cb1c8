"""Course intake: units of a document by its lines, their subchapters, Markdown with that structure, and the pools of chunks that belong to a unit.

A document is a table of lines, never one row: what a line says is worked out in its row, units are few rows for each document, and lines and
chunks meet units by bins of their positions. Only the first LOOK_AHEAD lines of a unit are put together, for its subchapters.

Defined results: of units with the same number or title the first stays; a document without units has none, and is supplemental as a whole where
its filename says so; a null line is an empty one; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import MARKED, PLAIN, unrolled, without_marks
from corpusloom.session import ship, stage

#: Patterns by which units, plans and supplements are known; the lines that are looked through, and the most subchapters.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
).split()
UNIT = (
    r"(?i)\b(semaine|week|lecture|chapter|module|unit|unite)\s*(?:n[°o.]?\s*)?"
    rf"(\d{{1,2}}|[ivxlcdm]{{1,8}}|{'|'.join(NUMBER_WORDS)})\s*(?:[:.\-–]\s*)?(.{{0,180}})"
)
SUPPLEMENT = (
    r"\b(guide|student\s+guide|guide\s+for\s+students|syllabus|appendix|annex|bibliography|references?|lectures?\s+recommended|table\s+des\s+matieres)\b"
)
SUPPLEMENT_START = r"^(guide|appendix|annex|syllabus|references|bibliography)"
PLAN = r"(?i)\b(plan\s+de\s+la\s+s\s*eance|agenda|outline|course\s+outline|contents|table\s+of\s+contents|table\s+des\s+matieres)\b"
ITEM = re.compile(r"(?:^|\s)\d{1,2}\s*[.)]?\s*(.+?)(?=(?:\s+\d{1,2}\s*[.)]?\s*(?=[A-ZÀ-ÖØ-Þ0-9]))|$)", re.DOTALL)
MONTHS = "october|november|december|janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre"
CUT_OFF = rf"(?i)\b(?:pr\.?|prof(?:essor)?|dr\.?|ecole|school|master|{MONTHS})\b"
PAGE_OF, OPEN_END = r"\b\d{1,3}\s*/\s*\d{1,3}\b", r"(?:\b(?:aux|des|de|du|dans|et|with|and|of|the|to)|systemes|syst emes|modeles|mod eles)$"
NO_TITLE = r"plan\s+de\s+la\s+seance|agenda|outline|contents?|table\s+des\s+matieres|references?|bibliography|source\s+material"
FORMULA, PEOPLE = r"[=∈≈Σ∑√^]|\\[a-zA-Z]+|\|[A-Z]\|", r"\b(pr\.?|prof(?:essor)?|dr\.?|ecole|school|master|enseignant)\b"
NO_PART = r"\b(behavioral finance|bought|jars?|millennial|right table|left table|sales)\b|\b(and|et|or|ou|has|avec)$|^(le probleme|probleme|the problem|problem)$"
#: Words of which UNIT, PLAN and SUPPLEMENT need one, looked for before them.
UNIT_WORDS, PLAN_WORDS = ("semaine", "week", "lecture", "chapter", "module", "unit"), ("agenda", "outline", "contents", "eance", "matieres")
SUPPLEMENT_WORDS = ("guide", "syllabus", "appendix", "annex", "bibliography", "reference", "lecture", "matieres")
PLAN_LINES, LOOK_AHEAD, AFTER_PLAN, MOST_PARTS = 120, 180, 40, 12
SUPPLEMENTAL, PRIMARY = "supplemental", "primary"
#: Lines or chunks of a bin.
BIN = 256


def _roman(n: int) -> str:
    out = ""
    for value, letters in ((50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += letters * (n // value)
        n %= value
    return out


NUMBERS = {str(n): n for n in range(1, 51)} | {f"0{n}": n for n in range(1, 10)} | {_roman(n): n for n in range(1, 51)} | {w: k for k, w in enumerate(NUMBER_WORDS, 1)}


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def clean_title(text: Column) -> Column:
    plain = compact(F.regexp_replace(text, r"<[^>]+>", " "))
    return F.left(F.btrim(plain, F.lit(" -*•▶✓:;,.#")), F.lit(180))


def title_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(without_marks(text)), r"[^a-z0-9]+", "")


def valid_title(text: Column) -> Column:
    low = F.lower(without_marks(text))
    bad = low.rlike(rf"^(?:{NO_TITLE})$") | (text.rlike(FORMULA) & (F.size(F.split(text, " ")) <= 8)) | low.rlike(PEOPLE)
    bad = bad | low.rlike(rf"^(?:{MONTHS})(?:\s+\d{{1,2}},?\s+\d{{4}}|\s+\d{{4}})?$") | low.rlike(r"^(?:\d{1,4}|[ivxlcdm]+|page\s+\d{1,4}|slide\s+\d{1,4})$")
    return F.length(text).between(4, 150) & ~bad & (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 3)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, filename, at, line) of documents (doc_id, filename, text)."""
    parts = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    return unrolled(docs.select("doc_id", "filename", F.posexplode_outer(parts).alias("at", "line")), "at")


def may_hold(line: Column, words: tuple[str, ...]) -> Column:
    """Whether a line may have one of the words, in any case and with any marks: of ASCII by a plain search, other lines always may."""
    low = F.lower(line)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words], F.length(line) != F.octet_length(line))


def may_bound(line: Column, filename: Column) -> Column:
    """Whether a line may begin as a supplement does, or its file may be named as one."""
    return line.rlike(r"^\s*(?i:guide|appendix|annex|syllabus|references|bibliography)") | (F.length(line) != F.octet_length(line)) | may_hold(filename, SUPPLEMENT_WORDS)


def _number(line: Column) -> Column:
    """Of a line that names a unit its number, else null."""
    names = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return names[F.lower(F.regexp_extract(F.translate(line, MARKED, PLAIN), UNIT, 2))].cast("int")


def _titled(named: DataFrame) -> DataFrame:
    """rows (line, number) with the unit's title. Marks are taken off letter by letter, so that places stay."""
    c, plain = F.col, lambda x: F.translate(x, MARKED, PLAIN)
    rest = F.regexp_replace(F.substr("line", F.regexp_instr(plain(c("line")), F.lit(UNIT))), PAGE_OF, " ")
    rows = named.withColumn("rest", rest).withColumn("cut", F.regexp_instr(plain(c("rest")), F.lit(CUT_OFF)))
    rows = rows.withColumn("title", clean_title(F.when(c("cut") > 0, F.left("rest", c("cut") - 1)).otherwise(c("rest"))))
    label = F.concat(F.initcap(F.regexp_extract(plain(c("line")), UNIT, 1)), F.lit(" "), c("number").cast("string"))
    return rows.withColumn("title", F.when(valid_title(c("title")), c("title")).otherwise(label)).drop("line", "rest", "cut")


def course_units(lines: DataFrame) -> DataFrame:
    """(doc_id, filename, unit, number, title, role, first_line, end_line) of lines (doc_id, filename, at, line)."""
    c = F.col
    seen = lambda may: lines.where(may).select("doc_id", "filename", "at", compact(c("line")).alias("line"))
    named = stage(_titled(stage(seen(may_hold(c("line"), UNIT_WORDS)).withColumn("number", _number(c("line"))).where("number IS NOT NULL"), "unit-lines")), "units")  # few rows
    # a title that ends in the middle goes on in the next line
    open_ = named.withColumn("open", F.lower(without_marks(c("title"))).rlike(OPEN_END))
    following = open_.where("open").select("doc_id", (c("at") + 1).alias("at")).join(lines.select("doc_id", "at", "line"), ["doc_id", "at"])
    following = following.select("doc_id", (c("at") - 1).alias("at"), compact(c("line")).alias("more"))
    longer = clean_title(F.regexp_replace(F.concat_ws(" ", "title", "more"), PAGE_OF, " "))
    named = open_.join(following, ["doc_id", "at"], "left").withColumn("title", F.when(c("more").isNotNull(), longer).otherwise(c("title")))
    # the first of each wording, then those whose number and title are both new
    one = named.withColumn("k", title_key(c("title"))).groupBy("doc_id", "number", "k").agg(F.min(F.struct("at", "title", "filename")).alias("f"))
    rows = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("f.at", "number", "k", "f.title", "f.filename"))).alias("rows"))
    kept = F.aggregate("rows", F.slice("rows", 1, 0), lambda done, r: F.when(
        F.exists(done, lambda d: (d["number"] == r["number"]) | (d["k"] == r["k"])), done).otherwise(F.concat(done, F.array(r))))
    primary = unrolled(rows.select("doc_id", F.explode_outer(kept).alias("r")), "r").select(
        "doc_id", "r.filename", "r.at", "r.number", "r.title", F.lit(PRIMARY).alias("role")
    )
    # one boundary after the first unit
    low, file = F.lower(without_marks(c("line"))), F.lower(without_marks(F.coalesce("filename", F.lit(""))))
    says = (low.rlike(SUPPLEMENT_START) | file.rlike(SUPPLEMENT)) & low.rlike(SUPPLEMENT) & _number(c("line")).isNull()  # the rarest first
    first = primary.groupBy("doc_id").agg(F.min("at").alias("first"))
    bounds = seen(may_bound(c("line"), c("filename"))).where(says).join(first, "doc_id").where("at > first")
    bound = bounds.groupBy("doc_id").agg(F.min(F.struct("at", "line", "filename")).alias("b"))
    title = F.left(clean_title(c("b.line")), F.lit(140))
    extra = bound.select("doc_id", "b.filename", "b.at", F.lit(None).cast("int").alias("number"), F.when(title == "", "Supplemental Material").otherwise(title).alias("title"), F.lit(SUPPLEMENTAL).alias("role"))
    sizes = lines.groupBy("doc_id").agg((F.max("at") + 1).alias("n_lines"), F.min("filename").alias("filename"))
    stem = F.trim(F.replace(F.regexp_replace(F.regexp_extract("filename", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""), F.lit("_"), F.lit(" ")))
    whole = sizes.where(F.lower(without_marks(F.coalesce("filename", F.lit("")))).rlike(SUPPLEMENT)).join(first, "doc_id", "left_anti").select(
        "doc_id", "filename", F.lit(0).alias("at"), F.lit(None).cast("int").alias("number"), F.when(stem == "", "Supplemental Material").otherwise(stem).alias("title"), F.lit(SUPPLEMENTAL).alias("role")
    )
    order = Window.partitionBy("doc_id").orderBy("at")  # few rows for each document: fifty numbers and a boundary
    units = primary.unionByName(extra).unionByName(whole).join(sizes.select("doc_id", "n_lines"), "doc_id")
    return units.select(
        "doc_id", "filename", (F.row_number().over(order) - 1).alias("unit"), "number", "title", "role", c("at").alias("first_line"),
        F.coalesce(F.lead("at").over(order), c("n_lines")).cast("int").alias("end_line"),
    )


def inside(rows: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """rows joined to the spans of their key with start <= at < end: both meet by bins, which a long span has many of."""
    bins = F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / BIN)))
    return rows.withColumn("_bin", F.floor(F.col(at) / BIN)).join(spans.withColumn("_bin", bins), [key, "_bin"]).where(
        (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    ).drop("_bin")


_BULLETS, _TAG, _PAGE = re.compile(r"^[\-*•▶✓\s]+"), re.compile(r"<[^>]+>"), re.compile(r"\s+\d{1,4}$")
_NO_TITLE, _PEOPLE, _FORMULA, _NO_PART, _UNIT, _PLAN, _KEY = map(re.compile, (NO_TITLE, PEOPLE, FORMULA, NO_PART, UNIT, PLAN, r"[^a-z0-9]+"))
_NUMBER = re.compile(r"\d{1,4}|[ivxlcdm]+|page\s+\d{1,4}|slide\s+\d{1,4}")
_DATE = re.compile(rf"(?:{MONTHS})(?:\s+\d{{1,2}},?\s+\d{{4}}|\s+\d{{4}})?")


def part_title(text: str) -> str:
    text = " ".join(_BULLETS.sub("", text.strip()).split())
    before, colon, after = text.partition(":")
    if colon and (len(before.split()) >= 3 or len(after) > 80):
        text = before
    text = _PAGE.sub("", text) if text[-1:].isdigit() else text
    text = _TAG.sub(" ", text) if "<" in text else text
    return " ".join(text.split()).strip(" -*•▶✓:;,.#")[:180]


def _plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch)).lower()


def _part(text: str) -> bool:
    if not 4 <= len(text) <= 150 or sum(map(str.isalpha, text)) < 3 or "|" in text or "%" in text:
        return False
    low = _plain(text)
    if _NO_TITLE.fullmatch(low) or _NUMBER.fullmatch(low) or _DATE.fullmatch(low) or _PEOPLE.search(low):
        return False
    return not (_NO_PART.search(low.strip(" :-")) or (_FORMULA.search(text) and len(text.split()) <= 8))


def _items(line: str) -> list[str]:
    return [t for t in map(part_title, ITEM.findall(line)) if _part(t)]


def _may(low: str, words: tuple[str, ...]) -> bool:
    """Whether a pattern that needs one of the words may hold; letters that are equal but for their case have other forms outside of ASCII."""
    return not low.isascii() or any(w in low for w in words)


def _names_unit(low: str) -> bool:
    m = _may(low, UNIT_WORDS) and _UNIT.search(low)
    return bool(m and m[2].lower() in NUMBERS)


def _plans(low: str) -> bool:
    return bool(_may(low, PLAN_WORDS) and _PLAN.search(low))


def parts_of(lines: list[str]) -> list[str]:
    """Titles of a unit's parts from its first lines: what a plan lists, or else lines that are numbered or look like titles."""
    lines = [" ".join((x or "").split()) for x in lines]
    lows = [_plain(x) for x in lines]
    found: list[str] = []
    whole = "\n".join(lows)
    planned, named = _may(whole, PLAN_WORDS), _may(whole, UNIT_WORDS)
    for k, line in enumerate(lines[:PLAN_LINES] if planned else []):
        if not _plans(lows[k]):
            continue
        found = _items(line)
        for more, low in zip(lines[k + 1 : k + AFTER_PLAN], lows[k + 1 : k + AFTER_PLAN]):
            other = _names_unit(low)
            new = [] if other else _items(more)
            if other or len(found) >= MOST_PARTS or (found and not new):
                break
            found += new
        if found:
            break
    for line, low in zip(lines, lows) if not found else []:
        if len(found) >= MOST_PARTS:
            break
        if not line or (planned and _plans(low)) or (named and _names_unit(low)):
            continue
        if new := _items(line):
            found += new
            continue
        words = line.split()
        if not 2 <= len(words) <= 12 or "|" in line or "%" in line:
            continue
        titled = sum(w[:1].isupper() for w in words) >= max(2, len(words) // 2)
        if not titled:
            letters = [ch for ch in line if ch.isalpha()]
            titled = sum(map(str.isupper, letters)) > 0.55 * max(1, len(letters))
        if titled and _part(clean := part_title(line)):
            found.append(clean)
    first: dict[str, str] = {}
    for title in found:
        first.setdefault(_KEY.sub("", _plain(title)), title)
    return [t for k, t in first.items() if k][:MOST_PARTS]


def subchapters(units: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, unit, part, title): the parts of each unit; a primary one without any is its own part."""

    def run(batches):
        own, held, last = None, [], None  # a unit's key, lines and title; it may go on in the next batch

        def rows():
            found = parts_of(held) or ([last] if last is not None else [])
            return [(*own, k, t) for k, t in enumerate(found)]

        for batch in batches:
            docs, units = (batch.column(c).to_numpy() for c in ("doc_id", "unit"))
            lines, titles, out = batch.column("line").to_pylist(), batch.column("title"), []
            cuts = (np.flatnonzero((docs[1:] != docs[:-1]) | (units[1:] != units[:-1])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(lines)] if lines else []):
                if (key := (int(docs[a]), int(units[a]))) != own:
                    out += rows() if own else []
                    own, held, last = key, [], titles[a].as_py()
                held += lines[a:b]
            yield made(out)
        yield made(rows() if own else [])

    def made(rows):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "unit", "part", "title"])

    ship(units.sparkSession)
    first = units.withColumn("to", F.least(F.col("end_line"), F.col("first_line") + LOOK_AHEAD))
    near = inside(lines.select("doc_id", "at", "line"), first, "doc_id", "at", "first_line", "to")
    named = F.when((F.col("at") == F.col("first_line")) & (F.col("role") == PRIMARY), F.col("title"))  # once, with the unit's first line
    sent = near.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("unit").cast("int").alias("unit"), "at", "line", named.alias("title"))
    # a unit's lines are LOOK_AHEAD at most, and come one after another, so that none are gathered before they are read
    return sent.repartition("doc_id", "unit").sortWithinPartitions("doc_id", "unit", "at").drop("at").mapInArrow(
        run, "doc_id bigint, unit int, part int, title string"
    )


def rendered(lines: DataFrame, units: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, unit, step, at, line): the document's lines under its units, to be read in the order of (unit, step, at). Empty lines between blocks are
    rows of their own."""
    u = units.select("doc_id", "unit", "title", "filename", "first_line", "end_line")
    rows = lambda d, step, at, *texts: d.select("doc_id", "unit", F.lit(step).alias("step"), at.cast("int").alias("at"), F.posexplode(F.array(*texts)).alias("k", "line")).select(
        "doc_id", "unit", "step", (F.col("at") * 4 + F.col("k")).alias("at"), "line"
    )
    stem = F.trim(F.replace(F.regexp_replace(F.regexp_extract("filename", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""), F.lit("_"), F.lit(" ")))
    empty, zero, cat = F.lit(""), F.lit(0), F.concat
    root = u.where("unit = 0").withColumn("unit", F.lit(-1))
    heads = rows(root, 0, zero, cat(F.lit("# "), stem), empty).unionByName(rows(u, 0, zero, cat(F.lit("## "), "title"), empty))
    named = rows(parts, 1, F.col("part"), cat(F.lit("### "), "title"), cat(F.lit("Source plan item: "), "title"), empty)
    opened = rows(u, 2, zero, F.lit("### Source material"), empty)
    body = inside(lines.select("doc_id", "at", "line"), u, "doc_id", "at", "first_line", "end_line").select("doc_id", "unit", F.lit(3).alias("step"), "at", "line")
    ends = rows(u, 4, zero, empty)
    return heads.unionByName(named).unionByName(opened).unionByName(body).unionByName(ends)


def unit_pools(chunks: DataFrame) -> DataFrame:
    """(scope, chapter, doc_id, at, origin): the chunks that a unit's lessons may draw on, for chunks (scope, doc_id, at, unit, title, role).

    chapter is the key of a primary unit's title. primary are its chunks; window what follows its first one in a document, up to the first
    chunk of another unit with a larger number, without chunks of other titles; supplemental all of the scope's supplemental ones. A chunk
    stands once, with the first of these that holds."""
    c = F.col
    keyed = chunks.withColumn("chapter", F.when(c("role") == PRIMARY, title_key(c("title"))))
    starts = keyed.where("chapter IS NOT NULL").groupBy("scope", "doc_id", "chapter").agg(F.min("at").alias("start"), F.min_by("unit", "at").alias("unit"), F.max("at").alias("last"))
    starts = starts.where("chapter != ''")
    # for each unit, a document's other units with a larger number that begin later: few rows
    other = keyed.where("chapter IS NOT NULL").select("scope", "doc_id", c("chapter").alias("c2"), c("unit").alias("u2"), c("at").alias("a2"))
    firsts = other.groupBy("scope", "doc_id", "c2", "u2").agg(F.array_sort(F.collect_set("a2")).alias("places"))
    later = starts.join(firsts, ["scope", "doc_id"]).where((c("c2") != c("chapter")) & (c("u2").isNull() | c("unit").isNull() | (c("u2") > c("unit"))))
    after = F.array_min(F.filter("places", lambda a: a > c("start")))
    ends = later.groupBy("scope", "doc_id", "chapter").agg(F.min(after).alias("stop"))
    spans = starts.join(ends, ["scope", "doc_id", "chapter"], "left")
    sizes = chunks.groupBy("scope", "doc_id").agg((F.max("at") + 1).alias("size"))
    spans = spans.join(sizes, ["scope", "doc_id"]).select("scope", "doc_id", "chapter", "start", F.coalesce("stop", "size").alias("stop"))
    named = keyed.select(F.struct("scope", "doc_id").alias("d"), "at", c("chapter").alias("own"), c("title").alias("t"))
    window = inside(named, spans.select(F.struct("scope", "doc_id").alias("d"), "chapter", "start", "stop"), "d", "at", "start", "stop")
    window = window.where((F.coalesce("t", F.lit("")) == "") | (title_key(c("t")) == c("chapter"))).select("d.scope", "chapter", "d.doc_id", "at", F.lit(1).alias("o"))
    primary = keyed.where("chapter != ''").select("scope", "chapter", "doc_id", "at", F.lit(0).alias("o"))
    chapters = starts.select("scope", "chapter").distinct()
    extra = keyed.where(c("role") == SUPPLEMENTAL).select("scope", "doc_id", "at").join(chapters, "scope").select("scope", "chapter", "doc_id", "at", F.lit(2).alias("o"))
    every = primary.unionByName(window).unionByName(extra).groupBy("scope", "chapter", "doc_id", "at").agg(F.min("o").alias("o"))
    return every.select("scope", "chapter", "doc_id", "at", F.element_at(F.array(*map(F.lit, (PRIMARY, "window", SUPPLEMENTAL))), c("o") + 1).alias("origin"))
