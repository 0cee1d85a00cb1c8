"""Semantic chunks: texts are cut into units, and units are joined until a valley of likeness between neighbours ends a chunk.

A unit is a paragraph; prose beyond the largest size is packed from its lines or sentences, and what has no place to break is cut
hard. Tables, fenced code and display formulas are units that are never cut off from their neighbours while there is another way.
Likeness of neighbours is the cosine of given unit vectors, or else the share of common terms. What one document gives is worked out in its
row, in Arrow batches; only given vectors are joined.

Defined results: a null or blank text gives no units; ties between valleys go to the later cut; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import cosine
from corpusloom.session import ship

MOST, LEAST, OVERLAP = 1800, 600, 180
#: Likeness up to which a cut is a valley, for vectors and for terms, and how far below the median of its neighbours another one lies.
THRESHOLD, TERM_THRESHOLD, BELOW_MEDIAN = 0.72, 0.12, 0.08
#: Words that don't count as common terms.
COMMON = frozenset(
    "about after also avec dans elle elles from have pour that their there these this those une which with sont".split()
)
TERM = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ0-9_-]{2,}")
_SENTENCE, _FORMULA = re.compile(r"(?<=[.!?…])\s+"), re.compile(r"\$\$[\s\S]*?\$\$|\\\[[\s\S]*?\\\]")
Unit = tuple[str, bool]


def _in_bars(line: str) -> bool:
    return line[:1] == "|" and line[-1:] == "|"


def structured(text: str) -> bool:
    """A fenced block, a display formula, or lines of which four in five are table rows."""
    for opening, closing in (("```", "```"), ("$$", "$$"), (r"\[", r"\]")):
        if text.startswith(opening) and text.endswith(closing):
            return True
    lines = [x for x in map(str.strip, text.splitlines()) if x]
    return len(lines) > 1 and 5 * sum(map(_in_bars, lines)) >= 4 * len(lines)


def wrapped(text: str, most: int) -> Iterator[str]:
    """Parts of `most` characters or less, cut at the last space or line end of each that lies in its second half, else hard."""
    at, text = 0, text.strip()
    while len(text) - at > most:
        cut = max(text.rfind(c, at, at + most + 1) for c in "\n ")
        if cut - at < max(1, most // 2):
            cut = at + most
        yield text[at:cut].strip()
        at = cut
        while at < len(text) and text[at].isspace():
            at += 1
    if at < len(text):
        yield text[at:]


def packed(parts: Iterator[str], most: int) -> Iterator[str]:
    """Parts joined by line ends as long as they fit."""
    held: list[str] = []
    size = -1
    for part in filter(None, parts):
        if held and size + 1 + len(part) > most:
            yield "\n".join(held)
            held, size = [], -1
        held.append(part)
        size += 1 + len(part)
    if held:
        yield "\n".join(held)


def units(text: str | None, most: int = MOST) -> list[Unit]:
    """(text, structured) of each unit."""
    found: list[Unit] = []
    for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text or ""))):
        fixed = structured(paragraph)
        if fixed or len(paragraph) <= most:
            found.append((paragraph, fixed))
            continue
        lines = [x for x in map(str.strip, paragraph.splitlines()) if x]
        pieces = lines if len(lines) > 1 else _SENTENCE.split(" ".join(paragraph.split()))
        found += [(piece, False) for piece in packed((part for piece in pieces for part in wrapped(piece, most)), most)]
    return found


def terms(text: str) -> frozenset[str]:
    return frozenset(TERM.findall(text.casefold())) - COMMON


def cohesion(texts: Sequence[str]) -> list[float]:
    """Shares of common terms of each text and the next; 0 beside a text without terms."""
    return [len(a & b) / len(a | b) if a and b else 0.0 for a, b in pairwise(map(terms, texts))]


def cuts(found: list[Unit], likeness: Sequence[float], most: int, least: int, overlap: int, threshold: float) -> list[tuple[int, int, str, float | None]]:
    """(first unit, unit after the last, boundary, likeness there) of each chunk; boundary is semantic, size or section_end."""
    ends = [0, *accumulate(len(t) + 2 for t, _ in found)]  # with the blank line after each
    spans, start = [], 0
    while start < len(found):
        room = most if start == 0 else max(200, most - overlap)
        size = lambda end: ends[end] - ends[start] - 2  # noqa: E731, B023
        end = max(start + 1, bisect_right(ends, ends[start] + room + 2) - 1)
        if end == len(found):
            spans.append((start, end, "section_end", None))
            break
        whole = [k for k in range(start + 1, end + 1) if size(k) >= least]
        free = [k for k in whole if not (found[k - 1][1] or found[k][1])]
        middle = sorted(likeness[k - 1] for k in free)[len(free) // 2] if free else 0.0
        valleys = [k for k in free if likeness[k - 1] <= max(threshold, middle - BELOW_MEDIAN)]
        cut = min(valleys, key=lambda k: (likeness[k - 1], -k)) if valleys else (free or whole or [end])[-1]
        spans.append((start, cut, "semantic" if valleys else "size", likeness[cut - 1]))
        start = cut
    return spans


def tail(text: str, room: int) -> str:
    """The last whole sentences of prose that fit; longer ones are passed over."""
    if room < 40:
        return ""
    lines = [x for x in _FORMULA.sub(" ", text).splitlines() if not _in_bars(x.strip())]
    sentences = [s for line in lines for s in map(str.strip, _SENTENCE.split(line)) if s]
    kept: list[str] = []
    used = 0
    for s in reversed(sentences):
        more = len(s) + bool(kept)
        if kept and used + more > room:
            break
        if more <= room:
            kept.append(s)
            used += more
    return " ".join(reversed(kept))


def chunked(
    text: str | None, likeness: Sequence[float] | None = None, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP, threshold: float = THRESHOLD
) -> list[tuple[str, str, float | None]]:
    """(text, boundary, likeness) of each chunk. A likeness for each pair of neighbours is taken if there is one; else terms decide."""
    found = units(text, most)
    if found and len(text) <= most:
        return [(text.strip(), "section_end", None)]
    if likeness is None or len(likeness) != len(found) - 1:
        likeness, threshold = cohesion([t for t, _ in found]), min(threshold, TERM_THRESHOLD)
    made, before = [], ""
    for start, end, boundary, like in cuts(found, likeness, most, least, overlap, threshold):
        body = "\n\n".join(t for t, _ in found[start:end])
        lead = tail(before, min(overlap, most - len(body) - 2)) if before and overlap > 0 and len(body) < most else ""
        made.append((f"{lead}\n\n{body}" if lead else body, boundary, None if like is None else round(like, 4)))
        before = body
    return made


def semantic_units(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, unit, text, structured) of documents (doc_id, text), for those who give vectors to units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = units(text, most)
                columns = [pa.array([doc] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32())]
                columns += [pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "unit", "text", "structured"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, unit int, text string, structured boolean")


def likeness_of(vectors: DataFrame) -> DataFrame:
    """(doc_id, likeness) of unit vectors (doc_id, unit, embedding): the cosines of neighbours, in order. A pair of which one lacks a vector is left out,
    so that the list is too short to be taken."""
    after = vectors.select("doc_id", (F.col("unit") - 1).alias("unit"), F.col("embedding").alias("after"))
    each = vectors.join(after, ["doc_id", "unit"]).select("doc_id", F.struct("unit", cosine(F.col("embedding"), F.col("after")).alias("x")).alias("p"))
    return each.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"]).alias("likeness"))


def semantic_chunks(
    docs: DataFrame, vectors: DataFrame | None = None, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, chunk, boundary, likeness, text) of documents (doc_id, text), doc_id being unique, and unit vectors (doc_id, unit, embedding), if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, like in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "likeness"))):
                made = chunked(text, like, most, least, overlap, threshold)
                columns = [pa.array([doc] * len(made), pa.int64()), pa.array(range(len(made)), pa.int32())]
                columns += [pa.array([m[k] for m in made], kind) for k, kind in ((1, pa.string()), (2, pa.float64()), (0, pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "chunk", "boundary", "likeness", "text"])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if vectors is None:
        rows = rows.withColumn("likeness", F.lit(None).cast("array<double>"))
    else:
        rows = rows.join(likeness_of(vectors), "doc_id", "left")
    return rows.mapInArrow(run, "doc_id bigint, chunk int, boundary string, likeness double, text string")
