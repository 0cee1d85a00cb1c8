"""Substring dedup by hashing lines, paragraphs and the sentences in lines.

Units are every line with a word, every paragraph (lines with words on end, two or more), and every piece of MIN_PIECE words
or more into which a line falls at sentence ends, so that a passage is found where it is wrapped in another way and where it stands in the middle
of a line. A unit is normalised (A-Z in lower case, single blanks) and hashed; digests are grouped over the whole corpus, the
occurrence with the smallest (doc_id, start) stays, and every other one is a copy. Copies that touch or overlap
within a document are one passage, with its offsets in the original text. Every copy points to an earlier place of the
same words, so each word keeps a place that no passage covers. A passage without a whole unit inside is not found.

Only digests and numbers leave the tasks that read the texts. Groups are counted with map-side combining; the join back to
the occurrences has no operator above it that needs a digest's rows together, so that Spark may split the occurrences of a
digest that is everywhere; passages are put together within a document.

Defined results: a null or empty text has no units; repeated rows with one doc_id and text are one document; one doc_id on two texts ranks
as one, equal starts by their text's hash; a null doc_id ranks last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stage, table
from corpusloom.session import ship

#: Words in a piece of a line, at least.
MIN_PIECE = 4
_BLANK = " \t\n\x0b\f\r"
#: A line is cut after such a mark, or several, and the white space that follows.
_CUT = re.compile(r"[.!?][\x20\x09\x0B-\x0D]+")
LAST = (1 << 63) - 1


def units(text: str, by: str = "all", min_words: int = 1, min_piece: int = MIN_PIECE) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    """(start, end, first, last, before, after, words): code points, end exclusive; ordinals of its first and last piece;
    words of the text before and up to its end; its normalised text."""
    piece = words = at = 0
    lines: list[tuple[int, int, int, int, int, int, bytes]] = []

    def paragraph() -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
        if len(lines) > 1:
            first, last = lines[0], lines[-1]
            yield first[0], last[1], first[2], last[3], first[4], last[5], b" ".join(x[6] for x in lines)
        lines.clear()

    for line in text.split("\n"):
        pieces, begin = [], 0
        for end in [*(m.end() for m in _CUT.finditer(line)), len(line)]:
            part = line[begin:end]
            plain = part.encode().lower().split()
            if plain:
                start = at + begin + len(part) - len(part.lstrip(_BLANK))
                stop = at + begin + len(part.rstrip(_BLANK))
                pieces.append((start, stop, piece, piece, words, words + len(plain), b" ".join(plain)))
                piece += 1
                words += len(plain)
            begin = end
        if pieces:
            first, last = pieces[0], pieces[-1]
            lines.append((first[0], last[1], first[2], last[3], first[4], last[5], b" ".join(x[6] for x in pieces)))
            if by in ("all", "line"):
                yield lines[-1]
            if by == "all" and len(pieces) > 1:
                yield from (x for x in pieces if x[5] - x[4] >= min_piece)
        elif by in ("all", "paragraph"):
            yield from paragraph()
        at += len(line) + 1
    if by in ("all", "paragraph"):
        yield from paragraph()


def _occurrences(docs: DataFrame, by: str, min_words: int, min_piece: int) -> DataFrame:
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.binary()]
    names = ["doc_id", "key", "start", "end", "first", "last", "before", "after", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]

            def out() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
                for c in columns:
                    c.clear()
                return made

            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
                for *numbers, plain in units(text or "", by, min_words, min_piece):
                    if numbers[5] - numbers[4] >= min_words:
                        for c, v in zip(columns, (doc, key, *numbers, hashlib.blake2b(plain, digest_size=16).digest())):
                            c.append(v)
                        if len(columns[0]) >= 50_000:
                            yield out()
            yield out()

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), "text").mapInArrow(
        run, "doc_id bigint, key bigint, start int, end int, first int, last int, before int, after int, digest binary"
    )


def repeated_units(docs: DataFrame, by: str = "all", min_words: int = 1, min_piece: int = MIN_PIECE) -> DataFrame:
    """(doc_id, key, start, end, first, last, before, after, keep_doc_id, keep_start): each copy of a unit, and the one that stays.

    by: "line", "paragraph", or "all", with pieces of lines. key is the text's hash, that tells texts of one doc_id apart.
    """
    found = stage(_occurrences(docs, by, min_words, min_piece), "units")
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.col("start"), F.col("key"))
    groups = stage(
        found.groupBy("digest").agg(F.min(place).alias("keep"), F.max(place).alias("top")).where("keep != top").select("digest", "keep"),
        "repeated",
    )
    return found.join(groups, "digest").where(place != F.col("keep")).select(
        "doc_id", "key", "start", "end", "first", "last", "before", "after",
        F.nullif(F.col("keep.doc_id"), F.lit(LAST)).alias("keep_doc_id"), F.col("keep.start").alias("keep_start"),
    )


def repeated_passages(docs: DataFrame, by: str = "all", min_words: int = 1, min_piece: int = MIN_PIECE) -> DataFrame:
    """(doc_id, key, start, end, n_words, keep_doc_id, keep_start): one row for each passage to remove. The last two tell where the
    passage's first unit, the longest one there, stays."""
    copies = repeated_units(docs, by, min_words, min_piece).distinct()
    order = Window.partitionBy("doc_id", "key").orderBy("first", F.desc("last"), "start", F.desc("end"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce((F.col("first") > F.max("last").over(before) + 1).cast("int"), F.lit(0))
    numbered = copies.withColumn("apart", apart).withColumn("passage", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.min(F.struct("first", -F.col("last"), "keep_doc_id", "keep_start"))
    return (
        numbered.groupBy("doc_id", "key", "passage")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("before").alias("before"), F.max("after").alias("after"), kept.alias("kept"))
        .select(
            "doc_id", "key", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"),
            (F.col("after") - F.col("before")).cast("bigint").alias("n_words"),
            F.col("kept.keep_doc_id").alias("keep_doc_id"), F.col("kept.keep_start").cast("bigint").alias("keep_start"),
        )
    )


def without_repeats(docs: DataFrame, by: str = "all", min_words: int = 1, min_piece: int = MIN_PIECE) -> DataFrame:
    """The input rows with repeated passages cut out of the text, and `removed`: their (start, end) in the original."""
    spans = (
        repeated_passages(docs, by, min_words, min_piece).groupBy("doc_id", "key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    )
    d, s = docs.withColumn("_key", F.xxhash64("text")).alias("d"), spans.alias("s")
    same = F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("s.doc_id")) & (F.col("d._key") == F.col("s.key"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    r = F.coalesce(F.col("s.removed"), none)
    text = F.col("d.text")
    begin = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(r, lambda x: x["end"]))
    stop = F.concat(F.transform(r, lambda x: x["start"]), F.array(F.length(text).cast("bigint")))
    kept = F.zip_with(begin, stop, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return d.join(s, same, "left").select(
        *[F.col(f"d.`{c}`") for c in docs.columns if c not in ("text", "removed")],
        F.when(text.isNotNull(), F.array_join(kept, "")).alias("text"), r.alias("removed"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("key")


_PLAIN = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
_LEAD = "length(regexp_extract({}, '^[\\x20\\x09-\\x0D]*'))"
SQL = {
    "op8_substring_dedup": rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
lo AS (SELECT doc_id, text, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
c AS (SELECT *, string_split(regexp_replace(line, '([.!?][\x20\x09\x0B-\x0D]+)', '\1' || chr(10), 'g'), chr(10)) AS cut FROM lo),
p0 AS (SELECT doc_id, text, i, off, unnest(cut) AS part, generate_subscripts(cut, 1) AS k FROM c),
p1 AS (SELECT doc_id, text, i, part, k, {_PLAIN.format('part')} AS plain,
  off + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, text, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p0),
p2 AS (SELECT *, off + {_LEAD.format('part')} AS s, len(string_split(plain, ' ')) AS w FROM p1 WHERE plain <> ''),
p AS (SELECT doc_id, text, i, plain, s, s + length(regexp_replace(regexp_replace(part, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')) AS e, w,
  row_number() OVER (PARTITION BY doc_id, text ORDER BY s) AS n, sum(w) OVER (PARTITION BY doc_id, text ORDER BY s) AS wa FROM p2),
ln AS (SELECT doc_id, text, i, string_agg(plain, ' ' ORDER BY n) AS plain, min(s) AS s, max(e) AS e, min(n) AS a, max(n) AS b, min(wa - w) AS w0, max(wa) AS w1, count(*) AS k
  FROM p GROUP BY doc_id, text, i),
pg AS (SELECT doc_id, text, string_agg(plain, ' ' ORDER BY i) AS plain, min(s) AS s, max(e) AS e, min(a) AS a, max(b) AS b, min(w0) AS w0, max(w1) AS w1
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS g FROM ln) GROUP BY doc_id, text, g HAVING count(*) > 1),
u AS (
  SELECT doc_id, text, plain, s, e, a, b, w0, w1 FROM ln
  UNION SELECT doc_id, text, plain, s, e, a, b, w0, w1 FROM pg
  UNION SELECT doc_id, text, p.plain, p.s, p.e, n, n, wa - w, wa FROM p JOIN ln USING (doc_id, text, i) WHERE k > 1 AND w >= {MIN_PIECE}),
r AS (SELECT *, first_value(doc_id) OVER o AS kd, first_value(s) OVER o AS ks FROM u WINDOW o AS (PARTITION BY plain ORDER BY doc_id, s)),
x AS (SELECT * FROM r WHERE doc_id <> kd OR s <> ks),
y AS (SELECT *, coalesce(CAST(a > max(b) OVER (PARTITION BY doc_id, text ORDER BY a, b DESC, s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS INT), 0) AS gap FROM x),
z AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, text ORDER BY a, b DESC, s, e DESC ROWS UNBOUNDED PRECEDING) AS g FROM y)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", CAST(max(w1) - min(w0) AS BIGINT) AS n_words,
       min(struct_pack(a := a, b := -b, d := kd, s := ks)).d AS keep_doc_id,
       CAST(min(struct_pack(a := a, b := -b, d := kd, s := ks)).s AS BIGINT) AS keep_start
FROM z GROUP BY doc_id, text, g"""
}
