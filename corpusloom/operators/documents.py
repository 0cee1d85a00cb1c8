"""Documents as lines, sections, chunks and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import let, term_counts, tokens


#: Phrases of slide furniture; patterns of line parts to cut, and of lines to drop.
NOISE_PHRASES = (
    "navigation controls", "navigation icons", "footer icons", "footer navigation", "page number icon", "presentation controls",
    "slide navigation", "seal or stamp", "stamp/seal", "logo",
)
MONTH_DATE = (
    r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december|janvier|février|fevrier|mars|avril|"
    r"mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre)\s+\d{1,2},?\s+\d{4}\b"
)
COUNTER, DOT_LEADER = r"\b\d{1,3}\s*/\s*\d{1,3}\b", r"\.{5,}\s*\d{1,4}\s*$"
IMAGE_FILE = r"(?i)\bpage_\d+_[\w_]+\.(?:png|jpg|jpeg|webp)\b"
LEADING_FOOTER = (
    r"(?i)^\s*(?:prof(?:essor)?|pr\.?|dr\.?|teacher|enseignant|universit(?:y|e)|facult(?:y|e)|school|college|institute|department|"
    r"dept\.?|master|course|cours|lecture|chapter)\b.{0,240}?(?:\d{1,3}\s*/\s*\d{1,3}|\b\d{4}\b)\s+"
)
FOOTER_WORD = (
    r"(?i)\b(?:university|universit[eé]|faculty|facult[eé]|school|college|institute|department|dept\.?|professor|enseignant|copyright|"
    r"all rights reserved)\b"
)
#: (pattern, replacement) in the order in which a line is cleaned.
LINE_RULES = (
    (LEADING_FOOTER, ""), (r"\(\s*[,;|]?\s*\)", " "), (MONTH_DATE, " "), (COUNTER, " "), (IMAGE_FILE, " "), (r"(?:\s*\.\s*){5,}", " "),
)


def _bare(text: Column) -> Column:
    """Without comments and images, with plain line ends."""
    whole = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?s)<!--.*?-->", " ")
    return F.regexp_replace(whole, r"!\[[^\]]*\]\([^)]*\)|(?i:<img\b[^>]*>)", " ")


def _cleaned(text: Column, tables: bool = False) -> Column:
    """Array of (at, line, norm) of the lines that stay. With `tables`, lines between bars stay as they are, and what stands before a footer's
    counter at the head of a line stays too."""
    between = lambda line: line.startswith("|") & line.endswith("|")

    def clean(line: Column) -> Column:
        whole = line = F.trim(line)
        for pattern, by in LINE_RULES[1:] if tables else LINE_RULES:
            line = F.regexp_replace(line, pattern, by)
        line = F.btrim(F.regexp_replace(F.trim(line), r"[ \t]{2,}", " "), F.lit(" |\t" if tables else " |•\t"))
        return F.when(between(whole), whole).otherwise(line) if tables else line

    def stays(line: Column, norm: Column) -> Column:
        noise = F.lit(False)
        for p in NOISE_PHRASES:
            noise = noise | norm.contains(p)
        count = lambda mark: (F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))) / len(mark)
        footer = (F.length(line) <= 180) & line.rlike(FOOTER_WORD) & (
            line.rlike(COUNTER) | line.rlike(MONTH_DATE) | (count("|") + count(" - ") + count(" / ") >= 2) | (F.size(F.split(norm, " ")) <= 10)
        )
        thin = (F.length(line) >= 8) & (F.length(F.regexp_replace(line, r"[^\p{L}\p{N}]", "")) < 0.25 * F.length(line))
        good = ~noise & ~line.rlike(DOT_LEADER) & ~line.rlike(IMAGE_FILE) & ~footer & ~thin
        return (norm != "") & (between(line) | good if tables else good)

    lines = F.transform(F.split(_bare(text), "\n"), lambda x, i: F.struct(i.alias("at"), clean(x).alias("line")))
    lines = F.transform(lines, lambda x: F.struct(x["at"], x["line"], F.trim(F.regexp_replace(F.lower(x["line"]), r"\s+", " ")).alias("norm")))
    kept = F.filter(lines, lambda x: stays(x["line"], x["norm"]))
    if tables:  # (at - place) tells how many lines went before: where that grows between two lines that stay, there is a gap
        kept = F.transform(kept, lambda x, i: F.struct((x["at"] - i).alias("at"), x["line"], x["norm"]))
    return let(kept, lambda k: F.filter(k, lambda x, i: (i == 0) | (F.get(k, i - 1)["norm"] != x["norm"])))


def cleaned_text(text: Column) -> Column:
    """The lines that stay of a text with tables, one empty line for each gap of empty or dropped ones."""
    gap = lambda k, i: F.when(i == 0, "").when(F.get(k, i - 1)["at"] < F.get(k, i)["at"], "\n\n").otherwise("\n")
    return let(let(text, lambda t: _cleaned(t, True)), lambda k: F.array_join(F.transform(k, lambda x, i: F.concat(gap(k, i), x["line"])), ""))


def clean_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): cleaned lines without empty ones, slide furniture, footers, counters, dates, image names, lines of hardly
    any letters, and lines that repeat the kept line before them. A document's lines are cleaned within its row."""
    d = docs.select("doc_id", F.explode(_cleaned(F.col("text"))).alias("x"))
    return d.select("doc_id", F.col("x.at").alias("line_no"), "x.line")


def clean_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, n_removed)."""
    n, kept = F.size(F.split(_bare(F.col("text")), "\n")).cast("bigint"), F.size(_cleaned(F.col("text"))).cast("bigint")
    return docs.select("doc_id", n.alias("n_lines"), kept.alias("n_kept")).withColumn("n_removed", F.col("n_lines") - F.col("n_kept"))


def key_terms(docs: DataFrame, n: int = 8, least: int = 5) -> DataFrame:
    """(doc_id, term, n_uses, rank): the most frequent words of at least `least` characters, ties by first position; within a row."""
    counted = term_counts(F.filter(tokens(F.col("text")), lambda w: F.length(w) >= least))
    ranked = F.slice(F.array_sort(F.transform(counted, lambda c: F.struct((-c["n"]).alias("back"), c["at"].alias("at"), c["term"].alias("term")))), 1, n)
    each = docs.select("doc_id", F.posexplode(ranked).alias("rank", "c"))
    return each.select("doc_id", "c.term", (-F.col("c.back")).alias("n_uses"), (F.col("rank") + 1).alias("rank"))


def timeline(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, year, line of up to 240 characters): lines that name a year from 1900 to 2099."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    year = F.regexp_extract("line", r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1)
    return lines.withColumn("year", year).where("year != ''").select(
        "doc_id", "line_no", "year", F.substring(F.trim("line"), 1, 240).alias("line")
    )
