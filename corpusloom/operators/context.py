"""What is put before a reader: predicates of chunks and questions, comparisons, formula hits, samples, expansions, citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import let, without_marks
from corpusloom.operators.structure import distinct_by_key

#: Words by which a comparison, a formula question, a question about a whole course is known, and words that name nothing.
COMPARES = r"(?i)\b(compare|comparison|difference|differentiate|versus|vs|between|comparer|comparaison|diff[eé]rence|entre)\b"
COMPARED = (
    r"(?i)\bbetween\s+(.+?)\s+and\s+(.+?)(?:$|[?.,;]|\s+in\s+|\s+for\s+)",
    r"(?i)\bcompare\s+(.+?)\s+(?:and|with|to|versus|vs\.?)\s+(.+?)(?:$|[?.,;]|\s+in\s+|\s+for\s+)",
    r"(?i)\bentre\s+(.+?)\s+et\s+(.+?)(?:$|[?.,;]|\s+dans\s+|\s+pour\s+)",
    r"(?i)\bcomparer\s+(.+?)\s+(?:et|avec|a|à)\s+(.+?)(?:$|[?.,;]|\s+dans\s+|\s+pour\s+)",
    r"(?i)^(.*?)\b(?:versus|vs\.?)\b(.*)$",
)
NAMELESS = (
    "what whats is are the a an of for in on to from course material materials explain compare comparison difference differentiate "
    "between versus vs and with me please quelle quel est sont la le les des du de un une dans pour cours document documents explique "
    "comparer comparaison difference différence entre et"
).split()
FORMULA = r"(?i)\b(formula|equation|derive|derivation|calculate|compute|symbol|formule|[eé]quation|calculer|calcule)\b|[=+\-*/^_]"
MATH = r"\$\$|\\(?:frac|sum|sqrt|hat|bar|vec|int|prod)\b|[=∑√∫±×÷≤≥≈∞]|[A-Za-z]\s*[_^]\s*[A-Za-z0-9]"
OVERVIEW_INTENTS, COURSE_WORDS = "summarize summary overview explain teach describe resume explique".split(), "course class lecture lesson document documents files materials cours chapitre".split()
SUPPLEMENT = r"(?i)\b(appendix|supplement|supplemental|extra|annex|annexe|bonus|exercise|exercises|td|tp|solution|solutions)\b"
SEQUENCE = r"(?i)\b(?:week|lecture|chapter|module|unit|part|lesson|chapitre|cours|semaine)[\s_-]*(\d{1,3}|[ivxlc]+)\b"
ISO_DATE = r"\b((?:19|20)\d{2})[-_/.](\d{1,2})[-_/.](\d{1,2})\b"
#: Which ranking an output takes.
MODES = {
    "text": "semantic_topk", "chat": "semantic_topk", "quiz": "coverage_broad", "report": "topic_clusters", "presentation": "topic_clusters",
    "podcast": "narrative_arc", "chart": "relationship_dense", "diagram": "relationship_dense", "mindmap": "topic_clusters",
}


def comparison_terms(question: Column) -> Column:
    """The two or more names that a question compares, each once, in its order; empty for other questions."""
    flat = F.btrim(F.regexp_replace(question, r"\s+", " "), F.lit(" ?!."))
    both = F.array().cast("array<string>")
    for pattern in reversed(COMPARED):
        both = F.when(flat.rlike(pattern), F.array(F.regexp_extract(flat, pattern, 1), F.regexp_extract(flat, pattern, 2))).otherwise(both)
    parts = F.flatten(F.transform(both, lambda x: F.split(x, r"\s*,\s*|\s*/\s*")))

    def clean(x: Column) -> Column:
        words = F.transform(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_+/#.-]*"), F.lit(0)), lambda w: F.btrim(w, F.lit(".,;:?!()[]{}\"'")))
        kept = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*NAMELESS))
        return F.array_join(F.slice(kept, F.greatest(F.size(kept) - 4, F.lit(1)), 5), " ")

    def once(names: Column) -> Column:
        low = F.transform(names, F.lower)
        first = F.filter(names, lambda n, i: (n != "") & (F.array_position(low, F.lower(n)) == i + 1))
        return F.when(F.size(first) >= 2, first).otherwise(F.array().cast("array<string>"))

    return F.when(question.rlike(COMPARES), let(F.transform(parts, clean), once)).otherwise(F.array().cast("array<string>"))


def balanced_merge(term_hits: DataFrame, full_hits: DataFrame, target: int) -> DataFrame:
    """(query_id, doc_id, term, pos): the best hit of each term, then the second ones, and so on, then those of the whole question; each
    document once, at its first place. term_hits (query_id, term_no, doc_id, rank), full_hits (query_id, doc_id, rank)."""
    low = term_hits.where(F.col("rank") <= target).select("query_id", "doc_id", F.lit(0).alias("part"), F.col("rank").alias("at"), "term_no")
    rest = full_hits.select("query_id", "doc_id", F.lit(1).alias("part"), F.col("rank").alias("at"), F.lit(-1).alias("term_no"))
    first = low.unionByName(rest).groupBy("query_id", "doc_id").agg(F.min(F.struct("part", "at", "term_no")).alias("first"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "doc_id"))
    return first.select("query_id", "doc_id", F.col("first.term_no").alias("term"), pos.alias("pos")).where(F.col("pos") <= target)


def formula_score(text: Column, terms: Column) -> Column:
    """Four for each term that a mathematical text holds and one for each formula mark, six at most; without a term a third of it. Null for
    other texts."""
    low = F.lower(text)
    overlap = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    density = F.least(F.size(F.regexp_extract_all(text, F.lit(MATH), F.lit(0))), F.lit(6))
    score = (overlap * 4 + density) * F.when((overlap == 0) & (F.size(terms) > 0), 0.35).otherwise(1.0)
    return F.when(text.rlike(MATH), F.round(score, 6))


def _words(flat: Column) -> Column:
    """Words of a text in single blanks."""
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1)


def navigation(heading: Column, text: Column) -> Column:
    """Chunks that only lead elsewhere: tables of contents, indexes, lists of pages."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    low, n = F.lower(flat), F.length(flat)
    refs = F.size(F.regexp_extract_all(flat, F.lit(r"\b[A-Z][A-Za-z'(),.\- ]{3,80}\s+\d{1,4}\b"), F.lit(0)))
    some = F.regexp_count(flat, F.lit(r"\s\d{1,4}\b")) >= 3  # each of refs ends with one
    numbers = F.size(F.regexp_extract_all(flat, F.lit(r"\b\d{1,4}\b"), F.lit(0)))
    return (
        F.lower(heading).rlike("contents|index") | (flat == "") | F.contains(low, F.lit("*index*")) | low.startswith("index ")
        | (F.contains(F.substring(low, 1, 120), F.lit("contents")) & (n < 1200)) | (flat.startswith("- ") & (n < 500) & (numbers >= 2)) | ((n < 1600) & some & (refs >= 3))
    )


def structure_only(heading: Column, text: Column) -> Column:
    """Four words or fewer, the heading alone, or mostly short lines without an end mark."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = _words(flat)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: ~x.rlike("[.!?:;]$") & (F.size(F.split(x, r"\s+")) <= 8)))
    return (words <= 4) | (F.lower(flat) == F.lower(heading)) | ((F.size(lines) >= 3) & (short >= 0.7 * F.size(lines)))


def thin(title: Column, text: Column) -> Column:
    """Content that says too little: under 85 words, its title alone, or under three sentences and 130 words."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = _words(flat)
    ends = F.size(F.regexp_extract_all(flat, F.lit(r"[.!?](?:\s|$)"), F.lit(0)))
    return (words < 85) | (F.lower(flat) == F.lower(title)) | ((ends < 3) & (words < 130))


def noisy_section(path: Column, title: Column, text: Column) -> Column:
    """Sections that outlines leave out: furniture, institutions, hardly any text, titles that are too long."""
    low = F.lower(F.trim(title))
    furniture = r"^(contents?|index|references|bibliography|questions?|thank you|merci|agenda|plan|outline|slide \d+|page \d+)$"
    known = r"\b(plan de|agenda|table of contents|contents)\b"
    house = r"\b(university|universite|ecole|school|college|faculty|faculte|professor|enseignant)\b"
    return (
        (low == "") | low.rlike(furniture) | F.lower(path).rlike(known) | F.lower(path).rlike(house) | low.rlike("^(master|degree|program) ")
        | (F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) < 24) | (F.length(title) > 140)
    )


def overview_question(question: Column) -> Column:
    """Asks about the course as a whole: a word of intent with a word for the course, or with this, it, all in eight words at most."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(without_marks(F.lower(question)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    words = F.split(norm, " ")
    has = lambda known: F.exists(words, lambda w: w.isin(*known))
    intent, target, vague = has(OVERVIEW_INTENTS), has(COURSE_WORDS), has(["this", "that", "it", "all", "everything", "these", "ce", "cette", "tout"])
    return (norm != "") & ((intent & target) | ((intent | (has(["about"]) & target)) & vague & (F.size(words) <= 8)))


def roman(numeral: Column) -> Column:
    """Value of a Roman numeral of i, v, x, l, c; null for other text."""
    values = F.transform(F.split(F.lower(numeral), ""), lambda c: reduce(lambda e, kv: e.when(c == kv[0], kv[1]), [("v", 5), ("x", 10), ("l", 50), ("c", 100)], F.when(c == "i", 1)))
    total = let(values, lambda v: F.aggregate(F.transform(v, lambda x, i: F.when(x < F.coalesce(F.get(v, i + 1), F.lit(0)), -x).otherwise(x)), F.lit(0), lambda t, x: t + x))
    return F.when(F.lower(numeral).rlike("^[ivxlc]+$"), total)


def document_order(filename: Column, title: Column) -> list[Column]:
    """Sort keys of course files: supplements last; then a sequence number, a date, any number; those without one last; then the name."""
    both = F.concat(filename, F.lit(" "), title)
    token = F.regexp_extract(both, SEQUENCE, 1)
    number = F.coalesce(F.when(token.rlike("^[0-9]+$"), token.cast("int")), roman(token))
    day = [F.regexp_extract(both, ISO_DATE, i).cast("int") for i in (1, 2, 3)]
    date = F.when(both.rlike(ISO_DATE), day[0] * 10_000 + day[1] * 100 + day[2])
    any_ = F.when(filename.rlike("[0-9]"), F.regexp_extract(filename, "([0-9]{1,8})", 1).cast("int"))
    found = F.coalesce(F.when(token != "", number), date, any_)
    return [F.when(both.rlike(SUPPLEMENT), 1).otherwise(0), F.when(found.isNull(), 1).otherwise(0), found, F.lower(filename)]


def section_budget(n: Column) -> Column:
    return F.when(n <= 10, F.greatest(F.lit(4), n)).when(n <= 30, 10).otherwise(14)


def select_sections(sections: DataFrame, limit: int) -> DataFrame:
    """(doc_id, section, pos): all sections up to `limit`; else those of level 1 and 2 up to half of it, then every stride-th, then the rest,
    each once."""
    w = Window.partitionBy("doc_id")
    s = sections.select("doc_id", "section", "level").withColumn("i", F.row_number().over(w.orderBy("section")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    half = max(3, limit // 2)
    s = s.withColumn("top", F.when(F.col("level") <= 2, F.row_number().over(Window.partitionBy("doc_id", F.col("level") <= 2).orderBy("section"))))
    chosen = F.col("top") <= half
    s = s.withColumn("k", F.count_if(chosen).over(w))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / F.greatest(F.lit(1), limit - F.col("k"))))
    tier = F.when(F.col("n") <= limit, 0).when(F.coalesce(chosen, F.lit(False)), 0).when(F.col("i") % stride == 0, 1).otherwise(2)
    pos = F.row_number().over(w.orderBy(tier, "section"))
    return s.select("doc_id", "section", pos.alias("pos")).where(F.col("pos") <= limit)


def broad_sample(chunks: DataFrame, scope: str, group: str, order: str, target: int) -> DataFrame:
    """(scope, order, pos): the first chunk of each group, then every stride-th, each once, `target` a scope at most."""
    w = Window.partitionBy(scope)
    c = chunks.select(scope, group, order).withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    c = c.withColumn("first", F.row_number().over(Window.partitionBy(scope, group).orderBy(order)) == 1)
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / target))
    c = c.withColumn("tier", F.when(F.col("first"), 0).when(F.col("i") % stride == 0, 1))
    pos = F.row_number().over(w.orderBy("tier", order))
    return c.where("tier IS NOT NULL").select(scope, order, pos.alias("pos")).where(F.col("pos") <= target)


def expanded(chunks: DataFrame, most: int = 4500) -> DataFrame:
    """(doc_id, section, n_parts, text): a chunk's path, summary, the chunks before and after it and itself, each wording once, cut at a word.
    chunks (doc_id, section, path, summary, text)."""
    w = Window.partitionBy("doc_id").orderBy("section")
    c = chunks.withColumn("before", F.lag("text").over(w)).withColumn("after", F.lead("text").over(w))
    labelled = lambda name, c_: F.when(F.trim(c_) != "", F.concat(F.lit(name), c_))
    parts = F.array(
        labelled("Section path: ", F.col("path")), labelled("Section summary: ", F.col("summary")), F.col("before"), F.col("after"),
        F.concat(F.lit("Focused chunk:\n"), F.col("text")),
    )
    plain = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    once = distinct_by_key(F.array_compact(parts), plain)
    c = c.withColumn("parts", once).withColumn("text", F.array_join(F.transform("parts", lambda x: F.btrim(x, F.lit(" \n\t"))), "\n\n"))
    cut = F.regexp_replace(F.substring("text", 1, most), r" [^ ]*$", "")
    return c.select("doc_id", "section", F.size("parts").alias("n_parts"), F.when(F.length("text") > most, cut).otherwise(F.col("text")).alias("text"))


def citations(chunks: DataFrame, wanted: DataFrame | Column, scope: str, item: str, most: int = 4) -> DataFrame:
    """(scope, item, pos, snippet): of a scope's chunks (scope, item, text) the wanted ones, which are rows (scope, item) or those that meet a condition, else its
    first two; `most` at most."""
    if isinstance(wanted, Column):
        marked = chunks.withColumn("_in", F.when(wanted, True))
    else:
        marked = chunks.join(wanted.select(scope, item, F.lit(True).alias("_in")).distinct(), [scope, item], "left")
    w = Window.partitionBy(scope)
    marked = marked.withColumn("_n", F.count("_in").over(w)).withColumn("_i", F.row_number().over(w.orderBy(item)))
    kept = marked.where((F.col("_n") > 0) & F.col("_in") | (F.col("_n") == 0) & (F.col("_i") <= 2))
    pos = F.row_number().over(w.orderBy(item))
    snippet = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 360)
    return kept.select(scope, item, pos.alias("pos"), snippet.alias("snippet")).where(F.col("pos") <= most)


def graph_chunks(scores: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, chunk, score, pos): chunks of the best `most` nodes, then of their edges, then of the nodes at the other ends; each once, with
    a score that falls with its place. scores (query_id, node, score), nodes (node, chunk), edges (source, target, chunk)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node"))
    best = scores.select("query_id", "node", rank.alias("r")).where(F.col("r") <= most)
    own = best.join(nodes, "node").select("query_id", "chunk", F.lit(0).alias("part"), F.col("r").alias("at"))
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("far"), "chunk").unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("far"), "chunk"))
    near = best.join(ends, "node")
    on = near.select("query_id", "chunk", F.lit(1).alias("part"), F.col("r").alias("at"))
    far = near.select("query_id", F.col("far").alias("node"), "r").join(nodes, "node").select("query_id", "chunk", F.lit(2).alias("part"), F.col("r").alias("at"))
    first = own.unionByName(on).unionByName(far).groupBy("query_id", "chunk").agg(F.min(F.struct("part", "at")).alias("first"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "chunk"))
    ranked = first.select("query_id", "chunk", pos.alias("pos"))
    return ranked.withColumn("score", F.round(F.greatest(F.lit(0.65), 1 - 0.03 * (F.col("pos") - 1)), 6))


def evidence(question_terms: Column, text: Column) -> Column:
    """Whether a text holds two of a question's terms as words, or its only one."""
    terms = F.array_distinct(question_terms)
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return (F.size(terms) > 0) & (F.size(F.array_intersect(terms, words)) >= F.least(F.lit(2), F.size(terms)))


def off_topic(score: Column, has_evidence: Column) -> Column:
    return (score < -2.0) & ~has_evidence


def usable(text: Column) -> Column:
    """24 characters that aren't white space, ten of them letters."""
    return (F.length(F.regexp_replace(text, r"\s", "")) >= 24) & (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 10)


def one_of(value: Column, known: tuple[str, ...], default: str) -> Column:
    """A name in lower case with single underscores if it is known, else the default."""
    name = F.regexp_replace(F.trim(F.lower(value)), r"[\s-]+", "_")
    return F.when(name.isin(*known), name).otherwise(F.lit(default))


def lesson_rank(chunks: DataFrame, terms: Column, unit: Column, title: Column, most: int = 12) -> DataFrame:
    """chunks with their score for a lesson and rank: six for the unit's name, eight for the title's, one a term, up to three for length."""
    low, words = F.lower("text"), F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    score = (
        F.when(F.contains(low, F.lower(unit)), 6.0).otherwise(0.0) + F.when(F.contains(low, F.lower(title)), 8.0).otherwise(0.0)
        + F.size(F.filter(terms, lambda t: F.contains(low, t))) + F.least(F.lit(3.0), words / 90.0)
    )
    scored = chunks.withColumn("score", F.round(score, 6))
    rank = F.row_number().over(Window.partitionBy("lesson").orderBy(F.desc("score"), "chunk"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def examples_first(chunks: DataFrame, scope: str, order: str) -> DataFrame:
    """Adds pos: chunks that show an example come first, then the others, both in their order."""
    shows = F.lower("text").rlike(r"\b(example|for instance|e\.g\.|case study|exemple|par exemple)")
    return chunks.withColumn("pos", F.row_number().over(Window.partitionBy(scope).orderBy(F.when(shows, 0).otherwise(1), order)))


def without_near_copies(rows: DataFrame, scope: str, order: str, words: str, most: float = 0.55) -> DataFrame:
    """Rows in order, without those whose words overlap with an earlier row that stays by `most` of the smaller set or more; a row without words stays.
    Of equal sets only the first can stay, so the fold, which runs within a scope's row, sees each set once, whatever the number of rows."""
    sets = rows.select(scope, order, F.array_sort(F.array_distinct(words)).alias("w"))
    some = F.coalesce(F.size("w") > 0, F.lit(False))
    first = sets.where(some).groupBy(scope, "w").agg(F.min(order).alias(order))
    lists = first.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct(order, "w"))).alias("l"))

    def step(kept: Column, x: Column) -> Column:
        near = F.exists(
            kept, lambda k: (F.least(F.size(k["w"]), F.size(x["w"])) > 0) & (F.size(F.array_intersect(k["w"], x["w"])) >= most * F.least(F.size(k["w"]), F.size(x["w"])))
        )
        return F.when(near, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("l", F.slice("l", 1, 0), step)
    return lists.select(scope, F.explode(F.transform(kept, lambda k: k[order])).alias(order)).unionByName(sets.where(~some).select(scope, order))
