"""Course building: graphs of everything, evidence for lessons, questions and knowledge items from statements, names that stay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import concept_key, unrolled
from corpusloom.operators.structure import SENTENCE_END
from corpusloom.session import stage

#: Which words make a statement one of a kind, looked for in this order.
KINDS = (
    ("definition", r"\b(is|are|means|refers to|is called)\b"), ("cause", r"\b(because|therefore|depends|leads to|causes?)\b"),
    ("comparison", r"\b(than|versus|unlike|whereas)\b"), ("process", r"\b(first|then|next|finally|step)\b"), ("quantity", r"[0-9]"),
)


#: Titles of a side that are paired in one group.
MEMBERS = 2048


def edges(rows: DataFrame, source: tuple[str, str], target: tuple[str, str], relation: str, confidence: float = 1.0) -> DataFrame:
    """(source, target, relation, confidence) of rows: nodes are named by their kind and a column's value; rows with an unknown end give none."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    e = rows.select(node(*source).alias("source"), node(*target).alias("target"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))
    return e.where("source IS NOT NULL AND target IS NOT NULL AND source != target").distinct()


def together(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def graph_text(graph: DataFrame, scope: str, most: int) -> DataFrame:
    """(scope, n_edges, text): a scope's edges, surest first, a line each, while they fit `most` characters."""
    line = F.concat("source", F.lit(" -["), "relation", F.lit("]-> "), "target")
    w = Window.partitionBy(scope).orderBy(F.desc("confidence"), "source", "relation", "target")
    g = graph.withColumn("line", line).withColumn("at", F.row_number().over(w))
    g = g.withColumn("used", F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    return g.groupBy(scope).agg(F.count(F.lit(1)).alias("n_edges"), F.array_join(lines, "\n").alias("text"))


def lesson_evidence(support: DataFrame, most: int = 12) -> DataFrame:
    """(lesson, chunk, rank): of supported chunks (lesson, chunk, hits) each goes to the first lesson that it supports; the best `most` a lesson."""
    first = support.groupBy("chunk").agg(F.min_by("hits", "lesson").alias("hits"), F.min("lesson").alias("lesson"))
    rank = F.row_number().over(Window.partitionBy("lesson").orderBy(F.desc("hits"), "chunk"))
    return first.select("lesson", "chunk", rank.alias("rank")).where(F.col("rank") <= most)


def statements_of(text: Column) -> Column:
    """A text's sentences in single blanks, without the marks of headings and lists."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.transform(F.split(flat, SENTENCE_END), lambda s: F.btrim(s, F.lit(" -*#|"))), lambda s: s != "")


def fallback_questions(sections: DataFrame, most: int = 5, least: int = 45) -> DataFrame:
    """(doc_id, section, pos, answer, options): the first long statement of a document's sections, and those of up to three sections after it, or before at the
    end, as distractors; two options at least."""
    long = F.filter(statements_of(F.col("text")), lambda x: F.length(x) >= least)
    s = unrolled(sections.select("doc_id", "section", F.explode_outer(F.slice(long, 1, 1)).alias("answer")), "answer")
    w = Window.partitionBy("doc_id").orderBy("section")
    others = F.filter(F.array(*[F.lead("answer", k).over(w) for k in (1, 2, 3)], *[F.lag("answer", k).over(w) for k in (1, 2, 3)]), lambda x: x.isNotNull())
    s = s.withColumn("pos", F.row_number().over(w)).withColumn("others", others).where(F.col("pos") <= most)
    options = F.slice(F.array_distinct(F.concat(F.array("answer"), "others")), 1, 4)
    return s.select("doc_id", "section", "pos", "answer", options.alias("options")).where(F.size("options") >= 2)


def knowledge_items(sections: DataFrame) -> DataFrame:
    """(doc_id, section, pos, kind, answer): statements by the first kind that fits, "fact" without one; each wording once a document and kind."""
    s = unrolled(sections.select("doc_id", "section", F.posexplode_outer(statements_of(F.col("text"))).alias("pos", "answer")), "pos").where(F.length("answer") >= 24)
    kind = F.lit("fact")
    for name, pattern in reversed(KINDS):
        kind = F.when(F.lower("answer").rlike(pattern), name).otherwise(kind)
    first = F.min(F.struct("section", "pos", "answer"))
    g = s.withColumn("kind", kind).groupBy("doc_id", "kind", F.lower("answer").alias("k")).agg(first.alias("f"))
    return g.select("doc_id", "f.section", "f.pos", "kind", "f.answer")


def similar_titles(titles: DataFrame, scope: str, key: str, title: str, least: float = 0.75) -> DataFrame:
    """(scope, a, b): pairs of a scope's titles with the same words, or common ones from `least` of the larger set on.

    Equal sets of words are compared once. Two sets that are alike share one of the rarest words of each, as many as may be missing and one more, and meet by
    those alone. Their titles are paired at the end, up to MEMBERS of each side in a group. All is shuffled: a table's file says little of the rows that come of it,
    so nothing is left to the planner to be sent through the driver."""
    words, n = lambda c: F.split(c, " "), int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = titles.select(scope, F.col(key).alias("k"), F.array_join(F.array_sort(F.array_distinct(words(concept_key(F.col(title))))), " ").alias("w")).where("w IS NOT NULL")
    needed = lambda n: F.greatest(F.lit(1), F.ceil(F.lit(least) * n)).cast("int")
    sets = stage(t.groupBy(scope, "w").agg(F.count(F.lit(1)).alias("n")), "title-sets")
    each = sets.select(scope, "w", F.explode(words("w")).alias("word"))
    rare = each.join(each.groupBy(scope, "word").agg(F.count(F.lit(1)).alias("df")).hint("merge"), [scope, "word"])
    ordered = rare.groupBy(scope, "w").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("o"))
    first = stage(ordered.select(scope, "w", F.explode(F.slice("o", F.lit(1), F.size("o") - needed(F.size("o")) + 1)).alias("x")).select(scope, "w", "x.word"), "rare-words")
    met = first.toDF(scope, "v", "word").join(first.hint("merge"), [scope, "word"]).where("v < w").select(scope, "v", "w").distinct()
    alike = stage(met.where(F.size(F.array_intersect(words("v"), words("w"))) >= needed(F.greatest(F.size(words("v")), F.size(words("w"))))), "alike-sets")
    links = together(sets.select(scope, F.col("w").alias("v"), "w"), alike, alike.select(scope, F.col("w").alias("v"), F.col("v").alias("w")))
    facing = links.join(sets.withColumnRenamed("w", "v").hint("merge"), [scope, "v"]).groupBy(scope, "w").agg(F.sum("n").alias("m"))
    groups = lambda c: F.ceil(F.col(c) / MEMBERS).cast("int")
    shapes = stage(facing.join(sets.hint("merge"), [scope, "w"]).select(scope, "w", groups("m").alias("p"), groups("n").alias("q")), "shapes")
    some, every = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int"), lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    x = t.select(scope, F.col("k").alias("a"), F.col("w").alias("v")).join(links.join(shapes.hint("merge"), [scope, "w"]).hint("merge"), [scope, "v"])
    x = x.select(scope, "w", some("a", "p").alias("i"), every("q").alias("j"), "a").repartition(n, scope, "w", "i", "j")
    y = t.select(scope, F.col("k").alias("b"), "w").join(shapes.hint("merge"), [scope, "w"])
    y = y.select(scope, "w", every("p").alias("i"), some("b", "q").alias("j"), "b").repartition(n, scope, "w", "i", "j")
    return x.join(y.hint("merge"), [scope, "w", "i", "j"]).where("a < b").select(scope, "a", "b")


def keep_names(fresh: DataFrame, former: DataFrame, key: str, name: str) -> DataFrame:
    """fresh with the name that former has for the same concept key, so that a concept is not renamed by a new run."""
    k = concept_key(F.col(name))
    old = former.groupBy(k.alias("_k")).agg(F.min(name).alias("_old"))
    return fresh.withColumn("_k", k).join(old, "_k", "left").withColumn(name, F.coalesce("_old", name)).drop("_k", "_old")


def valleys(units: DataFrame, scope: str, order: str, similarity: str, most: float) -> DataFrame:
    """Adds chunk: units in order, parted after a unit whose similarity to the next one is `most` at most and no larger than those beside it."""
    w = Window.partitionBy(scope).orderBy(order)
    before, after, own = F.lag(similarity).over(w), F.lead(similarity).over(w), F.col(similarity)
    low = (own <= most) & (own <= F.coalesce(before, F.lit(2.0))) & (own <= F.coalesce(after, F.lit(2.0)))
    u = units.withColumn("_ends", F.coalesce(low, F.lit(False)).cast("int"))
    return u.withColumn("chunk", F.coalesce(F.sum("_ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_ends")


def attached(details: DataFrame, most: int = 7) -> DataFrame:
    """Of details matched to nodes (item, target, overlap) the best `most` of each node, with their place."""
    pos = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("overlap"), "item"))
    return details.withColumn("pos", pos).where(F.col("pos") <= most)


def top_up(made: DataFrame, fallback: DataFrame, scope: str, order: str, item: str, target: int) -> DataFrame:
    """(scope, item, pos): made items in order, then fallback ones that aren't among them, up to the target."""
    both = made.select(scope, F.lit(0).alias("part"), order, item).unionByName(fallback.select(scope, F.lit(1).alias("part"), order, item))
    first = both.groupBy(scope, item).agg(F.min(F.struct("part", order)).alias("first"))
    pos = F.row_number().over(Window.partitionBy(scope).orderBy("first", item))
    return first.select(scope, item, pos.alias("pos")).where(F.col("pos") <= target)
