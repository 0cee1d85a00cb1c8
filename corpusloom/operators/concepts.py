"""Concept inventories: which names are concepts, which of them are one, how a new inventory replaces an old one."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import concept_key
from corpusloom.operators.components import connected_components
from corpusloom.session import ship, stage

#: Words with which no concept begins; marks that no concept has.
FRAGMENT_STARTS = "and or but because with without for to et ou avec sans pour dans de des du".split()
BAD_MARKS = r"[=%<>{}|\\$#*`_]"


def valid_name(name: Column, context: Column) -> Column:
    """A name of up to eight words that is no markup, formula or fragment of a sentence; one word must be an acronym or stand,
    capitalised, for something that the context names."""
    text = F.trim(F.regexp_replace(name, r"\s+", " "))
    key = concept_key(text)
    n = F.size(F.split(key, " "))
    shouted = (text == F.upper(text)) & F.length(text).between(2, 10)
    compact = F.regexp_replace(text, "[^A-Za-z0-9]", "")
    acronym = F.substring(compact, 2, 100).rlike("[A-Z]") & F.length(compact).between(2, 10)
    titled = text.rlike(r"^\p{Lu}") & (text != F.upper(text)) & F.contains(concept_key(context), key)
    alone = (F.length(key) >= 3) & (shouted | acronym | titled)
    capital = text.rlike(r"(^| )\p{Lu}")
    words = F.size(F.split(text, " "))
    fragment = text.rlike(r"[.?!;]") | ((words >= 6) & text.rlike(r"^\p{Ll}")) | F.lower(F.substring_index(text, " ", 1)).isin(*FRAGMENT_STARTS)
    content = F.exists(F.split(key, " "), lambda w: F.length(w) > 2)
    sized = (n <= 4) | ((n <= 8) & capital)
    ok = F.length(text).between(2, 120) & (key != "") & ~text.rlike(BAD_MARKS) & (n <= 8) & ((n > 1) | alone)
    return F.coalesce(ok & (~fragment | (n.between(2, 4) & capital)) & (shouted | (content & sized)), F.lit(False))


def merge(candidates: DataFrame) -> DataFrame:
    """(scope, name, importance, n_names, n_sources) of candidates (scope, name, aliases, importance, source).

    Names that share a key, of themselves or of an alias, are one concept, over any number of steps; it is called by its most important
    name, then the longest, then the first by letters.
    """
    keys = F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), concept_key))
    c = stage(candidates.withColumn("keys", F.filter(keys, lambda k: k != "")).where(F.size("keys") > 0), "candidates")
    each = c.select("scope", F.col("keys")[0].alias("own"), F.explode("keys").alias("key")).distinct()
    node = lambda k: F.xxhash64("scope", k)
    links = each.where("own != key").select(node("own").alias("a"), node("key").alias("b")).distinct()
    found = connected_components(links)
    named = c.withColumn("node", node(F.col("keys")[0])).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = F.max_by("name", F.struct("importance", F.length("name").alias("n"), F.translate(F.col("name"), _LETTERS, _LETTERS[::-1]).alias("back")))
    g = named.groupBy("scope", "component").agg(
        best.alias("name"), F.max("importance").alias("importance"), F.countDistinct("name").alias("n_names"), F.countDistinct("source").alias("n_sources")
    )
    return g.drop("component")


_LETTERS = "".join(map(chr, range(32, 127)))


def first_spelling(names: DataFrame, scope: str, name: str, order: str) -> DataFrame:
    """(scope, name, n): names that differ by case only are one, as it is spelt first."""
    g = names.groupBy(scope, F.lower(name).alias("_key")).agg(F.min_by(name, order).alias(name), F.count(F.lit(1)).alias("n"))
    return g.drop("_key")


def similarity(a: str, b: str) -> float:
    """The share of the longer key that the shorter one is, if it stands in it; else the ratio of matching runs."""
    if len(a) >= 4 and len(b) >= 4 and (a in b or b in a):
        return min(len(a), len(b)) / max(len(a), len(b))
    return SequenceMatcher(a=a, b=b).ratio()


def resolve(labels: DataFrame, concepts: DataFrame, least: float = 0.92) -> DataFrame:
    """(label, concept, score): of concepts (concept, name) the one whose key a label's key equals, else the most similar from `least` on.

    At 0.92 two keys of four characters or more that are not equal share three characters on end, so only keys that share such a run, found
    by an equi-join, are compared; shorter keys must be equal. Ties go to the smaller concept.
    """
    trigrams = lambda k: F.when(F.length(k) >= 3, F.transform(F.sequence(F.lit(1), F.length(k) - 2), lambda i: F.substring(k, i, 3))).otherwise(F.array().cast("array<string>"))
    own = labels.select("label", concept_key(F.col("label")).alias("key")).where("key != ''").distinct()
    known = stage(concepts.select(concept_key(F.col("name")).alias("alias"), "concept").where("alias != ''").groupBy("alias").agg(F.min("concept").alias("concept")), "aliases")
    exact = own.join(known.withColumnRenamed("alias", "key"), "key").select("label", "concept", F.lit(1.0).alias("score"))
    rest = own.join(known.select(F.col("alias").alias("key")), "key", "left_anti")
    a = rest.select("label", "key", F.explode(F.array_distinct(trigrams(F.col("key")))).alias("g"))
    b = known.select("alias", "concept", F.explode(F.array_distinct(trigrams(F.col("alias")))).alias("g"))
    near = (2 * F.least(F.length("key"), F.length("alias")) >= least * (F.length("key") + F.length("alias")))
    inside = F.contains("key", "alias") | F.contains("alias", "key")
    pairs = a.join(b, "g").where(near | inside).select("label", "key", "alias", "concept").distinct()

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["score"] = [similarity(x, y) for x, y in zip(f["key"], f["alias"])]
            yield f[f["score"] >= least][["label", "concept", "score"]]

    ship(labels.sparkSession)
    kind = dict(concepts.select("concept").dtypes)["concept"]
    fuzzy = pairs.mapInPandas(score, f"label string, concept {kind}, score double")
    order = Window.partitionBy("label").orderBy(F.desc("score"), "concept")
    best = fuzzy.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    return exact.unionByName(best)


def by_alias(labels: DataFrame, concepts: DataFrame) -> DataFrame:
    """labels with the concept whose name has the same key, the smallest of several; null where there is none."""
    known = concepts.groupBy(concept_key(F.col("name")).alias("_key")).agg(F.min("concept").alias("concept")).where("_key != ''")
    return labels.withColumn("_key", concept_key(F.col("label"))).join(known, "_key", "left").drop("_key")


def reference_counts(*references: DataFrame) -> DataFrame:
    """(id, n): how often ids stand in several tables (id), each counted before they are put together."""
    counted = [r.groupBy("id").agg(F.count(F.lit(1)).alias("n")) for r in references]
    both = counted[0]
    for other in counted[1:]:
        both = both.unionByName(other)
    return both.groupBy("id").agg(F.sum("n").alias("n"))


def reconcile(desired: DataFrame, existing: DataFrame, references: DataFrame) -> DataFrame:
    """(id, action) of desired (id, value) against existing (id, value): insert, update, keep; what is no longer desired is deactivated
    where references (id, n) point to it and deleted otherwise."""
    both = desired.select("id", F.col("value").alias("new"), F.lit(True).alias("wanted")).join(
        existing.select("id", F.col("value").alias("old"), F.lit(True).alias("there")), "id", "full_outer"
    )
    both = both.join(references.select("id", F.col("n").alias("refs")), "id", "left")
    action = (
        F.when(F.col("there").isNull(), "insert").when(F.col("wanted").isNull(), F.when(F.coalesce("refs", F.lit(0)) > 0, "deactivate").otherwise("delete"))
        .when(F.col("new").eqNullSafe(F.col("old")), "keep").otherwise("update")
    )
    return both.select("id", action.alias("action"))


def upsert(existing: DataFrame, desired: DataFrame, key: list[str]) -> DataFrame:
    """existing with desired rows in place of theirs; rows that are no longer desired stay, with active = false."""
    rest = [c for c in desired.columns if c not in key]
    d, e = desired.withColumn("_new", F.lit(True)).alias("d"), existing.alias("e")
    both = d.join(e, key, "full_outer")
    values = [F.when(F.col("_new"), F.col(f"d.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in rest]
    return both.select(*key, *values, F.col("_new").isNotNull().alias("active"))


def overlapping(concepts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(scope, concept): concepts (concept, sources array) of which a source is in the scope's wanted ones (scope, source)."""
    return concepts.select("concept", F.explode("sources").alias("source")).join(wanted, "source").select("scope", "concept").distinct()


