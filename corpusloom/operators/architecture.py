"""The kind of course that chunks make up, and rules that tell what of a course is shown, asked and answered.

Defined results: null and empty texts count nothing; a course without chunks has no row; equal scores go to the kind that is named first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import concept_key, without_marks

#: Words that tell a kind of course, and those without which it is none.
KEYWORDS = {
    "historical": (
        "history", "historical", "century", "bce", "dynasty", "empire", "revolution", "war", "treaty", "reign", "colonial", "chronology", "timeline",
        "aftermath", "historiography",
    ),
    "chemistry": (
        "chemistry", "chemical", "atom", "molecule", "molar", "stoichiometry", "reaction", "compound", "acid", "base", "oxidation", "reduction",
        "organic", "inorganic", "equilibrium", "periodic table",
    ),
    "physics": (
        "physics", "force", "velocity", "acceleration", "momentum", "thermodynamics", "quantum", "electromagnetic", "optics", "mechanics", "newton",
        "energy conservation", "wave", "relativity",
    ),
    "mathematics": (
        "mathematics", "theorem", "proof", "lemma", "calculus", "algebra", "geometry", "topology", "derivative", "integral", "matrix",
        "probability distribution", "vector space",
    ),
    "life_science": (
        "biology", "biological", "cell", "genetics", "organism", "protein", "enzyme", "anatomy", "physiology", "ecology", "evolution", "metabolism",
        "dna", "rna",
    ),
    "procedural": (
        "procedure", "step by step", "workflow", "installation", "configuration", "protocol", "tutorial", "operating procedure", "laboratory method",
        "troubleshooting",
    ),
}
ANCHORS = {
    "historical": ("history", "historical", "histoire", "dynasty", "empire", "colonial", "historiography"),
    "chemistry": (
        "chemistry", "chimie", "chemical", "chimique", "atom", "atome", "molecule", "stoichiometry", "oxidation", "periodic table",
    ),
    "physics": ("physics", "physique", "newton", "thermodynamics", "quantum", "electromagnetic", "relativity"),
    "mathematics": (
        "mathematics", "mathematique", "theorem", "theoreme", "proof", "lemma", "calculus", "algebra", "geometry", "topology",
    ),
    "life_science": ("biology", "biologie", "biological", "cell", "genetics", "organism", "protein", "enzyme", "dna", "rna"),
    "procedural": (
        "step by step", "workflow", "installation", "configuration", "protocol", "tutorial", "laboratory method", "troubleshooting",
    ),
}
SIGNALS = (
    "recommendation", "recommender", "systeme de recommandation", "machine learning", "information retrieval", "software", "algorithm",
    "computer science",
)
CONCEPTUAL, MIXED = "conceptual", "mixed"
YEAR = r"\b(?:\d{3,4}(?:\s*(?:(?i)BCE|BC|CE|AD))?)\b"
_SPECIES = r"(?:\d+\s*)?(?:[A-Z][a-z]?(?:_?\{?\d+\}?)?)++(?:\^?\{?[+-]\}?)?(?:\((?:s|l|g|aq)\))?"
_SIDE = rf"{_SPECIES}(?:\s*\+\s*{_SPECIES}){{0,30}}"
REACTION = rf"(?m)\\ce\s*\{{|^[\s$]*{_SIDE}\s*(?:<=>|->|<-|=>|→|⇌|\\rightarrow|\\leftrightarrow)\s*{_SIDE}[\s$]*$"


def uses(text: Column, words: tuple[str, ...]) -> Column:
    """How often the words stand in a text. Phrases are counted apart, as one may hold another word of the list."""
    found = F.lit(0)
    for group in ([w for w in words if " " not in w], [w for w in words if " " in w]):
        if group:
            found = found + F.size(F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(group)})(?![\p{{L}}\p{{N}}_])"), F.lit(0)))
    return F.greatest(found, F.lit(0))


def course_architecture(chunks: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(course, architecture, best, score) of chunks (course, heading, concepts, text, n_equations) and the labels (course, text) of a course's graph.

    Words are counted within a chunk, in its whole text, then added up for the course, so that only counts are shuffled. A kind without an anchor counts 0; two for each
    anchor are added, 8 at most; a third of chunks with years, three at least, give history 4, reactions give chemistry 3 each, chunks with formulas
    physics up to 4. Below 3 a course is conceptual, with a second kind from 3 and 0.8 of the best on it is mixed.
    """
    said = chunks.select("course", F.concat_ws(" ", "heading", "concepts", "text").alias("t"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_equations", F.lit(0)).alias("n_equations"), F.lit(1).alias("n"))
    if labels is not None:
        said = said.unionByName(labels.select("course", F.col("text").alias("t"), F.lit("").alias("text"), F.lit(0).alias("n_equations"), F.lit(0).alias("n")))
    t = F.lower(without_marks(F.lower("t")))
    counts = {f"k_{k}": uses(F.col("t"), w) for k, w in KEYWORDS.items()} | {f"a_{k}": uses(F.col("t"), w) for k, w in ANCHORS.items()}
    counts |= {"signals": uses(F.col("t"), SIGNALS), "dated": F.col("text").rlike(YEAR).cast("int"), "reactions": F.col("text").rlike(REACTION).cast("int")}
    counts |= {"formulas": (F.col("n_equations") > 0).cast("int"), "n": F.col("n")}
    g = said.withColumn("t", t).select("course", *[c.alias(k) for k, c in counts.items()]).groupBy("course").agg(*[F.sum(k).alias(k) for k in counts])
    c = F.col
    score = {k: F.when(c(f"a_{k}") == 0, 0).otherwise(c(f"k_{k}") + F.least(F.lit(8), 2 * c(f"a_{k}"))) for k in KEYWORDS}
    score["historical"] += F.when(c("dated") >= F.greatest(F.lit(3), F.floor(c("n") / 3)), 4).otherwise(0)
    score["chemistry"] += F.when(c("a_chemistry") > 0, 3 * c("reactions")).otherwise(0)
    score["physics"] += F.when(score["physics"] > 0, F.least(F.lit(4), c("formulas"))).otherwise(0)
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("back"), F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, (k, s) in enumerate(score.items())]))
    first, second = -F.get("ranked", F.lit(0))["back"], -F.get("ranked", F.lit(1))["back"]
    concept = c("signals") >= F.greatest(F.lit(4), 2 * F.greatest(*[c(f"a_{k}") for k in ANCHORS]))
    kind = F.when(concept | (first < 3), CONCEPTUAL).when(second >= F.greatest(F.lit(3.0), 0.8 * first), MIXED).otherwise(F.get("ranked", F.lit(0))["kind"])
    return g.withColumn("ranked", ranked).select("course", kind.alias("architecture"), F.get("ranked", F.lit(0))["kind"].alias("best"), first.cast("bigint").alias("score"))


#: Titles that name no phase, or too little of one.
NO_PHASE = ("introduction", "conclusion", "summary", "resume", "overview", "agenda", "plan")
TOO_SMALL = ("question", "example", "exemple", "scenario", "stats", "python u2")


def active_concept(inactive: Column, chunks: Column) -> Column:
    return ~F.coalesce(inactive, F.lit(False)) & (F.size(F.coalesce(chunks, F.array())) > 0)


def valid_phase_title(title: Column) -> Column:
    """2 to 160 characters with a letter or digit, no markup, no bare number, none of NO_PHASE; null is none."""
    t, key = F.trim(F.regexp_replace(title, r"\s+", " ")), concept_key(title)
    bad = t.rlike(r"[$\\{}<>]|^\d+(?:\.\d+)*$") | key.isin(*NO_PHASE) | (key == "")
    return F.coalesce(F.length(t).between(2, 160) & ~bad, F.lit(False))


def too_granular(title: Column) -> Column:
    """A title that is longer than 90 characters, numbered, marked up, a score or one letter, or one of TOO_SMALL."""
    t = F.trim(F.regexp_replace(title, r"\s+", " "))
    return F.coalesce((F.length(t) > 90) | t.rlike(r"(?i)</?\w+|[$\\{}]|^\d+[\).:-]|^[a-z]$|\bdoc\s*\d|\bscore\s*:") | concept_key(title).isin(*TOO_SMALL), F.lit(False))


def active_map(phases: DataFrame, objectives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phases (phase, inactive, …) that are active, and active objectives (phase, inactive, …) of these."""
    on = lambda d: d.where(~F.coalesce("inactive", F.lit(False)))
    return on(phases), on(objectives).join(on(phases).select("phase").distinct(), "phase", "left_semi")


#: Words of a question that wants an answer; words of what files don't hold; words of a summary that name no topic.
GREETINGS = ("hi", "hello", "hey", "thanks", "thank you", "ok", "okay")
ASKS = (
    r"\b(what|why|how|explain|define|summarize|compare|write|create|generate|give|show|teach|tell|calculate|solve|recipe|plan|code|"
    r"quoi|pourquoi|comment|explique|ecris|cr[eé]e|donne)\b"
)
OUTSIDE = (
    r"\b(recipe|dinner|lunch|breakfast|cook|meal)\b", r"\b(weather|forecast|temperature)\b", r"\b(stock price|crypto|bitcoin|exchange rate)\b",
    r"\b(movie|netflix|restaurant|hotel|flight|travel itinerary)\b", r"\bmedical advice|legal advice\b",
)
NO_TOPIC = ("uploaded", "files", "main", "visible", "topics", "course", "cours")


def substantive(message: Column) -> Column:
    """A message that asks for something: with a question mark or a word of ASKS, and no greeting."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), r"\s+", " ")))
    return ~t.isin("", *GREETINGS) & (t.contains("?") | t.rlike(ASKS))


def outside_files(message: Column, summary: Column) -> Column:
    """A message about what files don't hold, without a word of the course's summary."""
    terms = lambda x: F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-zA-Z][a-zA-Z0-9+/#-]{2,}"), F.lit(0))
    known = F.filter(terms(summary), lambda w: ~w.isin(*NO_TOPIC))
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), r"\s+", " ")))
    return t.rlike("|".join(OUTSIDE)) & ~F.coalesce(F.arrays_overlap(known, terms(message)), F.lit(False))


def guarded_route(action: Column, message: Column, summary: Column) -> Column:
    """The action that is taken: small talk is none where the message asks for something; then files are searched, or it lies outside them."""
    talk = (action == "conversational_reply") & substantive(message)
    return F.when(talk & outside_files(message, summary), "outside_files").when(talk, "retrieve").otherwise(action)


def in_source_scope(nodes: DataFrame, chunks: DataFrame | None, files: DataFrame | None) -> DataFrame:
    """Graph nodes (node, kind, ref, chunk_ids, file_ids) of allowed chunks (chunk) and files (file): all where no filter is given, always those of kind
    course. Ids are exploded and met by semi-joins, so that any number of them may be allowed; the same ids in several ways give one node."""
    if chunks is None and files is None:
        return nodes
    own = lambda ids, kind: F.explode(F.array_distinct(F.concat(F.coalesce(ids, F.array().cast("array<string>")), F.when(F.col("kind") == kind, F.array("ref")).otherwise(F.array().cast("array<string>")))))
    found = nodes.where("kind = 'course'").select("node")
    for allowed, name, ids in ((chunks, "chunk", "chunk_ids"), (files, "file", "file_ids")):
        if allowed is not None:
            found = found.unionByName(nodes.select("node", own(F.col(ids), name).alias(name)).join(allowed.select(name), name, "left_semi").select("node"))
    return nodes.join(found.distinct(), "node", "left_semi")
