"""Course material for learners: ranking modes, statements, questions, grading and the choice of a reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import sentences, tokens
from corpusloom.operators.retrieval import dense

#: Phrases of a message that show its intent, in the order in which they are looked for.
CONFUSED = ("i don't understand", "i dont understand", "i don't get", "i dont get", "i'm lost", "im lost", "confused", "huh",
            "what do you mean", "not clear", "doesn't make sense", "doesnt make sense")
CLARIFY = ("explain again", "rephrase", "another way", "more detail", "clarify", "example")
CONFIRM = ("right?", "is that correct", "am i right", "so ", "does that mean", "can i say")
#: What a question to learn from starts with, and messages that are none.
STARTERS = ("explain", "teach", "show", "compare", "summarize", "résume", "resume", "explique", "montre", "pourquoi", "comment",
            "what", "why", "how", "can you", "could you")
GREETINGS = ("hi", "hello", "hey", "thanks", "thank you", "ok", "okay")
#: Node types that count half a point more.
TEACHING_TYPES = ("concept", "objective", "skill", "procedure", "formula", "example")


def _any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def topic_buckets(pool: DataFrame, topic: str) -> DataFrame:
    """(topic, n, doc_id, pos): the best document of each topic by score, then length, then id; large topics first."""
    best = F.max(F.struct(F.col("score"), F.length("text").alias("size"), (-F.col("doc_id")).alias("back")))
    found = pool.groupBy(topic).agg(F.count(F.lit(1)).alias("n"), (-best["back"]).alias("doc_id"))
    return found.withColumn("pos", F.row_number().over(Window.orderBy(F.col("n").desc(), topic)))  # one row a topic


def narrative_arc(docs: DataFrame, middle: DataFrame, key: str, each: int = 2) -> DataFrame:
    """(key, doc_id, pos): first rows, those of `middle` (key, doc_id, rank), last rows; each once, at its first place.

    First and last are `each` of the leading and trailing tenth of a key's documents, one at least.
    """
    def ends(order: Column, part: int, sign: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
        found = docs.select(key, "doc_id", rank.alias("i")).where(F.col("i") <= each)  # ranked and cut before rows are shuffled
        return found.join(tenths, key).where(F.col("i") <= F.least("most", F.lit(each))).select(key, "doc_id", F.lit(part).alias("part"), (sign * F.col("i")).alias("at"))

    tenths = docs.groupBy(key).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 10)).alias("most"))
    parts = (
        ends(F.col("doc_id"), 0, 1).unionByName(middle.select(key, "doc_id", F.lit(1).alias("part"), F.col("rank").alias("at")))
        .unionByName(ends(F.col("doc_id").desc(), 2, -1))
    )
    first = parts.groupBy(key, "doc_id").agg(F.min(F.struct("part", "at")).alias("first"))
    pos = F.row_number().over(Window.partitionBy(key).orderBy("first", "doc_id"))
    return first.select(key, "doc_id", pos.alias("pos"))


def relationship_density(text: Column) -> Column:
    """Names of several capitalised words and words with a verb's ending, over the number of tokens; null without tokens."""
    words = tokens(text)
    items = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_ \t\n\r\f]+", " | "), r"[ \t\n\r\f]+")  # punctuation ends a name
    marks = F.array_join(F.transform(items, lambda w: F.when(w.rlike("^[A-Z][a-z]+$"), "C").otherwise("x")), "")
    names = F.size(F.regexp_extract_all(marks, F.lit("CC+"), F.lit(0)))
    verbs = F.size(F.filter(words, lambda w: w.rlike(".(ed|ing|es)$")))
    return F.when(F.size(words) > 0, F.round((names + verbs) / F.size(words), 6))


def jaccard(a: Column, b: Column) -> Column:
    """Of the token sets of two texts; 0 if either is empty."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.round(both / (F.size(x) + F.size(y) - both), 6))


def node_scores(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, node_id, score) of nodes (node_id, type, text) for queries' terms (query_id, term).

    A term counts 3 as a whole word of the node and 1 more if it has five letters; teaching types add 0.5. Words are joined by
    equality. A term of five letters or more inside a longer word is found by its first five: a distinct word gives a row for each
    distinct five letters in it, however long it is, and what meets is checked.
    """
    words = nodes.select("node_id", "type", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).withColumn("named", F.sha2("word", 256))
    asked = terms.distinct()
    exact = words.join(asked.withColumnRenamed("term", "word"), "word").select("query_id", "node_id", "type", F.lit(3.0).alias("s"), F.col("word").alias("term"))
    vocabulary = words.where(F.length("word") >= 5).select("word", "named").distinct()
    fives = F.array_distinct(F.regexp_extract_all("word", F.lit("(?=(.{5}))"), F.lit(1)))
    grams = vocabulary.select("named", fives.alias("fives")).select("named", F.explode("fives").alias("five"))
    long = asked.where(F.length("term") >= 5).withColumn("five", F.left("term", F.lit(5)))
    met = words.join(grams.join(long, "five").select("named", "query_id", "term"), "named").where(F.contains("word", "term"))
    fuzzy = met.select("query_id", "node_id", "type", F.lit(1.0).alias("s"), "term")
    once = exact.unionByName(fuzzy).distinct()
    bonus = F.when(F.first("type").isin(*TEACHING_TYPES), 0.5).otherwise(0.0)
    return once.groupBy("query_id", "node_id").agg((F.sum("s") + bonus).alias("score"))


def statements(docs: DataFrame, least: int = 24, most: int = 180) -> DataFrame:
    """(doc_id, pos, statement): a text's sentences that can be asserted, each wording once, at its first place.

    Marks around a sentence and numbers before it go; questions and sentences under `least` characters are left out, and
    longer ones than `most` are cut at a word.
    """
    cut = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "s"))
    s = F.regexp_replace(F.btrim(F.regexp_replace("s", r"\s+", " "), F.lit(" -*#:;")), r"^\d+(\.\d+)*\s+", "")
    cut = cut.select("doc_id", "pos", s.alias("s")).where((F.length("s") >= least) & ~F.col("s").endswith("?"))
    short = F.rtrim(F.regexp_replace(F.substring("s", 1, most - 3), r" [^ ]*$", ""), F.lit(",;:"))
    s = F.when(F.length("s") > most, short).otherwise(F.col("s"))
    cut = cut.withColumn("s", s).withColumn("s", F.when(F.col("s").rlike("[.!]$"), F.col("s")).otherwise(F.concat("s", F.lit("."))))
    first = F.min(F.struct("pos", "s"))
    return cut.groupBy("doc_id", F.lower("s").alias("k")).agg(first["pos"].alias("pos"), first["s"].alias("statement")).drop("k")


def best_statements(found: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc_id, pos, hits): of each text's statements the first that holds most of its concept's terms (doc_id, terms)."""
    hits = F.size(F.filter("terms", lambda t: F.lower("statement").contains(t)))
    scored = found.join(concepts, "doc_id").select("doc_id", "pos", hits.alias("hits"))
    best = F.max(F.struct("hits", (-F.col("pos")).alias("back")))
    return scored.groupBy("doc_id").agg((-best["back"]).alias("pos"), best["hits"].alias("hits"))


def distractors(vectors: DataFrame, asked: DataFrame, n: int = 3, low: float = 0.4, high: float = 0.7) -> DataFrame:
    """(query_id, doc_id, score, rank): the n most similar vectors within the band; if it holds fewer, the n most similar
    of all below 0.999. `asked` is a stated set of vectors, compared with all others."""
    step = 0.0000005  # scores have six digits
    band = dense(vectors, asked, n, low - step, high, others=True).withColumn("inside", F.lit(True))
    rest = dense(vectors, asked, n, high=0.999 - step, others=True).withColumn("inside", F.lit(False))
    order = Window.partitionBy("query_id", "inside").orderBy(F.col("score").desc(), "doc_id")
    best = band.unionByName(rest).withColumn("rank", F.row_number().over(order))
    full = F.count_if("inside").over(Window.partitionBy("query_id")) >= n
    return best.withColumn("full", full).where("inside = full").select("query_id", "doc_id", "score", "rank")


def normal_answer(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def grade(kind: Column, answer: Column, expected: Column) -> Column:
    """1 or 0: a choice by its index, true or false by the usual words, a blank by its normalised wording."""
    truth = F.lower(F.trim(answer))
    said = F.when(truth.isin("true", "t", "yes", "1"), "true").when(truth.isin("false", "f", "no", "0"), "false")
    right = (
        F.when(kind == "mcq", F.trim(answer).rlike("^[0-9]+$") & (F.trim(answer) == expected))
        .when(kind == "true_false", said == F.lower(expected))
        .otherwise(normal_answer(answer) == normal_answer(expected))
    )
    return F.when(right, 1.0).otherwise(0.0)


def short_answer_score(answer: Column, expected: Column) -> Column:
    """Share of the expected terms of three letters or more that are said, and 0.2 for eight different words; at most 1."""
    said = F.array_distinct(tokens(answer))
    terms = F.filter(F.array_distinct(tokens(expected)), lambda t: F.length(t) > 2)
    share = F.size(F.array_intersect(said, terms)) / F.size(terms) + F.when(F.size(said) >= 8, 0.2).otherwise(0.0)
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), share), 6))


def is_learning_question(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    starts = F.lit(False)
    for s in STARTERS:
        starts = starts | t.startswith(s)
    return (F.length(t) >= 4) & ~t.isin(*GREETINGS) & (t.contains("?") | starts)


def reply_mode(messages: DataFrame, guide_above: float = 0.6, stuck_after: int = 3) -> DataFrame:
    """(key columns, intent, confusion, mode) of messages with text, has_history and turns_since_progress."""
    t = F.lower(F.trim("text"))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    intent = (
        F.when(_any_of(t, CONFUSED), "confusion").when(F.col("has_history") & _any_of(t, CLARIFY), "clarification")
        .when(_any_of(t, CONFIRM), "confirmation").when(F.col("has_history") & (words < 12), "follow_up").otherwise("new_question")
    )
    level = {"confusion": 0.85, "clarification": 0.45, "confirmation": 0.25, "follow_up": 0.2, "new_question": 0.15}
    known = F.create_map(*[F.lit(x) for pair in level.items() for x in pair])
    read = messages.withColumn("intent", intent).withColumn("confusion", F.element_at(known, F.col("intent")))
    stuck = (F.col("turns_since_progress") > stuck_after) & (F.col("confusion") > guide_above)
    mode = (
        F.when(stuck, "explain").when((F.col("confusion") > guide_above) | (F.col("intent") == "confusion"), "guide")
        .when(F.col("intent") == "confirmation", "quiz_back").otherwise("explain")
    )
    return read.withColumn("mode", mode)


def chunk_questions(terms: DataFrame, topic: str, count: int = 3) -> DataFrame:
    """(doc_id, pos, question) from ranked terms (doc_id, term, rank) and the topic's name."""
    asked = F.concat(F.lit("What does "), F.col(topic), F.lit(" explain about "), F.col("term"), F.lit("?"))
    return terms.where(F.col("rank") <= count).select("doc_id", F.col("rank").alias("pos"), asked.alias("question"))


def learning_phases(concepts: DataFrame, key: str, order: str, size: int = 8, most: int = 5) -> DataFrame:
    """(key, order, phase): concepts in order, in as many even phases as hold `size` of them, `most` at most."""
    w = Window.partitionBy(key)
    c = concepts.select(key, order, F.row_number().over(w.orderBy(order)).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    phases = F.least(F.lit(most), F.ceil(F.col("n") / size))
    return c.select(key, order, F.floor((F.col("i") - 1) * phases / F.col("n")).cast("bigint").alias("phase"))


def chapter_progress(mastery: DataFrame, best: DataFrame, passed: float = 0.7) -> DataFrame:
    """(learner, chapter, progress): the larger of the mean mastery and the best score, which counts 0.7 until passed."""
    mean = mastery.groupBy("learner", "chapter").agg(F.avg("mastery").alias("mean"))
    score = F.coalesce("best", F.lit(0.0))
    counted = F.when(score >= passed, score).otherwise(0.7 * score)
    both = mean.join(best, ["learner", "chapter"], "left")
    return both.select("learner", "chapter", F.round(F.greatest("mean", counted), 6).alias("progress"))


def remediation(required: DataFrame, mastery: DataFrame, most: int = 4, below: float = 0.7) -> DataFrame:
    """(seed, node, depth, rank): unmastered prerequisites (seed, node, depth), nearest first; unknown mastery is 0."""
    weak = required.join(mastery.select("node", "mastery"), "node", "left").where(F.coalesce("mastery", F.lit(0.0)) < below)
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))
    return weak.withColumn("rank", rank).where(F.col("rank") <= most).select("seed", "node", "depth", "rank")
