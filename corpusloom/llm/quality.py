"""Quality rules whose cutoffs are certified on labelled holdouts.

Each rule scores a document by one ratio and rejects it above a cutoff. All rules are tightened along one fixed path of nested
cutoffs, from loose to strict. For every stratum (language) and step, the hypothesis "the rules at this step reject more than
`alpha` of the good documents of this stratum" is tested on the labelled good documents that the base keeps: it is refuted
when the exact binomial probability of so few rejections is at most `delta` divided by the number of strata. The steps of
a stratum are tested in order until one is not refuted, so that the first true hypothesis alone can be refuted wrongly
(fixed-sequence testing), and only the strata need a correction. With probability 1 - delta no stratum loses more than
`alpha` of its good documents to the rules; 86 good documents are enough for four strata. The strictest refuted step is
taken; a stratum whose first step holds no proof rejects nothing.

Everything is DataFrame operations; no text is shuffled.

Defined results: a null text has no words and fails the base; a null language is a stratum of its own; labels with null
or unknown values, or without a document, are ignored, and a document of which one label says 0 is not good; of
repeated rows each is judged; no labels, no rejections beyond the base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE_CLASS, binomial_tail_log, columns, let, stage, table

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\f\r"
#: Rule: grid of cutoffs, lowest (strictest) first. Fixed before any label is seen, as the bound asks for.
GRIDS: dict[str, list[float]] = {
    "symbols": [0.1, 0.2, 0.4, 0.8, 1.6],
    "dup_lines": [0.1, 0.2, 0.3, 0.4, 0.6],
    "repeats": [0.1, 0.2, 0.3, 0.4],
    "word_length": [7.0, 8.0, 9.0, 12.0, 20.0],
    "sameness": [0.4, 0.5, 0.6, 0.7, 0.8],
}
#: (rule, cutoff) in the order in which joint_cutoffs tightens them: each rule's loosest first, then each rule's next one.
PATH = [(rule, grid[-1 - i]) for i in range(max(map(len, GRIDS.values()))) for rule, grid in GRIDS.items() if i < len(grid)]
ALPHA, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEATS_PERCENT = 50, 50
#: Cutoffs of up to so many strata are broadcast; beyond that they are joined by shuffling.
MAX_BROADCAST_STRATA = 10_000


def words_of(text: Column) -> Column:
    """Runs of other characters than space and U+0009 to U+000D; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found at least twice; takes words as a lambda variable."""

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.coalesce(F.least(F.get(at, j + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def doubled(ranked: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ranked, i)["h"] == x["h"], F.lit(False))
        hits = F.filter(ranked, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return let(F.array_sort(F.transform(hits, lambda x: x["i"])), covered)

    def windows(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ranked, doubled))

    hashes = F.transform(
        F.slice(words, 3, F.size(words)),  # one entry for each window, its last word
        lambda w, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), w),
    )
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, windows))


def measures(text: Column) -> Column:
    """Struct of the counts that the base and the rules use."""
    raw = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    of_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    n_chars = F.length(raw)
    all_counts = F.struct(
        of_words.alias("words"),
        of_lines.alias("lines"),
        (n_chars - F.length(F.translate(raw, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    # bound to a variable, for the optimizer takes a bare struct apart and computes its parts anew at each use
    return let(all_counts, lambda m: m)


def measured(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """keep and the counts as columns; null ids and languages pass through."""
    m = docs.select(*[c.alias(name) for name, c in keep.items()], measures(F.col("text")).alias("_m"))
    return m.select(
        *keep,
        F.col("_m.words.n_words").alias("n_words"),
        F.col("_m.words.word_chars").alias("word_chars"),
        F.col("_m.n_symbols").alias("n_symbols"),
        F.col("_m.lines.n_dup_lines").alias("n_dup_lines"),
        F.col("_m.words.n_repeat_words").alias("n_repeat_words"),
        F.col("_m.words.n_distinct").alias("n_distinct"),
        F.col("_m.lines.n_lines").alias("n_lines"),
    )


def scores() -> dict[str, Column]:
    """Ratio that each rule compares with its cutoff; null, and so no rejection, for a text without words."""
    n = F.nullif(F.col("n_words"), F.lit(0))
    return {
        "symbols": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)),
        "repeats": F.col("n_repeat_words") / n,
        "word_length": F.col("word_chars") / n,
        "sameness": F.lit(1.0) - F.col("n_distinct") / n,
    }


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATS_PERCENT * n)


def joint_cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): what the last step of PATH that holds asks for, for strata whose first step holds.

    `scored` has _doc_id, _stratum and the counts. Documents that the base keeps and whose labels all say good form the holdout; only one
    count for each stratum and step leaves the executors' partial aggregation. A step rejects all that the steps before it reject, so its
    tail is no smaller than theirs: the steps refuted in order are those refuted at all.
    """
    good = labels.groupBy(F.col("doc_id").alias("_doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("_doc_id")
    scored = scored.withColumnRenamed("_stratum", "stratum").where(~base_failed()).join(good, "_doc_id", "left_semi")
    per_rule = scores()
    rejected_at = F.least(*[F.when(per_rule[rule] > c, F.lit(i)) for i, (rule, c) in enumerate(PATH)])
    counts = scored.select("stratum", rejected_at.alias("at")).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("at") <= i).alias(f"k{i}") for i in range(len(PATH))]
    )
    tests = counts.select(
        "stratum", "n", F.posexplode(F.array(*[F.col(f"k{i}") for i in range(len(PATH))])).alias("step", "k")
    )
    strata = counts.agg(F.count(F.lit(1)).alias("n_strata"))
    level = F.log(F.lit(delta) / F.col("n_strata"))
    passed = tests.crossJoin(F.broadcast(strata)).where(  # one row of one number
        binomial_tail_log(F.col("n"), F.col("k"), alpha) <= level
    )
    path = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff")) for rule, c in PATH])
    taken = passed.select("stratum", F.get(path, F.col("step")).alias("t"))
    return taken.groupBy("stratum", F.col("t.rule").alias("rule")).agg(F.min("t.cutoff").alias("cutoff"))


def _keyed(stratum: str) -> dict[str, Column]:
    return {"_doc_id": F.col("doc_id"), "_stratum": F.coalesce(F.col(stratum).cast("string"), F.lit(""))}


def _verdicts(base: DataFrame, cutoffs: DataFrame, keep: list[str]) -> DataFrame:
    wide = stage(
        cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(
            *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in GRIDS]
        ),
        "cutoffs",
    )
    if wide.limit(MAX_BROADCAST_STRATA + 1).count() <= MAX_BROADCAST_STRATA:
        wide = F.broadcast(wide)
    rejected = F.array_compact(
        F.array(*[F.when(s > F.col(f"_cut_{rule}"), F.lit(rule)) for rule, s in scores().items()])
    )
    return (
        base.join(wide, "_stratum", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", F.array_join(rejected, ","))
        .select(
            *keep,
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept"),
            "rejected_by",
        )
    )


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **risk: float) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the rules that rejected. The counts are computed once."""
    base = stage(measured(docs, _keyed(stratum)), "quality-counts")
    found = _verdicts(base, joint_cutoffs(base, labels, **risk), ["_doc_id"])
    return found.withColumnRenamed("_doc_id", "doc_id")


def keep_good_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **risk: float) -> DataFrame:
    """The input rows that the base and the jointly certified rules keep, with all their columns. Rows are written once with
    their counts, which cost far more than that; the cutoffs read the counts alone."""
    row = {"_row": F.struct(*columns(docs))}
    counted = stage(measured(docs, row | _keyed(stratum)), "quality-counts")
    return _verdicts(counted, joint_cutoffs(counted, labels, **risk), ["_row"]).where("kept").select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    score = {
        "symbols": "n_symbols / n_words",
        "dup_lines": "n_dup_lines / nullif(n_lines, 0)",
        "repeats": "n_repeat_words / n_words",
        "word_length": "word_chars / n_words",
        "sameness": "1.0 - n_distinct / n_words",
    }
    path = ", ".join(f"({i}, '{r}', {c})" for i, (r, c) in enumerate(PATH))
    case = "CASE rule " + " ".join(f"WHEN '{r}' THEN {s}" for r, s in score.items()) + " END"
    rules = " ".join(
        f"|| CASE WHEN {s} > (SELECT cutoff FROM cuts c WHERE c.stratum = j.stratum AND c.rule = '{r}') THEN ',{r}' ELSE '' END"
        for r, s in score.items()
    )
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, p, w[p] || chr(32) || w[p + 1] || chr(32) || w[p + 2] AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rc AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
b AS (
  SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rc.n, 0) AS n_repeat_words,
         len(list_distinct(w)) AS n_distinct, len(l) AS n_lines
  FROM d LEFT JOIN rc ON rc.doc_id = d.doc_id),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATS_PERCENT} * n_words AS base_failed FROM b),
held AS (
  SELECT * FROM j WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
path AS (SELECT * FROM (VALUES {path}) AS q(step, rule, cutoff)),
first_hit AS (
  SELECT doc_id, stratum, min(step) FILTER ({case} > cutoff) AS step FROM held, path GROUP BY doc_id, stratum),
tests AS (
  SELECT stratum, path.step, count(*) AS n, count(*) FILTER (first_hit.step <= path.step) AS k FROM first_hit, path GROUP BY ALL),
tails AS (
  SELECT stratum, step,
         list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - (CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END)
           - (CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END) + i * ln({ALPHA!r}) + (n - i) * ln({1 - ALPHA!r})))) AS p
  FROM tests),
cuts AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM tails JOIN path USING (step)
  WHERE p <= {DELTA} / (SELECT count(DISTINCT stratum) FROM held) GROUP BY ALL),
v AS (SELECT j.*, ltrim('' {rules}, ',') AS rejected_by FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rejected_by = '' AS kept, rejected_by
FROM v"""


SQL = {"op1_quality_rules": _sql()}
