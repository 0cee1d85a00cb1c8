"""Text columns: tokens, sentences, key terms, acronyms. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no topic, as the confidence scores leave them out.
STOPWORDS = """
a an the and or but if then else when while of to in on at by for with from as is are was were be been being do does did
have has had i you he she it we they them me my your his her our their this that these those not no yes so too very can
could should would may might will shall just than into over under about above below out up down off again further here
there where which who whom what why how all any both each few more most other some such own same also only s t d ll ve re m
""".split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row; a plain reuse could be inlined into every lambda call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unrolled(rows: DataFrame, at: str) -> DataFrame:
    """Rows of an explode_outer or posexplode_outer, whose elements or places are in `at`, without those of null and empty arrays. posexplode itself gives the same, but the optimiser asks for
    its array's size and for null in a filter below it, where the array's whole expression is worked out twice more."""
    return rows.where(F.col(at).isNotNull())


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def term_counts(words: Column) -> Column:
    """Array of (term, n, first place) of an array's distinct values: sorted once, runs counted, so long texts stay cheap."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at"))))

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["term"] != x["term"]), i)), lambda i: i.isNotNull())
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda i, k: F.struct(
                    F.get(s, i)["term"].alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("bigint").alias("n"), F.get(s, i)["at"].alias("at")
                ),
            ),
        )

    return let(placed, runs)


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(STOPWORDS))


#: Letters with marks and the plain ones for them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def without_marks(text: Column) -> Column:
    """Latin letters without their accents; œ and æ become two letters."""
    return F.replace(F.replace(F.translate(text, MARKED, PLAIN), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))


def concept_key(text: Column) -> Column:
    """Runs of plain letters and digits in lower case, single blanks between them."""
    return F.array_join(F.regexp_extract_all(without_marks(F.lower(text)), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def sentences(text: Column) -> Column:
    """Split after . ! ? before white space and a capital or digit."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def acronym(text: Column) -> Column:
    """Initials of two to eight words, else null."""
    initials = F.array_join(F.transform(tokens(text), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(F.length(initials).between(2, 8), initials)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is empty, or a norm is 0."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def low_information(text: Column) -> Column:
    """Chunks that say nothing: very short, page marks, hardly any letters or distinct words."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    letters = F.length(F.regexp_replace(trimmed, r"[^\p{L}]", ""))
    n = F.length(trimmed)
    return (
        (n < 18)
        | (F.size(tokens(trimmed)) <= 3)
        | F.lower(trimmed).rlike(r"^(page|slide)?\s*\d+(\s*(/|of)\s*\d+)?$|^(thank you|questions)[.!?]*$")
        | ((letters < 8) & (n < 80))
        | ((F.size(F.array_distinct(tokens(trimmed))) <= 2) & (n < 80))
    )


def flat(text: Column) -> Column:
    """Single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shortened(text: Column, most: int) -> Column:
    """Up to `most` characters, cut at a blank."""
    return F.when(F.length(text) > most, F.regexp_replace(F.substring(text, 1, most), r" [^ ]*$", "")).otherwise(text)


def normalised_vector(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Common elements over those of the smaller set; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)), 6))


def unit_number(value: Column) -> Column:
    """A number held between 0 and 1; text that is none counts 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_to_number(value, F.lit("999999.999999")).cast("double"), F.lit(0.0))))


def json_part(text: Column) -> Column:
    """What stands from the first to the last brace of a text, also between fences; empty without braces."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def table_cells(line: Column, n: int) -> Column:
    """n cells of a Markdown table's line: bars that are not escaped part them, missing ones are empty, surplus ones go."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), n)), 1, n)


#: Frequent words by which a language is guessed.
MARKERS = {
    "de": "der die das und ist nicht ein eine mit auf".split(), "en": "the and is of to in that it with for".split(),
    "es": "el los las y es una con por que del".split(), "fr": "le les des et est une dans pour que du".split(),
}


def language_guess(text: Column) -> Column:
    """The language of which most marker words stand in a text, the first by name on ties; "en" without any."""
    words = tokens(text)
    scores = F.array(*[F.struct((-F.size(F.filter(words, lambda w: w.isin(*known)))).alias("n"), F.lit(code).alias("code")) for code, known in MARKERS.items()])
    best = F.array_min(scores)
    return F.when(best["n"] == 0, "en").otherwise(best["code"])
