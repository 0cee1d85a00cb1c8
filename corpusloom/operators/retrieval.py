"""Lexical, dense and fused ranking, and the scores of answers against their evidence."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import content_tokens, let, sentences, term_counts, tokens, unrolled
from corpusloom.session import broadcast_if_few, ship, stage


def top_k(scored: DataFrame, k: int, per: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank from 1; ties by the item. Spark limits groups before the shuffle."""
    order = Window.partitionBy(per).orderBy(F.col(score).desc(), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf) of documents (doc_id, text): a text's terms are counted within its row, nothing is shuffled."""
    # the length goes into each count, as a column beside an explode is worked out anew for each row that it gives
    counted = let(
        tokens(F.col("text")),
        lambda t: F.transform(term_counts(t), lambda c: F.struct(F.size(t).alias("dl"), c["term"].alias("term"), c["n"].alias("tf"))),
    )
    return unrolled(docs.select("doc_id", F.explode_outer(counted).alias("c")), "c").select("doc_id", "c.dl", "c.term", "c.tf")


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf)."""
    each = queries.select("query_id", F.explode(term_counts(tokens(F.col("text")))).alias("c"))
    return each.select("query_id", F.col("c.term").alias("term"), F.col("c.n").alias("qtf"))


def bm25(
    found: DataFrame, docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25
) -> DataFrame:
    """(query_id, doc_id, score) of documents (doc_id, text), with their postings, that share a term with queries (query_id, text).

    Repeated query terms add up; a term in more than half of the documents, whose idf is negative, takes `epsilon` times
    the mean idf. Postings meet the asked terms, sent to every task where they are few by count, before anything is scored.
    """
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.col("text")))).alias("avgdl"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats)).select("term", "avgdl", raw.alias("raw"))
    terms = stage(terms, "terms")
    mean = terms.agg(F.avg("raw").alias("mean"))  # one row of one number
    idf = terms.join(_asked(queries).select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(mean)).select(
        "term", "avgdl", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf")
    )
    wanted = broadcast_if_few(stage(_asked(queries).join(idf, "term"), "asked"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return found.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * weight), 6).alias("score"))


def overlap_scores(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Fallback without idf: the sum of the lesser frequencies over the root of the document's length."""
    common = found.join(broadcast_if_few(stage(_asked(queries), "asked")), "term").groupBy("query_id", "doc_id").agg(
        F.sum(F.least("tf", "qtf")).alias("common"), F.max("dl").alias("dl")
    )
    return common.select("query_id", "doc_id", F.round(F.col("common") / F.sqrt(F.greatest("dl", F.lit(1))), 6).alias("score"))


#: Texts and queries that are scored as one matrix, and the counts of terms beyond which a block has fewer of them.
TEXT_BLOCK, QUERY_BLOCK, BLOCK_TERMS = 2048, 512, 1 << 18


def _term_blocks(texts: DataFrame, key: str, rows: int) -> DataFrame:
    """(ids, dl, sizes, codes, ns, terms) of blocks of up to `rows` texts (key, text): each has `sizes` codes, places in the block's terms, and their counts."""
    counted = let(tokens(F.col("text")), lambda t: F.struct(F.size(t).alias("dl"), term_counts(t).alias("c")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = batch.column("x"), batch.column("id").to_numpy()
            dl, each, values = x.field("dl").to_numpy(), x.field("c"), x.field("c").flatten()
            sizes, terms = each.value_lengths().to_numpy(), values.field("term").dictionary_encode()
            codes, ns, ends = terms.indices.to_numpy(), values.field("n").to_numpy(), np.cumsum(sizes)
            a = 0
            while a < len(ids):
                low = ends[a] - sizes[a]
                b = min(a + rows, max(a + 1, int(np.searchsorted(ends, low + BLOCK_TERMS, "right"))), len(ids))
                used, local = np.unique(codes[low : ends[b - 1]], return_inverse=True)
                held = [ids[a:b], dl[a:b], sizes[a:b], local, ns[low : ends[b - 1]]]
                lists = [pa.array([v], pa.list_(t)) for v, t in zip(held, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [*lists, pa.array([terms.dictionary.take(pa.array(used)).to_pylist()], pa.list_(pa.string()))], ["ids", "dl", "sizes", "codes", "ns", "terms"]
                )
                a = b

    ship(texts.sparkSession)
    return texts.select(F.col(key).cast("bigint").alias("id"), counted.alias("x")).where("id IS NOT NULL").mapInArrow(
        run, "ids array<bigint>, dl array<int>, sizes array<int>, codes array<int>, ns array<bigint>, terms array<string>"
    )


def _millionths(x: np.ndarray) -> np.ndarray:
    """Whole millionths as SQL's round has them: halves, by the shortest decimal of a number, go up."""
    y = x * 1e6
    whole = np.rint(y).astype(np.int64)
    near = np.abs(y - np.floor(y) - 0.5) < 1e-3
    if near.any():
        values, back = np.unique(x[near], return_inverse=True)
        whole[near] = np.array([int(Decimal(repr(float(v))).scaleb(6).to_integral_value(ROUND_HALF_UP)) for v in values])[back]
    return whole


def _best_overlaps(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): of each pair of blocks of texts and queries (q_ and so on) each query's k best texts by overlap_scores."""

    def by_term(batch: pa.RecordBatch, r: int, sign: str) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes, codes, ns = (batch.column(sign + c)[r].values.to_numpy() for c in ("ids", "sizes", "codes", "ns"))
        terms, order = batch.column(sign + "terms")[r].values.to_pylist(), np.argsort(codes, kind="stable")
        return ids, terms, np.searchsorted(codes[order], np.arange(len(terms) + 1)), np.repeat(np.arange(len(ids)), sizes)[order], ns[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, terms, bound, row, n = by_term(batch, r, "")
                q_ids, q_terms, q_bound, q_row, q_n = by_term(batch, r, "q_")
                common, at = np.zeros((len(q_ids), len(ids)), np.int64), {t: i for i, t in enumerate(terms)}
                for i, j in ((i, at[t]) for i, t in enumerate(q_terms) if t in at):
                    q, d = slice(q_bound[i], q_bound[i + 1]), slice(bound[j], bound[j + 1])
                    common[np.ix_(q_row[q], row[d])] += np.minimum(q_n[q, None], n[None, d])
                score = _millionths(common / np.sqrt(np.maximum(batch.column("dl")[r].values.to_numpy(), 1)))
                first = np.argsort(np.argsort(-ids))  # of equal scores the smaller id's is larger
                place = np.where(common > 0, score * len(ids) + first, -1)
                best = np.argpartition(-place, k - 1, axis=1)[:, :k] if k < len(ids) else np.broadcast_to(np.arange(len(ids)), place.shape)
                i, j = np.nonzero(np.take_along_axis(place, best, 1) >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[best[i, j]]), pa.array(score[i, best[i, j]] / 1e6)], ["query_id", "doc_id", "score"])

    return pairs.mapInArrow(run, "query_id bigint, doc_id bigint, score double")


def overlap_top(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents (doc_id, text) of each query (query_id, text) by overlap_scores; ties by doc_id.

    Equal texts have equal scores, so each text is scored once for each wording of a query. The k best documents are among the k first ones of the k best texts,
    by score and the first document. Blocks of texts meet blocks of wordings as matrices, of which each gives k rows a wording at most."""
    alike = stage(top_k(docs.where("text IS NOT NULL").withColumn("same", F.lit(0)), k, per="text", score="same"), "alike-texts").select("doc_id", "text", "rank")
    texts = alike.where("rank = 1").select("doc_id", "text")
    asked = stage(queries.where("text IS NOT NULL").groupBy("text").agg(F.min("query_id").alias("query_id")), "asked-texts")
    blocks = _term_blocks(asked.coalesce(1) if asked.limit(QUERY_BLOCK * 64).count() < QUERY_BLOCK * 64 else asked, "query_id", QUERY_BLOCK)
    wanted = stage(blocks.select([F.col(c).alias("q_" + c) for c in blocks.columns]), "asked-blocks")
    held = wanted.agg(F.coalesce(F.sum(12 * F.size("q_codes") + 16 * F.size("q_ids") + 16 * F.size("q_terms")), F.lit(0))).first()[0]
    spread = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # each task has its own texts
    pairs = _term_blocks(spread, "doc_id", TEXT_BLOCK).crossJoin(F.broadcast(wanted) if held <= BROADCAST_BYTES else wanted)
    best = top_k(_best_overlaps(pairs, k), k).select("query_id", "doc_id", "score")
    members = texts.select("doc_id", "text").join(alike.select("text", F.col("doc_id").alias("member")), "text").select("doc_id", "member")
    found = top_k(best.join(members, "doc_id").select("query_id", F.col("member").alias("doc_id"), "score"), k)
    of = queries.select("query_id", "text").join(asked.select("text", F.col("query_id").alias("first")), "text").select("query_id", "first")
    return found.withColumnRenamed("query_id", "first").join(of, "first").select("query_id", "doc_id", "score", "rank")


#: Vectors that are compared as one matrix; query blocks of up to so many bytes are sent to every task.
VECTOR_BLOCK, BROADCAST_BYTES = 2048, 64 << 20


def _blocks(vectors: DataFrame, key: str) -> DataFrame:
    """(key array, values binary, dim) of blocks of VECTOR_BLOCK vectors or less, scaled to length one; a zero vector stays zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.asarray(v, np.float64) for v in batch.column("embedding").to_pylist() if v is not None]
            ids = [i for i, v in zip(batch.column(key).to_pylist(), batch.column("embedding").to_pylist()) if v is not None]
            for dim in sorted({len(v) for v in values}):
                at = [k for k, v in enumerate(values) if len(v) == dim]
                for low in range(0, len(at), VECTOR_BLOCK):
                    part = at[low : low + VECTOR_BLOCK]
                    m = np.stack([values[k] for k in part]).reshape(len(part), dim)
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([[ids[k] for k in part]], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary()), pa.array([dim], pa.int32())],
                        ["ids", "m", "dim"],
                    )

    ship(vectors.sparkSession)
    return vectors.select(F.col(key).cast("bigint").alias(key), "embedding").mapInArrow(run, "ids array<bigint>, m binary, dim int")


def dense(vectors: DataFrame, queries: DataFrame, k: int, low: float = -2.0, high: float = 2.0, others: bool = False) -> DataFrame:
    """(query_id, doc_id, score): of each query's vectors with a cosine above `low` and up to `high` the k best; ties go to the smaller id.

    Exact: a stated set of query vectors against all others, block by block as matrix products, of which each pair of blocks gives k rows a
    query at most. Vectors of another length don't meet; with `others` a vector doesn't meet itself.
    """
    q = stage(_blocks(queries, "query_id"), "query-blocks").toDF("q_ids", "q_m", "q_dim")
    held = q.agg(F.coalesce(F.sum(F.length("q_m")), F.lit(0))).first()[0]
    pairs = _blocks(vectors, "doc_id").join(F.broadcast(q) if held <= BROADCAST_BYTES else q, F.col("dim") == F.col("q_dim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                a = np.frombuffer(batch.column("q_m")[r].as_py(), np.float64).reshape(-1, dim)
                b = np.frombuffer(batch.column("m")[r].as_py(), np.float64).reshape(-1, dim)
                q_ids, ids = np.array(batch.column("q_ids")[r].as_py()), np.array(batch.column("ids")[r].as_py())
                score = np.round(a @ b.T, 6)
                ok = (score > low) & (score <= high)
                if others:
                    ok &= q_ids[:, None] != ids[None, :]
                score = np.where(ok, score, -np.inf)
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                best = np.take_along_axis(score, order, 1)
                i, j = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[i]), pa.array(ids[order[i, j]]), pa.array(best[i, j] + 0.0)], ["query_id", "doc_id", "score"]
                )

    return top_k(pairs.mapInArrow(run, "query_id bigint, doc_id bigint, score double"), k).drop("rank")


def reciprocal_rank_fusion(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, doc_id, score, first_list, first_rank) from rankings (query_id, doc_id, rank), first list first."""
    lists = [r.select("query_id", "doc_id", "rank", F.lit(i).alias("list")) for i, r in enumerate(rankings)]
    both = lists[0]
    for other in lists[1:]:
        both = both.unionByName(other)
    first = F.min(F.struct("list", "rank"))
    return both.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"),
        first["list"].alias("first_list"),
        first["rank"].cast("int").alias("first_rank"),
    )


def marginal_relevance(pool: DataFrame, queries: DataFrame, k: int, balance: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance of each query's bounded, ranked pool (query_id, doc_id, rank, text): (query_id, doc_id, pos).

    Relevance is the Jaccard similarity of the token sets of query and text; likeness the largest one to a text chosen before. Ties go to
    the better rank.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        rest = [(d, set(w), set(q)) for d, w, q in zip(*(frame.sort_values("rank")[c] for c in ("doc_id", "words", "asked")))]
        like = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        scores = [balance * like(q, w) for _, w, q in rest]
        nearest = [0.0] * len(rest)
        chosen: list[int] = []
        while len(chosen) < min(k, len(rest)):
            best = max((i for i in range(len(rest)) if i not in chosen), key=lambda i: (scores[i] - (1 - balance) * nearest[i], -i))
            chosen.append(best)
            nearest = [max(n, like(w, rest[best][1])) for n, (_, w, _) in zip(nearest, rest)]
        return pd.DataFrame({"query_id": frame.query_id.iloc[0], "doc_id": [rest[i][0] for i in chosen], "pos": range(len(chosen))})

    ship(pool.sparkSession)
    words = lambda c: F.array_distinct(tokens(F.col(c)))
    asked = queries.select("query_id", words("text").alias("asked"))
    both = pool.select("query_id", "doc_id", "rank", words("text").alias("words")).join(asked, "query_id")
    return both.groupBy("query_id").applyInPandas(pick, "query_id bigint, doc_id bigint, pos int")


def groundedness(answers: DataFrame) -> DataFrame:
    """(answer_id, groundedness, coverage, confidence, label) of rows (answer_id, response, evidence, query).

    Groundedness is the mean over sentences of the share of content tokens that the evidence has; coverage the share of
    the query's distinct content tokens that it has. Evidence, response and query are of one row, so nothing is shuffled.
    """

    def share(words: Column, known: Column) -> Column:
        return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(
            F.size(F.filter(words, lambda w: F.array_contains(known, w))) / F.size(words)
        )

    known = F.array_distinct(content_tokens(F.col("evidence")))
    a = answers.select(
        "answer_id",
        known.alias("known"),
        F.filter(F.transform(sentences(F.col("response")), content_tokens), lambda s: F.size(s) > 0).alias("said"),
        F.array_distinct(content_tokens(F.col("query"))).alias("asked"),
    )
    each = F.transform("said", lambda s: share(s, F.col("known")))
    g = F.when(F.size("said") == 0, F.lit(0.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda t, x: t + x) / F.size("said"))
    scored = a.select("answer_id", F.round(g, 6).alias("groundedness"), F.round(share(F.col("asked"), F.col("known")), 6).alias("coverage"))
    c = F.round(0.7 * F.col("groundedness") + 0.3 * F.col("coverage"), 3)
    return scored.withColumn("confidence", c).withColumn(
        "label", F.when(F.col("confidence") >= 0.75, "high").when(F.col("confidence") >= 0.45, "medium").otherwise("low")
    )


def ranking_metrics(ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per case hit rate, precision, recall, reciprocal rank and ndcg at each k.

    ranking (case_id, doc_id, rank), gold (case_id, doc_id). Precision divides by k even if fewer were retrieved; the ideal
    gain counts as many hits as were relevant and retrieved in the top k.
    """
    relevant = gold.select("case_id", "doc_id").distinct()
    sizes = relevant.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = ranking.join(relevant.withColumn("hit", F.lit(1)), ["case_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    rank, hit = F.col("rank"), F.col("hit")
    sums = []
    for k in ks:
        inside = rank <= k
        sums += [
            F.sum(F.when(inside, hit).otherwise(0)).alias(f"h{k}"),
            F.count_if(inside).alias(f"m{k}"),
            F.sum(F.when(inside & (hit == 1), 1.0 / F.log2(rank + 1)).otherwise(0.0)).alias(f"d{k}"),
            F.min(F.when(inside & (hit == 1), rank)).alias(f"f{k}"),
        ]
    per = hits.groupBy("case_id").agg(*sums).join(sizes, "case_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    columns = [F.col("case_id")]
    for k in ks:
        h, m, d, f, n = (F.col(c) for c in (f"h{k}", f"m{k}", f"d{k}", f"f{k}", "n_relevant"))
        ideal = F.aggregate(
            F.when(F.least(n, m) > 0, F.sequence(F.lit(1).cast("bigint"), F.least(n, m))).otherwise(F.array().cast("array<bigint>")),
            F.lit(0.0), lambda t, i: t + 1.0 / F.log2(i + 1),
        )
        columns += [
            (h > 0).cast("double").alias(f"hit_rate_{k}"),
            F.round(h / F.lit(k), 6).alias(f"precision_{k}"),
            F.round(F.when(n > 0, h / n).otherwise(0.0), 6).alias(f"recall_{k}"),
            F.round(F.coalesce(1.0 / f, F.lit(0.0)), 6).alias(f"mrr_{k}"),
            F.round(F.when(ideal > 0, d / ideal).otherwise(0.0), 6).alias(f"ndcg_{k}"),
        ]
    return per.select(*columns)



def resolved_metrics(ranking: DataFrame, gold: DataFrame, needle: str, k: int) -> DataFrame:
    """(query_id, n_relevant, recall_k, source_hit, failed): relevant are the gold documents (query_id, doc_id) and what was retrieved
    (query_id, doc_id, rank, source) from sources that hold the needle."""
    named = F.contains("source", F.lit(needle))
    relevant = gold.select("query_id", "doc_id").unionByName(ranking.where(named).select("query_id", "doc_id")).distinct().withColumn("hit", F.lit(1))
    n = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    h = ranking.join(relevant, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.count(F.when(F.col("rank") <= k, F.col("hit"))).alias("h"), F.max(named.cast("int")).alias("named")
    )
    h_ = F.coalesce("h", F.lit(0))
    return n.join(h, "query_id", "left").select(
        "query_id", "n_relevant", F.round(h_ / F.col("n_relevant"), 6).alias(f"recall_{k}"),
        F.coalesce("named", F.lit(0)).cast("double").alias("source_hit"), (h_ == 0).alias("failed"),
    )
