"""Hard negatives of anchors: rows of another label whose score lies in a window below each positive's.

Scores are inner products of whole numbers, exact. Vectors travel as blocks; anchors, a stated set of queries, meet all rows block by
block, as matrix products.

1.  Positives: the best rows of the anchor's label. Each task keeps its best for every anchor, and what the tasks have kept is ranked.
2.  Slots: the upper limits of an anchor's positives, falling, cut its scores into disjoint slots: slot j holds the scores from above limit
    j + 1 up to limit j. Each task keeps the k best rows of another label for each slot, so that a task gives anchors * positives * k rows
    at most, however many rows it has met.
3.  Suffix merges: the window of positive i is slots i and on, cut at its lower limit. The k best of slots from the last to the first
    are merged once, and every window reads its suffix.

Broadcast are blocks of anchors of BROADCAST_BYTES at most, checked; more are dealt with the rows over cells of anchors and salts.

Defined results: a row with a null label, a null vector, or a null component takes no part (non-finite ones go when vectors are made
whole numbers); vectors of another length than the anchor's don't meet it; another row is one with another id; a null id is no anchor, follows
all others in ties, and is returned as null; an id counts once for each score, so that repeated rows are one; an id that stands on several
rows is an anchor for each; a positive with a score below 0 has an empty window; scores beyond a long stay at its ends; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions, stage, table
from corpusloom.session import ship

#: Vectors of a block; bytes of anchors' blocks that are sent to every task, and of anchors in a cell beyond that.
BLOCK, BROADCAST_BYTES = 1024, 8 << 20
_LOW, _HIGH = -(2**63) + 1, 2**63 - 1


def whole_numbers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a vector with a component that is null or not finite."""
    x = embedding.cast("array<double>")
    sound = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * scale).cast("bigint")))


def _blocks(rows: DataFrame) -> DataFrame:
    """(ids, marks, labels, m, dim) of blocks of rows (id, mark, label, v), m being the matrix of whole numbers; of anchors with limits also
    (lowers, uppers), one and several for each."""
    single = [c for c in ("id", "mark", "label", "lower") if c in rows.columns]
    limited = "uppers" in rows.columns
    names = [f"{c}s" for c in single] + ["uppers"] * limited

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                for low in range(0, part.num_rows, BLOCK):
                    b = part.slice(low, BLOCK)
                    m = b.column("v").flatten().to_numpy().astype(np.int64).tobytes()
                    lists = [b.column(c) for c in single] + ([b.column("uppers").flatten()] if limited else [])
                    columns = [pa.array([x.to_pylist()], pa.list_(pa.int64())) for x in lists]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([m], pa.binary()), pa.array([dim], pa.int32())], [*names, "m", "dim"])

    ship(rows.sparkSession)
    long = [F.col(c).cast("bigint").alias(c) for c in single] + [F.col(c).cast("array<bigint>").alias(c) for c in ["v"] + ["uppers"] * limited]
    return rows.select(*long).mapInArrow(run, ", ".join(f"{c} array<bigint>" for c in names) + ", m binary, dim int")


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact; beyond a long its ends."""
    dim = a.shape[1]
    top = max(1, dim) * max(map(abs, (int(a.min(initial=0)), int(a.max(initial=0))))) * max(map(abs, (int(b.min(initial=0)), int(b.max(initial=0)))))
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top <= _HIGH:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.array([[min(max(int(x), _LOW), _HIGH) for x in row] for row in exact], np.int64).reshape(exact.shape)


class Kept:
    """The k best of each (anchor, slot), by falling score, then id with null last; an id counts once for each score."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots = k, slots
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # group, score, unknown, id
        self.full = np.full(anchors * slots, _LOW, np.int64)  # a group with k rows takes none below its last score

    def add(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, unknown: np.ndarray, ids: np.ndarray) -> None:
        group = anchor * self.slots + slot
        fits = score >= self.full[group]
        new = [x[fits] for x in (group, score, unknown.astype(np.int64), ids)]
        if not len(new[0]):
            return
        g, s, u, i = (np.concatenate([a, b]) for a, b in zip(self.rows, new))
        order = np.lexsort((i, u, -s, g))
        g, s, u, i = g[order], s[order], u[order], i[order]
        again = np.zeros(len(g), bool)
        again[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1]) & (u[1:] == u[:-1]) & (i[1:] == i[:-1])
        g, s, u, i = g[~again], s[~again], u[~again], i[~again]
        first = np.flatnonzero(np.diff(g, prepend=-1))
        at = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        kept = at < self.k
        last = at == self.k - 1
        self.full[g[last]] = s[last]
        self.rows = [x[kept] for x in (g, s, u, i)]


def _met(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every pair of a block of rows and one of anchors of the same length; the anchors' columns begin with a_."""
    held = anchors.agg(F.coalesce(F.sum(F.length("m")), F.lit(0))).first()[0]
    asked = anchors.toDF(*(f"a_{c}" for c in anchors.columns))
    same = F.col("dim") == F.col("a_dim")
    if held <= BROADCAST_BYTES:
        return rows.join(F.broadcast(asked), same)
    cells, salts = -(-held // BROADCAST_BYTES), partitions(rows.sparkSession)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("salt", F.pmod(F.xxhash64("m", "ids"), F.lit(salts)).cast("int")).withColumn("cell", every(int(cells)))
    right = asked.withColumn("cell", F.pmod(F.xxhash64("a_m", "a_marks"), F.lit(int(cells))).cast("int")).withColumn("salt", every(salts))
    return left.join(right, ["cell", "salt"]).where(same).drop("cell", "salt")


def _best(rows: DataFrame, anchors: DataFrame, slots: int, k: int, same_label: bool) -> DataFrame:
    """(mark, slot, score, unknown, id): of each anchor and slot the k best of what a task has met.

    anchors has blocks with uppers, `slots` falling limits for each anchor, and lowers, one; without uppers there is one slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[bytes, tuple[np.ndarray, Kept]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for marks, kept in state.values():
                g, s, u, i = kept.rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks[g // slots]), pa.array(g % slots), pa.array(s), pa.array(u == 1), pa.array(i, pa.int64(), mask=u == 1)],
                    ["mark", "slot", "score", "unknown", "id"],
                )
            state.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c)[r] for c in batch.schema.names}
                a_marks = one["a_marks"].values.to_numpy()
                if a_marks.tobytes() not in state:
                    if held > 1 << 16:  # anchors whose best are held at once
                        yield from flush()
                        held = 0
                    held += len(a_marks)
                    state[a_marks.tobytes()] = a_marks, Kept(len(a_marks), slots, k)
                kept = state[a_marks.tobytes()][1]
                ids = one["ids"].values
                unknown = ids.is_null().to_numpy(zero_copy_only=False)
                ids, labels = ids.fill_null(0).to_numpy(), one["labels"].values.to_numpy()
                a_ids, a_labels = one["a_ids"].values.to_numpy(), one["a_labels"].values.to_numpy()
                dim = one["dim"].as_py()
                a = np.frombuffer(one["a_m"].as_buffer(), np.int64).reshape(len(a_ids), dim)
                b = np.frombuffer(one["m"].as_buffer(), np.int64).reshape(len(ids), dim)
                score = scores(a, b)
                ok = (a_labels[:, None] == labels[None, :]) == same_label
                ok &= (a_ids[:, None] != ids[None, :]) | unknown[None, :]
                slot = np.zeros(score.shape, np.int64)
                if "a_uppers" in one:
                    slot -= 1
                    for limit in one["a_uppers"].values.to_numpy().reshape(len(a_ids), slots).T:
                        slot += score <= limit[:, None]
                    ok &= (slot >= 0) & (score >= one["a_lowers"].values.to_numpy()[:, None])
                i, j = np.nonzero(ok & (score >= kept.full.reshape(-1, slots)[np.arange(len(a_ids))[:, None], np.maximum(slot, 0)]))
                kept.add(i, slot[i, j], score[i, j], unknown[j], ids[j])
        yield from flush()

    met = _met(rows, anchors)
    columns = [c for c in met.columns if c not in ("marks", "a_dim")]
    found = met.select(columns).mapInArrow(run, "mark bigint, slot bigint, score bigint, unknown boolean, id bigint").distinct()
    order = Window.partitionBy("mark", "slot").orderBy(F.col("score").desc(), "unknown", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, v) with arrays of whole numbers v.

    anchors is a condition on rows. An anchor's positives are its first `positives` other rows of its label; for each the first `negatives`
    rows of other labels whose score is `low` to `high` per cent of the positive's. Higher scores come first, then smaller ids."""
    long = [F.col(c).cast("bigint").alias(c) for c in ("id", "label")]
    sound = rows.where("label IS NOT NULL AND v IS NOT NULL").where(F.forall("v", lambda x: x.isNotNull()))
    asked = sound.where("id IS NOT NULL").where(anchors).select(*long, "v").distinct()
    asked = stage(asked.withColumn("mark", F.monotonically_increasing_id()), "anchors")
    blocks = _blocks(sound.select(*long, "v", F.lit(0).alias("mark")))
    found = _best(blocks, stage(_blocks(asked), "anchor-blocks"), 1, positives, True)
    own = stage(found.select("mark", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # ceil(low * s / 100) and floor(high * s / 100); those below 0 have empty windows and come last
    part = lambda s, share: s.cast("decimal(38,0)") * share
    upper = F.floor(part(F.col("positive_score"), high) / 100).cast("bigint")
    lower = F.ceil(part(F.col("positive_score"), low) / 100).cast("bigint")
    windows = stage(own.where("positive_score >= 0").withColumns({"upper": upper, "lower": lower}), "windows")
    limits = windows.groupBy("mark").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "upper"))), lambda x: x["upper"]).alias("uppers"), F.min("lower").alias("lower")
    )
    filled = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("uppers", i), F.lit(_LOW)))
    limited = asked.join(limits, "mark").select("id", "mark", "label", "v", filled.alias("uppers"), "lower")
    found = _best(blocks, stage(_blocks(limited), "limited-blocks"), positives, negatives, False)

    # from the last slot to the first: the best of a slot and all after it
    best = F.struct((-F.col("score")).alias("below"), "unknown", "id")
    by_slot = found.groupBy("mark").agg(F.collect_list(F.struct("slot", best.alias("b"))).alias("held"))
    merged = by_slot.select("mark", F.aggregate(
        F.sequence(F.lit(positives - 1), F.lit(0), F.lit(-1)),
        F.array().cast("array<array<struct<below: bigint, unknown: boolean, id: bigint>>>"),
        lambda done, i: F.concat(F.array(F.slice(F.array_sort(F.concat(
            F.transform(F.filter("held", lambda h: h["slot"] == i), lambda h: h["b"]),
            F.coalesce(F.get(done, F.lit(0)), F.array().cast("array<struct<below: bigint, unknown: boolean, id: bigint>>")),
        )), 1, negatives)), done),
    ).alias("suffixes"))
    inside = F.filter(F.get("suffixes", F.col("place") - 1), lambda b: -b["below"] >= F.col("lower"))
    out = windows.join(merged, "mark").join(asked.select("mark", F.col("id").alias("anchor_id")), "mark")
    return out.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "b")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("negative_id"), "positive_score",
        (-F.col("b.below")).alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = e.select(F.col("vec_id").alias("id"), label.alias("label"), whole_numbers(F.col("embedding")).alias("v"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


SQL = {
    "op11_hard_negatives": """
WITH sound AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT DISTINCT a.id AS anchor_id, a.label AS own, r.id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM sound a JOIN sound r ON a.id % 100 = 0 AND r.id IS DISTINCT FROM a.id AND len(a.v) = len(r.v)),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id NULLS LAST) <= 5),
pairs AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id, p.score ORDER BY n.score DESC, n.id NULLS LAST) AS place
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM pairs WHERE place <= 10
"""
}
