"""Best-fit packing of tokenised documents into sequences, with vector capacities.

Every document becomes its token ids and a separator; only one longer than a sequence is cut, into full pieces with the
shorter one first. A sequence has three capacities: tokens, number of pieces, and attention cost (the sum of the squared
lengths). Pieces are placed longest first into the open sequence that is feasible under all three and scores best: the
smallest weighted norm of what remains, or the largest weighted dot product of demand and residual.

Texts are tokenised where they are read; only (id, length, checksum) rows are shuffled, by a hash of document and piece,
so that every partition holds the same mix of lengths and no document's pieces meet in one task. The pieces are counted
and dealt to one task for each BLOCK of them, so a task's memory does not grow with the corpus and the result does not
depend on the session's partitions. Sequences that are not full are then packed again, as items, in rounds over fewer
blocks until one block holds them all or a round joins none; those too long to join even the shortest of them stay out.

Defined results: a null or empty text is the separator alone; a null doc_id is carried along; repeated rows are packed
each; an empty table gives no rows; ties in length go by the order of hash, doc_id and piece, so a retried task packs the
same; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import json_encoder
from corpusloom.llm.common import slices, small_batches, stage, table
from corpusloom.session import ship

SEQUENCE_TOKENS = 2048
SEPARATOR = 0
BLOCK = 32_768
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, max_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row for each piece, with a checksum of its ids, by the tokenizers JSON file at `path`."""
    ship(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = json_encoder(raw.value)
        for batch in slices(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            texts = batch.column("text").to_pylist()
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                data = np.append(ids, np.uint32(SEPARATOR)).astype("<u4").tobytes()
                n = len(data) // 4
                cuts = [0, *range(n % max_tokens or max_tokens, n + 1, max_tokens)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECE_SCHEMA)


def best_fit(
    lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], score: str = "norm",
    counts: np.ndarray | None = None, attention: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed longest first; ties in the order given. Items of several pieces bring their
    numbers of pieces and attention costs."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    cap, w = np.array(capacity, float), np.array(weights, float)
    left = np.empty((n, 3))  # residuals of the open bins, in the first `m` rows
    room = np.empty(n)  # of tokens alone: few bins have enough, and only they are looked at
    number = np.empty(n, np.int64)
    m = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = float(lengths[i])
        need = np.array([size, 1.0 if counts is None else counts[i], size * size if attention is None else attention[i]])
        best = -1
        if m:
            near = np.flatnonzero(room[:m] >= size)
            rest = left[near] - need
            fits = (rest >= 0).all(1)
            if fits.any():
                if score == "norm":
                    value = ((rest / cap) ** 2) @ w
                    best = int(near[np.where(fits, value, np.inf).argmin()])
                else:
                    value = (left[near] / cap) @ (w * need / cap)
                    best = int(near[np.where(fits, value, -np.inf).argmax()])
        if best < 0:
            left[m], number[m] = cap, made
            best, m, made = m, m + 1, made + 1
        bins[i], offsets[i] = number[best], cap[0] - left[best, 0]
        left[best] -= need
        room[best] = left[best, 0]
        if (left[best] < 1).any():  # full under one of the capacities: closed
            m -= 1
            left[best], room[best], number[best] = left[m], room[m], number[m]
    return bins, offsets


def pack(
    found: DataFrame,
    max_tokens: int = SEQUENCE_TOKENS,
    max_pieces: int = SEQUENCE_TOKENS,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    score: str = "norm",
) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    capacity = (max_tokens, max_pieces, max_attention or max_tokens**2)

    spark = found.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, held, count = TaskContext.get().partitionId() << 33, [], 0

        def packed(frame: pd.DataFrame) -> pd.DataFrame:
            nonlocal base
            more = (frame["n"].to_numpy(), frame["attention"].to_numpy()) if "n" in frame else ()
            bins, offsets = best_fit(frame["length"].to_numpy(), capacity, weights, score, *more)
            out = frame.assign(sequence_id=bins + base, offset=offsets)
            base += int(bins.max()) + 1
            return out

        for frame in frames:
            held.append(frame)
            count += len(frame)
            while count >= 2 * BLOCK:  # hashing deals somewhat more than BLOCK to some tasks
                whole = pd.concat(held, ignore_index=True)
                yield packed(whole.iloc[:BLOCK].reset_index(drop=True))
                held, count = [whole.iloc[BLOCK:]], count - BLOCK
        if count:
            yield packed(pd.concat(held, ignore_index=True))

    ship(spark)
    with small_batches(spark):
        found = stage(found, "pieces")
    blocks = max(1, -(-found.count() // BLOCK))
    key = F.xxhash64("doc_id", "piece")
    placed = (
        found.repartition(blocks, key)
        .sortWithinPartitions(key, "doc_id", "piece")
        .mapInPandas(run, PIECE_SCHEMA + ", sequence_id bigint, offset bigint")
    )
    while blocks > 1:
        placed = stage(placed, "placed")
        square = F.col("length").cast("double") * F.col("length")
        items = placed.groupBy(F.col("sequence_id").alias("item")).agg(
            F.sum("length").alias("length"), F.count(F.lit(1)).alias("n"), F.sum(square).alias("attention")
        )
        items = stage(items.where((F.col("length") < max_tokens) & (F.col("n") < capacity[1])), "unfilled")
        low = items.agg(F.min("length")).first()[0] or 0
        items = items.where(F.col("length") <= max_tokens - low)
        n = items.count()
        if not n:
            break
        blocks = min(blocks - 1, max(1, -(-n // BLOCK)))
        mixed = F.xxhash64("item")
        again = stage(
            items.repartition(blocks, mixed).sortWithinPartitions(mixed, "item").mapInPandas(
                run, "item bigint, length bigint, n bigint, attention double, sequence_id bigint, offset bigint"
            ),
            "repacked",
        )
        if again.select("sequence_id").distinct().count() == n:
            break
        to = again.select(F.col("item").alias("sequence_id"), F.col("sequence_id").alias("to"), F.col("offset").alias("shift"))
        # sequences that stay as they are take odd ids, the new ones even ids
        placed = placed.join(to, "sequence_id", "left").select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            F.when(F.col("to").isNull(), F.col("sequence_id") * 2 + 1).otherwise(F.col("to") * 2).alias("sequence_id"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    return placed


def pack_documents(docs: DataFrame, path: str | None = None, **limits) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(pieces(docs, path, limits.get("max_tokens", SEQUENCE_TOKENS)), **limits)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
