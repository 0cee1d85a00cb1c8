"""Byte-level BPE encoding and decoding of a text column (see bpe.py for the method and the defined results).

fold_words folds ranked merges over the bytes of distinct words in Spark's higher-order functions with a rank map. Encoding whole corpora
by it can't meet the time at hand (README.md has the figures), so texts are encoded in one pass of Arrow tasks, which fold
the distinct words of each block in the same way; no shuffle, and the vocabulary goes to the executors once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import GPT2_PATTERN, parse_ranks, rank_encoder
from corpusloom.llm.common import let, stage, table
from corpusloom.session import ship


def vocabulary(path: str) -> bytes:
    return Path(path).read_bytes()


#: Buckets of the rank map, so that a look-up reads a few pairs; a rank that no pair has.
BUCKETS, NO_RANK = 1 << 17, (1 << 31) - 1


def rank_map(spark: SparkSession, path: str) -> DataFrame:
    """One row (ranks, of_byte): maps from two neighbours' ids, left * 2^20 + right, to the id that they make, by buckets; the id of each byte."""
    ranks = parse_ranks(vocabulary(path))
    held: list[list[tuple[int, int]]] = [[] for _ in range(BUCKETS)]
    for piece, made in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                held[(a * 131 + b) % BUCKETS].append(((a << 20) | b, made))
    kinds = pa.schema([("ranks", pa.list_(pa.map_(pa.int64(), pa.int32()))), ("of_byte", pa.list_(pa.int32()))])
    return stage(spark.createDataFrame(pa.table({"ranks": [held], "of_byte": [[ranks[bytes([b])] for b in range(256)]]}, schema=kinds)), "rank-map")


def fold_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) of distinct words (word string): ranked merges folded over a word's bytes by higher-order functions.

    The state of the fold are the ids of the pieces so far and the rank of each pair of neighbours; a step joins the first pair of the least
    rank and looks up the two pairs that it makes. Words come in groups of a bounded number, as each row carries the rank map.
    """
    t = F.col("ranks")

    def rank(a: Column, b: Column) -> Column:
        key = F.shiftleft(a.cast("bigint"), 20) + b
        return let(key, lambda k: F.coalesce(F.try_element_at(F.get(t, ((a * 131 + b) % BUCKETS).cast("int")), k), F.lit(NO_RANK)))

    def step(state: Column, _: Column) -> Column:
        ids, r = state["ids"], state["r"]
        least = F.coalesce(F.array_min(r), F.lit(NO_RANK))
        none = F.array().cast("array<int>")
        join = lambda k: F.struct(
            F.concat(F.slice(ids, 1, k - 1), F.array(least), F.slice(ids, k + 2, F.size(ids))).alias("ids"),
            F.concat(
                F.slice(r, 1, F.greatest(k - 2, F.lit(0))),
                F.when(k > 1, F.array(rank(F.get(ids, k - 2), least))).otherwise(none),
                F.when(k + 1 < F.size(ids), F.array(rank(least, F.get(ids, k + 1)))).otherwise(none),
                F.slice(r, k + 2, F.size(ids)),
            ).alias("r"),
        )
        return F.when(least == NO_RANK, state).otherwise(let(F.array_position(r, least).cast("int"), join))

    def fold(ids: Column) -> Column:
        pairs = F.transform(F.slice(ids, 2, F.size(ids)), lambda b, i: rank(F.get(ids, i), b))
        start = F.struct(ids.alias("ids"), pairs.alias("r"))
        return F.when(F.size(ids) < 2, ids).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(ids) - 1), start, step, lambda s: s["ids"]))

    raw = lambda w: F.encode(w, "utf-8")
    byte = lambda w, i: F.get(F.col("of_byte"), F.conv(F.hex(F.substring(raw(w), i, 1)), 16, 10).cast("int"))
    bytes_of = lambda w: F.transform(F.sequence(F.lit(1), F.octet_length(w)), lambda i: byte(w, i))
    one = words.where("word IS NOT NULL AND word != ''").select("word").distinct()
    groups = F.pmod(F.xxhash64("word"), F.lit(max(1, one.count() // 1000)))
    held = one.groupBy(groups.alias("group")).agg(F.collect_list("word").alias("words")).crossJoin(F.broadcast(rank_map(words.sparkSession, path)))
    made = held.select(F.explode(F.transform("words", lambda w: F.struct(w.alias("word"), let(bytes_of(w), fold).alias("ids")))).alias("m"))
    return made.select("m.word", "m.ids")


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text by the rank file at `path`."""
    ship(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(raw.value)
        for batch in batches:
            ids = [x.astype("int32") for x in encoder.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes): the pieces of the ids, joined."""
    ship(encoded.sparkSession)
    raw = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(raw.value)
        for batch in batches:
            texts = [b"".join(map(encoder.pieces.__getitem__, ids or [])) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return encoded.mapInArrow(run, "doc_id bigint, bytes binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str = GPT2_PATTERN) -> DataFrame:
    """Digests of the ids of every whole text and of what they decode to, without moving either."""
    ship(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(raw.value, pattern)
        decimal = list(map(str, range(len(encoder.pieces))))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for ids in encoder.encode(x.as_py() for x in batch.column("text")):
                text = ",".join(map(decimal.__getitem__, ids.tolist()))
                rows.append((len(ids), sha(text.encode()), sha(encoder.decode(ids))))
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=schema
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_and_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
