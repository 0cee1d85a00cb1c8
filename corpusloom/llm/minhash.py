"""Near-duplicate texts by MinHash: many universal hash minima, bands, signatures, full sets, connected components by stars.

1.  Signatures. Each set of word n-grams gets HASHES minima of multiply-add-shift hashes of its n-grams' 32-bit values, a
    universal family with random odd factors. Documents with the same set are one class, which has one signature.
2.  Bands. ROWS minima make a band; classes that agree in a whole band share a bucket. Buckets of one class go before
    anything else travels.
3.  Stars, then rest. Every class meets one pivot of its buckets, then one of another bucket; what links is one component.
    Only pairs of different components in a bucket are looked at further, in blocks of bounded size, so that a bucket of many copies
    makes rows in proportion to its members.
4.  Signature verification. Pairs need sizes within the similarity and as many equal minima as a linked pair has, but for a chance
    of MISS_BY_SIGNATURE.
5.  Full sets. What is left is confirmed by intersection and union of the whole sets.
6.  Components of all confirmed links by alternating large-star and small-star rounds, at every size.

Two sets of exactly the asked similarity s miss all bands with a chance of (1 - s^ROWS)^(HASHES / ROWS): 7e-10 at 0.8. Nothing else
loses a link: neither buckets nor candidates are capped.

Defined results: those of jaccard_join. A null text and one without words are their own component; repeated rows are a class; a null doc_id
takes the component of its class; an empty table gives no rows; other columns are ignored. kept is doc_id <=> component_id, so
that equal ids of one component are all kept, and a null one only where the component has no id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.llm.jaccard_join import SENT_CLASSES, Bounds, Join, class_of, components_of, gram_sets, mix, near_sql
from corpusloom.operators.components import connected_components
from corpusloom.session import ship

HASHES, ROWS = 160, 4
MISS_BY_SIGNATURE = 1e-12
#: N-grams that are hashed at once.
BLOCK_GRAMS = 1 << 15
_RANDOM = np.random.default_rng(1)
FACTORS = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES 32-bit minima of each set, none of which is empty."""
    ends = np.cumsum([len(x) for x in sets])
    keys, starts = np.concatenate(sets) >> np.uint64(32), np.concatenate([[0], ends[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(keys * FACTORS[k] + TERMS[k], starts) >> np.uint64(32)
    return out


def minima_of_long(grams: np.ndarray) -> np.ndarray:
    """The same for one set, block by block."""
    parts = [minima([grams[k : k + BLOCK_GRAMS]]) for k in range(0, len(grams), BLOCK_GRAMS)]
    return np.minimum.reduce(parts)


def signatures(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    block: list[np.ndarray] = []
    size = 0
    for grams in sets:
        if block and size + len(grams) > BLOCK_GRAMS:
            yield from minima(block)
            block, size = [], 0
        if len(grams) > BLOCK_GRAMS:
            yield from minima_of_long(grams)
        else:
            block.append(grams)
            size += len(grams)
    if block:
        yield from minima(block)


def bands(signature: np.ndarray) -> np.ndarray:
    """The buckets of a signature."""
    rows = signature.reshape(-1, ROWS).astype(np.uint64)
    h = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h


def least_equal(percent: int, miss: float = MISS_BY_SIGNATURE) -> int:
    """The largest k with P(Binomial(HASHES, percent / 100) < k) <= miss."""
    s, below = percent / 100, 0.0
    for k in range(HASHES + 1):
        below += comb(HASHES, k) * s**k * (1 - s) ** (HASHES - k)
        if below > miss:
            return k
    return HASHES


class Signatures(Bounds):
    """What two linked sets keep: sizes within the similarity, and enough equal minima."""

    def __init__(self, percent: int):
        super().__init__(percent)
        self.least = least_equal(percent)

    @staticmethod
    def matrix(sketches: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(sketches), np.uint16).reshape(len(sketches), HASHES)

    def near(self, n_a: np.ndarray, s_a: np.ndarray, n_b: np.ndarray, s_b: np.ndarray) -> np.ndarray:
        ok = 100 * np.minimum(n_a, n_b) >= self.p * np.maximum(n_a, n_b)
        at = np.flatnonzero(ok)
        ok[at] = ((s_a[at] if s_a.ndim > 1 else s_a) == s_b[at]).sum(1) >= self.least
        return ok

    def near_pairs(self, i: np.ndarray, j: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> np.ndarray:
        m = self.matrix(sketches)
        parts = [np.arange(k, min(k + 8192, len(i))) for k in range(0, len(i), 8192)]
        found = [self.near(sizes[i[part]], m[i[part]], sizes[j[part]], m[j[part]]) for part in parts]
        return np.concatenate(found) if found else np.zeros(0, bool)

    def forest(self, labels: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        return Bounds(self.p).forest(labels, sets)


class BandJoin(Join):
    """The join whose regions are the buckets of bands, and whose sketches are signatures of 16 bits for each minimum."""

    in_blocks = True

    def labels(self) -> DataFrame | None:
        """As of the join, which settles regions by components as it goes; those of all its confirmed links are made by stars."""
        if super().labels() is None:
            return None
        found = connected_components(self.links, few=0)
        return self.scratch.stage(found.select(F.col("node").alias("class"), F.col("component").alias("label")), "labels")

    def tests(self) -> Bounds:
        return Signatures(self.percent)

    def profiled(self) -> DataFrame:
        n, fold = self.n, self.fold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent: set[int] = set()
            for whole in batches:
                for low in range(0, whole.num_rows, 1000):
                    batch = whole.slice(low, 1000)
                    sets = list(gram_sets(batch.column("text").to_pylist(), n, fold))
                    group = [class_of(g) if len(g) else None for g in sets]
                    wanted: dict[int, np.ndarray] = {}
                    for c, g in zip(group, sets):
                        if c is not None and c not in sent:
                            wanted.setdefault(c, g)
                    if len(sent) >= SENT_CLASSES:
                        sent.clear()
                    sent.update(wanted)
                    signed = dict(zip(wanted, signatures(list(wanted.values()))))
                    sketch, cells = [], []
                    for c in group:
                        own = signed.pop(c, None)
                        sketch.append(None if own is None else own.astype(np.uint16).tobytes())
                        cells.append(None if own is None else bands(own).view(np.int64))
                    columns = [
                        pa.array([len(g) for g in sets], pa.int64()), pa.array(group, pa.int64()),
                        pa.array(sketch, pa.binary()), pa.array(cells, pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), batch.column("key"), *columns], ["doc_id", "key", "size", "class", "sketch", "cells"]
                    )

        ship(self.docs.sparkSession)
        return self.docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("key")).mapInArrow(
            run, "doc_id bigint, key bigint, size bigint, class bigint, sketch binary, cells array<bigint>"
        )


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: documents link when 100 * intersection >= percent * union."""
    found = components_of(BandJoin(docs, n, percent, True))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


SQL = {"op13_minhash_dedup": near_sql(2, 80, ", s.doc_id = least(s.doc_id, coalesce(l.b, s.doc_id)) AS kept")}
