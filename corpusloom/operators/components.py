"""Connected components of a table of links, by alternating stars. Nothing is collected; every round is a written table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import Scratch, ship, stage

#: Up to so many links are joined in one task, in memory of a few MB; more of them by rounds over the cluster.
FEW_LINKS = 100_000


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(find, nodes), pa.int64())], ["node", "component"])

    ship(links.sparkSession)
    return links.select("a", "b").coalesce(1).mapInArrow(run, "node bigint, component bigint")


def connected_components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, component) for the ends of links (a, b): component is the smallest node that can be reached.

    A small table of links, by its checked size, is joined in one task. Otherwise each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour, until nothing
    changes; minima are combined before each shuffle and the joins' skewed keys can be split. No links, no rows.
    """
    a, b = F.col("a"), F.col("b")
    if links.limit(few + 1).count() <= few:
        return _in_one_task(links)
    scratch = Scratch()
    edges = scratch.stage(
        links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links"
    )

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        # a root's own smaller side is kept by its neighbours; here every edge points from the larger to the smaller end
        round_ = Scratch()
        large = round_.stage(large.where(F.col("a") != F.col("b")).distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(b.alias("v"), a.alias("u"), "m")
        edges = round_.stage(
            small.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where(a != b)
            .distinct(),
            "small-star",
        )
        scratch.clear()
        scratch = round_
        after = state(edges)
        if after == before:
            break
        before = after
    # a star: every node points at its root
    tails = edges.select(a.alias("node"), b.alias("component"))
    return tails.unionByName(edges.select(b.alias("node"), b.alias("component")).distinct())
