"""Operators that depend on an order: windows, samples, budgets, links between neighbours. Every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import broadcast_if_few, stage


def last_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key with their position from 1, oldest first."""
    back = Window.partitionBy(key).orderBy(F.col(order).desc())
    tail = rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n)
    return tail.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop("_back")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row with the largest order of each key, by map-side combining instead of a window."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(key, "r.*").select(rows.columns)


def distinct_in_order(rows: DataFrame, scope: str, order: str, key: Column) -> DataFrame:
    """The first row of each scope and key in the given order; those with an empty or null key go. Partial minima are all that is shuffled."""
    rest = [c for c in rows.columns if c not in (scope, order)]
    first = rows.withColumn("_key", key).where("_key != ''").groupBy(scope, "_key").agg(F.min(F.struct(order, *rest)).alias("_r"))
    return first.select(scope, "_r.*").select(rows.columns)


def count_windows(rows: DataFrame, key: str, order: str, size: int = 10) -> DataFrame:
    """Full windows of `size` rows of each key: (key, window, first, last, n, pending of the key)."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.select(key, order, F.floor((F.row_number().over(w) - 1) / size).cast("bigint").alias("window"))
    found = numbered.groupBy(key, "window").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))
    pending = F.coalesce(F.sum(F.when(F.col("n") < size, F.col("n"))).over(Window.partitionBy(key)), F.lit(0))
    return found.withColumn("pending", pending).where(F.col("n") == size)


def placed(rows: DataFrame, key: str, order: str | list[str], size: str | None = None) -> DataFrame:
    """rows with _at, the place of each in its key's order (by one column or several) from 0, _n, the rows of its key, and, for a size, _used, the sum of sizes up to it.

    Rows are dealt by ranges of (key, order); a range counts its own, and counts of the ranges before are added. So no task orders a
    whole key, however large a share of the rows it has.
    """
    order = [order] if isinstance(order, str) else order
    ranged = stage(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    amount = F.sum(size) if size else F.lit(0).cast("bigint")
    totals = ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("rows"), amount.alias("size"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = totals.select(
        F.col(key).alias("_key"), F.col("_part").alias("_of"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("_size"), F.sum("rows").over(Window.partitionBy(key)).alias("_n"),
    )
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    own = ranged.withColumn("_at", F.row_number().over(inside) - 1)
    if size:
        own = own.withColumn("_used", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    both = own.join(broadcast_if_few(before), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    both = both.withColumn("_at", F.col("_at") + F.col("_rows"))
    if size:
        both = both.withColumn("_used", F.col("_used") + F.col("_size"))
    return both.select(*rows.columns, "_at", "_n", *(["_used"] if size else []))


def spread_pick(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """Of each key the rows at round(i * (n - 1) / (k - 1)), i from 0 to k - 1, halves to the even number."""
    r = placed(rows, key, order)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (k - 1)).cast("bigint"))
    return r.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_at").cast("bigint"))).drop("_at", "_n")


def stride_sample(rows: DataFrame, key: str, order: str, target: int) -> DataFrame:
    """Every max(1, n // target)-th row of each key, `target` at most."""
    r = placed(rows, key, order)
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / target))
    return r.where((F.col("_at") % stride == 0) & (F.col("_at") / stride < target)).drop("_at", "_n")


def even_groups(rows: DataFrame, key: str, order: str, groups: int) -> DataFrame:
    """Contiguous groups: row i of n goes to the group g with floor(g * n / groups) <= i."""
    r = placed(rows, key, order)
    group = F.floor(((F.col("_at") + 1) * groups - 1) / F.col("_n"))
    return r.withColumn("group", group.cast("bigint")).drop("_at", "_n")


def round_robin(rows: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """First rows of every key, then second rows, and so on: the first `limit` with their position from 1."""
    turn = rows.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("turn") <= limit)
    best = turn.orderBy("turn", key).limit(limit)
    return best.withColumn("pos", F.row_number().over(Window.orderBy("turn", key)))


def char_budget(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each key while their sizes add up to no more than the budget; the first that does not ends it."""
    r = placed(rows, key, order, size).withColumnRenamed("_used", "used")
    return r.where(F.col("used") <= budget).drop("_at", "_n")


def largest_remainder(totals: DataFrame, key: str, total: str, shares: dict[str, float]) -> DataFrame:
    """(key, slot, n): whole numbers in the given shares that add up to the total; remainders to the largest fractions, equal ones in the order of
    the shares. Shares are counted as the decimals they are written as, for as doubles equal fractions of different shares differ in their last digits."""
    share = lambda x: F.lit(repr(x)).cast("decimal(17,16)")
    slots = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(s).alias("slot"), share(x).alias("share")) for i, (s, x) in enumerate(shares.items())])
    each = totals.select(key, total, F.explode(slots).alias("s")).select(key, total, "s.*")
    exact = F.round(F.col(total).cast("decimal(20,0)") * F.col("share"), 9)
    each = each.withColumn("low", F.floor(exact)).withColumn("fraction", exact - F.floor(exact))
    w = Window.partitionBy(key)
    left = F.col(total) - F.sum("low").over(w)
    rank = F.row_number().over(w.orderBy(F.col("fraction").desc(), "at"))
    return each.select(key, "slot", (F.col("low") + F.when(rank <= left, 1).otherwise(0)).cast("bigint").alias("n"))


def neighbours(rows: DataFrame, key: str, at: str, window: int = 1) -> DataFrame:
    """(key, at, near): positions within `window` of each row. Offsets are exploded, so the join is an equi-join."""
    offsets = F.array(*[F.lit(o) for o in range(-window, window + 1) if o])
    asked = rows.select(key, at, F.explode(offsets).alias("o")).select(key, at, (F.col(at) + F.col("o")).alias("near"))
    return asked.join(rows.select(key, F.col(at).alias("near")), [key, "near"]).select(key, at, "near")


def previous_and_next(rows: DataFrame, key: str, at: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(at)
    return rows.select(key, at, F.lag(at).over(w).alias("previous"), F.lead(at).over(w).alias("next"))


def ordered_union(*lists: DataFrame, key: str, item: str, at: str = "rank") -> DataFrame:
    """Distinct items of several ranked lists in the order of their first occurrence: (key, item, pos from 1)."""
    both = lists[0].select(key, item, at, F.lit(0).alias("_list"))
    for i, other in enumerate(lists[1:], 1):
        both = both.unionByName(other.select(key, item, at, F.lit(i).alias("_list")))
    first = both.groupBy(key, item).agg(F.min(F.struct("_list", at)).alias("_first"))
    return first.select(key, item, F.row_number().over(Window.partitionBy(key).orderBy("_first", item)).alias("pos"))
