"""Total-order work without a single-partition window.

A window over the whole table would put every row in one task. Here each value gets an integer that never falls as the
value grows, and the leading bits of these integers make a tree: rows that share enough bits form a slice, slices that
share all but their last 8 bits a parent, and so on up. Totals are added up the tree; what comes before a node is what
comes before its parent and, in a window of at most 256 siblings, what its smaller siblings hold. A window over rows
runs inside slices only. How many bits a slice needs is found by counting: only slices that are still too large are
counted again, 8 bits deeper. No list of cuts exists, on the driver or anywhere; results are exact.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

ROWS_PER_SLICE = 100_000
STEP = 8  # bits between a level of the tree and the next
FINE = 42  # bits after the point of a binary logarithm: what a double still tells apart at 1,075


def _key(df: DataFrame, order: str) -> Column:
    """An integer that never falls as `order` grows, NaN last; null for null. Values that share one stay in one slice."""
    if isinstance(df.schema[order].dataType, IntegralType):
        return F.col(order).cast("bigint")
    x = F.col(order).cast("double")
    # 1 to 2,099 for any size of number; the sign mirrors it
    size = F.least(F.log2(F.abs(x)) + 1_075, F.lit(2_100.0))
    scaled = F.floor(F.signum(x) * size * F.lit(float(1 << FINE)))
    return F.when(F.isnan(x), F.lit(2_200 << FINE)).when(x == 0, F.lit(0).cast("bigint")).otherwise(scaled)


def _slices(df: DataFrame, order: str, rows_per_slice: int) -> tuple[Column, int]:
    """The slice of each row, from 0 (null, if any null has a slice of its own), and how many bits slices have."""
    keys = df.select(_key(df, order).alias("key"))
    low, high, rows = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if rows <= rows_per_slice:
        return F.lit(0).cast("bigint"), 0
    key = _key(df, order)
    if high - low >= 1 << 62:  # room for differences, and for one more
        keys, key, low, high = keys.select(F.shiftright("key", 2).alias("key")), F.shiftright(key, 2), low >> 2, high >> 2
    bits = (high - low).bit_length()
    left = bits
    while left > 0:
        left = max(0, left - STEP)
        counted = keys.groupBy(F.shiftright(F.col("key") - low, left).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
        large = counted.filter((F.col("n") > rows_per_slice) & F.col("slice").isNotNull()).select("slice")
        if large.isEmpty():
            break
        # at most rows / rows_per_slice slices; only their rows are counted again
        keys = keys.join(large, F.shiftright(F.col("key") - low, left) == F.col("slice"), "left_semi")
    return F.coalesce(F.shiftright(key - F.lit(low), left) + 1, F.lit(0).cast("bigint")), bits - left + 1


def _before(nodes: DataFrame, names: list[str], bits: int) -> DataFrame:
    """node and, by name, the totals of all smaller nodes."""
    parent = F.shiftright("node", STEP)
    siblings = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    within = nodes.withColumn("parent", parent).select(
        "node", "parent", *[F.coalesce(F.sum(name).over(siblings), F.lit(0)).alias(name) for name in names]
    )
    if bits <= STEP:
        return within.drop("parent")
    above = nodes.groupBy(parent.alias("node")).agg(*[F.sum(name).alias(name) for name in names])
    starts = _before(above, names, bits - STEP).select(F.col("node").alias("parent"), *[F.col(n).alias(f"__{n}") for n in names])
    return within.join(starts, "parent").select("node", *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in names])


def bucket_of(df: DataFrame, value: str, cuts: list[float], out: str) -> DataFrame:
    """Number of `cuts` that are <= value (binary search, lower bound inclusive); -1 for null, and one
    above all others for NaN, as Spark orders them."""
    if not cuts:
        number = F.col(value).cast("double")
        return df.withColumn(out, F.when(number.isNull(), -1.0).when(F.isnan(number), 1.0).otherwise(0.0))
    splits = [-math.inf, *cuts, math.inf]
    as_double = df.withColumn("__value", F.col(value).cast("double"))
    finder = Bucketizer(splits=splits, inputCol="__value", outputCol=out, handleInvalid="keep")
    bucketed = finder.transform(as_double)
    return bucketed.withColumn(out, F.when(F.col("__value").isNull(), -1.0).otherwise(F.col(out))).drop("__value")


def running_totals(
    df: DataFrame,
    order: str,
    totals: dict[str, Column],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add inclusive running sums of the `totals` columns in `order`, nulls first and NaN last.

    `order` must be numeric and unique: sum up equal values first. The answer is the same for any slices.
    """
    slice_of, bits = _slices(df, order, rows_per_slice)
    sliced = df.withColumn("__slice", slice_of).withColumns({f"__{name}": value for name, value in totals.items()})
    inside = Window.partitionBy("__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = sliced.withColumns({n: F.sum(f"__{n}").over(inside) for n in totals})
    if not bits:
        return summed.select(*df.columns, *totals)
    slices = sliced.groupBy(F.col("__slice").alias("node")).agg(*[F.sum(f"__{name}").alias(name) for name in totals])
    starts = _before(slices, list(totals), bits).select(F.col("node").alias("__slice"), *[F.col(n).alias(f"__start_{n}") for n in totals])
    return summed.join(starts, "__slice").select(
        *df.columns, *[(F.col(n) + F.col(f"__start_{n}")).alias(n) for n in totals]
    )


def number_rows(df: DataFrame, order: str, out: str = "position", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add 0-based positions in the order of a unique numeric column."""
    numbered = running_totals(df, order, {out: F.lit(1).cast("long")}, rows_per_slice)
    return numbered.withColumn(out, F.col(out) - 1)


def exact_quantiles(
    df: DataFrame, value: str, fractions: list[float], rows_per_slice: int = ROWS_PER_SLICE
) -> list[float]:
    """Exact linearly interpolated quantiles; only the two order statistics around
    each fraction leave the cluster, at most 2 x len(fractions) numbers. Null and NaN have no rank."""
    counted = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.col(value).alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = counted.agg(F.sum("n")).first()[0]
        if not total:
            return []
        places = [fraction * (total - 1) for fraction in fractions]
        needed = sorted({math.floor(p) for p in places} | {math.ceil(p) for p in places})

        # A value holds ranks [upto - n, upto); keep it when a needed rank lies there.
        cuts = [float(rank) for rank in needed]
        held = running_totals(counted, "v", {"upto": F.col("n")}, rows_per_slice)
        held = held.withColumns({"first": F.col("upto") - F.col("n"), "last": F.col("upto") - 1})
        held = bucket_of(held.withColumn("below", F.col("first") - 0.5), "below", cuts, "lo")
        spans = bucket_of(held, "last", cuts, "hi").filter("hi > lo").select("first", "last", "v").collect()
    finally:
        counted.unpersist()

    at, ordered = {}, iter(sorted(spans))
    span = next(ordered)
    for rank in needed:
        while rank > span["last"]:
            span = next(ordered)
        at[rank] = span["v"]

    def between(place: float) -> float:
        low, high, part = at[math.floor(place)], at[math.ceil(place)], place - math.floor(place)
        step = high - low
        return low + step * part if part < 0.5 else high - step * (1 - part)

    return [between(place) for place in places]
