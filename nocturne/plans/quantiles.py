"""Exact quantiles of many groups by radix selection: nothing is sorted or ranked.

A double has a key that rises with it: its binary exponent and its leading
mantissa bits, for negative numbers turned round.  A histogram over short keys
tells in which cell each wanted rank lies; only the rows of these cells are
counted again, by longer keys, and then by value.  Each count is an aggregate
with map-side combine, so a group of any size and any skew is spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.session import stage

BITS = (10, 28)  # mantissa bits of the keys of the first two counts
_ABOVE = 2**41  # key of values above all numbers


def with_radix_key(df: DataFrame, value: str, bits: int, name: str) -> DataFrame:
    """``name``: a long that never falls as the double ``value`` rises; NaN is above infinity.

    Rounding of the logarithm just below a power of two gives the last cell of
    the binade, which is where such a number belongs.  Column by column, so that
    logarithm and powers are computed once a row."""
    x, size, exponent = F.col(value), F.abs(value), F.col("_exponent")
    # in two steps, as the power of two of the smallest numbers is itself at the edge
    half = F.floor(exponent / 2)
    steps = df.withColumn("_exponent", F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size)))).withColumn(
        "_mantissa", size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), exponent - half))
    key = (exponent + 1100) * 2**bits + F.floor((F.col("_mantissa") - 1) * 2**bits)
    key = F.when(size == 0, 0).when(size == float("inf"), _ABOVE).otherwise(key).cast("long")
    signed = F.when(F.isnan(x), _ABOVE + 1).when(x < 0, -key).otherwise(key)
    return steps.withColumn(name, signed).drop("_exponent", "_mantissa")


def wanted_ranks(n: Column, at: Mapping[str, float]) -> list[Column]:
    """Structs (name, end, rank from 0) of the values on both sides of each quantile."""
    ends = []
    for name, p in at.items():
        spot = (n - 1) * p
        ends += [F.struct(F.lit(name).alias("q"), F.lit(end).alias("end"), side.cast("long").alias("rank"))
                 for end, side in (("a", F.floor(spot)), ("b", F.ceil(spot)))]
    return ends


def cells_of_ranks(counts: DataFrame, wanted: DataFrame, keys: Sequence[str], by: Sequence[str], cell: str) -> DataFrame:
    """keys, n, q, end, rank, cell: the cell of each rank, which now counts within it.

    ``counts`` has the rows ``c`` per cell of the groups ``by``; staged."""
    order = W.partitionBy(*by).orderBy(cell)
    bounds = counts.withColumn("_below", F.sum("c").over(order.rowsBetween(W.unboundedPreceding, -1)))
    bounds = bounds.withColumn("_below", F.coalesce("_below", F.lit(0).cast("long")))
    held = bounds.join(wanted, list(by)).where(
        (F.col("rank") >= F.col("_below")) & (F.col("rank") < F.col("_below") + F.col("c")))
    return stage(held.select(*keys, "n", "q", "end", (F.col("rank") - F.col("_below")).alias("rank"), cell), "cells")


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Mapping[str, float]) -> DataFrame:
    """``n`` and the linearly interpolated quantiles of each group.

    ``keys`` are never null; rows without a value are left out."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    coarse = with_radix_key(rows, "_v", BITS[0], "_k0").groupBy(*keys, "_k0").agg(F.count(F.lit(1)).alias("c"))
    sizes = coarse.groupBy(*keys).agg(F.sum("c").alias("n"))  # the plan counts once for both
    wanted = sizes.select(*keys, "n", F.inline(F.array(*wanted_ranks(F.col("n"), at))))
    first = cells_of_ranks(coarse, wanted, keys, keys, "_k0")

    near = with_radix_key(rows, "_v", BITS[0], "_k0").join(first, [*keys, "_k0"], "left_semi")
    fine = with_radix_key(near, "_v", BITS[1], "_k1").groupBy(*keys, "_k0", "_k1").agg(F.count(F.lit(1)).alias("c"))
    second = cells_of_ranks(fine, first, [*keys, "_k0"], [*keys, "_k0"], "_k1")

    near = with_radix_key(rows, "_v", BITS[1], "_k1").join(second, [*keys, "_k1"], "left_semi")
    values = near.groupBy(*keys, "_k1", "_v").agg(F.count(F.lit(1)).alias("c"))
    found = cells_of_ranks(values, second, keys, [*keys, "_k1"], "_v")

    ends = found.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.max(F.when((F.col("q") == q) & (F.col("end") == e), F.col("_v"))).alias(f"_{q}_{e}") for q in at for e in "ab"])

    def between(q: str, p: float) -> Column:
        spot = (F.col("n") - 1) * p
        return F.col(f"_{q}_a") + (F.col(f"_{q}_b") - F.col(f"_{q}_a")) * (spot - F.floor(spot))

    missed = reduce(lambda a, b: a | b, [F.col(f"_{q}_{e}").isNull() for q in at for e in "ab"])
    checked = F.when(missed, F.raise_error(F.lit("a rank was not found"))).otherwise(F.col("n"))
    return ends.select(*keys, checked.alias("n"), *[between(q, p).alias(q) for q, p in at.items()])
