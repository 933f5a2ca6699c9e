"""Intervals from leaving each cluster out, without replicates.

A term is a function of cell sums, so its value without a cluster comes from the
totals minus that cluster's own sums: one row per cluster, no refit.  Clusters
are nested in strata (individuals in cohorts), within which they are exchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.functions.columns import ratio
from nocturne.functions.distributions import normal_quantile
from nocturne.plans.effects import log_odds, of_levels
from nocturne.session import stage


def cell_sums(
    counts: DataFrame, hits: str, trials: str, first: tuple[str, Sequence], second: tuple[str, Sequence],
    keys: Sequence[str],
) -> DataFrame:
    """One row per key with the hits and trials of each of the four cells."""
    (a, levels_a), (b, levels_b) = first, second
    rows = counts.withColumns({a: of_levels(a, levels_a), b: of_levels(b, levels_b)})
    sums = {}
    for i, x in enumerate(levels_a):
        for j, y in enumerate(levels_b):
            here = (F.col(a) == F.lit(x)) & (F.col(b) == F.lit(y))
            sums[f"k{i}{j}"], sums[f"n{i}{j}"] = (
                F.coalesce(F.sum(F.when(here, F.col(c))), F.lit(0)).cast("double") for c in (hits, trials))
    return rows.groupBy(*keys).agg(*[v.alias(n) for n, v in sums.items()])


def term_values(first: tuple[str, Sequence], second: tuple[str, Sequence], pad: float, less: str = "") -> Column:
    """Array of (term, value) from the cell totals ``_k00`` …, less the row's own sums."""
    (a, (_, a1)), (b, (_, b1)) = first, second

    def odds(cell: str) -> Column:
        k, n = (F.col(f"_{c}{cell}") - (F.col(f"{c}{cell}") if less else 0.0) for c in "kn")
        return log_odds(k, n, pad)

    base, na, nb = odds("00"), f"{a}{a1}", f"{b}{b1}"
    values = {"(Intercept)": base, na: odds("10") - base, nb: odds("01") - base,
              f"{na}:{nb}": (odds("11") - odds("01")) - (odds("10") - base)}
    return F.array(*[F.struct(F.lit(t).alias("term"), v.alias("value")) for t, v in values.items()])


def accelerated_intervals(
    counts: DataFrame, hits: str, trials: str, cluster: str, stratum: str,
    first: tuple[str, Sequence], second: tuple[str, Sequence], level: float = 0.95, pad: float = 0.5,
) -> DataFrame:
    """term, estimate, se, bias, acceleration, low, high, clusters.

    With d the mean of a stratum's leave-one-out values minus one of them, and m
    its clusters: the variance is sum (m - 1) / m d², the bias sum (m - 1) d̄ against
    the estimate, the acceleration sum (l / m)³ / 6 / (sum (l / m)²)^1.5 of
    l = (m - 1) d.  The bounds are those of a normal distribution of the estimate
    moved by the acceleration a and by a - bias / se.  A stratum of one cluster adds
    nothing; where nothing varies, bounds are null.  A null cluster or stratum is a
    value like others."""
    own = stage(cell_sums(counts, hits, trials, first, second, [stratum, cluster]), "own-sums")
    cells = [c for c in own.columns if c not in (stratum, cluster)]
    # one row of totals: scalar subqueries
    totals = stage(own.agg(*[F.sum(c).alias(f"_{c}") for c in cells]), "cell-totals")
    whole = totals.select(F.inline(term_values(first, second, pad))).withColumnRenamed("value", "estimate")
    rows = own.withColumns({f"_{c}": totals.select(f"_{c}").scalar() for c in cells})
    left = stage(rows.select(stratum, F.inline(term_values(first, second, pad, "own"))), "left-out")
    group = left.groupBy(stratum, "term").agg(F.avg("value").alias("centre"), F.count("value").alias("m"))
    keyed = left.withColumnsRenamed({stratum: "_s"}).join(
        group, F.col("_s").eqNullSafe(F.col(stratum)) & (left["term"] == group["term"])).drop(left["term"])
    keyed = keyed.join(whole, "term")
    m, d = F.col("m"), F.col("centre") - F.col("value")
    share = (m - 1) * d / m
    parts = keyed.groupBy("term").agg(
        F.first("estimate").alias("estimate"), F.count("value").alias("clusters"),
        F.sqrt(F.sum((m - 1) / m * d * d)).alias("se"),
        F.sum((m - 1) / m * (F.col("centre") - F.col("estimate"))).alias("bias"),
        F.sum(share * share).alias("_two"), F.sum(share * share * share).alias("_three"))
    a = ratio(F.col("_three"), 6 * F.pow("_two", F.lit(1.5)))
    z = normal_quantile(0.5 + level / 2)
    table = parts.withColumn("acceleration", a).withColumn("_z0", F.col("acceleration") - ratio("bias", "se"))

    def bound(at: float) -> Column:
        w = F.col("_z0") + at
        return F.col("estimate") + F.col("se") * (F.col("_z0") + ratio(w, 1 - F.col("acceleration") * w))

    return table.select("term", "estimate", "se", "bias", "acceleration", bound(-z).alias("low"), bound(z).alias("high"), "clusters")
