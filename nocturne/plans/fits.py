"""Least squares and logistic fits with their covariance.

A fit is (term, estimate) and (term1, term2, value).  The rows are reduced to
sums of products of fixed size, or to one row per cluster; only the sums of
fixed size reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.plans.effects import binomial_glm, of_levels
from nocturne.session import stage


@dataclass(frozen=True)
class Fit:
    """``terms`` (term, estimate) and ``covariance`` (term1, term2, value); ``df``
    is infinite where intervals go by the normal distribution."""

    terms: DataFrame
    covariance: DataFrame
    df: float
    n_used: int
    names: tuple[str, ...] = ()
    clusters: int | None = None


def fit_tables(
    spark: SparkSession, names: Sequence[str], beta: np.ndarray, cov: np.ndarray, df: float, n: int,
    clusters: int | None = None,
) -> Fit:
    terms = spark.createDataFrame([(t, float(b)) for t, b in zip(names, beta)], "term string, estimate double")
    pairs = [(a, b, float(cov[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    table = spark.createDataFrame(pairs, "term1 string, term2 string, value double")
    return Fit(terms, table, df, n, tuple(names), clusters)


def product_sums(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The matrix of summed products of all pairs of columns: one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = df.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{k}") for k, (i, j) in enumerate(pairs)])
    out = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, sums.first()):
        out[i, j] = out[j, i] = v or 0.0
    return out


def inverted(matrix: np.ndarray) -> np.ndarray:
    if np.linalg.matrix_rank(matrix) < len(matrix):
        raise ValueError("the terms are not all estimable")
    return np.linalg.inv(matrix)


def linear_model(df: DataFrame, y: str, fixed: Mapping[str, Column]) -> Fit:
    """Ordinary least squares; rows with a null in ``y`` or a term are left out."""
    columns = [f"_x{i}" for i in range(len(fixed))]
    rows = df.select(*[c.cast("double").alias(n) for n, c in zip(columns, fixed.values())],
                     F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_one")).dropna()
    sums, p = product_sums(rows, [*columns, "_y", "_one"]), len(fixed)
    n = round(sums[-1, -1])
    if n <= p:
        raise ValueError(f"{n} usable rows for {p} terms")
    inverse = inverted(sums[:p, :p])
    beta = inverse @ sums[:p, p]
    left = sums[p, p] - beta @ sums[:p, p]
    return fit_tables(df.sparkSession, list(fixed), beta, inverse * left / (n - p), float(n - p), n)


def binomial_columns(
    counts: DataFrame, hits: str, trials: str, first: tuple[str, Sequence], second: tuple[str, Sequence],
    covariate: str | None, cluster: str,
) -> tuple[dict[str, str], DataFrame]:
    """Term names by design column, and the rows of the design with their cluster.

    A null cluster is a cluster of its own kind, like any other value."""
    (a, (a0, a1)), (b, (b0, b1)) = first, second
    is_a = (of_levels(a, (a0, a1)) == F.lit(a1)).cast("double")
    is_b = (of_levels(b, (b0, b1)) == F.lit(b1)).cast("double")
    columns = {"_x0": "(Intercept)", "_x1": f"{a}{a1}", "_x2": f"{b}{b1}", "_x3": f"{a}{a1}:{b}{b1}"}
    values = [F.lit(1.0), is_a, is_b, is_a * is_b]
    if covariate:
        columns["_x4"] = covariate
        values.append(F.col(covariate).cast("double"))
    design = counts.select(F.col(cluster).alias("_cluster"), *[v.alias(c) for c, v in zip(columns, values)],
                           F.col(hits).cast("double").alias("_k"), F.col(trials).cast("double").alias("_n"))
    return columns, design.dropna(subset=[*columns, "_k", "_n"])


def clustered_glm(
    counts: DataFrame, hits: str, trials: str, first: tuple[str, Sequence], second: tuple[str, Sequence],
    cluster: str, covariate: str | None = None,
) -> Fit:
    """The logistic fit of `binomial_glm` with a covariance that lets the rows of a
    cluster depend on each other in any way.

    With p the fitted share, A = sum n p (1 - p) x x' and s_c the sum over the
    cluster of (k - n p) x, it is A^-1 (sum s_c s_c') A^-1 times m / (m - 1) for m
    clusters.  Rows are summed into one row per cluster on the map side; then two
    matrices of fixed size are summed.  One cluster alone has no covariance: null."""
    spark = counts.sparkSession
    estimates = {r["term"]: r["estimate"] for r in binomial_glm(
        counts, hits, trials, first, second, covariate).collect()}  # one row per term
    columns, design = binomial_columns(counts, hits, trials, first, second, covariate, cluster)
    names = list(columns)
    eta = sum((F.lit(float(estimates[t])) * F.col(c) for c, t in columns.items()), F.lit(0.0))
    share = 1 / (1 + F.exp(-eta))
    rows = design.withColumns({"_p": share}).withColumns({
        "_left": F.col("_k") - F.col("_n") * F.col("_p"), "_w": F.col("_n") * F.col("_p") * (1 - F.col("_p"))})
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    weighted = [F.sum(F.col("_w") * F.col(names[i]) * F.col(names[j])).alias(f"a{i}_{j}") for i, j in pairs]
    per_cluster = stage(rows.groupBy("_cluster").agg(
        F.count(F.lit(1)).alias("rows"), *weighted,
        *[F.sum(F.col("_left") * F.col(c)).alias(f"s{i}") for i, c in enumerate(names)]), "cluster-scores")
    totals = per_cluster.agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("clusters"),
        *[F.sum(f"a{i}_{j}").alias(f"a{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    bread, meat = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
    for i, j in pairs:
        bread[i, j] = bread[j, i] = totals[f"a{i}_{j}"] or 0.0
        meat[i, j] = meat[j, i] = totals[f"m{i}_{j}"] or 0.0
    m = totals["clusters"]
    inverse = inverted(bread)
    cov = inverse @ meat @ inverse * (m / (m - 1) if m > 1 else math.nan)
    beta = np.array([estimates[columns[c]] for c in names])
    return fit_tables(spark, list(columns.values()), beta, cov, math.inf, totals["rows"] or 0, m)
