"""Gaussian mixed models: group-level intercepts and slopes by restricted maximum likelihood.

    y = X b + Z u_group + e,   u ~ N(0, G),   e ~ N(0, s2)

A group enters through its sums of products alone, so the rows are aggregated
once, by group, with map-side combine; a group that holds a third of the rows
is no heavier than another.  Each step of the fit is one pass over these group
rows, which adds up matrices of fixed size for a few trial values of G at once.
Only those sums reach the driver.

The steps are Newton's, over the Cholesky factor of G / s2, with exact
gradients.  Where a gradient vanishes, an expectation-maximisation step would
stand still too; Newton's steps need a tenth of its passes, and the factor keeps
G a covariance, down to a variance of zero.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.plans.effects import of_levels
from nocturne.plans.fits import Fit, fit_tables
from nocturne.session import stage

MAX_STEPS = 60
STEPS = (1.0, 0.5, 0.2, 0.05, 0.01)  # shares of Newton's step tried in one pass
NUDGE = 1e-5  # for differences of the gradient


@dataclass(frozen=True)
class MixedFit:
    """The fixed effects (intervals go by the normal distribution) and the variance
    components (component, value); ``effects`` (group, term, estimate, se) are the
    predicted random terms of each group, shrunk towards zero, with the error of the
    prediction; ``passes`` is the number of passes over the groups."""

    fixed: Fit
    components: DataFrame
    effects: DataFrame
    n_groups: int
    passes: int
    beta: np.ndarray
    between: np.ndarray  # G
    within: float  # s2


def group_products(df: DataFrame, columns: Sequence[Column], group: str) -> DataFrame:
    """g, n and the products of all pairs of columns, summed by group; rows in which
    the group or a column is null are left out.  One row per group, staged."""
    named = [c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.select(F.col(group).alias("g"), *named).dropna()
    pairs = [(i, j) for i in range(len(named)) for j in range(i, len(named))]
    sums = rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    return stage(sums.select(F.col("g").cast("string").alias("g"), "n", F.array(*[f"s{i}_{j}" for i, j in pairs]).alias("sums")), "group-products")


class Criterion:
    """-2 log restricted likelihood and its gradient, for several G / s2 in one pass.

    p fixed and q random columns; the last of the p + q + 1 columns is y."""

    def __init__(self, groups: DataFrame, p: int, q: int):
        self.groups, self.p, self.q, self.passes = groups, p, q, 0
        total = groups.agg(F.sum("n"), F.count(F.lit(1))).first()
        self.n, self.m = total[0] or 0, total[1]
        if self.n <= p:
            raise ValueError(f"{self.n} usable rows for {p} fixed effects")
        size = p + q + 1
        upper = np.triu_indices(size)
        squares = [int(np.flatnonzero((upper[0] == p + j) & (upper[1] == p + j))[0]) for j in range(q)]
        sums = groups.agg(*[F.sum(F.get("sums", F.lit(i))) for i in squares]).first()
        self.scale = np.sqrt(np.array(sums, float) / self.n)  # of the random columns
        if not (self.scale > 0).all():
            raise ValueError("a random column is zero throughout")

    def sums(self, trials: Sequence[np.ndarray]) -> list[tuple]:
        """(S, log determinants, H, products of A Z'[X y]) per trial, summed over groups."""
        p, q, scale = self.p, self.q, self.scale
        size, wide = p + q + 1, q * (p + 1)
        upper = np.triu_indices(size)
        self.passes += 1

        def add(batches):
            held = [np.zeros((p + 1) ** 2 + 1 + q * q + wide * wide) for _ in trials]
            for batch in batches:
                flat = batch["sums"].flatten().to_numpy().reshape(batch.num_rows, -1)
                full = np.zeros((len(flat), size, size))
                full[:, upper[0], upper[1]] = flat
                full[:, upper[1], upper[0]] = flat
                keep = [*range(p), size - 1]
                own = full[:, keep][:, :, keep]
                cross = full[:, p : p + q][:, :, keep] / scale[:, None]
                w = full[:, p : p + q, p : p + q] / np.outer(scale, scale)
                for trial, total in zip(trials, held):
                    spread = np.eye(q) + w @ trial
                    a = np.linalg.inv(spread)
                    lifted = a @ cross
                    k = trial @ a
                    s = own - np.swapaxes(cross, 1, 2) @ k @ cross
                    v = lifted.reshape(len(lifted), -1)
                    total += np.concatenate([
                        s.sum(0).ravel(), [np.linalg.slogdet(spread)[1].sum()], (a @ w).sum(0).ravel(), (v.T @ v).ravel()])
            for t, total in enumerate(held):
                yield pa.RecordBatch.from_pydict({
                    "t": pa.array(np.full(len(total), t), pa.int32()),
                    "i": pa.array(np.arange(len(total)), pa.int32()), "value": total})

        rows = self.groups.mapInArrow(add, "t int, i int, value double").groupBy("t", "i").agg(F.sum("value").alias("v"))
        out = np.zeros((len(trials), (p + 1) ** 2 + 1 + q * q + wide * wide))
        for r in rows.collect():  # trials times a fixed number of sums
            out[r["t"], r["i"]] = r["v"]
        cut = np.cumsum([(p + 1) ** 2, 1, q * q])
        return [(s.reshape(p + 1, p + 1), float(d[0]), h.reshape(q, q), v.reshape(q, p + 1, q, p + 1))
                for s, d, h, v in (np.split(o, cut) for o in out)]

    def solved(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Fixed effects, inverse of X'V^-1 X, and what they leave of y."""
        p = self.p
        if np.linalg.matrix_rank(s[:p, :p]) < p:
            raise ValueError("the fixed effects are not all estimable")
        inverse = np.linalg.inv(s[:p, :p])
        beta = inverse @ s[:p, p]
        return beta, inverse, max(float(s[p, p] - beta @ s[:p, p]), 1e-300)

    def at(self, factors: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """Value and gradient by the lower triangle, for Cholesky factors."""
        out, low = [], np.tril_indices(self.q)
        for factor, (s, logdet, h, v) in zip(factors, self.sums([f @ f.T for f in factors])):
            beta, inverse, rss = self.solved(s)
            left = self.n - self.p
            value = left * np.log(rss) + logdet + np.linalg.slogdet(s[: self.p, : self.p])[1]
            seen = h - np.einsum("iajb,ab->ij", v[:, : self.p, :, : self.p], inverse)
            c = np.append(-beta, 1.0)
            slope = seen - np.einsum("iajb,a,b->ij", v, c, c) * left / rss
            out.append((value, ((slope + slope.T) @ factor)[low]))
        return out


def group_effects(
    criterion: Criterion, root: np.ndarray, beta: np.ndarray, inverse: np.ndarray, within: float, names: Sequence[str],
) -> DataFrame:
    """Predicted random terms of every group, from its own sums alone."""
    p, q, scale, trial = criterion.p, criterion.q, criterion.scale, root @ root.T
    upper = np.triu_indices(p + q + 1)

    def predict(batches):
        for batch in batches:
            n = batch.num_rows
            flat = batch["sums"].flatten().to_numpy().reshape(n, -1)
            full = np.zeros((n, p + q + 1, p + q + 1))
            full[:, upper[0], upper[1]] = full[:, upper[1], upper[0]] = flat
            zx, zy = full[:, p : p + q, :p] / scale[:, None], full[:, p : p + q, -1] / scale
            w = full[:, p : p + q, p : p + q] / np.outer(scale, scale)
            a = np.linalg.inv(np.eye(q) + w @ trial)
            left = (a @ (zy - zx @ beta)[:, :, None])[:, :, 0]
            seen = a @ w - a @ zx @ inverse @ np.swapaxes(zx, 1, 2) @ np.swapaxes(a, 1, 2)
            error = within * np.diagonal(trial - trial @ seen @ trial, axis1=1, axis2=2)
            group = [g for g in batch["g"].to_pylist() for _ in range(q)]
            yield pa.RecordBatch.from_pydict({
                "group": pa.array(group, pa.string()), "term": pa.array([*names] * n, pa.string()),
                "estimate": (left @ trial / scale).ravel(), "se": (np.sqrt(np.maximum(error, 0)) / scale).ravel()})

    return criterion.groups.mapInArrow(predict, "group string, term string, estimate double, se double")


def restricted_fit(criterion: Criterion) -> np.ndarray:
    """The Cholesky factor of G / s2 (of scaled random columns) at the maximum."""
    q = criterion.q
    low = np.tril_indices(q)

    def factor(theta: np.ndarray) -> np.ndarray:
        out = np.zeros((q, q))
        out[low] = theta
        return out

    theta = (np.eye(q) / 2)[low]
    for _ in range(MAX_STEPS):
        near = [theta, *(theta + NUDGE * e for e in np.eye(len(theta)))]
        (value, slope), *others = criterion.at([factor(t) for t in near])
        bend = np.array([(g - slope) / NUDGE for _, g in others])
        power, axes = np.linalg.eigh((bend + bend.T) / 2)
        step = -axes @ ((axes.T @ slope) / np.maximum(np.abs(power), 1e-6))
        if np.abs(step).max() < 1e-9 * (1 + np.abs(theta).max()):
            return factor(theta)
        tried = [theta + share * step for share in STEPS]
        found = criterion.at([factor(t) for t in tried])
        best, trial = min((v, i) for i, (v, _) in enumerate(found))
        if best < value - 1e-9 * abs(value):
            theta = tried[trial]
        elif np.abs(found[0][1]).max() < np.abs(slope).max():  # too flat for values to tell: go by the gradient
            theta = tried[0]
        else:
            return factor(theta)
    raise ValueError(f"no maximum within {MAX_STEPS} steps")


def mixed_model(
    df: DataFrame, y: str, fixed: Mapping[str, Column], random: Mapping[str, Column], group: str,
) -> MixedFit:
    """Fit ``y`` by the fixed terms with an unstructured covariance of the random
    terms between groups.

    Rows with a null in ``y``, a term or the group are left out (``n_used`` counts
    the others); fixed effects that the rows do not determine raise."""
    names, q = list(fixed), len(random)
    groups = group_products(df, [*fixed.values(), *random.values(), F.col(y)], group)
    criterion = Criterion(groups, len(names), q)
    root = restricted_fit(criterion)
    (s, *_), = criterion.sums([root @ root.T])
    beta, inverse, rss = criterion.solved(s)
    within = rss / (criterion.n - criterion.p)
    between = within * (root @ root.T) / np.outer(criterion.scale, criterion.scale)
    spark = df.sparkSession
    cov = within * inverse
    parts = [(f"var({a})" if i == j else f"cov({a}, {b})", float(between[i, j]))
             for i, a in enumerate(random) for j, b in enumerate(random) if j >= i]
    return MixedFit(
        fixed=fit_tables(spark, names, beta, cov, math.inf, criterion.n),
        components=spark.createDataFrame([*parts, ("residual", float(within))], "component string, value double"),
        effects=group_effects(criterion, root, beta, inverse, within, list(random)),
        n_groups=criterion.m, passes=criterion.passes, beta=beta, between=between, within=float(within))


def crossed_names(first: tuple[str, Sequence], second: tuple[str, Sequence], covariate: str) -> list[str]:
    (a, (_, a1)), (b, (_, b1)) = first, second
    na, nb, x = f"{a}{a1}", f"{b}{b1}", covariate
    return ["(Intercept)", na, nb, x, f"{na}:{nb}", f"{na}:{x}", f"{nb}:{x}", f"{na}:{nb}:{x}"]


def crossed_terms(first: tuple[str, Sequence], second: tuple[str, Sequence], covariate: str) -> dict[str, Column]:
    """Treatment-coded terms of ``first * second * covariate``."""
    (a, (a0, a1)), (b, (b0, b1)) = first, second
    is_a = (of_levels(a, (a0, a1)) == F.lit(a1)).cast("double")
    is_b = (of_levels(b, (b0, b1)) == F.lit(b1)).cast("double")
    x = F.col(covariate).cast("double")
    columns = [F.lit(1.0), is_a, is_b, x, is_a * is_b, is_a * x, is_b * x, is_a * is_b * x]
    return dict(zip(crossed_names(first, second, covariate), columns))


def intake_model(dispersion: DataFrame, first: tuple[str, Sequence], second: tuple[str, Sequence]) -> MixedFit:
    """Spread of intake by both factors and the night, with an intercept and a
    slope over nights for each cohort."""
    terms = crossed_terms(first, second, "night")
    random = {"(Intercept)": F.lit(1.0), "night": F.col("night")}
    return mixed_model(dispersion, "sd_consumed", terms, random, "cohort")


def fixed_scores(df: DataFrame, y: str, fixed: Mapping[str, Column], group: str, slope: str, fit: MixedFit) -> DataFrame:
    """(term, score, n_used): X'V^-1 (y - X b) at the fit, from the rows, relative
    to the spread of y: zero for generalised least squares with the fit's variances.

    Random intercept and slope over ``slope``; the two by two inverse is written out."""
    (g00, g01), (_, g11) = fit.between
    beta = dict(zip(fit.fixed.names, fit.beta))
    names = {f"_x{i}": c.cast("double") for i, c in enumerate(fixed.values())}
    rows = df.select(F.col(group).alias("g"), F.col(slope).cast("double").alias("z"),
                     F.col(y).cast("double").alias("y"), *[c.alias(n) for n, c in names.items()]).dropna()
    guess = reduce(lambda a, b: a + b, [F.lit(float(beta[t])) * F.col(n) for t, n in zip(fixed, names)])
    rows = rows.withColumn("r", F.col("y") - guess)
    sums = rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.sum("z").alias("w1"), F.sum(F.col("z") * F.col("z")).alias("w2"),
        F.sum("r").alias("r0"), F.sum(F.col("z") * F.col("r")).alias("r1"), F.sum(F.abs("r")).alias("size"),
        *[F.sum(F.col(n) * F.col("r")).alias(f"{n}r") for n in names],
        *[F.sum(n).alias(f"{n}0") for n in names], *[F.sum(F.col(n) * F.col("z")).alias(f"{n}1") for n in names])
    # u = G (I + W G / s2)^-1 Z'r / s2, written out for two columns
    s2 = fit.within
    a, b = 1 + (F.col("n") * g00 + F.col("w1") * g01) / s2, (F.col("n") * g01 + F.col("w1") * g11) / s2
    c, d = (F.col("w1") * g00 + F.col("w2") * g01) / s2, 1 + (F.col("w1") * g01 + F.col("w2") * g11) / s2
    det = a * d - b * c
    v0, v1 = (d * F.col("r0") - b * F.col("r1")) / det, (a * F.col("r1") - c * F.col("r0")) / det
    u0, u1 = (v0 * g00 + v1 * g01) / s2, (v0 * g01 + v1 * g11) / s2
    parts = sums.withColumns({"u0": u0, "u1": u1})
    scores = parts.agg(F.sum("n").alias("n_used"), F.sum("size").alias("size"), *[
        F.sum(F.col(f"{n}r") - F.col(f"{n}0") * F.col("u0") - F.col(f"{n}1") * F.col("u1")).alias(n) for n in names])
    return scores.select("n_used", F.inline(F.array(*[
        F.struct(F.lit(t).alias("term"), (F.col(n) / F.col("size")).alias("score")) for t, n in zip(fixed, names)])))
