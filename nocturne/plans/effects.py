"""Fixed effects from cell sums, trends, a GLM, and cluster-bootstrap draws.

These give the fixed part of the binomial and Gaussian models without random
effects or priors: they are not posterior estimates.  Uncertainty comes from
resampling individuals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.plans.comparisons import level_pairs
from nocturne.session import stage


def log_odds(k: Column, n: Column, pad: float = 0.0) -> Column:
    """``ln((k + pad) / (n - k + pad))``; null where that is undefined."""
    odds = F.try_divide(k + pad, n - k + pad)
    return F.ln(F.when(odds > 0, odds))


def cell_log_odds(
    counts: DataFrame, hits: str, trials: str, by: Sequence[str], pad: float = 0.0
) -> DataFrame:
    """Log-odds and its large-sample error per cell."""
    cells = counts.groupBy(*by).agg(F.sum(hits).alias("k"), F.sum(trials).alias("n"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    variance = F.try_divide(F.lit(1.0), k + pad) + F.try_divide(F.lit(1.0), n - k + pad)
    return cells.withColumns({
        "log_odds": log_odds(k, n, pad),
        "se": F.sqrt(F.when(variance > 0, variance)),
    })


def of_levels(column: str, levels: Sequence) -> Column:
    """The column; a value that is neither null nor one of the levels is an error."""
    known = F.col(column).isin(*levels) | F.col(column).isNull()
    wrong = F.concat(F.lit(f"{column} has a level beside {list(levels)}: "), F.col(column).cast("string"))
    return F.when(known, F.col(column)).otherwise(F.raise_error(wrong))


def treatment_terms(
    cells: DataFrame, value: str, first: tuple[str, Sequence], second: tuple[str, Sequence],
    within: Sequence[str] = (),
) -> DataFrame:
    """Treatment-coded terms of a saturated 2 × 2 table, in long form.

    ``first`` and ``second`` name a column with its base level and other level;
    a row at any other level fails at run time.
    """
    (a, (a0, a1)), (b, (b0, b1)) = first, second
    cells = cells.withColumns({a: of_levels(a, (a0, a1)), b: of_levels(b, (b0, b1))})

    def cell(x, y) -> Column:
        return F.max(F.when((F.col(a) == x) & (F.col(b) == y), F.col(value)))

    wide = cells.groupBy(*within).agg(
        cell(a0, b0).alias("_00"), cell(a1, b0).alias("_10"),
        cell(a0, b1).alias("_01"), cell(a1, b1).alias("_11"),
    )
    c00, c10, c01, c11 = (F.col(c) for c in ("_00", "_10", "_01", "_11"))
    terms = {
        "(Intercept)": c00,
        f"{a}{a1}": c10 - c00,
        f"{b}{b1}": c01 - c00,
        f"{a}{a1}:{b}{b1}": (c11 - c01) - (c10 - c00),
    }
    rows = F.array(*[
        F.struct(F.lit(name).alias("term"), v.alias("value")) for name, v in terms.items()
    ])
    return wide.select(*within, F.inline(rows))


def cell_trends(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """One least-squares line per cell: a fully crossed model has no other."""
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )


def pairwise(cells: DataFrame, value: str, over: str, within: Sequence[str]) -> DataFrame:
    """Differences between the levels of ``over``, within the other cells."""
    pairs = level_pairs(cells.select(*within, over, value), over, within)
    return pairs.select(
        *within, F.col(f"{over}1").alias("level1"), F.col(f"{over}2").alias("level2"),
        (F.col(f"{value}1") - F.col(f"{value}2")).alias("estimate"),
    )


def marginal_means(cells: DataFrame, value: str, over: str) -> DataFrame:
    """Unweighted mean of the cells at each level."""
    return cells.groupBy(over).agg(F.avg(value).alias("mean"))


def binomial_glm(
    counts: DataFrame, hits: str, trials: str, first: tuple[str, Sequence], second: tuple[str, Sequence],
    covariate: str | None = None,
) -> DataFrame:
    """Logistic regression of grouped counts on a 2 × 2 design and a covariate.

    ``first`` and ``second`` are (column, (base level, level coded 1)); another
    level fails at run time.  Rows with a null in the design are left out:
    ``n_used`` counts the others.  Counts are summed by design row first, so the
    fit runs over distinct rows.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    (a, (_, a1)), (b, (_, b1)) = first, second
    extra = [covariate] if covariate else []
    cells = stage(design_rows(counts, hits, trials, first, second, extra), "design")
    rows = cells.where(F.col("_n") > 0).select(
        "_a", "_b", "_ab", *extra,
        (F.col("_k") / F.col("_n")).alias("label"), F.col("_n").cast("double").alias("w"),
    )
    used = cells.agg(F.sum("_rows")).first()[0] or 0
    inputs = ["_a", "_b", "_ab", *extra]
    data = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", weightCol="w", maxIter=50, tol=1e-10
    ).fit(data)
    names = ["(Intercept)", f"{a}{a1}", f"{b}{b1}", f"{a}{a1}:{b}{b1}", *extra]
    values = [model.intercept, *model.coefficients.toArray().tolist()]
    return counts.sparkSession.createDataFrame(
        [(n, float(v), used) for n, v in zip(names, values)], "term string, estimate double, n_used long"
    )


def design_rows(
    counts: DataFrame, hits: str, trials: str, first: tuple[str, Sequence], second: tuple[str, Sequence],
    extra: Sequence[str] = (),
) -> DataFrame:
    """Counts by row of the 2 × 2 design: ``_a, _b, _ab``, the covariates, ``_k, _n``
    and the number of rows."""
    (a, (a0, a1)), (b, (b0, b1)) = first, second
    design = counts.select(
        (of_levels(a, (a0, a1)) == F.lit(a1)).cast("double").alias("_a"),
        (of_levels(b, (b0, b1)) == F.lit(b1)).cast("double").alias("_b"),
        *extra, F.col(hits).alias("_k"), F.col(trials).alias("_n"),
    ).dropna()
    cells = design.groupBy("_a", "_b", *extra).agg(
        F.sum("_k").alias("_k"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    return cells.withColumn("_ab", F.col("_a") * F.col("_b"))


def score_sums(
    counts: DataFrame, hits: str, trials: str, fit: DataFrame, first: tuple[str, Sequence],
    second: tuple[str, Sequence], covariate: str | None = None,
) -> DataFrame:
    """Derivative of the log-likelihood by each term at the fit, per trial: all
    are zero at the maximum."""
    (a, (_, a1)), (b, (_, b1)) = first, second
    extra = [covariate] if covariate else []
    columns = {"(Intercept)": F.lit(1.0), f"{a}{a1}": F.col("_a"), f"{b}{b1}": F.col("_b"),
               f"{a}{a1}:{b}{b1}": F.col("_ab"), **{c: F.col(c) for c in extra}}
    weights = {r["term"]: r["estimate"] for r in fit.collect()}  # one row per term
    rows = design_rows(counts, hits, trials, first, second, extra)
    eta = sum((F.lit(weights[n]) * c for n, c in columns.items()), F.lit(0.0))
    left = F.col("_k") - F.col("_n") / (1 + F.exp(-eta))
    sums = rows.agg(*[(F.sum(left * c) / F.sum("_n")).alias(f"_s{i}") for i, c in enumerate(columns.values())])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("term"), F.col(f"_s{i}").alias("score")) for i, n in enumerate(columns)])))


def poisson_one(u: Column) -> Column:
    """Poisson(1) by inversion of a uniform number."""
    total, branches = 0.0, F
    for count in range(11):
        total += math.exp(-1) / math.factorial(count)
        branches = branches.when(u < total, count)
    return branches.otherwise(11)


def hashed_uniform(*parts: Column | str) -> Column:
    """A uniform number fixed by its inputs: 32 bits of their MD5."""
    text = F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2**32


def bootstrap_draws(
    counts: DataFrame, hits: str, trials: str, cluster: str,
    first: tuple[str, Sequence], second: tuple[str, Sequence],
    model: str, replicates: int = 200, seed: int = 42, pad: float = 0.5,
) -> DataFrame:
    """Draws of the treatment-coded log-odds terms by resampling individuals.

    Each individual gets a Poisson(1) weight per replicate, the same in all its
    cells.  Counts are summed per individual first, and the exploded rows are
    summed into cells on the map side, so only replicates × cells move.
    """
    a, b = first[0], second[0]
    sums = counts.groupBy(cluster, a, b).agg(F.sum(hits).alias("k"), F.sum(trials).alias("n"))
    weight = poisson_one(hashed_uniform(F.lit(str(seed)), cluster, F.col("iter").cast("string")))
    drawn = (
        sums.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .withColumn("w", weight)
    )
    cells = drawn.groupBy("iter", a, b).agg(
        F.sum(F.col("k") * F.col("w")).cast("double").alias("k"),
        F.sum(F.col("n") * F.col("w")).cast("double").alias("n"),
    )
    cells = cells.withColumn("log_odds", log_odds(F.col("k"), F.col("n"), pad))
    terms = treatment_terms(cells, "log_odds", first, second, ["iter"])
    return terms.select(F.lit(model).alias("model"), "term", F.col("iter").cast("long"), "value")


def bootstrap_trend_draws(
    df: DataFrame, y: str, x: str, cluster: str,
    first: tuple[str, Sequence], second: tuple[str, Sequence],
    model: str, replicates: int = 200, seed: int = 42,
) -> DataFrame:
    """Draws of the terms of ``y ~ first * second * x`` by resampling clusters.

    A crossed model with one covariate is a line per cell, so five sums per
    cluster and cell carry everything the weighted fits need.  A term is null
    in replicates in which a cell it needs has no line.
    """
    a, b = first[0], second[0]
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    moments = {"s0": F.lit(1.0), "sx": F.col(x), "sy": F.col(y),
               "sxy": F.col(x) * F.col(y), "sxx": F.col(x) * F.col(x)}
    sums = rows.groupBy(cluster, a, b).agg(*[F.sum(v).alias(n) for n, v in moments.items()])
    weight = poisson_one(hashed_uniform(F.lit(str(seed)), cluster, F.col("iter").cast("string")))
    cells = (
        sums.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .withColumn("w", weight)
        .groupBy("iter", a, b).agg(*[F.sum(F.col(n) * F.col("w")).alias(n) for n in moments])
    )
    spread = F.col("s0") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(
        spread > 1e-9, (F.col("s0") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread
    )
    lines = cells.withColumn("slope", slope).withColumn(
        "intercept", F.try_divide(F.col("sy") - F.col("slope") * F.col("sx"), F.col("s0"))
    )
    levels = treatment_terms(lines, "intercept", first, second, ["iter"])
    trends = treatment_terms(lines, "slope", first, second, ["iter"]).withColumn(
        "term", F.when(F.col("term") == "(Intercept)", x).otherwise(F.concat("term", F.lit(f":{x}")))
    )
    terms = levels.unionByName(trends)
    return terms.select(F.lit(model).alias("model"), "term", F.col("iter").cast("long"), "value")


# Combinations of the terms of an intake model, by name
SEX_COMBINATIONS = {
    "females_phase2": {"phase2": 1, "sexf:phase2": 1},
    "night_phase2": {"night": 1, "phase2:night": 1},
    "sex_phase2": {"sexf": 1, "sexf:phase2": 1},
    "sex_night_phase2": {"sexf:phase2:night": -1, "sexf:night": -1},
    "females_night": {"night": 1, "sexf:night": 1},
    "females_night_phase2": {
        "night": 1, "sexf:night": 1, "phase2:night": 1, "sexf:phase2:night": 1,
    },
    "females_night_contrast": {"phase2:night": 1, "sexf:phase2:night": 1},
}


# The same for the model of cohort types
COHORT_TYPE_COMBINATIONS = {
    "grtypes_phase2": {"phase2": 1, "cohort_typemixed:phase2": 1},
    "night_phase2": {"night": 1, "phase2:night": 1},
    "mixed_phase2": {"cohort_typemixed": 1, "cohort_typemixed:phase2": 1},
    "grtype_night_phase2": {"cohort_typemixed:phase2:night": -1, "cohort_typemixed:night": -1},
    "mixed_nightph1": {"night": 1, "cohort_typemixed:night": 1},
    "mixed_nightph2": {
        "night": 1, "cohort_typemixed:night": 1, "phase2:night": 1, "cohort_typemixed:phase2:night": 1,
    },
    "mixed_night_contrast": {"phase2:night": 1, "cohort_typemixed:phase2:night": 1},
}
