"""Linear contrasts of a fit's terms: estimates, errors, intervals, adjusted p.

A contrast is a set of rows (keys…, term, coef).  With the terms b and their
covariance V, its estimate is L b and its variance L V L'; both are joins on the
term and sums by key, however many contrasts there are.  Reference grids,
marginal means, differences of pairs and slopes over a covariate all are such
rows, made from each other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.functions.columns import ratio
from nocturne.functions.distributions import normal_two_sided, range_tail, t_quantile, t_two_sided
from nocturne.plans.fits import Fit


def coefficient(term: str, first: tuple[str, Sequence], second: tuple[str, Sequence], covariate: str | None,
                level: tuple, x: float) -> float:
    """Value of a treatment-coded term's column at a point of the design."""
    (a, (_, a1)), (b, (_, b1)) = first, second
    value = 1.0
    for part in term.split(":"):
        if part == f"{a}{a1}":
            value *= level[0] == a1
        elif part == f"{b}{b1}":
            value *= level[1] == b1
        elif part == covariate:
            value *= x
        elif part != "(Intercept)":
            raise ValueError(f"unknown part of a term: {part}")
    return float(value)


def grid_weights(
    spark: SparkSession, names: Sequence[str], first: tuple[str, Sequence], second: tuple[str, Sequence],
    covariate: str | None = None, at: Sequence[float] = (0.0,),
) -> DataFrame:
    """Rows (first, second, covariate, term, coef) of the means at all levels and at
    the given values of the covariate."""
    (a, levels_a), (b, levels_b) = first, second
    rows = [(la, lb, float(x), t, coefficient(t, first, second, covariate, (la, lb), float(x)))
            for la in levels_a for lb in levels_b for x in at for t in names]
    types = ["string" if isinstance(levels[0], str) else "int" for levels in (levels_a, levels_b)]
    schema = f"`{a}` {types[0]}, `{b}` {types[1]}, `{covariate or 'x'}` double, term string, coef double"
    table = spark.createDataFrame(rows, schema)
    return table if covariate else table.drop("x")


def trend_weights(
    spark: SparkSession, names: Sequence[str], first: tuple[str, Sequence], second: tuple[str, Sequence], covariate: str,
) -> DataFrame:
    """Rows (first, second, term, coef) of the slopes over the covariate."""
    both = grid_weights(spark, names, first, second, covariate, (0.0, 1.0))
    change = F.sum(F.when(F.col(covariate) == 1, F.col("coef")).otherwise(-F.col("coef")))
    return both.groupBy(first[0], second[0], "term").agg(change.alias("coef"))


def averaged(weights: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Equal-weight means over the keys that are not kept."""
    return weights.groupBy(*keep, "term").agg(F.avg("coef").alias("coef"))


def pair_weights(weights: DataFrame, over: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Rows (within…, level1, level2, family, term, coef) of the differences between
    any two levels of ``over``; ``family`` is their number within the group."""
    level = F.concat_ws(" ", *[F.col(c).cast("string") for c in over])
    rows = weights.select(*within, level.alias("level"), "term", "coef")
    sizes = rows.groupBy(*within).agg(F.countDistinct("level").cast("int").alias("family"))
    one = rows.withColumnsRenamed({"level": "level1", "coef": "_c1"})
    two = rows.withColumnsRenamed({"level": "level2", "coef": "_c2"})
    pairs = one.join(two, [*within, "term"]).where("level1 < level2")
    pairs = pairs.join(sizes, list(within)) if within else pairs.withColumn("family", sizes.scalar())
    return pairs.select(*within, "level1", "level2", "family", "term", (F.col("_c1") - F.col("_c2")).alias("coef"))


def contrast(fit: Fit, weights: DataFrame, level: float = 0.95) -> DataFrame:
    """keys…, estimate, se, low, high, statistic, p of each contrast of ``weights``.

    A term that the fit does not have fails at run time.  Where the variance is
    zero or missing, statistic and p are null."""
    keys = [c for c in weights.columns if c not in ("term", "coef")]
    if not keys:
        raise ValueError("the contrasts have no column that names them")
    used = weights.where("coef <> 0")
    known = F.when(F.col("estimate").isNull(), F.raise_error(
        F.concat(F.lit("no such term in the fit: "), F.col("term")))).otherwise(F.col("estimate"))
    values = used.join(fit.terms, "term", "left").groupBy(*keys).agg(
        F.sum(F.col("coef") * known).alias("estimate"))
    left = used.withColumnsRenamed({"term": "term1", "coef": "_c1"})
    right = used.withColumnsRenamed({"term": "term2", "coef": "_c2"})
    spread = left.join(fit.covariance, "term1").join(right, [*keys, "term2"]).groupBy(*keys).agg(
        F.sum(F.col("_c1") * F.col("_c2") * F.col("value")).alias("_var"))
    # every contrast keeps a row, also one without any weight
    table = weights.select(*keys).distinct().join(values, keys, "left").join(spread, keys, "left")
    se = F.sqrt(F.when(F.col("_var") >= 0, F.col("_var")))
    reach = t_quantile(0.5 + level / 2, fit.df)
    table = table.withColumns({"estimate": F.coalesce("estimate", F.lit(0.0)), "se": se}).drop("_var")
    table = table.withColumns({
        "low": F.col("estimate") - reach * F.col("se"), "high": F.col("estimate") + reach * F.col("se"),
        "statistic": ratio("estimate", "se")})
    p = normal_two_sided("statistic") if math.isinf(fit.df) else t_two_sided("statistic", F.lit(fit.df))
    return table.withColumn("p", p)


def range_adjusted(table: DataFrame, fit: Fit) -> DataFrame:
    """``p_adj``: p of the largest of all differences in the family, by the studentized range."""
    df = F.lit(None if math.isinf(fit.df) else fit.df).cast("double")
    return table.withColumn("p_adj", range_tail(F.abs("statistic") * math.sqrt(2), "family", df))


def term_table(fit: Fit, level: float = 0.95) -> DataFrame:
    """Every term as a contrast of its own."""
    return contrast(fit, fit.terms.select(F.col("term").alias("name"), "term", F.lit(1.0).alias("coef")), level) \
        .withColumnRenamed("name", "term")
