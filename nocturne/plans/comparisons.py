"""Group comparisons: Welch and paired t-tests, Holm adjustment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.functions.columns import p_label, ratio, significance
from nocturne.functions.distributions import t_two_sided
from nocturne.operators.timeline import grouping, seal
from nocturne.session import stage


MAX_LEVELS = 1000  # paired without groups


def level_pairs(table: DataFrame, level: str, within: Sequence[str]) -> DataFrame:
    """Every two levels a < b within a group, side by side.

    ``table`` has one row per group and level; columns get the suffixes 1, 2.
    It is staged, so that it is computed once.  Without ``within`` the levels
    of the whole table are paired: at most ``MAX_LEVELS``, else it fails, as
    the pairs are their square.
    """
    keys = list(within) or ["_all"]
    base = stage(table if within else table.withColumn("_all", F.lit(0)), "levels")
    if not within and base.count() > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} levels to pair; name the groups to pair within")
    rest = [c for c in base.columns if c not in keys]
    one = base.withColumnsRenamed({c: f"{c}1" for c in rest})
    two = base.withColumnsRenamed({c: f"{c}2" for c in rest} | {k: f"_r_{k}" for k in keys})
    same = [one[k].eqNullSafe(two[f"_r_{k}"]) for k in keys]
    match = reduce(lambda a, b: a & b, same, F.col(f"{level}1") < F.col(f"{level}2"))
    return one.join(two, match).drop(*[f"_r_{k}" for k in keys], "_all")


def _safe_sqrt(c: Column) -> Column:
    return F.sqrt(F.when(c >= 0, c))


def welch(
    df: DataFrame, value: str, level: str, within: Sequence[str] = ()
) -> DataFrame:
    """Unequal-variance t-test of every pair of levels, within each group.

    The rows are reduced to count, mean and variance per level before the pairs
    are formed.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(level).isNotNull())
    moments = rows.groupBy(*within, level).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")
    )
    pairs = level_pairs(moments, level, within)
    e1, e2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    stat = ratio(F.col("mean1") - F.col("mean2"), _safe_sqrt(e1 + e2))
    free = ratio((e1 + e2) * (e1 + e2), e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    usable = (F.col("n1") > 1) & (F.col("n2") > 1)
    return pairs.select(
        *within, F.col(f"{level}1").alias("group1"), F.col(f"{level}2").alias("group2"),
        "n1", "n2", F.when(usable, stat).alias("statistic"), F.when(usable, free).alias("df"),
    )


def paired(
    df: DataFrame, value: str, level: str, unit: Sequence[str], within: Sequence[str] = ()
) -> DataFrame:
    """Paired t-test of every pair of levels; values are matched by ``unit``."""
    rows = df.where(F.col(value).isNotNull()).select(*within, *unit, level, value)
    pairs = level_pairs(rows, level, [*within, *unit])
    diff = F.col(f"{value}1") - F.col(f"{value}2")
    moments = pairs.groupBy(*within, f"{level}1", f"{level}2").agg(
        F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean"), F.stddev_samp(diff).alias("sd")
    )
    return moments.select(
        *within, F.col(f"{level}1").alias("group1"), F.col(f"{level}2").alias("group2"), "n",
        ratio("mean", F.col("sd") / F.sqrt("n")).alias("statistic"),
        F.when(F.col("n") > 1, F.col("n") - 1).cast("double").alias("df"),
    )


def with_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", t_two_sided("statistic", "df"))


def holm(
    tests: DataFrame, p: str = "p", unique: Sequence[str] = (), within: Sequence[str] = (),
    name: str = "p_adj",
) -> DataFrame:
    """Holm's step-down adjustment over the table, or within groups of it.

    Tests without a p-value are not counted and stay null.  ``unique`` makes
    the order of equal p-values definite; it does not change the result.
    """
    keyed, keys = grouping(tests, within)
    ordered = seal(keyed, keys, [F.asc_nulls_last(p), *unique], name="holm")
    counts = ordered.df.groupBy(*keys).agg(F.count(p).alias("_m"))
    placed = ordered.position("_i").attach(counts)
    step = (F.col("_m") - F.col("_i") + 1) * F.col(p)
    adjusted = placed.running(maxima={name: step}).table()
    capped = F.when(F.col(p).isNotNull(), F.least(name, F.lit(1.0)))
    return adjusted.withColumn(name, capped).drop("_m", "_i", *keys)


def marked(tests: DataFrame, p_crit: float | None = None) -> DataFrame:
    """Stars and a label; with ``p_crit`` only the tests below it."""
    table = tests.withColumns({"stars": significance("p_adj"), "label": p_label("p_adj")})
    return table.where(F.col("p_adj") < p_crit) if p_crit is not None else table
