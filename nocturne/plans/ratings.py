"""Glicko ratings from pairwise outcomes, one batch update per rating period."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from nocturne.operators.joins import keyed_join
from nocturne.operators.timeline import numbered
from nocturne.session import stage, unstage

# Rating, deviation, deviation cap and drift of a new player
INIT_RATING, INIT_RD, MAX_RD, DRIFT = 2200.0, 300.0, 350.0, 15.0
Q = math.log(10) / 400


def attenuation(rd: Column) -> Column:
    return 1 / F.sqrt(1 + 3 * Q**2 * rd * rd / math.pi**2)


def expected_score(rating: Column, other: Column, other_rd: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -attenuation(other_rd) * (rating - other) / 400))


def pair_results(
    games: DataFrame, group: Sequence[str], period: str, winner: str, loser: str, outcome: str
) -> DataFrame:
    """Games and points per period and ordered pair, once from each side.

    Aggregated before anything is joined: a pair that met a million times in a
    period is two rows.  Periods are numbered within each group.  A game with
    an unknown player rates nobody.
    """
    known = games.where(F.col(winner).isNotNull() & F.col(loser).isNotNull())
    pairs = known.groupBy(*group, period, winner, loser).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("double")).alias("points")
    )
    steps = pairs.select(*group, period).distinct().withColumn(
        "step", F.row_number().over(W.partitionBy(*group).orderBy(period))
    )
    pairs = keyed_join(pairs, steps, [*group, period], "inner", null_safe=True)
    sides = F.array(
        F.struct(F.col(winner).alias("player"), F.col(loser).alias("opponent"), F.col("points")),
        F.struct(F.col(loser).alias("player"), F.col(winner).alias("opponent"),
                 (F.col("n") - F.col("points")).alias("points")),
    )
    return pairs.select(*group, "step", "n", F.explode(sides).alias("side")).select(
        *group, "step", "n", "side.*"
    )


def glicko(
    games: DataFrame,
    group: Sequence[str] = ("cohort",),
    period: str = "group_night",
    winner: str = "id_label",
    loser: str = "counterpart",
    outcome: str = "outcome",
    init: tuple[float, float] = (INIT_RATING, INIT_RD),
    drift: float = DRIFT,
    max_rd: float = MAX_RD,
) -> DataFrame:
    """Ratings after the last period, one row per group and player.

    A null group is a group like others.  A deviation grows to ``min(sqrt(rd² + drift²·t), max_rd)`` over the ``t``
    periods since the player's last game, and does not grow before the first.
    Only the number of periods comes to the driver; the state of each period is
    staged, so the plan stays short and a lost executor costs one period.
    """
    results = stage(pair_results(games, group, period, winner, loser, outcome), "pairs")
    steps = results.agg(F.max("step")).first()[0] or 0
    key = [*group, "player"]
    state = results.select(*key).distinct().select(
        *key,
        F.lit(init[0]).alias("rating"), F.lit(init[1]).alias("rd"),
        F.lit(None).cast("int").alias("last_step"),
        *[F.lit(0).cast("long").alias(c) for c in ("games", "wins", "losses")],
    )
    for step in range(1, steps + 1):
        last, state = state, stage(_period(results, state, group, step, drift, max_rd), "ratings")
        unstage(last)
    return state


def _period(
    results: DataFrame, state: DataFrame, group: Sequence[str], step: int,
    drift: float, max_rd: float,
) -> DataFrame:
    key = [*group, "player"]
    idle = F.coalesce(F.lit(step) - F.col("last_step"), F.lit(0))
    grown = F.least(F.sqrt(F.pow("rd", 2) + drift**2 * idle), F.lit(max_rd))
    before = state.withColumn("grown", grown)
    rivals = before.select(
        *group, F.col("player").alias("opponent"),
        F.col("rating").alias("opp_rating"), F.col("grown").alias("opp_rd"),
    )
    met = keyed_join(
        results.where(F.col("step") == step), before.select(*key, "rating"), key, "inner", null_safe=True)
    met = keyed_join(met, rivals, [*group, "opponent"], "inner", null_safe=True)
    g = attenuation(F.col("opp_rd"))
    e = expected_score(F.col("rating"), F.col("opp_rating"), F.col("opp_rd"))
    sums = met.groupBy(*key).agg(
        (Q**2 * F.sum(F.col("n") * g * g * e * (1 - e))).alias("information"),
        F.sum(g * (F.col("points") - F.col("n") * e)).alias("surprise"),
        F.sum("n").alias("n"), F.sum("points").cast("long").alias("points"),
    )
    precision = 1 / F.pow("grown", 2) + F.col("information")
    played = F.col("n").isNotNull()
    return keyed_join(before, sums, key, null_safe=True).select(
        *key,
        F.when(played, F.col("rating") + Q / precision * F.col("surprise"))
        .otherwise(F.col("rating")).alias("rating"),
        F.when(played, F.sqrt(1 / precision)).otherwise(F.col("rd")).alias("rd"),
        F.when(played, F.lit(step)).otherwise(F.col("last_step")).alias("last_step"),
        (F.col("games") + F.coalesce("n", F.lit(0))).alias("games"),
        (F.col("wins") + F.coalesce("points", F.lit(0))).alias("wins"),
        (F.col("losses") + F.coalesce(F.col("n") - F.col("points"), F.lit(0))).alias("losses"),
    )


def ranking(ratings: DataFrame, group: Sequence[str] = ("cohort",)) -> DataFrame:
    """Players of each group by rating; of equal ratings the lower id first."""
    placed = numbered(ratings, group, [F.desc(F.round("rating", 6)), "player"], "glicko_rank")
    return placed.select(
        *group, F.col("player").alias("id_label"),
        F.col("rating").alias("glicko_rating"), F.col("glicko_rank").cast("int").alias("glicko_rank"),
    )


def recent_games(games: DataFrame, k: int = 2) -> DataFrame:
    """Games of each group's last ``k`` test nights."""
    return games.where((F.col("rev_night") <= k) & (F.col("cond") == "test"))


def compare_rankings(overall: DataFrame, recent: DataFrame) -> DataFrame:
    """Rank over all test nights (ratings) beside the rank over the last ones."""
    names = {"glicko_rating": "rating_recent", "glicko_rank": "rank_recent"}
    whole = ranking(overall).withColumnsRenamed(
        {"glicko_rating": "rating_all", "glicko_rank": "rank_all"})
    return keyed_join(whole, recent.withColumnsRenamed(names), ["cohort", "id_label"], null_safe=True)
