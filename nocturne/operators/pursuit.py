"""Ordered-event patterns: one individual displacing another at a place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.operators.joins import lookup_join
from nocturne.operators.timeline import Timeline


def detect_pursuits(
    log: Timeline,
    hit_kind: str = "Re",
    steps: Sequence[str] = ("LS", "Co"),
    place: str | None = "loc",
    max_duration: float = 200,
    exclude_self: bool = False,
) -> Timeline:
    """Mark rows that complete the pattern, with the individual that began it.

    ``steps`` are the kinds one, two, … rows back; the counterpart is the
    individual at the last of them.  The tests run in a fixed order and a test
    on a null value does not reject the row, so an unknown duration passes.
    """
    depth = len(steps)
    columns = ["unit_label", "id_label"] + ([place] if place else [])
    lagged = log.lags(columns, depth)
    back = [F.col(f"lag{j}") for j in range(1, depth + 1)]
    hit = (
        F.when(back[-1].isNull(), False)
        .when(F.col("id_label").isNull(), False)
        .when(F.col("event_duration") >= max_duration, False)
        .when(~F.col("unit_label").contains(hit_kind), False)
        .when(~back[0]["unit_label"].contains(steps[0]), False)
    )
    if place:
        differs = F.col(place) != back[0][place]
        for b in back[1:]:
            differs = differs | (F.col(place) != b[place])
        hit = hit.when(differs, False)
    for b, kind in zip(back[1:], steps[1:]):
        hit = hit.when(~b["unit_label"].contains(kind), False)
    hit = hit.otherwise(True)
    if exclude_self:
        hit = hit & ~F.col("id_label").eqNullSafe(back[-1]["id_label"])
    df = lagged.df.withColumn("hit", hit)
    df = df.withColumn("counterpart", F.when(F.col("hit"), back[-1]["id_label"]))
    return lagged.with_df(df.drop(*[f"lag{j}" for j in range(1, depth + 1)]))


def games(events: DataFrame, reverse_nights: DataFrame) -> DataFrame:
    """One row per pursuit, won by the pursuer, with the reverse night."""
    won = events.where("hit").select(
        "cond", "group_night", "cohort", "id_label", "counterpart", "loc",
        F.lit(1).alias("outcome"), "ts", "event_seq",
    )
    return lookup_join(won, reverse_nights, ["cohort", "group_night"], ["ts", "event_seq"]).drop(
        "ts", "event_seq"
    )
