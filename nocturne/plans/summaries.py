"""Summaries of the event table: scorecards, rates, profiles, contrasts.

Every one is a filter, a group-by whose map side combines first, and keyed
joins between aggregated tables.  Means, deviations and ratios are built from
sums, so a group of any size is never held in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from nocturne.functions.columns import (
    arcsine, cohort_type, hours_between, ratio,
)
from nocturne.operators.joins import (
    in_role, keyed_join, lookup_join, members_of, unique_rows,
)
from nocturne.operators.timeline import grouping, numbered
from nocturne.plans.quantiles import group_quantiles


def row_count() -> Column:
    return F.count(F.lit(1))


def phase_durations(events: DataFrame, night_hours: int = 12) -> DataFrame:
    """Hours from a night's first event to its last switch, and the rest."""
    marks = events.where((F.col("n_event") == 1) | (F.col("system_msg") == "switch"))
    first = F.round(hours_between(F.min("ts"), F.max("ts")), 1)
    wide = marks.groupBy("night").agg(first.alias("hours_ph1"))
    wide = wide.withColumn("hours_ph2", night_hours - F.col("hours_ph1"))
    long = wide.unpivot("night", ["hours_ph1", "hours_ph2"], "phase", "phase_dur")
    return long.withColumn("phase", F.regexp_replace("phase", "^hours_ph", "").cast("int"))


def visit_summary(
    events: DataFrame, durations: DataFrame, min_duration: float = 300
) -> DataFrame:
    """Visits and volume (mL) per individual, night, phase and patch; hourly rates."""
    visits = events.where(
        (F.col("event_duration") > min_duration) & F.col("choice") & F.col("id_label").isNotNull()
    )
    keys = ["night", "cohort", "group_night", "id_label", "phase", "cond", "patch", "sex"]
    counted = visits.groupBy(*keys).agg(
        row_count().alias("n"), (F.sum("vol") / 1000).alias("vol_consumed")
    )
    return counted.join(durations, ["night", "phase"], "left").withColumns({
        "vis_hour": ratio("n", "phase_dur"),
        "ml_hour": ratio("vol_consumed", "phase_dur"),
    })


def reverse_nights(summary: DataFrame) -> DataFrame:
    """Test nights of each cohort counted from the last one.

    The window runs over distinct (cohort, night) pairs only.
    """
    nights = summary.where(F.col("cond") == "test").select("cohort", "group_night").distinct()
    latest = W.partitionBy("cohort").orderBy(F.desc("group_night"))
    return nights.withColumn("rev_night", F.row_number().over(latest))


def with_reverse_nights(summary: DataFrame) -> DataFrame:
    return keyed_join(summary, reverse_nights(summary), ["cohort", "group_night"])


SCORE_KEYS = ["group_night", "cond", "id_label", "cohort", "sex", "phase"]


def pursuit_summary(events: DataFrame) -> DataFrame:
    """Detections, pursuits begun, feedings and score per individual and phase."""
    known = events.where(F.col("id_label").isNotNull() & F.col("cond").isNotNull())
    return known.groupBy(*SCORE_KEYS).agg(
        row_count().alias("n_detections"),
        F.count_if("hit").alias("n_chases"),
        F.sum("rewarded").alias("n_feedings"),
    ).withColumn("chase_score", ratio("n_chases", "n_detections"))


RECEIVED_KEYS = ["cond", "group_night", "id_label", "cohort", "phase"]


def received_counts(events: DataFrame) -> DataFrame:
    """How often each individual was the one pursued."""
    chased = events.where(F.col("counterpart").isNotNull())
    role = chased.drop("id_label").withColumnRenamed("counterpart", "id_label")
    return role.groupBy(*RECEIVED_KEYS).agg(row_count().alias("n_chased"))


def attributes_at(conditions: DataFrame, night: int = 5) -> DataFrame:
    """Weight and sex of each individual on a reference night."""
    rows = conditions.where(F.col("group_night") == night)
    weights = rows.groupBy("id_label").agg(F.avg("weight").alias("weight"))
    return weights.join(unique_rows(rows, ["id_label", "sex"], ["id_label"]), "id_label")


def scorecard(
    summary: DataFrame,
    received: DataFrame,
    attributes: DataFrame,
    ranking: DataFrame | None = None,
) -> DataFrame:
    """Begun and received pursuits with attributes and rank; absent counts are 0."""
    card = keyed_join(summary, received, RECEIVED_KEYS)
    card = keyed_join(card, attributes.drop("sex"), ["id_label"])
    if ranking is not None:
        card = keyed_join(card, ranking, ["cohort", "id_label"])
    card = card.fillna({"n_chased": 0})
    return card.withColumn("chased_score", ratio("n_chased", "n_detections"))


def with_status(df: DataFrame, statuses: DataFrame) -> DataFrame:
    return keyed_join(df, statuses, ["id_label", "cohort"])


def rewarded_visits(events: DataFrame, statuses: DataFrame) -> DataFrame:
    return _visit_facts(events.where(F.col("vol") > 0), statuses)


def choices(events: DataFrame, statuses: DataFrame) -> DataFrame:
    return _visit_facts(events.where("choice"), statuses)


def _visit_facts(events: DataFrame, statuses: DataFrame) -> DataFrame:
    kept = events.where((F.col("cond") == "test") & F.col("id_label").isNotNull())
    return lookup_join(kept, statuses, ["id_label", "cohort"], ["ts", "event_seq"]).select(
        "group_night", "id_label", "status", "cohort", "ts", "loc", "phase"
    )


def intake_rate(summary: DataFrame, by: Sequence[str], name: str = "vol_hr") -> DataFrame:
    """Volume over hours, summed before dividing."""
    return (
        summary.groupBy(*by)
        .agg(F.sum("vol_consumed").alias("_vol"), F.sum("phase_dur").alias("_hours"))
        .select(*by, ratio("_vol", "_hours").alias(name))
    )


def recent_rate(summary: DataFrame, k: int = 2, phase: int | None = None) -> DataFrame:
    """Intake rate over each cohort's last ``k`` test nights."""
    last = summary.where(F.col("rev_night") <= k)
    if phase is not None:
        return intake_rate(last.where(F.col("phase") == phase), ["cohort", "sex", "id_label"])
    return intake_rate(last, ["cohort", "phase", "sex", "id_label"])


def score_ratios(card: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scores from summed counts."""
    sums = card.groupBy(*by).agg(*[
        F.sum(c).alias(c) for c in ("n_chases", "n_chased", "n_detections", "n_feedings")
    ])
    return sums.withColumns({
        "chase_score": ratio("n_chases", "n_detections"),
        "chased_score": ratio("n_chased", "n_detections"),
    })


def score_intake(card: DataFrame, intake: DataFrame) -> DataFrame:
    """Scores in phase 1 of the test nights beside the recent intake rate."""
    keys = ["cohort", "sex", "id_label"]
    ranked = keys + [c for c in ("glicko_rank", "glicko_rating") if c in card.columns]
    rows = card.where((F.col("phase") == 1) & (F.col("cond") == "test"))
    scores = score_ratios(rows, ranked).drop("n_detections", "n_feedings")
    return keyed_join(scores, intake, keys)


def classify_status(table: DataFrame, score: float = 0.003, rate: float = 0.75) -> DataFrame:
    """Females, and males split by score and intake rate."""
    status = (
        F.when(F.col("sex") == "f", "Females")
        .when((F.col("chase_score") > score) & (F.col("vol_hr") > rate), "Dominant males")
        .otherwise("Subordinate males")
    )
    return table.select("id_label", status.alias("status"), "cohort")


def dominant_females(table: DataFrame, score: float = 0.003, rate: float = 0.75) -> DataFrame:
    """Females that pass both thresholds."""
    dominant = (F.col("chase_score") > score) & (F.col("vol_hr") > rate)
    status = F.when(dominant, "Dominant").otherwise("Subordinate")
    return table.select("id_label", status.alias("status"), "sex").where(
        (F.col("sex") == "f") & (F.col("status") == "Dominant")
    )


def _contrast(summary: DataFrame, partition: Column, statuses: DataFrame) -> DataFrame:
    parted = summary.withColumn("part", partition).where(F.col("part").isNotNull())
    rates = intake_rate(parted, ["cohort", "id_label", "phase", "part", "sex"])
    return with_status(rates, statuses)


def period_contrast(summary: DataFrame, statuses: DataFrame) -> DataFrame:
    """Intake in the first two and the last two test nights."""
    night = F.col("group_night")
    part = (
        F.when(F.col("rev_night").isNull(), F.lit(None).cast("string"))
        .when((night < 3) & (night > 0), "First two nights")
        .when(F.col("rev_night") < 3, "Last two nights")
    )
    return _contrast(summary, part, statuses)


def early_contrast(summary: DataFrame, statuses: DataFrame) -> DataFrame:
    """Intake in the first and the second test night."""
    night = F.col("group_night")
    part = F.when(night == 1, "First night").when(night == 2, "Second night")
    return _contrast(summary, part, statuses)


def centred(df: DataFrame, column: str, name: str) -> DataFrame:
    """``column`` minus its mean over the whole table."""
    mean = df.agg(F.avg(column)).scalar()
    return df.withColumn(name, F.col(column) - mean)


def dispersion(summary: DataFrame, by: Sequence[str] = ("sex",)) -> DataFrame:
    """Spread of intake between individuals by cohort, night and phase."""
    tests = summary.where(F.col("group_night") > 0)
    each = intake_rate(tests, ["cohort", "id_label", "phase", *by, "group_night"])
    spread = each.groupBy("cohort", "group_night", "phase", *by).agg(
        F.stddev_samp("vol_hr").alias("sd_consumed")
    )
    if "sex" in by:
        spread = spread.withColumn("group2", F.concat_ws(" ", "cohort", "sex"))
    return centred(spread, "group_night", "night")


def female_dispersion(summary: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """The same for females, by type of cohort."""
    rows = summary.where((F.col("sex") != "m") & ~F.col("cohort").isin(*excluded)
                         if excluded else F.col("sex") != "m")
    return dispersion(rows, ()).withColumn("cohort_type", cohort_type("cohort"))


def nightly_totals(card: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Pursuits per night by condition: mean and deviation over cohorts."""
    whole = card.join(incomplete, ["cohort", "group_night"], "left_anti")
    nights = whole.groupBy("cohort", "group_night", "cond").agg(F.sum("n_chases").alias("total"))
    cohorts = nights.groupBy("cohort", "cond").agg(
        ratio(F.sum("total"), row_count()).alias("chases_night")
    )
    return cohorts.groupBy("cond").agg(
        F.round(F.avg("chases_night"), 1).alias("mean"),
        F.round(F.stddev_samp("chases_night"), 1).alias("sd"),
    )


def target_mix(games: DataFrame, attributes: DataFrame) -> DataFrame:
    """Share and nightly frequency of each sex among the targets."""
    sexes = attributes.select("id_label", "sex")
    pairs = (
        games.where(F.col("cond") == "test").groupBy("id_label", "counterpart", "cohort")
        .agg(row_count().alias("n"), F.max("group_night").alias("last"))
    )
    both = keyed_join(pairs, sexes, ["id_label"])
    both = keyed_join(both, in_role(sexes, "id_label", "counterpart"), ["counterpart"])

    def of(sex: str) -> Column:
        return F.sum(F.when(F.col("sex_counterpart") == sex, F.col("n")).otherwise(0))

    known = F.sum(F.when(F.col("sex_counterpart").isNotNull(), F.col("n")))
    return both.groupBy("id_label", "sex", "cohort").agg(
        ratio(of("m"), known).alias("prop_males"),
        ratio(of("f"), known).alias("prop_females"),
        ratio(of("m"), F.max("last")).alias("freq_males"),
        ratio(of("f"), F.max("last")).alias("freq_females"),
    )


def pair_shares(
    games: DataFrame, ratings: DataFrame, statuses: DataFrame | None = None, status: str | None = None
) -> DataFrame:
    """Share of a cohort's pursuits per ordered pair, with the rating gap.

    ``statuses`` adds the status of the pursuer; ``status`` keeps the pairs of
    pursuers with that status (shares are of all pursuits)."""
    pairs = (
        games.where(F.col("group_night") > 0)
        .groupBy("cohort", "id_label", "counterpart").agg(row_count().alias("n"))
    )
    totals = pairs.groupBy("cohort").agg(F.sum("n").alias("_total"))
    rated = ratings.select("cohort", "id_label", "glicko_rating")
    other = rated.withColumnsRenamed(
        {"id_label": "counterpart", "glicko_rating": "rating_counterpart"}
    )
    shared = lookup_join(pairs, totals, ["cohort"], ["id_label", "counterpart"])
    joined = keyed_join(shared, rated, ["cohort", "id_label"])
    joined = keyed_join(joined, other, ["cohort", "counterpart"])
    shares = joined.withColumns({
        "share": ratio("n", "_total"),
        "rating_gap": F.col("glicko_rating") - F.col("rating_counterpart"),
    }).drop("_total")
    if statuses is None:
        return shares
    shares = with_status(shares, statuses)
    return shares if status is None else shares.where(F.col("status") == status)


def hourly_profile(
    events: DataFrame,
    durations: DataFrame,
    statuses: DataFrame | None = None,
    status: str | None = None,
) -> DataFrame:
    """Pursuits by hour of the night, with the hour the phase changes."""
    keys = ["cohort", "night", "group_night", "hour"]
    rows = events.where((F.col("cond") == "test") & F.col("hit")).withColumn("hour", F.hour("ts"))
    counts = rows.groupBy(*keys, "id_label").agg(row_count().alias("n"))
    if statuses is not None and status is not None:
        counts = with_status(counts, statuses).where(F.col("status") == status)
    counts = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    boundary = durations.where(F.col("phase") == 1).select(
        "night", (F.round("phase_dur") + 1).alias("boundary")
    )
    return counts.join(boundary, "night", "left").withColumn(
        "night_hour", (F.col("hour") + 9) % 24
    )


def place_distribution(
    visits: DataFrame, cohort: str | None = None, phase: int | None = None
) -> DataFrame:
    """Visits per place, individual, night and phase."""
    if phase is not None:
        visits = visits.where(F.col("phase") == phase)
    if cohort is not None:
        visits = visits.where(F.col("cohort") == cohort)
    keys = ["loc", "id_label", "status", F.col("group_night").alias("night"), "phase"]
    return visits.groupBy(*keys).agg(row_count().alias("n"))


def pursuit_places(games: DataFrame) -> DataFrame:
    return games.groupBy("cohort", "loc").agg(row_count().alias("n"))


def measure_cells(
    card: DataFrame, statuses: DataFrame, cohort: str, measure: str
) -> DataFrame:
    """The chosen measure by individual, night and phase of one cohort."""
    rows = with_status(card.where(F.col("cohort") == cohort), statuses)
    return rows.groupBy(
        "id_label", "status", F.col("group_night").alias("night"), "phase"
    ).agg(F.sum(measure).alias(measure))


def top_chasers(card: DataFrame) -> DataFrame:
    """The highest score per night, cohort and phase; ties go to the lower id."""
    tests = card.where(F.col("cond") == "test")
    keys = ["group_night", "cohort", "phase"]
    scored = F.col("chase_score").isNotNull()
    # max_by on the score alone is not enough: of equal scores keep the first id
    order = F.struct(F.when(scored, -F.col("chase_score")).alias("s"), F.col("id_label"))
    best = tests.where(scored).groupBy(*keys).agg(
        F.min_by(F.struct("id_label", "sex", "chase_score"), order).alias("_best")
    )
    return best.select(*keys, "_best.*")


def top_counts(tops: DataFrame) -> DataFrame:
    """How many nights each cohort has a top chaser in a phase."""
    nights = tops.groupBy("phase", "group_night", "cohort").agg(row_count().alias("n"))
    return nights.groupBy("cohort", "phase").agg(row_count().alias("n"))


def received_per_feeding(card: DataFrame) -> DataFrame:
    rows = score_ratios(card.where(F.col("cond") == "test"), ["sex", "cohort", "id_label"])
    return rows.select(
        "sex", "cohort", "id_label", ratio("n_chased", "n_feedings").alias("chased_per_feeding")
    )


def mean_rewarded(visits: DataFrame, attributes: DataFrame) -> DataFrame:
    """Rewarded visits a night per individual: mean and standard error."""
    keys = ["phase", "cohort", "id_label"]
    nightly = visits.groupBy("group_night", *keys).agg(row_count().alias("n"))
    cells = nightly.groupBy(*keys).agg(
        F.avg("n").alias("mean_rewarded"),
        (F.stddev_samp("n") / F.sqrt(row_count())).alias("se"),
    )
    return keyed_join(cells, attributes.select("id_label", "sex"), ["id_label"])


def mean_intake(
    summary: DataFrame, ids: DataFrame | None = None, phase: int = 1
) -> DataFrame:
    """Mean and deviation of the individuals' mean nightly intake rate."""
    rows = summary.where((F.col("cond") == "test") & (F.col("phase") == phase))
    if ids is not None:
        rows = members_of(rows, ids, ["id_label"])
    nightly = intake_rate(rows, ["group_night", "id_label"])
    each = nightly.groupBy("id_label").agg(F.avg("vol_hr").alias("mean_vol_hr"))
    return each.agg(
        F.round(F.avg("mean_vol_hr"), 2).alias("mean_intake"),
        F.round(F.stddev_samp("mean_vol_hr"), 2).alias("sd"),
    )


def total_intake(summary: DataFrame) -> DataFrame:
    keys = ["cohort", "group_night", "id_label", "sex", "phase"]
    tests = summary.where(F.col("cond") == "test")
    return tests.groupBy(*keys).agg(F.sum("vol_consumed").alias("vol_consumed"))


def mean_scores(
    card: DataFrame, by: Sequence[str], transform: bool = False, phase: int | None = None
) -> DataFrame:
    """Mean of the nightly scores, raw or arcsine-transformed."""
    rows = card.where(F.col("cond") == "test")
    if phase is not None:
        rows = rows.where(F.col("phase") == phase)
    value = arcsine if transform else F.col
    return rows.groupBy(*by).agg(*[
        F.avg(value(c)).alias(c) for c in ("chase_score", "chased_score")
    ])


def score_balance(card: DataFrame) -> DataFrame:
    """Scores over all nights with the type of cohort."""
    rows = score_ratios(card, ["id_label", "sex", "cohort"])
    return rows.select(
        "id_label", "sex", "cohort", "chase_score", "chased_score",
        cohort_type("cohort").alias("cohort_type"),
    )


def activity_by_night(
    rows: DataFrame, attributes: DataFrame, statuses: DataFrame
) -> DataFrame:
    """Rows per individual and test night with sex and status."""
    counts = (
        rows.where((F.col("group_night") > 0) & F.col("id_label").isNotNull())
        .groupBy("group_night", "id_label", "cohort").agg(row_count().alias("n"))
    )
    counts = keyed_join(counts, attributes.select("id_label", "sex"), ["id_label"])
    return with_status(counts, statuses)


def training_totals(events: DataFrame, night: int = 0) -> DataFrame:
    rows = events.where((F.col("group_night") == night) & F.col("hit"))
    return rows.groupBy("cohort").agg(row_count().alias("n"))


def with_group_type(card: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Females outside the excluded cohorts, labelled by type of cohort."""
    rows = card.where(F.col("sex") != "m")
    if excluded:
        rows = rows.where(~F.col("cohort").isin(*excluded))
    return rows.withColumn("cohort_type", cohort_type("cohort"))


def rank_intake(scores: DataFrame, rates: DataFrame) -> DataFrame:
    """Rank beside the intake rate; individuals without a rank are kept."""
    ranks = scores.select("id_label", "cohort", "glicko_rank").distinct()
    return keyed_join(ranks, rates, ["id_label", "cohort"], "right")


def total_pursuits(card: DataFrame) -> DataFrame:
    return card.agg(F.sum("n_chases").alias("total_chases"))


def plot_groups(intake: DataFrame, statuses: DataFrame) -> DataFrame:
    """Individuals of each cohort in order of sex, status and id, with a label
    that repeats after six."""
    rows = with_status(intake.select("sex", "id_label", "cohort").distinct(), statuses)
    placed = numbered(rows, ["cohort"], ["sex", "status", "id_label"], "n")
    return placed.withColumn("fill_group", ((F.col("n") - 1) % 6 + 1).cast("int"))


def five_numbers(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles with linear interpolation, and the whiskers at 1.5 IQR.

    Exact for groups of any size, by radix selection and one more aggregate.
    Nulls in ``by`` are a group; a group without values has n = 0."""
    keyed, keys = grouping(df, by)
    known = keyed.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    table = group_quantiles(known, keys, "_v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    whiskers = known.join(table, keys).groupBy(*keys).agg(
        F.min(F.when(F.col("_v") >= F.col("q1") - reach, F.col("_v"))).alias("low"),
        F.max(F.when(F.col("_v") <= F.col("q3") + reach, F.col("_v"))).alias("high"),
    )
    groups = keyed.select(*keys, *by).distinct()
    whole = groups.join(table.join(whiskers, keys), keys, "left").drop(*keys)
    return whole.fillna({"n": 0})
