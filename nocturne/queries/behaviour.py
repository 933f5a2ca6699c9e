"""Scorecards, rates, profiles and contrasts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.functions.columns import label_rank, recode
from nocturne.plans import ratings, summaries as S
from nocturne.queries.registry import Tables, query, query_of_all
from nocturne.queries.sql import CTES, twin

# thresholds at which the given tables have individuals on both sides
SCORE, RATE = 0.02, 0.001
# cohort and night pairs to leave out of nightly totals
INCOMPLETE = [("building", 4), ("automobile", 9)]

CTES["card0"] = """
SELECT group_night, cond, id_label, cohort, sex, phase, count(*) AS n_detections,
  CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS n_chases, sum(rewarded) AS n_feedings
FROM hits WHERE id_label IS NOT NULL AND cond IS NOT NULL GROUP BY ALL"""

CTES["received"] = """
SELECT cond, group_night, counterpart AS id_label, cohort, phase, count(*) AS n_chased
FROM hits WHERE counterpart IS NOT NULL GROUP BY ALL"""

CTES["attributes"] = """
SELECT id_label, avg(weight) AS weight, min(sex) AS sex FROM conditions WHERE group_night = 5
GROUP BY id_label"""

CTES["card"] = """
SELECT c.*, n_chases / n_detections AS chase_score, coalesce(n_chased, 0) AS n_chased,
  coalesce(n_chased, 0) / n_detections AS chased_score, weight
FROM card0 c LEFT JOIN received r USING (cond, group_night, id_label, cohort, phase)
LEFT JOIN (SELECT id_label, weight FROM attributes) a USING (id_label)"""

CTES["recent"] = """
SELECT cohort, sex, id_label, sum(vol_consumed) / nullif(sum(phase_dur), 0) AS vol_hr
FROM visits WHERE rev_night <= 2 AND phase = 1 GROUP BY ALL"""

CTES["score_intake"] = """
SELECT s.*, vol_hr FROM (
  SELECT cohort, sex, id_label, sum(n_chases) / sum(n_detections) AS chase_score,
    sum(n_chased) / sum(n_detections) AS chased_score,
    CAST(sum(n_chases) AS BIGINT) AS n_chases, CAST(sum(n_chased) AS BIGINT) AS n_chased
  FROM card WHERE phase = 1 AND cond = 'test' GROUP BY ALL) s
LEFT JOIN recent USING (cohort, sex, id_label)"""

CTES["statuses"] = f"""
SELECT id_label, CASE WHEN sex = 'f' THEN 'Females'
  WHEN chase_score > {SCORE} AND vol_hr > {RATE} THEN 'Dominant males'
  ELSE 'Subordinate males' END AS status, cohort FROM score_intake"""


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query_of_all("phase_durations", twin("durations", "SELECT night, phase, phase_dur FROM durations"))
def phase_durations(t: Tables):
    return S.phase_durations(t.hits)


@query_of_all("visit_summary", twin("visits0", """
SELECT night, cohort, group_night, id_label, phase, cond, patch, sex, n, phase_dur,
  round(vol_consumed, 9) AS vol_consumed, round(vis_hour, 9) AS vis_hour,
  round(ml_hour, 9) AS ml_hour FROM visits0"""))
def visit_summary(t: Tables):
    summary = S.visit_summary(t.hits, t.durations)
    return rounded(summary, "vol_consumed", "vis_hour", "ml_hour")


@query_of_all("reverse_nights", twin("visits", """
SELECT id_label, night, phase, patch, rev_night FROM visits"""))
def reverse_nights(t: Tables):
    return S.with_reverse_nights(S.visit_summary(t.hits, t.durations)).select(
        "id_label", "night", "phase", "patch", "rev_night")


@query_of_all("pursuit_summary", twin("card0", """
SELECT *, round(n_chases / n_detections, 9) AS chase_score FROM card0"""))
def pursuit_summary(t: Tables):
    return rounded(S.pursuit_summary(t.hits), "chase_score")


@query_of_all("received_counts", twin("received", "SELECT * FROM received"))
def received_counts(t: Tables):
    return S.received_counts(t.hits)


@query_of_all("attributes_at_night", twin("attributes", "SELECT id_label, weight, sex FROM attributes"))
def attributes_at_night(t: Tables):
    return S.attributes_at(t.conditions, 5)


@query_of_all("games", twin("games", "SELECT * FROM games"))
def games(t: Tables):
    return t.games


@query_of_all("scorecard_without_rank", twin("card", """
SELECT * REPLACE (round(chase_score, 9) AS chase_score, round(chased_score, 9) AS chased_score)
FROM card"""))
def scorecard_without_rank(t: Tables):
    return rounded(t.card, "chase_score", "chased_score")


@query_of_all("rewarded_visits", twin("statuses", """
SELECT group_night, id_label, status, cohort, loc, phase, epoch_us(ts) AS ts_us
FROM hits LEFT JOIN statuses USING (id_label, cohort)
WHERE vol > 0 AND cond = 'test' AND id_label IS NOT NULL"""))
def rewarded_visits(t: Tables):
    return with_micros(S.rewarded_visits(t.hits, t.statuses))


@query_of_all("choices", twin("statuses", """
SELECT group_night, id_label, status, cohort, loc, phase, epoch_us(ts) AS ts_us
FROM hits LEFT JOIN statuses USING (id_label, cohort)
WHERE choice AND cond = 'test' AND id_label IS NOT NULL"""))
def choices(t: Tables):
    return with_micros(S.choices(t.hits, t.statuses))


def with_micros(df: DataFrame) -> DataFrame:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (F.col("ts") - epoch).cast("interval second").cast("decimal(18,6)")
    return df.withColumn("ts_us", (seconds * 1000000).cast("long")).drop("ts")


@query_of_all("recent_rate", twin("recent", """
SELECT cohort, sex, id_label, round(vol_hr, 9) AS vol_hr FROM recent"""))
def recent_rate(t: Tables):
    return rounded(S.recent_rate(t.visits, 2, 1), "vol_hr")


@query_of_all("recent_rate_by_phase", twin("visits", """
SELECT cohort, phase, sex, id_label,
  round(sum(vol_consumed) / nullif(sum(phase_dur), 0), 9) AS vol_hr
FROM visits WHERE rev_night <= 2 GROUP BY cohort, phase, sex, id_label"""))
def recent_rate_by_phase(t: Tables):
    return rounded(S.recent_rate(t.visits, 2), "vol_hr")


@query_of_all("score_intake", twin("score_intake", """
SELECT * REPLACE (round(chase_score, 9) AS chase_score, round(chased_score, 9) AS chased_score,
  round(vol_hr, 9) AS vol_hr) FROM score_intake"""))
def score_intake(t: Tables):
    return rounded(t.score_intake, "chase_score", "chased_score", "vol_hr")


@query_of_all("classify_status", twin("statuses", "SELECT * FROM statuses"))
def classify_status(t: Tables):
    return S.classify_status(t.score_intake, SCORE, RATE)


@query_of_all("status_counts", twin("statuses", """
SELECT cohort, status, count(*) AS n FROM statuses GROUP BY cohort, status"""))
def status_counts(t: Tables):
    return t.statuses.groupBy("cohort", "status").count().withColumnRenamed("count", "n")


@query_of_all("dominant_females", twin("score_intake", f"""
SELECT id_label, 'Dominant' AS status, sex FROM score_intake
WHERE sex = 'f' AND chase_score > {SCORE} AND vol_hr > {RATE}"""))
def dominant_females(t: Tables):
    return S.dominant_females(t.score_intake, SCORE, RATE)


@query_of_all("dominant_female_intake", twin("statuses", f"""
SELECT cohort, id_label, phase, part, round(vol_hr, 9) AS vol_hr FROM (
  SELECT cohort, id_label, phase, CASE group_night WHEN 1 THEN 'First night'
    WHEN 2 THEN 'Second night' END AS part, sum(vol_consumed) / nullif(sum(phase_dur), 0) AS vol_hr
  FROM visits WHERE group_night IN (1, 2) GROUP BY ALL)
WHERE id_label IN (SELECT id_label FROM score_intake
  WHERE sex = 'f' AND chase_score > {SCORE} AND vol_hr > {RATE})"""))
def dominant_female_intake(t: Tables):
    from nocturne.operators.joins import members_of

    females = S.dominant_females(t.score_intake, SCORE, RATE)
    rows = members_of(S.early_contrast(t.visits, t.statuses), females, ["id_label"])
    return rounded(rows, "vol_hr").select("cohort", "id_label", "phase", "part", "vol_hr")


CTES["contrast"] = """
SELECT r.*, status FROM (
  SELECT cohort, id_label, phase, part, sex, sum(vol_consumed) / nullif(sum(phase_dur), 0) AS vol_hr
  FROM (SELECT *, CASE WHEN rev_night IS NULL THEN NULL
      WHEN group_night < 3 AND group_night > 0 THEN 'First two nights'
      WHEN rev_night < 3 THEN 'Last two nights' END AS part FROM visits)
  WHERE part IS NOT NULL GROUP BY ALL) r LEFT JOIN statuses USING (id_label, cohort)"""


@query_of_all("period_contrast", twin("contrast", """
SELECT * REPLACE (round(vol_hr, 9) AS vol_hr) FROM contrast"""))
def period_contrast(t: Tables):
    return rounded(S.period_contrast(t.visits, t.statuses), "vol_hr")


@query_of_all("early_contrast", twin("statuses", """
SELECT r.* REPLACE (round(vol_hr, 9) AS vol_hr), status FROM (
  SELECT cohort, id_label, phase, CASE group_night WHEN 1 THEN 'First night' ELSE 'Second night' END
    AS part, sex, sum(vol_consumed) / nullif(sum(phase_dur), 0) AS vol_hr
  FROM visits WHERE group_night IN (1, 2) GROUP BY ALL) r LEFT JOIN statuses USING (id_label, cohort)"""))
def early_contrast(t: Tables):
    return rounded(S.early_contrast(t.visits, t.statuses), "vol_hr")


CTES["dispersion"] = """
SELECT cohort, group_night, phase, sex, sd_consumed, cohort || ' ' || sex AS group2,
  group_night - avg(group_night) OVER () AS night
FROM (SELECT cohort, group_night, phase, sex, stddev_samp(vol_hr) AS sd_consumed FROM (
  SELECT cohort, id_label, phase, sex, group_night,
    sum(vol_consumed) / nullif(sum(phase_dur), 0) AS vol_hr
  FROM visits WHERE group_night > 0 GROUP BY ALL) GROUP BY ALL)"""


@query("dispersion", twin("dispersion", """
SELECT * REPLACE (round(sd_consumed, 9) AS sd_consumed, round(night, 9) AS night) FROM dispersion"""))
def dispersion(t: Tables):
    return rounded(S.dispersion(t.visits), "sd_consumed", "night")


@query_of_all("female_dispersion", twin("visits", """
SELECT cohort, group_night, phase, round(sd_consumed, 9) AS sd_consumed,
  round(group_night - avg(group_night) OVER (), 9) AS night,
  CASE WHEN cohort LIKE '%mixed%' THEN 'mixed' ELSE 'single-sex' END AS cohort_type
FROM (SELECT cohort, group_night, phase, stddev_samp(vol_hr) AS sd_consumed FROM (
  SELECT cohort, id_label, phase, group_night,
    sum(vol_consumed) / nullif(sum(phase_dur), 0) AS vol_hr
  FROM visits WHERE group_night > 0 AND sex <> 'm' AND cohort <> 'building' GROUP BY ALL) GROUP BY ALL)"""))
def female_dispersion(t: Tables):
    return rounded(S.female_dispersion(t.visits, ["building"]), "sd_consumed", "night")


@query_of_all("nightly_totals", twin("card", """
SELECT cond, round(avg(per_night), 1) AS mean, round(stddev_samp(per_night), 1) AS sd FROM (
  SELECT cohort, cond, sum(total) / count(*) AS per_night FROM (
    SELECT cohort, group_night, cond, sum(n_chases) AS total FROM card
    WHERE NOT (cohort = 'building' AND group_night = 4)
      AND NOT (cohort = 'automobile' AND group_night = 9)
    GROUP BY ALL) GROUP BY ALL) GROUP BY cond"""))
def nightly_totals(t: Tables):
    incomplete = t.spark.createDataFrame(INCOMPLETE, "cohort string, group_night int")
    return S.nightly_totals(t.card, incomplete)


@query_of_all("target_mix", twin("attributes", """
SELECT g.id_label, a.sex, cohort,
  round(avg(CASE WHEN b.sex = 'm' THEN 1 WHEN b.sex IS NULL THEN NULL ELSE 0 END), 9) AS prop_males,
  round(avg(CASE WHEN b.sex = 'f' THEN 1 WHEN b.sex IS NULL THEN NULL ELSE 0 END), 9) AS prop_females,
  round(count(CASE WHEN b.sex = 'm' THEN 1 END) / max(group_night), 9) AS freq_males,
  round(count(CASE WHEN b.sex = 'f' THEN 1 END) / max(group_night), 9) AS freq_females
FROM games g LEFT JOIN attributes a ON g.id_label = a.id_label
LEFT JOIN attributes b ON g.counterpart = b.id_label
WHERE cond = 'test' GROUP BY g.id_label, a.sex, cohort"""))
def target_mix(t: Tables):
    return rounded(S.target_mix(t.games, t.attributes),
                   "prop_males", "prop_females", "freq_males", "freq_females")


@query_of_all("hourly_profile", twin("durations", """
SELECT h.*, round(phase_dur) + 1 AS boundary, CAST((hour + 9) % 24 AS INTEGER) AS night_hour FROM (
  SELECT cohort, night, group_night, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n
  FROM hits WHERE cond = 'test' AND hit GROUP BY ALL) h
LEFT JOIN durations d ON h.night = d.night AND d.phase = 1"""))
def hourly_profile(t: Tables):
    return S.hourly_profile(t.hits, t.durations)


@query_of_all("hourly_profile_of_status", twin("statuses", """
SELECT h.*, round(phase_dur) + 1 AS boundary, CAST((hour + 9) % 24 AS INTEGER) AS night_hour FROM (
  SELECT cohort, night, group_night, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n
  FROM hits JOIN statuses USING (id_label, cohort)
  WHERE cond = 'test' AND hit AND status = 'Subordinate males' GROUP BY ALL) h
LEFT JOIN durations d ON h.night = d.night AND d.phase = 1"""))
def hourly_profile_of_status(t: Tables):
    return S.hourly_profile(t.hits, t.durations, t.statuses, "Subordinate males")


CTES["rewarded"] = """
SELECT group_night, id_label, status, cohort, ts, loc, phase
FROM hits LEFT JOIN statuses USING (id_label, cohort)
WHERE vol > 0 AND cond = 'test' AND id_label IS NOT NULL"""


@query_of_all("place_distribution", twin("rewarded", """
SELECT loc, id_label, status, group_night AS night, phase, count(*) AS n FROM rewarded
WHERE cohort = 'building' GROUP BY ALL"""))
def place_distribution(t: Tables):
    return S.place_distribution(t.rewarded, "building")


@query_of_all("place_distribution_one_phase", twin("rewarded", """
SELECT loc, id_label, status, group_night AS night, phase, count(*) AS n FROM rewarded
WHERE cohort = 'mixed_machinery' AND phase = 2 GROUP BY ALL"""))
def place_distribution_one_phase(t: Tables):
    return S.place_distribution(t.rewarded, "mixed_machinery", 2)


@query_of_all("pursuit_places", twin("games", """
SELECT cohort, loc, count(*) AS n FROM games GROUP BY cohort, loc"""))
def pursuit_places(t: Tables):
    return S.pursuit_places(t.games)


@query_of_all("measure_cells", twin("statuses", """
SELECT id_label, status, group_night AS night, phase, CAST(sum(n_detections) AS BIGINT) AS n_detections
FROM card LEFT JOIN statuses USING (id_label, cohort) WHERE cohort = 'building' GROUP BY ALL"""))
def measure_cells(t: Tables):
    return S.measure_cells(t.card, t.statuses, "building", "n_detections")


CTES["tops"] = """
SELECT group_night, cohort, phase, id_label, sex, chase_score FROM (
  SELECT *, row_number() OVER (PARTITION BY group_night, cohort, phase
    ORDER BY chase_score DESC, id_label) AS rn FROM card WHERE cond = 'test') WHERE rn = 1"""


@query_of_all("top_chasers", twin("tops", """
SELECT * REPLACE (round(chase_score, 9) AS chase_score) FROM tops"""))
def top_chasers(t: Tables):
    return rounded(S.top_chasers(t.card), "chase_score")


@query_of_all("top_chaser_nights", twin("tops", """
SELECT cohort, phase, count(*) AS n FROM (
  SELECT phase, group_night, cohort, count(*) AS n FROM tops GROUP BY ALL) GROUP BY cohort, phase"""))
def top_chaser_nights(t: Tables):
    return S.top_counts(S.top_chasers(t.card))


@query_of_all("top_chaser_sexes", twin("tops", """
SELECT phase, sex, count(*) AS n FROM tops GROUP BY phase, sex"""))
def top_chaser_sexes(t: Tables):
    tops = S.top_chasers(t.card)
    return tops.groupBy("phase", "sex").agg(S.row_count().alias("n"))


@query_of_all("received_per_feeding", twin("card", """
SELECT sex, cohort, id_label, round(sum(n_chased) / nullif(sum(n_feedings), 0), 9) AS chased_per_feeding
FROM card WHERE cond = 'test' GROUP BY ALL"""))
def received_per_feeding(t: Tables):
    return rounded(S.received_per_feeding(t.card), "chased_per_feeding")


@query_of_all("mean_rewarded", twin("rewarded", """
SELECT c.*, sex FROM (
  SELECT phase, cohort, id_label, round(avg(n), 9) AS mean_rewarded,
    round(stddev_samp(n) / sqrt(count(*)), 9) AS se
  FROM (SELECT group_night, phase, cohort, id_label, count(*) AS n FROM rewarded GROUP BY ALL)
  GROUP BY ALL) c LEFT JOIN (SELECT id_label, sex FROM attributes) a USING (id_label)"""))
def mean_rewarded(t: Tables):
    return rounded(S.mean_rewarded(t.rewarded, t.attributes), "mean_rewarded", "se")


MEAN_INTAKE = """
SELECT round(avg(m), 2) AS mean_intake, round(stddev_samp(m), 2) AS sd FROM (
  SELECT id_label, avg(vol_hr) AS m FROM (
    SELECT group_night, id_label, sum(vol_consumed) / nullif(sum(phase_dur), 0) AS vol_hr
    FROM visits WHERE cond = 'test' AND phase = 1 {where} GROUP BY ALL) GROUP BY ALL)"""


@query_of_all("mean_intake", twin("visits", MEAN_INTAKE.format(where="")))
def mean_intake(t: Tables):
    return S.mean_intake(t.visits)


@query_of_all("mean_intake_of_status", twin("statuses", MEAN_INTAKE.format(
    where="AND id_label IN (SELECT id_label FROM statuses WHERE status = 'Subordinate males')")))
def mean_intake_of_status(t: Tables):
    return S.mean_intake(t.visits, t.statuses.where(F.col("status") == "Subordinate males"))


@query_of_all("total_intake", twin("visits", """
SELECT cohort, group_night, id_label, sex, phase, round(sum(vol_consumed), 9) AS vol_consumed
FROM visits WHERE cond = 'test' GROUP BY ALL"""))
def total_intake(t: Tables):
    return rounded(S.total_intake(t.visits), "vol_consumed")


@query_of_all("mean_scores", twin("card", """
SELECT sex, cohort, id_label, round(avg(chase_score), 9) AS chase_score,
  round(avg(chased_score), 9) AS chased_score
FROM card WHERE cond = 'test' AND phase = 1 GROUP BY ALL"""))
def mean_scores(t: Tables):
    means = S.mean_scores(t.card, ["sex", "cohort", "id_label"], phase=1)
    return rounded(means, "chase_score", "chased_score")


@query_of_all("mean_scores_arcsine", twin("card", """
SELECT sex, cohort, round(avg(asin(sqrt(chase_score))), 9) AS chase_score,
  round(avg(asin(sqrt(CASE WHEN chased_score <= 1 THEN chased_score END))), 9) AS chased_score
FROM card WHERE cond = 'test' GROUP BY ALL"""))
def mean_scores_arcsine(t: Tables):
    # a received score above 1 (more pursuits than detections) is no proportion: null
    return rounded(S.mean_scores(t.card, ["sex", "cohort"], True), "chase_score", "chased_score")


@query_of_all("score_balance", twin("card", """
SELECT id_label, sex, cohort, round(sum(n_chases) / sum(n_detections), 9) AS chase_score,
  round(sum(n_chased) / sum(n_detections), 9) AS chased_score,
  CASE WHEN cohort LIKE '%mixed%' THEN 'mixed' ELSE 'single-sex' END AS cohort_type
FROM card GROUP BY ALL"""))
def score_balance(t: Tables):
    return rounded(S.score_balance(t.card), "chase_score", "chased_score")


ACTIVITY = """
SELECT r.*, sex, status FROM (
  SELECT group_night, id_label, cohort, count(*) AS n FROM {rows}
  WHERE group_night > 0 AND id_label IS NOT NULL GROUP BY ALL) r
LEFT JOIN (SELECT id_label, sex FROM attributes) a USING (id_label)
LEFT JOIN statuses USING (id_label, cohort)"""


@query_of_all("games_by_night", twin("statuses", ACTIVITY.format(rows="games")))
def games_by_night(t: Tables):
    return S.activity_by_night(t.games, t.attributes, t.statuses)


@query_of_all("detections_by_night", twin("statuses", ACTIVITY.format(rows="hits")))
def detections_by_night(t: Tables):
    return S.activity_by_night(t.hits, t.attributes, t.statuses)


@query_of_all("training_totals", twin("hits", """
SELECT cohort, count(*) AS n FROM hits WHERE group_night = 0 AND hit GROUP BY cohort"""))
def training_totals(t: Tables):
    return S.training_totals(t.hits)


@query_of_all("females_by_cohort_type", twin("card", """
SELECT id_label, group_night, phase, cohort, n_chases, n_detections,
  CASE WHEN cohort LIKE '%mixed%' THEN 'mixed' ELSE 'single-sex' END AS cohort_type
FROM card WHERE sex <> 'm' AND cohort <> 'building'"""))
def females_by_cohort_type(t: Tables):
    return S.with_group_type(t.card, ["building"]).select(
        "id_label", "group_night", "phase", "cohort", "n_chases", "n_detections", "cohort_type")


@query_of_all("total_pursuits", twin("card", """
SELECT CAST(sum(n_chases) AS BIGINT) AS total_chases FROM card"""))
def total_pursuits(t: Tables):
    return S.total_pursuits(t.card)


@query_of_all("plot_groups", twin("statuses", """
SELECT cohort, sex, id_label, status, n, CAST((n - 1) % 6 + 1 AS INTEGER) AS fill_group FROM (
  SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY sex, status NULLS FIRST, id_label) AS n
  FROM (SELECT DISTINCT sex, id_label, cohort FROM visits WHERE cond = 'test')
  LEFT JOIN statuses USING (id_label, cohort))"""))
def plot_groups(t: Tables):
    return S.plot_groups(S.total_intake(t.visits), t.statuses)


@query_of_all("intake_five_numbers", twin("contrast", """
SELECT q.*, min(CASE WHEN vol_hr >= q1 - 1.5 * (q3 - q1) THEN round(vol_hr, 9) END) AS low,
  max(CASE WHEN vol_hr <= q3 + 1.5 * (q3 - q1) THEN round(vol_hr, 9) END) AS high
FROM contrast c JOIN (
  SELECT phase, part, count(vol_hr) AS n, round(quantile_cont(vol_hr, 0.25), 9) AS q1,
    round(quantile_cont(vol_hr, 0.5), 9) AS median, round(quantile_cont(vol_hr, 0.75), 9) AS q3
  FROM contrast GROUP BY phase, part) q USING (phase, part) GROUP BY ALL"""))
def intake_five_numbers(t: Tables):
    rates = S.period_contrast(t.visits, t.statuses)
    table = S.five_numbers(rates, ["phase", "part"], "vol_hr")
    return rounded(table, "q1", "median", "q3", "low", "high")


# Display labels of the two phases
PHASE_LABELS = {1: "clumped", 2: "dispersed"}


@query_of_all("recode_and_order", twin("card", """
SELECT CASE phase WHEN 1 THEN 'clumped' WHEN 2 THEN 'dispersed' END AS phase_label,
  CASE sex WHEN 'm' THEN 1 WHEN 'f' THEN 2 END AS sex_rank, count(*) AS n FROM card GROUP BY ALL"""))
def recode_and_order(t: Tables):
    return t.card.groupBy(
        recode("phase", PHASE_LABELS).alias("phase_label"),
        label_rank("sex", ["m", "f"]).cast("int").alias("sex_rank"),
    ).agg(S.row_count().alias("n"))


@query_of_all("first_last_periods", twin("visits", """
SELECT id_label, group_night, rev_night, phase, patch FROM visits
WHERE (group_night < 3 AND group_night > 0) OR rev_night < 3"""))
def first_last_periods(t: Tables):
    night = F.col("group_night")
    return t.visits.where(((night < 3) & (night > 0)) | (F.col("rev_night") < 3)).select(
        "id_label", "group_night", "rev_night", "phase", "patch")


# --- ratings -----------------------------------------------------------------

_G = "(1 / sqrt(1 + 3 * pow(ln(10) / 400, 2) * rd * rd / pow(pi(), 2)))"


def glicko_ctes(games: str, steps: int) -> str:
    """The batch update written out once per period."""
    ctes = [f"""
gp AS MATERIALIZED (SELECT cohort, group_night, id_label AS w, counterpart AS l, count(*) AS n
  FROM {games} WHERE counterpart IS NOT NULL GROUP BY ALL)""", """
gs AS MATERIALIZED (SELECT cohort, dense_rank() OVER (PARTITION BY cohort ORDER BY group_night) AS step,
    w AS player, l AS opponent, n, n AS points FROM gp
  UNION ALL SELECT cohort, dense_rank() OVER (PARTITION BY cohort ORDER BY group_night), l, w, n, 0
  FROM gp)""", """
s0 AS MATERIALIZED (SELECT DISTINCT cohort, player, 2200e0 AS rating, 300e0 AS rd,
  CAST(NULL AS BIGINT) AS last FROM gs)"""]
    for i in range(1, steps + 1):
        ctes.append(f"""
b{i} AS MATERIALIZED (SELECT *, {_G} AS g FROM (SELECT cohort, player, rating, last, rd AS old,
  least(sqrt(rd * rd + 225 * coalesce({i} - last, 0)), 350) AS rd FROM s{i - 1})),
m{i} AS MATERIALIZED (SELECT cohort, player, pow(ln(10) / 400, 2) * sum(n * g * g * e * (1 - e)) AS info,
    sum(g * (points - n * e)) AS surprise
  FROM (SELECT gs.*, o.g, 1 / (1 + pow(10e0, -o.g * (p.rating - o.rating) / 400)) AS e
    FROM gs JOIN b{i} p ON gs.cohort = p.cohort AND gs.player = p.player
    JOIN b{i} o ON gs.cohort = o.cohort AND gs.opponent = o.player WHERE step = {i})
  GROUP BY cohort, player),
s{i} AS MATERIALIZED (SELECT b.cohort, b.player,
    CASE WHEN m.player IS NULL THEN rating
      ELSE rating + ln(10) / 400 / (1 / (rd * rd) + info) * surprise END AS rating,
    CASE WHEN m.player IS NULL THEN old ELSE sqrt(1 / (1 / (rd * rd) + info)) END AS rd,
    CASE WHEN m.player IS NULL THEN last ELSE {i} END AS last
  FROM b{i} b LEFT JOIN m{i} m ON b.cohort = m.cohort AND b.player = m.player)""")
    return ",".join(ctes) + f""",
ratings AS (SELECT * FROM s{steps}),
ranking AS (SELECT cohort, player AS id_label, rating AS glicko_rating,
  CAST(row_number() OVER (PARTITION BY cohort ORDER BY round(rating, 6) DESC, player) AS INTEGER)
    AS glicko_rank FROM ratings)"""


def rated_twin(needs: str, games: str, steps: int, select: str) -> str:
    head = twin(needs, "").rstrip()
    return f"{head},{glicko_ctes(games, steps)}\n{select}"


RECENT = "(SELECT * FROM games WHERE rev_night <= 2 AND cond = 'test')"
TESTS = "(SELECT * FROM games WHERE cond = 'test')"


@query_of_all("glicko_last_nights", rated_twin("games", RECENT, 2, """
SELECT cohort, player, round(rating, 6) AS rating, round(rd, 6) AS rd FROM ratings"""))
def glicko_last_nights(t: Tables):
    table = ratings.glicko(ratings.recent_games(t.games))
    return rounded(table, "rating", "rd", digits=6).select("cohort", "player", "rating", "rd")


@query_of_all("glicko_all_nights", rated_twin("games", TESTS, 30, """
SELECT cohort, player, round(rating, 6) AS rating, round(rd, 6) AS rd FROM ratings"""))
def glicko_all_nights(t: Tables):
    return rounded(t.ratings_all, "rating", "rd", digits=6).select("cohort", "player", "rating", "rd")


@query_of_all("ranking", rated_twin("games", RECENT, 2, """
SELECT cohort, id_label, round(glicko_rating, 6) AS glicko_rating, glicko_rank FROM ranking"""))
def ranking(t: Tables):
    return rounded(t.ranking, "glicko_rating", digits=6)


def named_apart(ctes: str, tail: str) -> str:
    """The rating CTEs under other names, to have two ratings in one query."""
    names = [part.split(" AS ", 1)[0].strip() for part in re.findall(r"(?:^|,)\s*(\w+ AS (?:MATERIALIZED )?\()", ctes)]
    return re.sub(r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b", rf"\1{tail}", ctes)


@query_of_all("compare_rankings", twin("games", "").rstrip() + "," + glicko_ctes(TESTS, 30) + ","
       + named_apart(glicko_ctes(RECENT, 2), "_late") + """
SELECT a.cohort, a.id_label, round(a.glicko_rating, 6) AS rating_all, a.glicko_rank AS rank_all,
  round(b.glicko_rating, 6) AS rating_recent, b.glicko_rank AS rank_recent
FROM ranking a LEFT JOIN ranking_late b ON a.cohort IS NOT DISTINCT FROM b.cohort AND a.id_label = b.id_label""")
def compare_rankings(t: Tables):
    """Both ratings of each player, side by side."""
    both = ratings.compare_rankings(t.ratings_all, t.ranking)
    return rounded(both, "rating_all", "rating_recent", digits=6).select(
        "cohort", "id_label", "rating_all", "rank_all", "rating_recent", "rank_recent")


@query_of_all("scorecard", rated_twin("card", RECENT, 2, """
SELECT c.* REPLACE (round(chase_score, 9) AS chase_score, round(chased_score, 9) AS chased_score),
  round(glicko_rating, 6) AS glicko_rating, glicko_rank
FROM card c LEFT JOIN ranking USING (cohort, id_label)"""))
def scorecard(t: Tables):
    card = rounded(t.ranked_card, "chase_score", "chased_score")
    return rounded(card, "glicko_rating", digits=6)


@query_of_all("pair_shares", rated_twin("games", RECENT, 2, """
SELECT p.cohort, p.id_label, p.counterpart, n, round(n / sum(n) OVER (PARTITION BY p.cohort), 9) AS share,
  round(a.glicko_rating, 6) AS glicko_rating, round(b.glicko_rating, 6) AS rating_counterpart,
  round(a.glicko_rating - b.glicko_rating, 6) AS rating_gap
FROM (SELECT cohort, id_label, counterpart, count(*) AS n FROM games WHERE group_night > 0 GROUP BY ALL) p
LEFT JOIN ranking a ON p.cohort = a.cohort AND p.id_label = a.id_label
LEFT JOIN ranking b ON p.cohort = b.cohort AND p.counterpart = b.id_label"""))
def pair_shares(t: Tables):
    shares = rounded(S.pair_shares(t.games, t.ranking), "share")
    return rounded(shares, "glicko_rating", "rating_counterpart", "rating_gap", digits=6)


@query_of_all("pair_shares_of_dominant", rated_twin("statuses", RECENT, 2, """
SELECT p.cohort, p.id_label, p.counterpart, n, round(share, 9) AS share, status,
  round(a.glicko_rating, 6) AS glicko_rating, round(b.glicko_rating, 6) AS rating_counterpart,
  round(a.glicko_rating - b.glicko_rating, 6) AS rating_gap
FROM (SELECT *, n / sum(n) OVER (PARTITION BY cohort) AS share FROM (
  SELECT cohort, id_label, counterpart, count(*) AS n FROM games WHERE group_night > 0 GROUP BY ALL)) p
LEFT JOIN ranking a ON p.cohort = a.cohort AND p.id_label = a.id_label
LEFT JOIN ranking b ON p.cohort = b.cohort AND p.counterpart = b.id_label
JOIN statuses s ON p.cohort = s.cohort AND p.id_label = s.id_label WHERE status = 'Dominant males'"""))
def pair_shares_of_dominant(t: Tables):
    shares = rounded(S.pair_shares(t.games, t.ranking, t.statuses, "Dominant males"), "share")
    return rounded(shares, "glicko_rating", "rating_counterpart", "rating_gap", digits=6)


@query_of_all("rank_intake", rated_twin("statuses", RECENT, 2, """
SELECT r.cohort, r.id_label, r.phase, r.sex, s.glicko_rank, round(vol_hr, 9) AS vol_hr FROM (
  SELECT cohort, phase, sex, id_label, sum(vol_consumed) / nullif(sum(phase_dur), 0) AS vol_hr
  FROM visits WHERE rev_night <= 2 GROUP BY ALL) r
LEFT JOIN (SELECT id_label, cohort, glicko_rank FROM (
  SELECT DISTINCT id_label, cohort FROM card WHERE phase = 1 AND cond = 'test')
  LEFT JOIN ranking USING (cohort, id_label)) s USING (id_label, cohort)"""))
def rank_intake(t: Tables):
    scores = S.score_intake(t.ranked_card, S.recent_rate(t.visits, 2, 1))
    return rounded(S.rank_intake(scores, S.recent_rate(t.visits, 2)), "vol_hr").select(
        "cohort", "id_label", "phase", "sex", "glicko_rank", "vol_hr")
