"""Log cleaning and pattern detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from nocturne.functions.columns import night_hour, seconds_between
from nocturne.operators import runs
from nocturne.operators.pursuit import detect_pursuits
from nocturne.queries.registry import Tables, query
from nocturne.queries.sql import twin


@query("trim_run", twin("trimmed", """
SELECT night, event_seq, unit_label, system_msg FROM trimmed"""))
def trim_run(t: Tables):
    return runs.trim_run(t.sealed_log).df.select("night", "event_seq", "unit_label", "system_msg")


@query("phase_counter", twin("log", """
SELECT night, event_seq, CAST(1 + sum(CASE WHEN system_msg = 'switch' THEN 1 ELSE 0 END) OVER (
  PARTITION BY night ORDER BY ts, event_seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS phase FROM log"""))
def phase_counter(t: Tables):
    return runs.phase_of(t.sealed_log).df.select("night", "event_seq", "phase")


@query("pump_state_across_nights", twin("log", """
SELECT night, event_seq, last_value(mark IGNORE NULLS) OVER (ORDER BY night, ts, event_seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pumping
FROM (SELECT *, CASE WHEN ts = (SELECT min(ts) FROM log) THEN 0e0
  WHEN system_msg LIKE '%start p%' THEN 1e0 WHEN system_msg LIKE '%end p%' THEN 0e0 END AS mark
  FROM log)"""))
def pump_state(t: Tables):
    carried = runs.carry_state(t.sealed_log, runs.state_marks())
    return carried.df.select("night", "event_seq", "pumping")


@query("pump_state_per_night", twin("log", """
SELECT night, event_seq, last_value(mark IGNORE NULLS) OVER (PARTITION BY night ORDER BY ts, event_seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pumping
FROM (SELECT *, CASE WHEN ts = min(ts) OVER (PARTITION BY night) THEN 0e0
  WHEN system_msg LIKE '%start p%' THEN 1e0 WHEN system_msg LIKE '%end p%' THEN 0e0 END AS mark
  FROM log)"""))
def pump_state_per_night(t: Tables):
    carried = runs.carry_state(t.sealed_log, runs.state_marks(), across=False)
    return carried.df.select("night", "event_seq", "pumping")


@query("repair_identities", twin("conditions", """
SELECT l.night, event_seq, l.tag, c.id_label FROM log l
LEFT JOIN (SELECT DISTINCT night, tag, id_label FROM conditions) c USING (night, tag)"""))
def repair_identities(t: Tables):
    return runs.repair_ids(t.log, t.lookup).select("night", "event_seq", "tag", "id_label")


@query("visit_columns", twin("log", """
SELECT event_seq, vol, CASE WHEN vol > 0 THEN 1e0 ELSE vol END AS rewarded, loc,
  CASE WHEN loc < 6 THEN 1 WHEN loc > 5 THEN 2 END AS patch,
  loc IS NOT NULL AND unit_label LIKE '%Cond%' AS choice
FROM (SELECT *, coalesce(reward_steps, 0e0) / 2 AS vol,
  TRY_CAST(nullif(regexp_extract(unit_label, '([0-9].*)$', 1), '') AS INTEGER) AS loc FROM log)"""))
def visit_columns(t: Tables):
    return runs.derive_visit_columns(t.log).select(
        "event_seq", "vol", "rewarded", "loc", "patch", "choice")


@query("exclusion_rules", twin("windows", """
SELECT night, id_label, epoch_us(low) AS low_us, epoch_us(high) AS high_us FROM windows
WHERE low IS NOT NULL"""))
def exclusion_rules(t: Tables):
    rules = t.rules
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def micros(c):
        seconds = (F.col(c) - epoch).cast("interval second").cast("decimal(18,6)")
        return (seconds * 1000000).cast("long")

    return rules.where(F.col("_low").isNotNull()).select(
        "night", "id_label", micros("_low").alias("low_us"), micros("_high").alias("high_us"))


@query("drop_excluded", twin("kept", """
SELECT night, event_seq, id_label, cohort, sex, cond FROM kept"""))
def drop_excluded(t: Tables):
    return runs.apply_rules(t.labelled.df, t.rules).select(
        "night", "event_seq", "id_label", "cohort", "sex", "cond")


@query("drop_excluded_without_times", twin("trimmed", """
SELECT t.night, event_seq, c.id_label FROM trimmed t LEFT JOIN conditions c USING (night, tag)
WHERE coalesce(c.discard, '0') <> '1'"""))
def drop_excluded_without_times(t: Tables):
    """Conditions whose rules name no times: whole individuals go, no anchor is looked for."""
    whole = t.conditions.withColumn(
        "discard", F.when(F.col("discard").rlike("[<>]"), "0").otherwise(F.col("discard")))
    return runs.drop_excluded(t.labelled.df, whole).select("night", "event_seq", "id_label")


@query("hours_of_night", twin("log", """
SELECT event_seq, CAST(hour(ts) AS INTEGER) AS hour, CAST((hour(ts) + 9) % 24 AS INTEGER) AS night_hour
FROM log WHERE hour(ts) > 15 OR hour(ts) < 4"""))
def hours_of_night(t: Tables):
    return t.log.where(runs.in_night("ts")).select(
        "event_seq", F.hour("ts").alias("hour"), night_hour("ts").alias("night_hour"))


@query("fill_global", twin("kept", """
SELECT event_seq, last_value(cohort IGNORE NULLS) OVER w AS cohort,
  last_value(group_night IGNORE NULLS) OVER w AS group_night FROM kept
WINDOW w AS (ORDER BY ts, event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def fill_global(t: Tables):
    return runs.fill_across(t.kept, ["cohort", "group_night"]).df.select(
        "event_seq", "cohort", "group_night")


@query("fill_within_night", twin("kept", """
SELECT event_seq, last_value(cohort IGNORE NULLS) OVER (PARTITION BY night ORDER BY ts, event_seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cohort FROM kept"""))
def fill_within_night(t: Tables):
    return t.kept.running(last={"cohort": F.col("cohort")}).df.select("event_seq", "cohort")


@query("event_table", twin("event_table", """
SELECT night, event_seq, id_label, tag, unit_label, event_duration, system_msg, pumping, phase, vol,
  rewarded, loc, patch, choice, group_night, weight, sex, cohort, cond FROM event_table"""))
def event_table(t: Tables):
    return t.sealed_events.table().drop("ts")


def pursuit_twin(steps: list[str], place: str | None, limit: int, exclude_self: bool = False) -> str:
    """The pattern spelled out over plain window functions."""
    depth = len(steps)
    lags = ", ".join(
        f"lag(unit_label, {j}) OVER w AS u{j}, lag(id_label, {j}) OVER w AS i{j}"
        + (f", lag({place}, {j}) OVER w AS p{j}" if place else "")
        for j in range(1, depth + 1)
    )
    tests = [f"n <= {depth}", "id_label IS NULL", f"event_duration >= {limit}",
             "NOT unit_label LIKE '%Re%'", f"NOT u1 LIKE '%{steps[0]}%'"]
    if place:
        tests.append(" OR ".join(f"{place} <> p{j}" for j in range(1, depth + 1)))
    tests += [f"NOT u{j} LIKE '%{steps[j - 1]}%'" for j in range(2, depth + 1)]
    branches = " ".join(f"WHEN {test} THEN FALSE" for test in tests)
    own = f" AND id_label IS DISTINCT FROM i{depth}" if exclude_self else ""
    return twin("event_table", f"""
SELECT night, event_seq, id_label, i{depth} AS counterpart FROM (
  SELECT *, CASE {branches} ELSE TRUE END AS hit FROM (
    SELECT *, row_number() OVER w AS n, {lags} FROM event_table
    WINDOW w AS (PARTITION BY night ORDER BY ts, event_seq)))
WHERE hit{own}""")


def _found(t: Tables, **how):
    hits = detect_pursuits(t.sealed_events, **how).df.where("hit")
    return hits.select("night", "event_seq", "id_label", "counterpart")


@query("pursuits_strict", pursuit_twin(["LS", "Co"], "patch", 200))
def pursuits_strict(t: Tables):
    return _found(t, place="patch")


@query("pursuits_same_place", pursuit_twin(["LS", "Co"], "loc", 200))
def pursuits_same_place(t: Tables):
    """All three rows at one place, the last one brief."""
    return _found(t, place="loc", max_duration=200)


@query("pursuits_any_place", pursuit_twin(["LS", "Co"], None, 2000))
def pursuits_any_place(t: Tables):
    return _found(t, place=None, max_duration=2000)


@query("pursuits_direct", pursuit_twin(["Co"], None, 2000, True))
def pursuits_direct(t: Tables):
    return _found(t, steps=("Co",), place=None, max_duration=2000, exclude_self=True)


@query("pursuits_same_patch", pursuit_twin(["LS", "Co"], "patch", 2000))
def pursuits_same_patch(t: Tables):
    return _found(t, place="patch", max_duration=2000)


@query("lag_lead_rows", twin("log", """
SELECT night, event_seq, lag(unit_label, 1) OVER w AS unit_1, lag(unit_label, 2) OVER w AS unit_2
FROM log WINDOW w AS (PARTITION BY night ORDER BY ts, event_seq)"""))
def lag_rows(t: Tables):
    return t.sealed_log.lags(["unit_label"], 2).df.select(
        "night", "event_seq", F.col("lag1.unit_label").alias("unit_1"),
        F.col("lag2.unit_label").alias("unit_2"))


@query("row_positions", twin("log", """
SELECT night, event_seq, row_number() OVER (PARTITION BY night ORDER BY ts, event_seq) AS pos,
  row_number() OVER (PARTITION BY night ORDER BY ts DESC, event_seq DESC) AS pos_from_end FROM log"""))
def row_positions(t: Tables):
    placed = t.sealed_log.position("pos").position_from_end("pos_from_end")
    return placed.df.select("night", "event_seq", "pos", "pos_from_end")


@query("row_slice", twin("log", """
SELECT night, event_seq FROM (SELECT night, event_seq,
  row_number() OVER (PARTITION BY night ORDER BY ts, event_seq) AS pos FROM log)
WHERE pos BETWEEN 3 AND 20"""))
def row_slice(t: Tables):
    placed = t.sealed_log.position("pos").df
    return placed.where(F.col("pos").between(3, 20)).select("night", "event_seq")


@query("night_start_on_rows", twin("log", """
SELECT night, event_seq, round(date_diff('microsecond', min(ts) OVER (PARTITION BY night), ts) / 1e6, 6)
  AS seconds_in FROM log"""))
def night_start(t: Tables):
    first = t.sealed_log.df.groupBy("night").agg(F.min("ts").alias("start"))
    return t.sealed_log.attach(first).df.select(
        "night", "event_seq", F.round(seconds_between("start", "ts"), 6).alias("seconds_in"))


@query("first_of_log", twin("log", """
SELECT event_seq, ts = (SELECT min(ts) FROM log) AS is_first FROM log"""))
def first_of_log(t: Tables):
    return t.log.select(
        "event_seq", (F.col("ts") == t.log.agg(F.min("ts")).scalar()).alias("is_first"))
