"""From raw night logs to the cleaned event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from nocturne.functions.columns import in_night, patch_of, place_of
from nocturne.operators.joins import keyed_join, lookup_join, unique_rows
from nocturne.operators.timeline import Timeline, seal
from nocturne.session import stage


def trim_run(log: Timeline, max_start: int | None = None, end_label: str = "T") -> Timeline:
    """Keep each night from after its last ``start`` to before the next ``end``.

    ``max_start`` is the last row at which a start is believed; by default any
    is.  Without a usable start the run begins at the first rewarded row that is not
    a test.  The end row must carry ``end_label`` in its label; without one the
    run goes to the last row.  Needs only aggregates by night over positions.
    """
    keys = list(log.partition_by)
    placed = log.position("_pos")
    rows = placed.df
    usable = F.col("_start").isNotNull() if max_start is None else F.col("_start") <= max_start
    begins = rows.groupBy(*keys).agg(
        (F.max(F.when(F.col("system_msg") == "start", F.col("_pos"))) + 1).alias("_start"),
        F.min(
            F.when((F.col("raw_label") != "Test") & (F.col("reward_steps") > 0), F.col("_pos"))
        ).alias("_reward"),
    ).select(
        *keys,
        F.when(usable, F.col("_start"))
        .otherwise(F.col("_reward")).alias("_from"),
    )
    ends = (
        rows.where((F.col("system_msg") == "end") & F.col("raw_label").contains(end_label))
        .join(begins, keys)
        .where(F.col("_pos") > F.col("_from"))
        .groupBy(*keys)
        .agg((F.min("_pos") - 1).alias("_to"))
    )
    # one row per night, read by every later branch of the plan
    bounded = placed.attach(stage(begins.join(ends, keys, "left"), "bounds"))
    inside = (F.col("_pos") >= F.col("_from")) & (
        F.col("_to").isNull() | (F.col("_pos") <= F.col("_to"))
    )
    return bounded.with_df(bounded.df.where(inside).drop("_pos", "_from", "_to"), whole=False)


def state_marks(message: str = "system_msg") -> Column:
    """1 at a pump start, 0 at a pump end, else null."""
    text = F.col(message)
    return F.when(text.contains("start p"), 1.0).when(text.contains("end p"), 0.0)


def carry_state(
    log: Timeline, marks: Column, name: str = "pumping", initial: float = 0.0,
    across: bool = True,
) -> Timeline:
    """On/off state carried forward in the order of the log.

    ``across`` lets the state run on from night to night; else every night
    starts anew.  Rows at the first time start at ``initial``.
    """
    return _carried(log, {name: (marks, initial)}, across)


def _carried(
    log: Timeline, states: dict[str, tuple[Column, float]], across: bool,
    sums: dict[str, Column] | None = None,
) -> Timeline:
    if across:
        first = log.df.agg(F.min("ts")).scalar()
        begun = log
    else:
        begun = log.attach(log.df.groupBy(*log.partition_by).agg(F.min("ts").alias("_first_ts")))
        first = F.col("_first_ts")
    start = F.col("ts") == first
    values = {n: F.when(start, F.lit(init)).otherwise(m) for n, (m, init) in states.items()}
    filled = begun.running(sums=sums, **{"last_across" if across else "last": values})
    return filled.with_df(filled.df.drop("_first_ts"))


def id_lookup(conditions: DataFrame) -> DataFrame:
    """The individual behind each (night, tag)."""
    return unique_rows(conditions, ["night", "tag", "id_label"], ["night", "tag"])


def repair_ids(log: DataFrame, lookup: DataFrame, **how) -> DataFrame:
    """Label each row by what the lookup says about (night, tag)."""
    return lookup_join(log, lookup, ["night", "tag"], ["ts", "event_seq"], **how)


def switches() -> Column:
    return F.when(F.col("system_msg") == "switch", 1).otherwise(0)


def phase_of(log: Timeline, name: str = "phase") -> Timeline:
    """1 + the switches seen so far in the night."""
    counted = log.running(sums={name: switches()})
    return counted.with_df(counted.df.withColumn(name, (F.col(name) + 1).cast("int")))


def phase_and_state(log: Timeline) -> Timeline:
    """Phase and pump state in one pass over the log."""
    both = _carried(log, {"pumping": (state_marks(), 0.0)}, True, {"phase": switches()})
    return both.with_df(both.df.withColumn("phase", (F.col("phase") + 1).cast("int")))


def derive_visit_columns(log: DataFrame) -> DataFrame:
    """Volume (half a microlitre per pump step), reward flag, place, patch, choice."""
    vol = F.coalesce("reward_steps", F.lit(0.0)) / 2
    loc = place_of("unit_label")
    return log.withColumns({
        "vol": vol,
        "rewarded": F.when(vol > 0, 1.0).otherwise(vol),
        "loc": loc,
        "patch": patch_of(loc),
        "choice": loc.isNotNull() & F.col("unit_label").contains("Cond"),
    })


def clock_time(rule: Column, sign: str) -> Column:
    """The HH:MM of a rule such as ``>22:04``; null for another sign."""
    return F.nullif(F.regexp_extract(rule, sign + r"([0-9]{2}:[0-9]{2})", 1), F.lit(""))


def clock_of_night(clock: Column, anchor: Column, noon: str = "16:00") -> Column:
    """A clock time as a timestamp of the night that starts on ``anchor``:
    times before ``noon`` belong to the next day."""
    hours = F.substring(clock, 1, 2).cast("int")
    minutes = F.substring(clock, 4, 2).cast("int")
    day = F.when(clock < noon, 1).otherwise(0)
    return anchor + F.make_dt_interval(day, hours, minutes, F.lit(0).cast("decimal(18,6)"))


def exclusion_window(rule: Column, anchor: Column) -> tuple[Column, Column]:
    """Both ends of the excluded time; null where the rule names no time.

    An open side reaches to the anchor or to two days after it.
    """
    after, before = clock_time(rule, ">"), clock_time(rule, "<")
    none = after.isNull() & before.isNull()
    two_days = anchor + F.make_dt_interval(F.lit(2))
    low = F.when(~none, F.coalesce(clock_of_night(after, anchor), anchor))
    high = F.when(~none, F.coalesce(clock_of_night(before, anchor), two_days))
    return low, high


def exclusion_rules(log: DataFrame, conditions: DataFrame) -> DataFrame:
    """Attributes of each (night, individual) with the times to leave out.

    The night of an individual is anchored at the date of its first row; that
    minimum is pre-aggregated, and only looked for where a rule needs it.
    """
    keys = ["night", "id_label"]
    attributes = unique_rows(
        conditions, [c for c in conditions.columns if c != "tag"], keys
    )
    timed = conditions.where(F.col("discard").rlike("[<>]")).select(*keys)
    anchors = (
        log.join(timed, keys, "left_semi")
        .groupBy(*keys)
        .agg(F.to_date(F.min("ts")).cast("timestamp_ntz").alias("_anchor"))
    )
    low, high = exclusion_window(F.col("discard"), F.col("_anchor"))
    return (
        attributes.join(anchors, keys, "left")
        .withColumns({"_low": low, "_high": high, "_all": F.col("discard") == "1"})
        .drop("discard", "_anchor")
    )


def with_rules(log: DataFrame, rules: DataFrame, name: str = "_kept", **how) -> DataFrame:
    """Join the attributes and mark the rows that the rules leave in.

    Rows without a known individual are left in, with null attributes."""
    return _marked(lookup_join(log, rules, ["night", "id_label"], ["ts", "event_seq"], **how), name)


def _marked(ruled: DataFrame, name: str = "_kept") -> DataFrame:
    inside = F.coalesce(F.col("ts").between(F.col("_low"), F.col("_high")), F.lit(False))
    return ruled.withColumn(name, ~F.coalesce(F.col("_all") | inside, F.lit(False))).drop(
        "_low", "_high", "_all")


def apply_rules(log: DataFrame, rules: DataFrame, **how) -> DataFrame:
    """Join the attributes and drop what the rules exclude."""
    return with_rules(log, rules, **how).where("_kept").drop("_kept")


def drop_excluded(log: DataFrame, conditions: DataFrame) -> DataFrame:
    return apply_rules(log, exclusion_rules(log, conditions))


def fill_global(log: DataFrame, columns: list[str], chunks: int | None = None) -> Timeline:
    """Carry values forward in time order over the whole log, across nights."""
    ordered = seal(log, [], ["ts", "event_seq"], chunks, "filled")
    return ordered.running(last={c: F.col(c) for c in columns})


def fill_across(log: Timeline, columns: list[str]) -> Timeline:
    """The same for a log in order by night: nights that follow each other are
    in the order of time already."""
    return log.running(last_across={c: F.col(c) for c in columns})


def require_disjoint(log: Timeline) -> None:
    """Raise if a night begins before the one before it has ended."""
    keys = list(log.partition_by)
    if log.spans is not None and log.whole:  # known from the sealing
        spans = log.spans.groupBy(*keys).agg(F.min("_least").alias("_begin"), F.max("_greatest").alias("_end"))
    else:
        spans = log.df.groupBy(*keys).agg(F.min("ts").alias("_begin"), F.max("ts").alias("_end"))
    # one row per night
    before = F.max("_end").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1))
    early = spans.withColumn("_before", before).where(F.col("_begin") < F.col("_before"))
    found = early.select(*keys).first()
    if found:
        raise ValueError(f"nights overlap: {found}; build the event table with overlapping=True")


# columns of the event table, in order
EVENT_COLUMNS = [
    "night", "event_seq", "ts", "id_label", "tag", "unit_label", "event_duration",
    "system_msg", "pumping", "phase", "vol", "rewarded", "loc", "patch", "choice",
    "group_night", "weight", "sex", "cohort", "cond",
]


def build_event_table(
    log: DataFrame,
    conditions: DataFrame,
    chunks: int | None = None,
    after: int = 15,
    before: int = 4,
    overlapping: bool = False,
) -> DataFrame:
    """Raw log and conditions to the event table.

    The log needs ``night, event_seq, ts, tag, raw_label, unit_label,
    event_duration, sense_duration, reward_steps, system_msg``.  It is put in
    order once, by night.  ``overlapping`` nights are not in the order of time
    then: the fill across nights needs a second order.
    """
    by_night = seal(log, ["night"], ["ts", "event_seq"], chunks, "log", "ts")
    if not overlapping:
        return event_timeline(by_night, conditions, after=after, before=before).table()
    kept = _event_rows(by_night, trim_run(by_night), conditions, after, before)
    return fill_global(kept.table(), FILLED, chunks).table().select(*EVENT_COLUMNS)


FILLED = ["group_night", "cohort", "cond"]


def event_timeline(
    log: Timeline, conditions: DataFrame, trimmed: Timeline | None = None, after: int = 15, before: int = 4
) -> Timeline:
    """The event table as a timeline of nights, from a log in order by night.

    Everything happens in that order, the fill across nights too, as nights
    follow each other (checked).  The log meets one table of facts by (night, tag),
    is put in order once more and written; all that is carried from chunk to chunk
    comes from the last rows of the chunks.
    """
    require_disjoint(log)
    trimmed = trimmed or trim_run(log)
    facts = _facts(trimmed, conditions)
    rows = _marked(lookup_join(
        derive_visit_columns(_timed(trimmed.df)), facts, ["night", "tag"], ["ts", "event_seq"]))
    rows = rows.withColumn("_kept", F.col("_kept") & in_night("ts", after, before))
    # phases and pump state count every row of the run, the fills only those that stay
    first = trimmed.df.agg(F.min("ts")).scalar()
    rows = rows.withColumn("_mark", F.when(F.col("ts") == first, F.lit(0.0)).otherwise(state_marks()))
    needed = [c for c in EVENT_COLUMNS if c not in ("phase", "pumping")]
    done = trimmed.with_df(rows.select(*needed, "_mark", "_kept", "_chunk", "_row")).written(
        "_kept",
        sums={"phase": switches()},
        last_across={"pumping": F.col("_mark"), **{c: F.when(F.col("_kept"), F.col(c)) for c in FILLED}},
        lagged=["unit_label", "id_label"], depth=1, name="events",
    )
    lags = [c for c in done.df.columns if c.startswith("_lag")]
    return done.with_df(done.df.withColumn("phase", (F.col("phase") + 1).cast("int")).select(
        *EVENT_COLUMNS, "_chunk", "_row", *lags))


def _facts(trimmed: Timeline, conditions: DataFrame) -> DataFrame:
    """The individual behind each (night, tag) with its rules, staged.

    Only rows of individuals whose rule names a time are looked at for anchors."""
    keys = ["night", "id_label"]
    lookup = stage(id_lookup(conditions), "lookup")
    timed = lookup.join(conditions.where(F.col("discard").rlike("[<>]")), keys, "left_semi")
    # anchors need no window, so they come from the rows before any pass
    rules = exclusion_rules(trimmed.df.join(timed, ["night", "tag"]), conditions)
    return stage(keyed_join(lookup, rules, keys), "facts")


def _timed(log: DataFrame) -> DataFrame:
    """The log with the sensed duration where there is no other."""
    return log.withColumn("event_duration", F.coalesce("event_duration", "sense_duration"))


def _event_rows(
    log: Timeline, trimmed: Timeline, conditions: DataFrame, after: int, before: int
) -> Timeline:
    facts = _facts(trimmed, conditions)
    passed = phase_and_state(trimmed)
    rows = derive_visit_columns(_timed(passed.df))
    kept = _marked(lookup_join(rows, facts, ["night", "tag"], ["ts", "event_seq"])).where("_kept")
    return passed.with_df(kept.where(in_night("ts", after, before)), whole=False)
