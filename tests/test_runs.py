"""Log cleaning on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nocturne.functions.columns import serial_to_timestamp, timestamp_to_serial
from nocturne.operators import runs
from nocturne.operators.pursuit import detect_pursuits
from nocturne.operators.timeline import seal

LOG = ("night int, event_seq int, ts timestamp_ntz, tag string, raw_label string, unit_label string, "
       "event_duration double, sense_duration double, reward_steps double, system_msg string")
T0 = dt.datetime(2015, 3, 9, 16)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def log_row(night, seq, msg="", label="", reward=None, tag=None, unit="exp", minutes=None, dur=None):
    return (night, seq, at(seq if minutes is None else minutes), tag, label, unit, dur, None, reward, msg)


def kept(spark, rows, chunks, **how):
    log = spark.createDataFrame(rows, LOG)
    out = runs.trim_run(seal(log, ["night"], ["ts", "event_seq"], chunks), **how).df
    return sorted((r.night, r.event_seq) for r in out.select("night", "event_seq").collect())


@pytest.mark.parametrize("chunks", [1, 5])
def test_trim(spark, chunks):
    msgs = ["", "start", "", "start", "", "", "end", ""]
    rows = [log_row(1, i, m, "Test" if m == "end" else "Ind1", 0.0) for i, m in enumerate(msgs)]
    # no start: from the first reward of an animal; the end without T is no end
    rows += [log_row(2, 0), log_row(2, 1, label="Test", reward=4.0), log_row(2, 2, label="", reward=4.0),
             log_row(2, 3, "end", ""), log_row(2, 4)]
    assert kept(spark, rows, chunks) == [(1, 4), (1, 5), (2, 2), (2, 3), (2, 4)]
    # a start too far down counts as missing
    assert kept(spark, rows[:8], chunks, max_start=3) == []


def test_trim_is_idempotent(spark):
    rows = [log_row(1, i, m, "Test", 1.0 if i == 2 else None)
            for i, m in enumerate(["start", "", "", "end", ""])]
    once = kept(spark, rows, 2)
    again = [r for r in rows if (1, r[1]) in once]
    again[1] = (*again[1][:4], "Ind1", *again[1][5:])
    assert once == [(1, 1), (1, 2)]
    assert kept(spark, again, 2) == [(1, 2)]  # the first reward now opens the run


PURSUIT = [  # kind, id, loc, duration, hit, counterpart
    ("CondMod", "A", 3, 900, False, None), ("LS", None, 3, 50, False, None),
    ("Reader", "B", 3, 120, True, "A"), ("CondMod", "B", 4, 100, False, None),
    ("LS", None, 4, 40, False, None), ("Reader", "A", 4, 200, False, None),
    ("CondMod", "A", 5, 800, False, None), ("LS", None, 5, 40, False, None),
    ("Reader", "B", 6, 90, False, None), ("CondMod", "C", 7, 600, False, None),
    ("LS", None, 7, 30, False, None), ("Reader", "C", 7, None, True, "C"),
    ("LS", None, 7, 30, False, None), ("Reader", "A", 7, 80, False, None),
]


@pytest.mark.parametrize("chunks", [1, 6, 14])
def test_pursuits(spark, chunks):
    rows = [(n, i, k, who, loc, None if d is None else float(d))
            for n in (1, 2) for i, (k, who, loc, d, _, _) in enumerate(PURSUIT)]
    df = spark.createDataFrame(
        rows, "night int, ts int, unit_label string, id_label string, loc int, event_duration double")
    found = detect_pursuits(seal(df, ["night"], ["ts"], chunks)).df
    got = [(r.hit, r.counterpart) for r in found.orderBy("night", "ts").collect()]
    assert got == [(h, c) for _ in (1, 2) for *_, h, c in PURSUIT]


def test_pursuits_exclude_self(spark):
    rows = [(1, i, k, who, loc, None if d is None else float(d))
            for i, (k, who, loc, d, _, _) in enumerate(PURSUIT)]
    df = spark.createDataFrame(
        rows, "night int, ts int, unit_label string, id_label string, loc int, event_duration double")
    found = detect_pursuits(seal(df, ["night"], ["ts"], 3), exclude_self=True).df
    assert [r.id_label for r in found.where("hit").collect()] == ["B"]


def test_exclusion(spark):
    conditions = spark.createDataFrame(
        [(1, "A", "RA", ">22:04"), (1, "B", "RB", ">02:00"), (1, "C", "RC", "1"), (1, "D", "RD", "0"),
         (1, "E", "RE", "<17:00")],
        "night int, id_label string, tag string, discard string")
    times = [dt.datetime(2015, 3, 9, 16), dt.datetime(2015, 3, 9, 22, 3, 59),
             dt.datetime(2015, 3, 9, 22, 4), dt.datetime(2015, 3, 10, 2), dt.datetime(2015, 3, 11),
             dt.datetime(2015, 3, 11, 0, 0, 1)]
    rows = [(1, who, t, i) for who in ["A", "B", "C", "D", "E", None] for i, t in enumerate(times)]
    log = spark.createDataFrame(rows, "night int, id_label string, ts timestamp_ntz, event_seq int")
    out = runs.drop_excluded(log, conditions)
    left = {}
    for r in out.collect():
        left.setdefault(r.id_label, []).append(times.index(r.ts))
    assert {k: sorted(v) for k, v in left.items()} == {
        "A": [0, 1, 5], "B": [0, 1, 2, 5], "D": [0, 1, 2, 3, 4, 5], "E": [1, 2, 3, 4, 5],
        None: [0, 1, 2, 3, 4, 5]}


def test_conditions_must_be_unique(spark):
    log = spark.createDataFrame([(1, "R1", 1, 1)], "night int, tag string, ts int, event_seq int")
    twice = spark.createDataFrame([(1, "R1", "A"), (1, "R1", "B")], "night int, tag string, id_label string")
    with pytest.raises(Exception, match="more than one row"):
        runs.repair_ids(log, runs.id_lookup(twice)).collect()


def test_salted_lookup_equals_broadcast(spark):
    rows = [(1, "R1" if i % 3 else None, i, i) for i in range(300)] + [(2, f"R{i}", i, i) for i in range(40)]
    log = spark.createDataFrame(rows, "night int, tag string, ts int, event_seq int")
    lookup = spark.createDataFrame([(n, f"R{i}", f"Ind{i}") for n in (1, 2) for i in range(30)],
                                   "night int, tag string, id_label string")
    plain = sorted(map(str, runs.repair_ids(log, lookup).collect()))
    salted = runs.repair_ids(log, lookup, salts=5)
    assert sorted(map(str, salted.collect())) == plain and len(plain) == 340


def test_pump_state_crosses_nights(spark):
    rows = [log_row(1, 0), log_row(1, 1, "start pump"), log_row(2, 0, minutes=900),
            log_row(2, 1, "end pump", minutes=901), log_row(2, 2, minutes=902)]
    tl = seal(spark.createDataFrame(rows, LOG), ["night"], ["ts", "event_seq"], 4)
    across = runs.carry_state(tl, runs.state_marks()).df
    within = runs.carry_state(tl, runs.state_marks(), across=False).df
    assert [r.pumping for r in across.orderBy("night", "ts").collect()] == [0, 1, 1, 0, 0]
    assert [r.pumping for r in within.orderBy("night", "ts").collect()] == [0, 1, 0, 0, 0]


def test_serial_time(spark):
    df = spark.createDataFrame([("42068,7083",)], "s string")
    row = df.select(serial_to_timestamp("s").alias("t")).select("t", timestamp_to_serial("t").alias("s")).first()
    assert row.t == dt.datetime(2015, 3, 5, 16, 59, 57, 120000)
    assert row.s.startswith("42068,7083000")


def test_event_table_same_for_any_chunks(spark):
    rng = __import__("random").Random(3)
    rows, conditions = [], []
    for night in (1, 2, 3):
        start = (night - 1) * 1440
        rows.append(log_row(night, 0, "start", minutes=start))
        for i in range(1, 60):
            who = rng.choice("ABC")
            tag = rng.choice([None, f"R{who}", "R?"])
            rows.append(log_row(night, i, rng.choice(["", "", "start p", "end p", "switch"]), "x",
                                rng.choice([None, 0.0, 8.0]), tag, rng.choice(["CondMod3", "LS3", "Reader7"]),
                                start + i * 11, rng.choice([None, 50.0, 900.0])))
        conditions += [(night, night - 1, w, f"R{w}", 9.0, "m", "g1", rng.choice(["0", ">20:00"]), "test")
                       for w in "ABC"]
    log = spark.createDataFrame(rows, LOG)
    conds = spark.createDataFrame(
        conditions, "night int, group_night int, id_label string, tag string, weight double, sex string, "
        "cohort string, discard string, cond string")
    tables = [sorted(map(str, runs.build_event_table(log, conds, chunks=c).collect())) for c in (1, 23)]
    assert tables[0] == tables[1] and len(tables[0]) > 100


def test_three_phases_stay_three(spark):
    rows = [log_row(1, 0), log_row(1, 1, "switch"), log_row(1, 2), log_row(1, 3, "switch", minutes=400), log_row(1, 4, minutes=401)]
    tl = seal(spark.createDataFrame(rows, LOG), ["night"], ["ts", "event_seq"], 2)
    assert [r.phase for r in runs.phase_of(tl).df.orderBy("ts", "event_seq").collect()] == [1, 2, 2, 3, 3]


def test_overlapping_nights_are_refused(spark):
    rows = [log_row(1, 0, minutes=0), log_row(1, 1, minutes=500), log_row(2, 0, minutes=300)]
    tl = seal(spark.createDataFrame(rows, LOG), ["night"], ["ts", "event_seq"], 2)
    with pytest.raises(ValueError, match="overlap"):
        runs.require_disjoint(tl)


def test_pursuits_need_no_second_order(spark):
    """events are written in order with the row before, so no pass sorts them again."""
    rows = [log_row(1, 0, "start")] + [
        log_row(1, i, tag=f"R{i % 2}", unit=["CondMod3", "Reader3"][i % 2], dur=9.0) for i in range(1, 20)]
    conditions = spark.createDataFrame(
        [(1, 0, f"Ind{i}", f"R{i}", 9.0, "m", "g1", "0", "test") for i in (0, 1)],
        "night int, group_night int, id_label string, tag string, weight double, sex string, "
        "cohort string, discard string, cond string")
    log = seal(spark.createDataFrame(rows, LOG), ["night"], ["ts", "event_seq"], 4, spans="ts")
    found = detect_pursuits(runs.event_timeline(log, conditions), steps=("Co",), place=None, max_duration=2000)
    hits = {r.event_seq: r.counterpart for r in found.df.where("hit").collect()}
    assert hits == {i: "Ind0" for i in range(3, 20, 2)}
    assert "Window [" not in found.df._jdf.queryExecution().optimizedPlan().toString()
