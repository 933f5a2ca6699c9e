"""Readers and sinks, exercised on files written from the given tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from nocturne.functions.columns import timestamp_to_serial
from nocturne.queries.registry import Tables, query
from nocturne.queries.sql import CTES, twin
from nocturne.session import staging_dir
from nocturne.sources import logs


def fresh(t: Tables, name: str) -> str:
    return os.path.join(staging_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


def comma(column: str):
    """A number as text with a decimal comma; null stays null."""
    text = F.replace(F.format_string("%.6f", column), F.lit("."), F.lit(","))
    return F.when(F.col(column).isNotNull(), text)


def raw_files(t: Tables) -> str:
    """The log written as UTF-16LE night files; times cut to the millisecond."""
    if t.raw_root is None:
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        zero = F.lit(0)
        seconds = (F.col("ts") - epoch).cast("interval second").cast("decimal(18,6)")
        cut = epoch + F.make_dt_interval(zero, zero, zero, F.floor(seconds, F.lit(3)).cast("decimal(18,6)"))
        mark = F.when(F.col("event_seq") % 50 == 0, F.lit("#")).otherwise(F.lit(""))
        text = t.log.select(
            "night",
            F.concat(mark, timestamp_to_serial(cut)).alias("DateTime"),
            F.col("tag").alias("IdRFID"), F.col("raw_label").alias("IdLabel"),
            F.col("unit_label").alias("unitLabel"),
            comma("event_duration").alias("eventDuration"),
            comma("sense_duration").alias("sense1duration"),
            comma("reward_steps").alias("reinforce1value"),
            F.col("system_msg").alias("SystemMsg"),
        )
        t.raw_root = fresh(t, "raw")
        logs.write_raw_logs(text, t.raw_root)
    return t.raw_root


def manifest_of(t: Tables, root: str):
    """A manifest with one entry per file written."""
    files = logs.list_files(t.spark, root).where(F.col("path").endswith(".csv"))
    night = F.regexp_extract("path", r"night=(-?\d+)/", 1).cast("int")
    return files.select(night.alias("night"), "path", F.lit("").alias("comments"))


CTES["file_log"] = """
SELECT night, event_seq, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms, tag, raw_label, unit_label,
  round(event_duration, 6) AS event_duration, round(reward_steps, 6) AS reward_steps, system_msg
FROM log WHERE event_seq % 50 <> 0"""


def millis(column: str):
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (F.col(column) - epoch).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1000).cast("long")


@query("raw_log_files", twin("file_log", """
SELECT night, ts_ms, tag, raw_label, unit_label, event_duration, reward_steps, system_msg FROM file_log"""))
def raw_log_files(t: Tables):
    root = raw_files(t)
    log = logs.load_logs(t.spark, root, manifest_of(t, root))
    return log.select(
        "night", millis("ts").alias("ts_ms"), "tag", "raw_label", "unit_label",
        F.round("event_duration", 6).alias("event_duration"),
        F.round("reward_steps", 6).alias("reward_steps"), "system_msg")


@query("marker_lines", twin("log", """
SELECT night, count(*) AS n FROM log WHERE event_seq % 50 = 0 GROUP BY night"""))
def marker_lines(t: Tables):
    root = raw_files(t)
    raw = logs.read_raw_logs(t.spark, root).join(manifest_of(t, root), "path")
    return raw.where(F.col("DateTime").contains("#")).groupBy("night").agg(
        F.count(F.lit(1)).alias("n"))


@query("missing_files", twin("log", """
SELECT DISTINCT night FROM log WHERE night % 2 = 0"""))
def missing_files(t: Tables):
    """Entries whose file is looked for in the wrong place."""
    root = raw_files(t)
    manifest = manifest_of(t, root)
    moved = manifest.withColumn("path", F.when(
        F.col("night") % 2 == 0, F.concat(F.lit("/moved"), "path")).otherwise(F.col("path")))
    return logs.missing_files(moved, logs.list_files(t.spark, root)).select("night").distinct()


@query("broken_manifest_entries", twin("log", """
SELECT DISTINCT night FROM log WHERE night % 3 = 0"""))
def broken_entries(t: Tables):
    root = raw_files(t)
    manifest = manifest_of(t, root)
    doubled = manifest.unionByName(manifest.where(F.col("night") % 3 == 0))
    return logs.broken_entries(doubled).select("night").distinct()


@query("conditions_file", twin("conditions", """
SELECT night, group_night, id_label, tag, weight, sex, cohort, discard, cond FROM conditions"""))
def conditions_file(t: Tables):
    path = fresh(t, "conditions")
    table = t.conditions.withColumnsRenamed(
        {"id_label": "IdLabel", "tag": "IdRFID", "cohort": "group"})
    logs.write_table(table.select(
        "night", "group_night", "IdLabel", "IdRFID", "weight", "sex", "group", "discard", "cond"), path)
    return logs.read_conditions(t.spark, path)


@query("manifest_file", twin("log", """
SELECT night, '/raw/night-' || night || '.csv' AS path, CASE WHEN night % 5 = 0 THEN 'late start' END
  AS comments FROM (SELECT DISTINCT night FROM log)"""))
def manifest_file(t: Tables):
    path = fresh(t, "manifest")
    nights = t.log.select("night").distinct().select(
        "night", F.concat(F.lit("/raw/night-"), F.col("night").cast("string"), F.lit(".csv")).alias("path"),
        F.when(F.col("night") % 5 == 0, "late start").alias("comments"))
    logs.write_table(nights, path)
    return logs.read_manifest(t.spark, path)


@query("event_table_by_night", twin("event_table", """
SELECT night, count(*) AS n, round(sum(vol), 6) AS vol FROM event_table GROUP BY night"""))
def event_table_by_night(t: Tables):
    """Write the event table by night and read all of it back."""
    path = fresh(t, "events")
    logs.write_events(t.sealed_events.table(), path)
    return logs.read_events(t.spark, path).groupBy("night").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("vol"), 6).alias("vol"))


@query("nights_written_again", twin("event_table", """
SELECT night, count(*) AS n, round(sum(CASE WHEN night % 5 = 0 THEN 2 * vol ELSE vol END), 6) AS vol
FROM event_table GROUP BY night"""))
def nights_written_again(t: Tables):
    """Write the event table, then every fifth night again with doubled volumes."""
    path = fresh(t, "events")
    events = t.sealed_events.table()
    logs.write_events(events, path)
    logs.replace_nights(events.where("night % 5 = 0").withColumn("vol", 2 * F.col("vol")), path)
    return logs.read_events(t.spark, path).groupBy("night").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("vol"), 6).alias("vol"))


@query("event_table_as_text", twin("event_table", """
SELECT night, event_seq, epoch_us(ts) AS ts_us, id_label, event_duration, phase, vol, choice
FROM event_table"""))
def event_table_as_text(t: Tables):
    """The event table as text with times, written and read back typed."""
    from nocturne.queries.behaviour import with_micros

    path = fresh(t, "text")
    rows = t.sealed_events.table().select(
        "night", "event_seq", "ts", "id_label", "event_duration", "phase", "vol", "choice")
    logs.write_table(rows, path)
    back = logs.read_table(
        t.spark, path, "night int, event_seq long, ts timestamp_ntz, id_label string, "
        "event_duration double, phase int, vol double, choice boolean")
    return with_micros(back)


@query("logs_to_event_table", twin("event_table", """
SELECT night, id_label, unit_label, phase, cohort, count(*) AS n FROM event_table GROUP BY ALL"""))
def logs_to_event_table(t: Tables):
    """From the UTF-16 files to the event table; here every line is kept."""
    from nocturne.operators.runs import build_event_table

    root = raw_files(t)
    raw = logs.read_raw_logs(t.spark, root)
    unmarked = raw.withColumn("DateTime", F.replace("DateTime", F.lit("#"), F.lit("")))
    log = logs.as_log(unmarked, manifest_of(t, root))
    events = build_event_table(log, t.conditions)
    return events.groupBy("night", "id_label", "unit_label", "phase", "cohort").agg(
        F.count(F.lit(1)).alias("n"))
