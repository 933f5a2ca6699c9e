"""The given star-schema tables read as an animal-tracking log.

``events`` are the detections, ``customer`` the individuals: every user's own, or
the first few dozen, among whom the users are dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.operators.joins import lookup_join
from nocturne.session import stage


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


INDIVIDUALS = 36  # so that an individual is seen in most phases and nights


def detections(spark: SparkSession, sf_dir: str, individuals: int | None = None) -> DataFrame:
    """Events, with the users folded into that many ``individuals`` if it is given."""
    events = read_table(spark, sf_dir, "events")
    if individuals is None:
        return events
    return events.withColumn("user_id", F.pmod("user_id", F.lit(individuals)))


def night_of(ts: str = "ts"):
    """Days since the epoch of the noon a night begins at."""
    return F.unix_date(F.to_date(F.col(ts) - F.make_dt_interval(F.lit(0), F.lit(12))))


def source_rows(spark: SparkSession, sf_dir: str, individuals: int | None = None) -> DataFrame:
    """The detections with their night and the event that is its switch: the first
    evening signup of a night that can be one."""
    switch = (F.col("event_type") == "signup") & F.hour("ts").between(20, 23) & (number() < 40)
    rows = detections(spark, sf_dir, individuals).withColumn("night", night_of())
    first = rows.where(switch).groupBy("night").agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("switch_id"))
    return lookup_join(rows, stage(first, "switches"), ["night"], ["event_id"])


def number():
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def raw_log(spark: SparkSession, sf_dir: str, individuals: int | None = None) -> DataFrame:
    return as_log(source_rows(spark, sf_dir, individuals))


def as_log(rows: DataFrame) -> DataFrame:
    """Purchases are visits, clicks beam interruptions, views reader detections;
    signups and errors carry the device messages.  Eight events in a row share a
    place.  Any other columns of the rows that begin with ``_`` stay."""
    k, kind, hour = F.col("k"), F.col("event_type"), F.hour("ts")
    place = (F.floor(F.col("event_id") / 8) % 10 + 1).cast("string")
    tagged = kind.isin("purchase", "view")
    animal = F.col("user_id").cast("string")
    return rows.withColumn("k", number()).select(
        "night",
        F.col("event_id").alias("event_seq"),
        "ts",
        F.when(tagged & (k % 25 == 0), "R?")
        .when(tagged, F.concat(F.lit("R"), animal)).alias("tag"),
        F.when(tagged & (k % 7 == 3), "")
        .when(tagged, F.concat(F.lit("Ind"), animal))
        .when(k % 2 == 0, "Test").otherwise("").alias("raw_label"),
        F.when(kind == "purchase", F.concat(F.lit("CondMod"), place))
        .when(kind == "click", F.concat(F.lit("LS"), place))
        .when(kind == "view", F.concat(F.lit("Reader"), place))
        .otherwise("exp").alias("unit_label"),
        F.when(k % 11 != 0, F.col("value") * 10).alias("event_duration"),
        F.when(k % 22 != 0, F.col("value") * 10).alias("sense_duration"),
        F.when((kind == "purchase") & (k % 4 == 0), 0.0)
        .when(kind == "purchase", F.col("value")).alias("reward_steps"),
        F.when((kind == "signup") & (hour == 12) & (k < 50), "start")
        .when((kind == "signup") & (hour == 11) & (k < 50), "end")
        .when(F.col("event_id") == F.col("switch_id"), "switch")
        .when((kind == "error") & (k < 50), "start pump")
        .when(kind == "error", "end pump").otherwise("").alias("system_msg"),
        *[c for c in rows.columns if c.startswith("_")],
    )


def conditions(spark: SparkSession, sf_dir: str, individuals: int | None = None) -> DataFrame:
    """One row per night and individual seen in it, with its attributes."""
    seen = (
        detections(spark, sf_dir, individuals)
        .select(night_of().alias("night"), F.col("user_id").alias("c_custkey"))
        .distinct()
    )
    first = read_table(spark, sf_dir, "events").agg(F.min(night_of())).scalar()
    group_night = F.col("night") - first - 1
    key, animal = F.col("c_custkey") % 40, F.col("c_custkey").cast("string")
    segment = F.lower("c_mktsegment")
    return seen.join(read_table(spark, sf_dir, "customer"), "c_custkey").select(
        "night",
        group_night.alias("group_night"),
        F.concat(F.lit("Ind"), animal).alias("id_label"),
        F.concat(F.lit("R"), animal).alias("tag"),
        F.col("c_acctbal").alias("weight"),
        F.when(F.col("c_nationkey") % 2 == 0, "m").otherwise("f").alias("sex"),
        F.when(segment.isin("household", "machinery"), F.concat(F.lit("mixed_"), segment))
        .otherwise(segment).alias("cohort"),
        F.when(key == 1, "1").when(key == 2, ">22:04").when(key == 3, "<18:30")
        .when(key == 4, ">02:00").when(key == 5, "<01:15").otherwise("0").alias("discard"),
        F.when(group_night < 1, "train").otherwise("test").alias("cond"),
    )
