"""Named queries with their SQL twins, and the staged tables they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.operators.joins import keyed_join
from nocturne.operators.pursuit import detect_pursuits, games
from nocturne.operators.runs import (
    apply_rules, event_timeline, exclusion_rules, id_lookup, repair_ids, trim_run,
)
from nocturne.operators.timeline import Timeline, numbered, seal
from nocturne.plans import effects, ratings, summaries
from nocturne.session import stage
from nocturne.queries.sql import of_every_user
from nocturne.sources import driver

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, every: bool = False):
    """Register ``f(tables) -> DataFrame`` under ``name``; with ``every`` over the
    log in which every user is an individual."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(tables(spark, sf_dir, every))
        if sql is not None:
            ORACLES[name] = of_every_user(sql) if every else sql
        return f

    return register


query_of_all = partial(query, every=True)


class Tables:
    """Tables derived from one data folder, each built once per session.

    The users are dealt among ``individuals``; without a number each is its own.
    The given tables are taken not to change meanwhile; after a change call
    `forget`."""

    def __init__(self, spark: SparkSession, sf_dir: str, individuals: int | None = None):
        self.spark, self.sf_dir, self.individuals = spark, sf_dir, individuals
        self.raw_root: str | None = None  # night files written from the log

    def read(self, name: str) -> DataFrame:
        return driver.read_table(self.spark, self.sf_dir, name)

    @cached_property
    def log(self) -> DataFrame:
        return driver.raw_log(self.spark, self.sf_dir, self.individuals)

    @cached_property
    def sealed_log(self) -> Timeline:
        rows = driver.source_rows(self.spark, self.sf_dir, self.individuals)
        return seal(rows, ["night"], ["ts", "event_id"], name="log", spans="ts", derive=driver.as_log)

    @cached_property
    def conditions(self) -> DataFrame:
        return stage(driver.conditions(self.spark, self.sf_dir, self.individuals), "conditions")

    @cached_property
    def lookup(self) -> DataFrame:
        return stage(id_lookup(self.conditions), "lookup")

    @cached_property
    def trimmed_log(self) -> Timeline:
        return trim_run(self.sealed_log)

    @cached_property
    def trimmed(self) -> DataFrame:
        return self.trimmed_log.table()

    @cached_property
    def labelled(self) -> Timeline:
        """The trimmed log with the individual behind each row."""
        return self.trimmed_log.with_df(repair_ids(self.trimmed_log.df, self.lookup))

    @cached_property
    def rules(self) -> DataFrame:
        return stage(exclusion_rules(self.labelled.df, self.conditions), "rules")

    @cached_property
    def kept(self) -> Timeline:
        """Without what the rules exclude; still in order, read by the fills."""
        return self.labelled.with_df(apply_rules(self.labelled.df, self.rules)).staged("kept")

    @cached_property
    def sealed_events(self) -> Timeline:
        """The event table in order."""
        return event_timeline(self.sealed_log, self.conditions, self.trimmed_log)

    @cached_property
    def hits(self) -> DataFrame:
        """The event table with pursuits: a reader detection right after a visit.

        Read off the staged event table, so each use asks for its own columns."""
        found = detect_pursuits(
            self.sealed_events, steps=("Co",), place=None, max_duration=2000
        )
        return found.position("n_event").table()

    @cached_property
    def durations(self) -> DataFrame:
        return stage(summaries.phase_durations(self.hits), "durations")

    @cached_property
    def visits(self) -> DataFrame:
        summary = summaries.visit_summary(self.hits, self.durations)
        return stage(summaries.with_reverse_nights(summary), "visits")

    @cached_property
    def reverse_nights(self) -> DataFrame:
        return summaries.reverse_nights(self.visits)

    @cached_property
    def games(self) -> DataFrame:
        return stage(games(self.hits, self.reverse_nights), "games")

    @cached_property
    def attributes(self) -> DataFrame:
        return stage(summaries.attributes_at(self.conditions, 5), "attributes")

    @cached_property
    def ratings_recent(self) -> DataFrame:
        return ratings.glicko(ratings.recent_games(self.games))

    @cached_property
    def ratings_all(self) -> DataFrame:
        return ratings.glicko(self.games.where(F.col("cond") == "test"))

    @cached_property
    def ranking(self) -> DataFrame:
        return ratings.ranking(self.ratings_recent)

    @cached_property
    def card(self) -> DataFrame:
        summary = summaries.pursuit_summary(self.hits)
        received = summaries.received_counts(self.hits)
        return stage(summaries.scorecard(summary, received, self.attributes), "card")

    @cached_property
    def ranked_card(self) -> DataFrame:
        return keyed_join(self.card, self.ranking, ["cohort", "id_label"])

    @cached_property
    def score_intake(self) -> DataFrame:
        return summaries.score_intake(self.card, summaries.recent_rate(self.visits, 2, 1))

    @cached_property
    def statuses(self) -> DataFrame:
        from nocturne.queries.behaviour import RATE, SCORE

        return stage(summaries.classify_status(self.score_intake, SCORE, RATE), "statuses")

    @cached_property
    def rewarded(self) -> DataFrame:
        return stage(summaries.rewarded_visits(self.hits, self.statuses), "rewarded")

    @cached_property
    def lines(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"),
            "l_orderkey", F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").alias("quantity"),
        )

    @cached_property
    def draws(self) -> DataFrame:
        """Line prices as draws: flag and status are the term."""
        lines = self.read("lineitem").select(
            F.lit("price").alias("model"), F.concat("l_returnflag", "l_linestatus").alias("term"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        )
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        placed = numbered(lines, ["model", "term"], order, "iter")
        value = F.col("l_extendedprice") / 1000 - 50
        return placed.select("model", "term", "iter", value.alias("value"))

    @cached_property
    def sorted_draws(self) -> Timeline:
        from nocturne.plans.draws import sorted_draws

        return sorted_draws(self.draws)

    @cached_property
    def bootstrap(self) -> DataFrame:
        from nocturne.queries.stats import PHASE, REPLICATES, SEX

        return stage(effects.bootstrap_draws(
            self.card, "n_chases", "n_detections", "id_label", SEX, PHASE, "chases", REPLICATES
        ), "bootstrap")


_tables: dict[tuple[str, str, bool], Tables] = {}


def tables(spark: SparkSession, sf_dir: str, every: bool = False) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir, every)
    if key not in _tables:
        _tables[key] = Tables(spark, sf_dir, None if every else driver.INDIVIDUALS)
    return _tables[key]


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Build the folder's tables anew when they are next needed."""
    for every in (False, True):
        _tables.pop((spark.sparkContext.applicationId, sf_dir, every), None)
