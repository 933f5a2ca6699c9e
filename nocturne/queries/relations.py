"""Joins, reshaping and scalar functions on the star schema and the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from nocturne.functions.columns import (
    arcsine, label_rank, place_of, recode, serial_to_timestamp, timestamp_to_serial,
)
from nocturne.operators.joins import in_role, keyed_join, members_of, unique_rows
from nocturne.operators.runs import clock_of_night
from nocturne.operators.timeline import numbered
from nocturne.plans.summaries import centred, five_numbers
from nocturne.queries.behaviour import rounded
from nocturne.queries.registry import Tables, query
from nocturne.queries.sql import twin


@query("null_safe_join", twin("log", """
SELECT a.night, a.tag, n, m FROM (SELECT night, tag, count(*) AS n FROM log GROUP BY night, tag) a
LEFT JOIN (SELECT tag, count(*) AS m FROM log GROUP BY tag) b ON a.tag IS NOT DISTINCT FROM b.tag"""))
def null_safe_join(t: Tables):
    nightly = t.log.groupBy("night", "tag").agg(F.count(F.lit(1)).alias("n"))
    overall = t.log.groupBy("tag").agg(F.count(F.lit(1)).alias("m"))
    return keyed_join(nightly, overall, ["tag"], "left", null_safe=True)


@query("plain_join_drops_null_keys", twin("log", """
SELECT a.night, a.tag, n, m FROM (SELECT night, tag, count(*) AS n FROM log GROUP BY night, tag) a
LEFT JOIN (SELECT tag, count(*) AS m FROM log GROUP BY tag) b ON a.tag = b.tag"""))
def plain_join(t: Tables):
    nightly = t.log.groupBy("night", "tag").agg(F.count(F.lit(1)).alias("n"))
    overall = t.log.groupBy("tag").agg(F.count(F.lit(1)).alias("m"))
    return keyed_join(nightly, overall, ["tag"])


@query("two_roles", """
SELECT o_orderpriority, c.n_name AS buyer, s.n_name AS seller, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation c ON c_nationkey = c.n_nationkey JOIN nation s ON s_nationkey = s.n_nationkey
GROUP BY ALL""")
def two_roles(t: Tables):
    """One dimension joined in two roles, after counting by its keys."""
    lines = t.read("lineitem").select("l_orderkey", "l_suppkey")
    orders = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    buyers = t.read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("buyer_key"))
    sellers = t.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("seller_key"))
    counts = (
        lines.join(orders, "l_orderkey").join(buyers, "o_custkey").join(sellers, "l_suppkey")
        .groupBy("o_orderpriority", "buyer_key", "seller_key").agg(F.count(F.lit(1)).alias("n"))
    )
    nations = t.read("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    buyer = in_role(nations, "key", "buyer_key").withColumnRenamed("name_buyer_key", "buyer")
    seller = in_role(nations, "key", "seller_key").withColumnRenamed("name_seller_key", "seller")
    return counts.join(buyer, "buyer_key").join(seller, "seller_key").select(
        "o_orderpriority", "buyer", "seller", "n")


@query("members_of_list", """
SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (
  SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%')""")
def members(t: Tables):
    regions = t.read("region").where(F.col("r_name").startswith("A")).select(
        F.col("r_regionkey").alias("n_regionkey"))
    nations = members_of(t.read("nation"), regions, ["n_regionkey"]).select(
        F.col("n_nationkey").alias("s_nationkey"))
    return members_of(t.read("supplier"), nations, ["s_nationkey"]).select("s_suppkey", "s_name")


@query("right_join_keeps_all", """
SELECT n_name, cnt FROM (SELECT s_nationkey, count(*) AS cnt FROM supplier GROUP BY s_nationkey)
RIGHT JOIN nation ON s_nationkey = n_nationkey""")
def right_join(t: Tables):
    counts = t.read("supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("cnt"))
    nations = t.read("nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return keyed_join(counts, nations, ["key"], "right").select("n_name", "cnt")


@query("distinct_dimension", twin("conditions", """
SELECT DISTINCT id_label, cohort, sex FROM conditions"""))
def distinct_dimension(t: Tables):
    return unique_rows(t.conditions, ["id_label", "cohort", "sex"], ["id_label"])


@query("share_of_total", """
SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 9) AS share
FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)""")
def share_of_total(t: Tables):
    counts = t.read("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("o_orderstatus").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "o_orderstatus")
    return shares.select("o_orderstatus", "o_orderpriority", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query("wide_to_long", """
SELECT o_custkey, 'F' AS status, f AS total FROM (
  SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 4) AS f
  FROM orders GROUP BY o_custkey)
UNION ALL SELECT o_custkey, 'O', o FROM (
  SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 4) AS o
  FROM orders GROUP BY o_custkey)""")
def wide_to_long(t: Tables):
    def of(status):
        amount = F.when(F.col("o_orderstatus") == status, F.col("o_totalprice")).otherwise(0.0)
        return F.round(F.sum(amount), 4).alias(f"total_{status}")

    wide = t.read("orders").groupBy("o_custkey").agg(of("F"), of("O"))
    long = wide.unpivot("o_custkey", ["total_F", "total_O"], "status", "total")
    return long.withColumn("status", F.regexp_replace("status", "^total_", ""))


@query("top_order_per_customer", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def top_order(t: Tables):
    """One per customer without a window: a partial aggregate on an ordered pair."""
    order = F.struct(-F.col("o_totalprice"), F.col("o_orderkey"))
    best = F.min_by(F.struct("o_orderkey", "o_totalprice"), order).alias("best")
    return t.read("orders").groupBy("o_custkey").agg(best).select("o_custkey", "best.*")


@query("numbered_within_group", """
SELECT c_mktsegment, c_custkey, row_number() OVER (
  PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer""")
def numbered_within(t: Tables):
    rows = t.read("customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return numbered(rows, ["c_mktsegment"], [F.desc("c_acctbal"), "c_custkey"]).drop("c_acctbal")


@query("price_five_numbers", """
SELECT flag, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(CASE WHEN price >= q1 - 1.5 * (q3 - q1) THEN price END) AS low,
  max(CASE WHEN price <= q3 + 1.5 * (q3 - q1) THEN price END) AS high
FROM (SELECT l_returnflag AS flag, l_extendedprice AS price FROM lineitem) JOIN (
  SELECT l_returnflag AS flag, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
    quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
  FROM lineitem GROUP BY l_returnflag) USING (flag) GROUP BY ALL""")
def price_five_numbers(t: Tables):
    rows = t.read("lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
    return rounded(five_numbers(rows, ["flag"], "price"), "q1", "median", "q3", digits=6)


@query("mean_and_error", """
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 9) AS mean,
  round(stddev_samp(l_quantity) / sqrt(count(*)), 9) AS se FROM lineitem GROUP BY ALL""")
def mean_and_error(t: Tables):
    return t.read("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg("l_quantity"), 9).alias("mean"),
        F.round(F.stddev_samp("l_quantity") / F.sqrt(F.count(F.lit(1))), 9).alias("se"))


@query("levels_of_aggregation", """
SELECT n_regionkey, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM (
  SELECT s_suppkey, n_regionkey, avg(q) AS m FROM (
    SELECT l_suppkey, l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)
GROUP BY n_regionkey""")
def levels(t: Tables):
    """Sum per order, mean per supplier, mean and deviation per region."""
    sums = t.read("lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_quantity").alias("q"))
    means = sums.groupBy("l_suppkey").agg(F.avg("q").alias("m"))
    sellers = t.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    regions = means.join(sellers, "l_suppkey").join(t.read("nation"), "n_nationkey")
    return regions.groupBy("n_regionkey").agg(
        F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"))


@query("count_of_counts", """
SELECT n AS orders_placed, count(*) AS customers FROM (
  SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n""")
def count_of_counts(t: Tables):
    placed = t.read("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders_placed"))
    return placed.groupBy("orders_placed").agg(F.count(F.lit(1)).alias("customers"))


@query("centred_by_grand_mean", """
SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 6) AS centred FROM customer""")
def centred_by_mean(t: Tables):
    table = centred(t.read("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "centred")
    return rounded(table, "centred", digits=6).drop("c_acctbal")


@query("labels_joined_from_literals", """
SELECT label, count(*) AS n, round(sum(l_quantity), 4) AS quantity
FROM lineitem LEFT JOIN (VALUES ('A', 'accepted'), ('R', 'returned')) v(flag, label) ON flag = l_returnflag
GROUP BY label""")
def literal_labels(t: Tables):
    sums = t.read("lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    labels = t.spark.createDataFrame([("A", "accepted"), ("R", "returned")], "l_returnflag string, label string")
    return sums.join(labels, "l_returnflag", "left").groupBy("label").agg(
        F.sum("n").alias("n"), F.round(F.sum("quantity"), 4).alias("quantity"))


@query("not_all_of_set", twin("conditions", """
SELECT cohort, bool_or(discard NOT IN ('0', '1')) AS has_times FROM conditions GROUP BY cohort"""))
def not_all_of_set(t: Tables):
    return t.conditions.groupBy("cohort").agg(
        F.bool_or(~F.col("discard").isin("0", "1")).alias("has_times"))


@query("rules_without_times", twin("conditions", """
SELECT night, id_label FROM conditions WHERE discard = '0'"""))
def rules_without_times(t: Tables):
    return t.conditions.where(~F.col("discard").rlike("[<>]") & (F.col("discard") == "0")).select("night", "id_label")


@query("first_known_duration", twin("log", """
SELECT event_seq, coalesce(event_duration, sense_duration) AS duration, coalesce(tag, 'none') AS tag
FROM log"""))
def first_known(t: Tables):
    return t.log.select(
        "event_seq", F.coalesce("event_duration", "sense_duration").alias("duration"),
        F.coalesce("tag", F.lit("none")).alias("tag"))


@query("text_functions", twin("log", r"""
SELECT event_seq, TRY_CAST(nullif(regexp_extract(unit_label, '([0-9].*)$', 1), '') AS INTEGER) AS place,
  unit_label LIKE '%Cond%' AS is_visit, regexp_replace(unit_label, '^[A-Z]', '_') AS masked,
  substr(unit_label, 1, 2) AS kind, len(regexp_extract_all(unit_label, '[A-Z]')) AS capitals,
  unit_label || ' at ' || night AS described
FROM log"""))
def text_functions(t: Tables):
    unit = F.col("unit_label")
    return t.log.select(
        "event_seq", place_of("unit_label").alias("place"), unit.contains("Cond").alias("is_visit"),
        F.regexp_replace(unit, "^[A-Z]", "_").alias("masked"), F.substring(unit, 1, 2).alias("kind"),
        F.regexp_count(unit, F.lit("[A-Z]")).cast("long").alias("capitals"),
        F.format_string("%s at %d", "unit_label", "night").alias("described"))


@query("numeric_functions", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(asin(sqrt(l_discount)), 9) AS transformed,
  round(l_extendedprice, 1) AS rounded, greatest(l_discount, l_tax) AS larger,
  least(l_discount, l_tax) AS smaller,
  round(l_discount / nullif(l_tax, 0), 9) AS guarded FROM lineitem""")
def numeric_functions(t: Tables):
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(arcsine("l_discount"), 9).alias("transformed"),
        F.round("l_extendedprice", 1).alias("rounded"),
        F.greatest("l_discount", "l_tax").alias("larger"), F.least("l_discount", "l_tax").alias("smaller"),
        F.round(F.try_divide("l_discount", "l_tax"), 9).alias("guarded"))


@query("serial_times", twin("log", """
SELECT event_seq, (epoch_us(ts) + 500) // 1000 AS at_ms FROM log"""))
def serial_times(t: Tables):
    """Times to serial days and back, compared at the millisecond."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def seconds(c):
        return (c - epoch).cast("interval second").cast("decimal(18,6)")

    back = serial_to_timestamp(timestamp_to_serial("ts"))
    return t.log.select("event_seq", (seconds(back) * 1000).cast("long").alias("at_ms"))


@query("clock_times_of_night", twin("log", """
SELECT DISTINCT night, c AS clock, epoch_us(CAST(DATE '1970-01-01' + night AS TIMESTAMP)
  + to_days(CASE WHEN c < '16:00' THEN 1 ELSE 0 END) + to_hours(CAST(substr(c, 1, 2) AS INTEGER))
  + to_minutes(CAST(substr(c, 4, 2) AS INTEGER))) // 1000000 AS at_second
FROM log, (VALUES ('22:04'), ('02:00'), ('15:59'), ('16:00')) v(c)"""))
def clock_times(t: Tables):
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    clocks = F.explode(F.array(*[F.lit(c) for c in ("22:04", "02:00", "15:59", "16:00")]))
    nights = t.log.select("night").distinct().select("night", clocks.alias("clock"))
    anchor = F.date_from_unix_date("night").cast("timestamp_ntz")
    at = clock_of_night(F.col("clock"), anchor) - epoch
    return nights.select("night", "clock", at.cast("interval second").cast("decimal(18,6)").cast("long").alias("at_second"))


@query("union_by_name", """
SELECT key, name, source, balance FROM (
  SELECT c_custkey AS key, c_name AS name, 'customer' AS source, c_acctbal AS balance FROM customer
  UNION ALL SELECT s_suppkey, s_name, 'supplier', NULL FROM supplier)""")
def union_by_name(t: Tables):
    customers = t.read("customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.lit("customer").alias("source"), F.col("c_acctbal").alias("balance"))
    suppliers = t.read("supplier").select(
        F.lit("supplier").alias("source"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


# Order of the priorities, and shorter names for them
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("ordered_categories", """
SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'soon' END AS label,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
    WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END AS place, n
FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority) ORDER BY place""")
def ordered_categories(t: Tables):
    counts = t.read("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "o_orderpriority", recode("o_orderpriority", {"1-URGENT": "now", "2-HIGH": "soon"}).alias("label"),
        label_rank("o_orderpriority", PRIORITIES).cast("int").alias("place"), "n").orderBy("place")
