"""The behaviour queries take every user as an individual of its own."""

import duckdb

from nocturne import queries
from tests.oracle import compare


def test_users_36_apart_are_two_individuals(spark, tmp_path):
    con = duckdb.connect()
    con.sql("""CREATE TABLE events AS SELECT range AS event_id, user_id, value, event_type, '{"k": 1}' AS props,
        TIMESTAMP '2024-01-01 12:30:00' + to_hours(CAST(range AS INTEGER)) AS ts
      FROM range(240) JOIN (VALUES (0, 10::BIGINT, 10e0, 'purchase'), (1, 46, 10e0, 'view')) v(i, user_id, value, event_type)
      ON range % 2 = i""")
    con.sql("""CREATE TABLE customer AS SELECT * FROM (VALUES (10::BIGINT, 1::INTEGER, 5e0, 'BUILDING'),
      (46, 2, 7e0, 'BUILDING')) v(c_custkey, c_nationkey, c_acctbal, c_mktsegment)""")
    for table in ("events", "customer"):
        con.sql(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    for name in ("attributes_at_night", "scorecard_without_rank", "games", "visit_summary"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        assert compare(df, con.sql(queries.ORACLES[name])) is None
    labels = {r["id_label"] for r in queries.QUERIES["attributes_at_night"](spark, str(tmp_path)).collect()}
    assert labels == {"Ind10", "Ind46"}
    pursued = {(r["id_label"], r["counterpart"]) for r in queries.QUERIES["games"](spark, str(tmp_path)).collect()}
    assert pursued == {("Ind46", "Ind10")}
