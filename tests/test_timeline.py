"""The chunked operators against the single-partition windows they replace."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.operators.timeline import numbered, seal


def _rows(seed, n=400):
    rng = random.Random(seed)
    # one night holds most rows; some nights hold a single one
    nights = [1] * 6 + [2, 3] + [4] * 2
    return [
        (rng.choice(nights) if i > 8 else 5 + i, rng.randrange(60), i,
         rng.choice([None, None, 0, 1, 2]), rng.choice("abc"))
        for i in range(n)
    ]


@pytest.mark.parametrize("chunks", [1, 3, 17, 60])
def test_matches_plain_windows(spark, chunks):
    df = spark.createDataFrame(_rows(chunks), "night int, ts int, seq int, v int, s string")
    tl = seal(df, ["night"], ["ts", "seq"], chunks)
    got = (
        tl.position("pos").position_from_end("rpos")
        .running(sums={"rs": F.col("v")}, maxima={"rm": F.col("v")}, last={"fill": F.col("v")})
        .lags(["v", "s"], 3)
        .table()
    )
    w = W.partitionBy("night").orderBy("ts", "seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    row = F.struct("v", "s")
    want = df.select(
        "*",
        F.row_number().over(w).alias("pos"),
        F.row_number().over(W.partitionBy("night").orderBy(F.desc("ts"), F.desc("seq"))).alias("rpos"),
        F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("rs"),
        F.max("v").over(upto).alias("rm"),
        F.last("v", ignorenulls=True).over(upto).alias("fill"),
        *[F.lag(row, j).over(w).alias(f"lag{j}") for j in (1, 2, 3)],
    )
    key = lambda r: r["seq"]
    assert [r.asDict(True) for r in sorted(got.select(want.columns).collect(), key=key)] == [
        r.asDict(True) for r in sorted(want.collect(), key=key)]


@pytest.mark.parametrize("chunks", [1, 5, 40])
def test_global_fill(spark, chunks):
    df = spark.createDataFrame(_rows(7), "night int, ts int, seq int, v int, s string")
    tl = seal(df, [], ["ts", "seq"], chunks)
    got = tl.running(last={"fill": F.col("v")}).table()
    upto = W.orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumn("fill", F.last("v", ignorenulls=True).over(upto))
    assert sorted((r.seq, r.fill) for r in got.collect()) == sorted((r.seq, r.fill) for r in want.collect())


def test_fill_over_empty_chunk(spark):
    values = [1, None, None, None, None, 0]
    df = spark.createDataFrame(list(enumerate(values)), "seq int, v int")
    got = seal(df, [], ["seq"], 3).running(last={"fill": F.col("v")}).table()
    assert [r.fill for r in got.orderBy("seq").collect()] == [1, 1, 1, 1, 1, 0]


def test_hot_partition_is_spread(spark):
    df = spark.range(20000).select(F.lit(1).alias("night"), F.col("id").alias("ts"))
    tl = seal(df, ["night"], ["ts"], 10)
    sizes = [r["_rows"] for r in tl.index.collect()]
    assert len(sizes) == 10 and max(sizes) < 4000


def test_null_partition_fails(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "night int, ts int")
    with pytest.raises(Exception, match="null in a partition column"):
        seal(df, ["night"], ["ts"])


@pytest.mark.parametrize("chunks", [1, 7])
def test_staged_after_a_filter(spark, chunks):
    """Positions, lags and fills of the rows that are left."""
    df = spark.createDataFrame(_rows(21), "night int, ts int, seq int, v int, s string")
    tl = seal(df, ["night"], ["ts", "seq"], chunks).where("seq % 3 <> 0")
    direct = tl.lags(["v"], 2).df.select("seq", "lag1", "lag2")
    staged = tl.staged()
    got = staged.position("pos").lags(["v"], 2).table().select("seq", "pos", "lag1", "lag2")
    w = W.partitionBy("night").orderBy("ts", "seq")
    want = df.where("seq % 3 <> 0").select(
        "seq", F.row_number().over(w).alias("pos"),
        *[F.lag(F.struct("v"), j).over(w).alias(f"lag{j}") for j in (1, 2)])
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(got) == rows(want) and rows(direct) == rows(want.drop("pos"))
    staged.release()


def test_numbered_descending(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "y"), ("a", 3.0, "z"), ("b", 2.0, "x")],
                               "g string, r double, id string")
    got = numbered(df, ["g"], [F.desc("r"), "id"], chunks=3)
    assert {(r.g, r.id): r.pos for r in got.collect()} == {
        ("a", "y"): 1, ("a", "z"): 2, ("a", "x"): 3, ("b", "x"): 1}


@pytest.mark.parametrize("chunks", [1, 7, 30])
def test_fill_across_partitions(spark, chunks):
    df = spark.createDataFrame(_rows(11), "night int, ts int, seq int, v int, s string")
    tl = seal(df, ["night"], ["ts", "seq"], chunks)
    got = tl.running(sums={"rs": F.col("v")}, last_across={"fill": F.col("v")}).table()
    everything = W.orderBy("night", "ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    each = W.partitionBy("night").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("seq", F.last("v", ignorenulls=True).over(everything).alias("fill"),
                     F.coalesce(F.sum("v").over(each), F.lit(0)).alias("rs"))
    assert sorted(map(tuple, got.select("seq", "fill", "rs").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("chunks", [1, 7, 60])
def test_written_rows_know_all_rows(spark, chunks):
    """Running values over all rows, lags and positions over the kept ones, in one order."""
    df = spark.createDataFrame(_rows(5), "night int, ts int, seq int, v int, s string")
    marked = df.withColumn("keep", F.col("seq") % 3 != 0)
    tl = seal(marked, ["night"], ["ts", "seq"], chunks).written(
        "keep", {"rs": F.coalesce("v", F.lit(0))}, {"fill": F.col("v")}, ["v", "s"], 2)
    got = tl.position("pos").lags(["s"], 2)
    assert "Window [" not in got.df._jdf.queryExecution().optimizedPlan().toString()
    night = W.partitionBy("night").orderBy("ts", "seq")
    log = W.orderBy("night", "ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    want = marked.withColumns({
        "rs": F.sum(F.coalesce("v", F.lit(0))).over(night), "fill": F.last("v", ignorenulls=True).over(log),
    }).where("keep").withColumns({
        "pos": F.row_number().over(night),
        **{f"lag{j}": F.lag(F.struct("s"), j).over(night) for j in (1, 2)}})
    names = ["seq", "rs", "fill", "pos", "lag1", "lag2"]
    rows = lambda d: sorted(map(str, d.select(*names).collect()))
    assert rows(got.table()) == rows(want)
    assert not [c for c in tl.table().columns if c.startswith("_")]
    tl.release()


def test_columns_derived_after_the_order(spark):
    df = spark.createDataFrame(_rows(9), "night int, ts int, seq int, v int, s string")
    twice = lambda d: d.withColumn("double", F.col("seq") * 2)
    got = seal(df, ["night"], ["ts", "seq"], 5, derive=twice).position().table()
    want = seal(twice(df), ["night"], ["ts", "seq"], 5).position().table()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
