"""Ordered operators that never put a whole partition into one task.

A window over ``PARTITION BY night`` sorts a whole night in one task, and one
night may hold a third of the log.  A :class:`Timeline` is the log in range
order, cut into the ranges Spark chose by sampling the unique order key, so no
range is larger than a shuffle partition, however the nights are skewed.
Each ordered operator then works in two steps: inside each (partition, chunk),
and over one summary row per (partition, chunk) for what comes before it.
Both sides are keyed by (partition, chunk), so they meet without moving the
log again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from nocturne.session import input_bytes, stage, unstage

CHUNK_BYTES = 256 * 2**20  # of input per chunk, at most
# monotonically_increasing_id keeps the partition above bit 33
_ROW_MASK = 2**33 - 1


@dataclass(frozen=True)
class Timeline:
    df: DataFrame
    partition_by: tuple[str, ...]
    index: DataFrame
    whole: bool = True  # no row of the sealed log has been left out
    spans: DataFrame | None = None  # least and greatest of a column per (partition, chunk)
    lagged: tuple[str, ...] = ()  # columns of earlier rows of the chunk, in ``_lag1``, …

    @property
    def keys(self) -> list[str]:
        return [*self.partition_by, "_chunk"]

    @property
    def _inside(self):
        return W.partitionBy(*self.keys).orderBy("_row")

    @property
    def _earlier(self):
        """Chunks before this one; one row per (partition, chunk)."""
        return (
            W.partitionBy(*self.partition_by)
            .orderBy("_chunk")
            .rowsBetween(W.unboundedPreceding, -1)
        )

    @property
    def _earlier_across(self):
        """All (partition, chunk) before this one, in the order of the log."""
        return W.orderBy("_chunk", *self.partition_by).rowsBetween(W.unboundedPreceding, -1)

    def table(self) -> DataFrame:
        """The rows without the order columns."""
        return self.df.drop("_chunk", "_row", *self._lag_columns)

    @property
    def _lag_columns(self) -> list[str]:
        return [c for c in self.df.columns if self.lagged and c.startswith("_lag")]

    def with_df(self, df: DataFrame, whole: bool | None = None) -> Timeline:
        """The same timeline with columns added, or rows removed (``whole=False``).

        Positions count the rows of the sealed log; everything else sees the
        rows that are left.
        """
        return replace(self, df=df, whole=self.whole if whole is None else whole)

    def where(self, condition: Column | str) -> Timeline:
        return self.with_df(self.df.where(condition), whole=False)

    def staged(self, name: str = "timeline") -> Timeline:
        """The rows that are left, written in the same order and counted anew.

        No second sort of the log: chunks stay where they are.
        """
        inside = F.row_number().over(self._inside).cast("long") - 1
        df = stage(self.df.withColumn("_row", inside), name)
        return Timeline(df, self.partition_by, _index(df, self.partition_by, name))

    def release(self) -> None:
        """Delete the staged tables; nothing built on them may be read any more."""
        unstage(self.df)
        unstage(self.index)

    def attach(self, facts: DataFrame) -> Timeline:
        """Add one row of facts per partition to every row of it.

        The facts go through the chunk index, so that the join key is
        (partition, chunk) and a large partition stays spread.
        """
        if not self.partition_by:  # one row of facts: scalar subqueries
            return self.with_df(
                self.df.withColumns({c: facts.select(c).scalar() for c in facts.columns})
            )
        spread = self.index.select(*self.keys).join(facts, list(self.partition_by), "left")
        return self.with_df(self.df.join(spread, self.keys, "left"))

    def position(self, name: str = "pos") -> Timeline:
        """1-based row number within the partition: no sort, one small join."""
        df = self.df.join(self.index, self.keys, "left")
        rank = F.col("_before") + F.col("_row") - F.col("_first") + 1
        return self.with_df(
            df.withColumn(name, rank).drop("_before", "_first", "_rows")
        )

    def position_from_end(self, name: str = "pos") -> Timeline:
        """1-based row number counted from the last row of the partition."""
        later = (
            W.partitionBy(*self.partition_by).orderBy("_chunk").rowsBetween(0, W.unboundedFollowing)
        )
        left = self.index.select(
            *self.keys, "_first", F.sum("_rows").over(later).alias("_left")
        )
        df = self.df.join(left, self.keys, "left")
        rank = F.col("_left") - F.col("_row") + F.col("_first")
        return self.with_df(df.withColumn(name, rank).drop("_left", "_first"))

    def running(
        self,
        sums: Mapping[str, Column] | None = None,
        maxima: Mapping[str, Column] | None = None,
        last: Mapping[str, Column] | None = None,
        last_across: Mapping[str, Column] | None = None,
        staged: bool = False,
    ) -> Timeline:
        """Running sums, running maxima and last-non-null values, in one pass.

        ``last_across`` carries a value on from one partition to the next.
        ``staged`` writes what is carried, one row per chunk, so that Spark knows
        how small it is.
        """
        specs = [
            (sums or {}, F.sum, self._earlier),
            (maxima or {}, F.max, self._earlier),
            (last or {}, None, self._earlier),
            (last_across or {}, None, self._earlier_across),
        ]
        upto = self._inside.rowsBetween(W.unboundedPreceding, 0)
        totals, before, now = [], [], {}
        for columns, combine, earlier in specs:
            for name, column in columns.items():
                if combine is None:  # last value that is not null
                    total = F.max_by(column, F.when(column.isNotNull(), F.col("_row")))
                    was = F.last(f"_in_{name}", ignorenulls=True)
                    here = F.last(column, ignorenulls=True)
                else:
                    total, was, here = combine(column), combine(f"_in_{name}"), combine(column)
                totals.append(total.alias(f"_in_{name}"))
                before.append(was.over(earlier).alias(f"_was_{name}"))
                now[f"_now_{name}"] = here.over(upto)
        carry = self.df.groupBy(*self.keys).agg(*totals).select(*self.keys, *before)
        carry = stage(carry, "carry") if staged else carry
        df = self.df.withColumns(now).join(carry, self.keys, "left")
        zero = F.lit(0)
        merged = {
            n: F.coalesce(f"_now_{n}", zero) + F.coalesce(f"_was_{n}", zero) for n in specs[0][0]
        }
        merged |= {n: F.greatest(f"_now_{n}", f"_was_{n}") for n in specs[1][0]}
        merged |= {n: F.coalesce(f"_now_{n}", f"_was_{n}") for n in {**specs[2][0], **specs[3][0]}}
        df = df.withColumns(merged)
        return self.with_df(df.drop(*now, *[f"_was_{n}" for n in merged]))

    def written(
        self,
        keep: str,
        sums: Mapping[str, Column],
        last_across: Mapping[str, Column],
        lagged: Sequence[str] = (),
        depth: int = 0,
        name: str = "timeline",
    ) -> Timeline:
        """The rows for which ``keep`` holds, with `running` values over all rows.

        One pass puts the rows in order and writes those to keep, with what is
        known inside their chunk: the running values and, for `lags`, ``lagged``
        of the ``depth`` kept rows before.  A chunk's last row is written too; what
        is carried on from chunk to chunk is read from those.
        """
        upto = self._inside.rowsBetween(W.unboundedPreceding, 0)
        past = self._inside.rowsBetween(W.unboundedPreceding, -1)
        sums = {**sums, "_nth": F.when(F.col(keep), 1).otherwise(0)}
        now = {f"_in_{n}": F.sum(c).over(upto) for n, c in sums.items()}
        now |= {f"_in_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in last_across.items()}
        df = self.df.withColumns({**now, "_last": F.lead("_row").over(self._inside).isNull()})
        earlier = F.struct(*lagged)
        for j in range(1, depth + 1):
            df = df.withColumn(
                f"_lag{j}", F.last(F.when(F.col(keep), earlier), ignorenulls=True).over(past))
            earlier = F.col(f"_lag{j}")
        rows = stage(
            df.where(F.col(keep) | F.col("_last")).drop("_row", *sums, *last_across), name)
        was = {n: F.sum(f"_in_{n}").over(self._earlier) for n in sums}
        was |= {n: F.last(f"_in_{n}", ignorenulls=True).over(self._earlier_across) for n in last_across}
        carry = stage(
            rows.where("_last").select(
                *self.keys, F.col("_in__nth").alias("_rows"), *[c.alias(f"_was_{n}") for n, c in was.items()]),
            f"{name}-index",
        )
        zero = F.lit(0)
        merged = {n: F.coalesce(f"_in_{n}", zero) + F.coalesce(f"_was_{n}", zero) for n in sums}
        merged |= {n: F.coalesce(f"_in_{n}", f"_was_{n}") for n in last_across}
        merged["_row"] = merged.pop("_nth") - 1
        kept = rows.where(keep).join(carry.drop("_rows"), self.keys, "left").withColumns(merged)
        kept = kept.drop("_last", *now, *[f"_was_{n}" for n in was])
        before = F.coalesce("_was__nth", zero)
        index = carry.where(F.col("_rows") > 0).select(
            *self.keys, "_rows", before.alias("_first"), before.alias("_before"))
        # what `release` deletes
        kept._staged_path, index._staged_path = rows._staged_path, carry._staged_path
        return Timeline(kept, self.partition_by, index, lagged=tuple(lagged))

    def lags(self, columns: Sequence[str], depth: int, name: str = "lag") -> Timeline:
        """``{name}1`` … ``{name}depth``: structs of earlier rows, null if none.

        Only the last ``depth`` rows of each chunk are looked at across chunks;
        the index knows them, unless rows were left out since.  Rows that were
        `written` with these columns need no order again.
        """
        row = F.struct(*columns)
        values = self.df.select(*self.keys, "_row", row.alias("_v"))
        if self.whole:
            ends = self.index.select(*self.keys, (F.col("_first") + F.col("_rows") - depth).alias("_from"))
            tails = values.join(ends, self.keys).where(F.col("_row") >= F.col("_from")).drop("_from")
        else:
            newest = W.partitionBy(*self.keys).orderBy(F.desc("_row"))
            tails = values.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= depth)
        across = W.partitionBy(*self.partition_by).orderBy("_chunk", "_row")
        previous = F.lag("_chunk").over(across)
        carry = (
            tails.select(
                *self.keys,
                previous.alias("_prev_chunk"),
                F.array(*[F.lag("_v", j).over(across) for j in range(1, depth + 1)]).alias("_tail"),
            )
            .where(F.col("_prev_chunk").isNull() | (F.col("_prev_chunk") != F.col("_chunk")))
            .drop("_prev_chunk")
        )
        if self.whole and set(columns) <= set(self.lagged) and f"_lag{depth}" in self.df.columns:
            # one row per chunk, staged so that Spark knows how small it is
            carry = stage(carry.join(self.index.select(*self.keys, "_first"), self.keys), "tails")
            number = (F.col("_row") - F.col("_first") + 1).cast("int")
            here = {f"{name}{j}": F.struct(*[F.col(f"_lag{j}")[c].alias(c) for c in columns])
                    for j in range(1, depth + 1)}
            df = self.df.join(carry, self.keys, "left").withColumns({"_n": number, **here}).drop("_first")
        else:
            number = F.row_number().over(self._inside)
            here = {f"{name}{j}": F.lag(row, j).over(self._inside) for j in range(1, depth + 1)}
            df = self.df.withColumns({"_n": number, **here}).join(carry, self.keys, "left")
        for j in range(1, depth + 1):
            reach = F.get("_tail", F.lit(j) - F.col("_n"))
            df = df.withColumn(f"{name}{j}", F.when(F.col("_n") > j, F.col(f"{name}{j}")).otherwise(reach))
        return self.with_df(df.drop("_n", "_tail", *self._lag_columns))


def seal(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str | Column],
    chunks: int | None = None,
    name: str = "timeline",
    spans: str | None = None,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> Timeline:
    """Put ``df`` into range order and stage it; with ``spans`` the index knows the
    least and the greatest value of that column.  ``derive`` computes columns row by
    row after the rows were sampled and moved, which else happens before, and twice.

    ``partition_by`` + ``order_by`` must be unique per row; a null partition
    column fails at run time (see `grouping`).  The number of chunks follows
    the size of the input where that asks for more than the session's number
    of shuffle partitions; below it AQE decides.
    """
    order = [*partition_by, *order_by]
    missing = F.raise_error(F.lit(f"null in a partition column of {list(partition_by)}"))
    df = df.withColumns({
        c: F.when(F.col(c).isNull(), missing).otherwise(F.col(c)) for c in partition_by})
    if chunks is None:
        wanted = -(-input_bytes(df) // CHUNK_BYTES)
        if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            chunks = wanted
    ranged = df.repartitionByRange(chunks, *order) if chunks else df.repartitionByRange(*order)
    placed = (
        ranged.sortWithinPartitions(*order)
        .withColumn("_chunk", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK)))
    )
    staged = stage(derive(placed) if derive else placed, name)
    index = _index(staged, partition_by, name, spans)
    if not spans:
        return Timeline(staged, tuple(partition_by), index)
    ends = ["_least", "_greatest"]
    return Timeline(staged, tuple(partition_by), index.drop(*ends), spans=index.select(*partition_by, "_chunk", *ends))


def _index(staged: DataFrame, partition_by: Sequence[str], name: str, spans: str | None = None) -> DataFrame:
    """Rows and first row of each (partition, chunk), and the rows before it.

    One row per chunk: without partition columns a single task orders them,
    which is input size / 256 MB rows.
    """
    keys = [*partition_by, "_chunk"]
    earlier = (
        W.partitionBy(*partition_by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    )
    ends = [F.min(spans).alias("_least"), F.max(spans).alias("_greatest")] if spans else []
    sizes = staged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"), *ends)
    return stage(
        sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0).cast("long"))),
        f"{name}-index",
    )


def grouping(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Text columns that are never null, one for each of ``columns``, for groups
    in which a null is a value like others; and their names."""
    named = {f"_key_{c}": F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
             for c in columns}
    return df.withColumns(named), list(named)


def numbered(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str | Column],
    name: str = "pos",
    chunks: int | None = None,
) -> DataFrame:
    """Row numbers within groups of any size; nulls are a group."""
    keyed, keys = grouping(df, partition_by)
    return seal(keyed, keys, order_by, chunks, "numbered").position(name).table().drop(*keys)
