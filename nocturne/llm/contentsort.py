"""Exact duplicates by sorting the content.

The normalised bytes of every text are put in order: sampled splitters cut the
order into ranges, each range is sorted externally, equal texts come to stand
next to each other, and each row is compared with its neighbour, byte by byte.
The first row of a run of equal texts, which has the smallest id, stays.

The order is that of the first ``HEAD`` bytes, then of the text's SHA-256, then
of the id.  So splitters are short however long the texts are, texts that share
a long beginning spread over many ranges, and so do the copies of one text,
which their ids tell apart: no group has to fit into one task.  A run that goes
on in the next range is found by comparing the last text of a range with the
first one of the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nocturne.session import input_bytes, stage

SPACES = r"[\x20\x09-\x0D]+"
HEAD = 64  # bytes of a text in the sort key
RANGE_BYTES = 64 * 2**20  # of text per range, about
PACKED = 4  # text is taken to be this many times its size in the table

EDGE = "first: binary, last: binary, first_keep: long, first_size: long, last_keep: long, last_size: long"


def normalised(text="text"):
    """The text as bytes, each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ").cast("binary")


def sorted_ranges(docs: DataFrame, payload: bool) -> DataFrame:
    """doc_id, text, sha (and the whole row) in ranges of the sort order."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-PACKED * input_bytes(docs) // RANGE_BYTES))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("payload")] if payload else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("text"), *whole)
    rows = rows.withColumns({"sha": F.unhex(F.sha2("text", 256)), "head": F.substring("text", 1, HEAD)})
    order = ["head", "sha", F.asc_nulls_last("doc_id")]
    return rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("head")


class Runs:
    """Runs of equal neighbours of one range, fed batch by batch.

    Only the ids and digests of the run that is still open are held."""

    def __init__(self):
        self.held: list[pa.RecordBatch] = []  # rows of the open run
        self.text = self.first = self.first_run = None
        self.number = 0  # of the open run

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        """Closed runs, as tables of (run, doc_id, keep_id, group_size, kept, row columns)."""
        n, texts = batch.num_rows, batch.column("text")
        new = np.ones(n, bool)
        new[1:] = ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if self.text is None:
            self.first = texts[0].as_py()
        else:
            new[0] = texts[0].as_py() != self.text
        self.text = texts[n - 1].as_py()
        slim = batch.select([c for c in batch.schema.names if c != "text"])
        starts = np.flatnonzero(new)
        if not len(starts):
            self.held.append(slim)
            return
        if starts[0] > 0:
            self.held.append(slim.slice(0, starts[0]))
        if self.held:
            yield self._close()
        last = starts[-1]
        if last > starts[0]:
            yield self._runs(pa.Table.from_batches([slim.slice(starts[0], last - starts[0])]), starts[:-1] - starts[0])
        self.held = [slim.slice(last)]

    def _close(self) -> pa.Table:
        table = self._runs(pa.Table.from_batches(self.held), np.zeros(1, int))
        self.held = []
        return table

    def _runs(self, rows: pa.Table, starts: np.ndarray) -> pa.Table:
        sizes = np.diff(np.append(starts, rows.num_rows))
        head = np.repeat(starts, sizes)
        run = self.number + np.repeat(np.arange(len(starts)), sizes)
        keep = rows["doc_id"].take(pa.array(head))
        self.last_run = (keep[-1].as_py(), int(sizes[-1]))
        if self.first_run is None:
            self.first_run = (keep[0].as_py(), int(sizes[0]))
        self.number += len(starts)
        out = {"run": pa.array(run, pa.int64()), "keep_id": keep,
               "group_size": pa.array(np.repeat(sizes, sizes), pa.int64()),
               "kept": pa.array(np.arange(rows.num_rows) == head)}
        return pa.table({**out, **{c: rows[c] for c in rows.column_names}})

    def finish(self) -> tuple[Iterator[pa.Table], dict | None]:
        """The last run, and what its neighbours need to know of this range."""
        if not self.held:
            return iter(()), None
        table = self._close()
        (a, n), (b, m) = self.first_run, self.last_run
        return iter((table,)), {"first": self.first, "last": self.text, "first_keep": a,
                                "first_size": n, "last_keep": b, "last_size": m}


def runs(docs: DataFrame, payload: bool) -> DataFrame:
    """Every row (only those that may stay, with ``payload``) with the run of its
    range it is in, and a row with an ``edge`` for each range.  Staged."""
    ordered = sorted_ranges(docs, payload)
    more = ["payload"] if payload else ["sha"]
    schema = StructType.fromDDL(
        f"part int, run long, doc_id long, keep_id long, group_size long, kept boolean, edge struct<{EDGE}>")
    for c in more:
        schema = schema.add(c, ordered.schema[c].dataType)  # null on the row of an edge

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        part, arrow, state = TaskContext.get().partitionId(), to_arrow_schema(schema), Runs()

        def shown(table):
            if payload:
                table = table.filter(table["kept"])
            for piece in table.to_batches(max_chunksize=10_000):
                columns = dict(zip(piece.schema.names, piece.columns))
                columns["part"] = pa.array(np.full(piece.num_rows, part), pa.int32())
                columns["edge"] = pa.nulls(piece.num_rows, arrow.field("edge").type)
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)

        for batch in batches:
            if batch.num_rows:
                for table in state.feed(batch):
                    yield from shown(table)
        tables, edge = state.finish()
        for table in tables:
            yield from shown(table)
        if edge:
            row = {"part": part, "run": state.number, "edge": edge}
            yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in arrow], schema=arrow)

    slim = ordered.select("doc_id", "text", *more)
    return stage(slim.mapInArrow(run, schema), "runs")


def continued(staged: DataFrame) -> DataFrame:
    """Runs that reach over the edge of a range: part, run, and the ``keep``,
    ``total`` and ``first_part`` of the whole run.  Two rows per range at most."""
    edges = staged.where("edge IS NOT NULL").select("part", F.col("run").alias("runs"), "edge.*")
    small = stage(edges.select("part", "runs", F.row_number().over(W.orderBy("part")).alias("at")), "ranges")
    ends = edges.select("part", F.col("last").alias("text")).join(small, "part").select(
        (F.col("at") + 1).alias("at"), "text")
    begins = edges.select("part", F.col("first").alias("text")).join(small, "part").select("at", "text")
    joined = begins.join(ends, ["at", "text"]).select("at", F.lit(1).alias("joined"))
    small = small.join(joined, "at", "left").withColumn("joined", F.coalesce("joined", F.lit(0)))
    earlier = W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("runs") - F.col("joined")).over(earlier), F.lit(0)) - F.col("joined")
    named = edges.drop("runs", "first", "last").join(small.withColumn("before", before), "part")
    first = F.struct(F.lit(0).cast("long").alias("run"), F.col("before").alias("name"),
                     F.col("first_keep").alias("keep"), F.col("first_size").alias("size"))
    last = F.struct((F.col("runs") - 1).alias("run"), (F.col("before") + F.col("runs") - 1).alias("name"),
                    F.col("last_keep").alias("keep"), F.col("last_size").alias("size"))
    both = F.when(F.col("runs") == 1, F.array(first)).otherwise(F.array(first, last))
    entries = stage(named.select("part", F.inline(both)), "edge-runs")
    groups = entries.groupBy("name").agg(
        F.sum("size").alias("total"), F.min_by(F.struct("keep"), "part").alias("k"),
        F.min("part").alias("first_part"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return stage(entries.select("part", "run", "name").join(groups, "name").select(
        "part", "run", F.col("k.keep").alias("keep"), "total", "first_part"), "continued")


def equal_texts(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal if they are after white space runs became one space each; a
    null text counts as empty.  The smallest id of equal texts is their keep_id,
    and of its rows one has ``kept``; rows without an id come last and stay only
    where no row of the text has an id.  A repeated row counts as one more copy.
    Other columns are not looked at.  An empty table gives an empty one."""
    staged = runs(docs, payload=False)
    rows = staged.where("edge IS NULL").join(continued(staged), ["part", "run"], "left")
    over = F.col("first_part").isNotNull()
    return rows.select(
        "doc_id", F.when(over, F.col("keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("total", "group_size").alias("group_size"),
        (F.col("kept") & (~over | (F.col("first_part") == F.col("part")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that `equal_texts` keeps."""
    staged = runs(docs, payload=True)
    later = continued(staged).where("part > first_part").select("part", "run")
    return staged.where("edge IS NULL").join(later, ["part", "run"], "left_anti").select("payload.*")
