"""Hard negatives by slots of the score.

An anchor's positives give windows of scores: from a share of the positive's
score up to another share of it.  The windows overlap, but their upper limits
cut the scores into disjoint slots.  Every task scores its rows against all
anchors of a batch and keeps, for each anchor and slot, the k best rows of other
labels; lists of tasks are merged slot by slot.  Then the slots are merged from
the lowest limit up: after a slot is added, the k best so far are the k best
under its limit, and those that reach the window's lower limit answer it.

Rows are never moved or copied for the search: a batch of anchors of bounded
size is broadcast, and the staged table is read once per batch.  Scores are
exact integers; one that no long holds counts as its limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.llm.topk import FAN_IN, LONG_MAX, matrix
from nocturne.session import stage

BATCH_BYTES = 32 * 2**20  # of anchor vectors broadcast at a time
ANCHORS = 1024  # anchors and rows scored at once
ROWS = 2048
NONE = -(2**63)  # below every score


def labelled_vectors(rows: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(row, vec_id, label, x): floor(scale * component) of usable vectors, staged.

    Rows without an id or a label, and vectors that are null or hold a null or
    non-finite component, take no part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")
    used = rows.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                       F.col(vector).alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("x", finite))
    named = used.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label",
                        F.transform("x", whole).alias("x"))
    return stage(named, "vectors")


def share(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * score / 100) without leaving 64 bits."""
    return score // 100 * percent + score % 100 * percent // 100


class Slots:
    """The k best rows of each slot of each anchor, over the rows seen so far.

    ``upper`` has the slots' limits in descending order, ``lower`` the least
    score that any window over the slot accepts; ``same`` asks for rows of the
    anchor's label, else for those of others.  Rows with the anchor's own id
    never count."""

    def __init__(self, ids, labels, vectors, upper, lower, k: int, same: bool):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.upper, self.lower, self.k, self.same = upper, lower, k, same
        shape = (*upper.shape, k)
        self.score = np.full(shape, NONE, np.int64)
        self.found = np.full(shape, np.iinfo(np.int64).max, np.int64)
        self.reach = float(np.abs(vectors.astype(np.float64)).max(initial=0)) * max(1, vectors.shape[1])
        self.block = 128  # rows at once; grows when the slots have filled

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        bound = self.reach * float(np.abs(rows.astype(np.float64)).max(initial=0))
        if bound < 2**53:
            return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
        if bound < 2**62:
            return anchors @ rows.T
        value = anchors.astype(object) @ rows.astype(object).T
        return np.minimum(LONG_MAX, np.maximum(-LONG_MAX, value)).astype(np.int64)

    def feed(self, ids: np.ndarray, labels: np.ndarray, lists: pa.Array) -> None:
        width = self.vectors.shape[1]
        longest = pc.max(pc.list_value_length(lists)).as_py() or 0
        rows = matrix(pa.chunked_array([lists]), max(width, longest))[:, :width]  # beyond it an anchor has zeros
        at = 0
        while at < len(ids):
            part = slice(at, at + self.block)
            for a in range(0, len(self.ids), ANCHORS):
                self._block(slice(a, a + ANCHORS), ids[part], labels[part], rows[part])
            at += self.block
            self.block = min(ROWS, 2 * self.block)

    def _block(self, a: slice, ids, labels, rows) -> None:
        value = self.scores(self.vectors[a], rows)
        slot = np.full(value.shape, -1, np.int8 if self.upper.shape[1] < 127 else np.int32)
        for limit in self.upper[a].T:
            slot += value <= limit[:, None]
        least = np.maximum(self.lower[a], self.score[a, :, -1])  # nothing below can enter
        bound = np.take_along_axis(least, np.maximum(slot, 0).astype(np.int64), 1)
        like = self.labels[a][:, None] == labels[None, :]
        line, column = np.nonzero((slot >= 0) & (value >= bound) & (like if self.same else ~like))
        other = self.ids[a][line] != ids[column]
        line, column = line[other], column[other]
        if len(line):
            self._merge(line + a.start, slot[line, column].astype(np.int64), value[line, column], ids[column])

    def _merge(self, line, slot, score, found) -> None:
        """Put candidates into their slots: best first, ties by smaller id."""
        key = line * self.upper.shape[1] + slot
        touched = np.unique(key)
        i, j = np.divmod(touched, self.upper.shape[1])
        key = np.concatenate([key, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.score[i, j].ravel()])
        found = np.concatenate([found, self.found[i, j].ravel()])
        order = np.lexsort((found, ~score, key))  # ~ turns the order of all longs round
        key, score, found = key[order], score[order], found[order]
        first = np.searchsorted(key, touched)
        take = first[:, None] + np.arange(self.k)
        self.score[i, j], self.found[i, j] = score[take], found[take]

    def best(self) -> tuple[np.ndarray, ...]:
        """(anchor, slot, score, id) of all entries."""
        line, slot, place = np.nonzero(self.score > NONE)
        return line, slot, self.score[line, slot, place], self.found[line, slot, place]


def search(vectors: DataFrame, anchors: DataFrame, k: int, same: bool, batches: int,
           limits: tuple[int, int] | None = None) -> DataFrame:
    """anchor, slot, best: the k best (lost, vec_id) of each slot of each anchor.

    ``anchors`` has row, vec_id, label, x, and with ``limits`` (percent of the
    lower and upper limit) also the scores of its positives in descending order."""
    spark, parts = vectors.sparkSession, []
    schema = "part int, anchor long, slot int, score long, vec_id long"
    for b in range(batches):
        chosen = anchors.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == b).toArrow()
        if not len(chosen):
            continue
        width = pc.max(pc.list_value_length(chosen["x"])).as_py() or 0
        names, ids, labels = (chosen[c].to_numpy() for c in ("row", "vec_id", "label"))
        if limits:
            sizes = pc.list_value_length(chosen["scores"]).to_numpy()
            scores = matrix(chosen["scores"], int(sizes.max()))
            there = np.arange(scores.shape[1]) < sizes[:, None]
            upper = np.where(there, share(scores, limits[1]), NONE)
            lower = np.where(there, -share(-scores, limits[0]), NONE)
        else:
            upper = np.full((len(ids), 1), LONG_MAX, np.int64)
            lower = np.full((len(ids), 1), NONE, np.int64)
        batch = spark.sparkContext.broadcast((names, ids, labels, matrix(chosen["x"], width), upper, lower))

        def scan(tables: Iterator[pa.RecordBatch], batch=batch) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            names, *given = batch.value
            slots = Slots(*given, k, same)
            for t in tables:
                if t.num_rows:
                    slots.feed(t["vec_id"].to_numpy(), t["label"].to_numpy(), t["x"])
            line, slot, score, found = slots.best()
            part = np.full(len(line), TaskContext.get().partitionId(), np.int32)
            table = pa.table({"part": part, "anchor": names[line], "slot": slot.astype(np.int32),
                              "score": score, "vec_id": found})
            yield from table.to_batches(max_chunksize=10_000)

        lists = stage(vectors.select("vec_id", "label", "x").mapInArrow(scan, schema), "slots")
        batch.destroy()
        parts.append(merged(lists, k))
    if not parts:
        return spark.createDataFrame([], "anchor long, slot int, best array<struct<lost: long, vec_id: long>>")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merged(lists: DataFrame, k: int) -> DataFrame:
    """One list per anchor and slot, ``FAN_IN`` tasks at a time."""
    tasks = (lists.agg(F.max("part")).first()[0] or 0) + 1
    entry = F.struct((-F.col("score")).alias("lost"), "vec_id")
    while True:
        tasks = -(-tasks // FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy(
            "anchor", "slot", "part").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))
        if tasks <= 1:
            return lists.select("anchor", "slot", "best")
        lists = lists.select("anchor", "slot", "part", F.inline("best")).withColumn("score", -F.col("lost"))


def mine(vectors: DataFrame, is_anchor: Column, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` are those of `labelled_vectors`; rows with ``is_anchor`` are the
    anchors.  The positives of an anchor are its ``positives`` best rows of its
    label; a positive's negatives are the ``negatives`` best rows of other labels
    whose score lies between ``low`` and ``high`` percent of the positive's.
    Higher scores come first, ties by the smaller id; where there are fewer, all
    are returned.  A row with the anchor's id is the anchor itself.  Repeated rows
    count as rows of their own, and a repeated anchor is answered once for each.
    A positive below zero has an empty window; vectors of unequal length are
    compared as if filled with zeros.  An empty table gives an empty result."""
    anchors = stage(vectors.where(is_anchor), "anchors")
    size = anchors.agg(F.sum(8 * F.size("x"))).first()[0] or 0
    batches = max(1, -(-size // BATCH_BYTES))
    first = search(vectors, anchors, positives, True, batches)
    found = stage(first.select(F.col("anchor").alias("row"), F.col("best").alias("positives")), "positives")
    ready = stage(anchors.join(found, "row").withColumn(
        "scores", F.transform("positives", lambda p: -p["lost"])), "anchors")
    slots = search(vectors, ready, negatives, False, batches, (low, high))
    lists = slots.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("lists"))
    rows = ready.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "positives").join(lists, "anchor")
    nothing = F.expr("CAST(array() AS array<struct<lost: bigint, vec_id: bigint>>)")
    under, windows = nothing, []
    for j in reversed(range(positives)):  # from the lowest limit up
        slot = F.coalesce(F.try_element_at("lists", F.lit(j)), nothing)
        under = F.slice(F.concat(slot, under), 1, negatives)
        positive = F.get("positives", F.lit(j))
        windows.append(F.struct(
            positive["vec_id"].alias("positive_id"), (-positive["lost"]).alias("positive_score"), under.alias("under")))
    open_windows = rows.select("anchor", "anchor_id", F.inline(F.array(*windows))).where("positive_id IS NOT NULL")
    answers = open_windows.withColumn("least", at_least(low)).withColumn(
        "under", F.filter("under", lambda e: -e["lost"] >= F.col("least")))
    return answers.select(
        "anchor_id", "positive_id", "positive_score", F.posexplode("under").alias("at", "e")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("negative_id"),
        "positive_score", (-F.col("e.lost")).alias("negative_score"))


def at_least(percent: int) -> Column:
    """The least whole score of a window: percent * positive_score / 100, rounded up."""
    return F.ceil(F.col("positive_score").cast("decimal(19, 0)") * percent / 100).cast("long")
