"""Exact top-k search: tiled matrix products, partial selection, tree merging.

Vectors are dealt into candidate tiles and query tiles of bounded size.  Every
pair of tiles is one group: a matrix product gives all its scores, a partial
selection keeps each query's k best.  The lists of ``FAN_IN`` tiles are merged
until one list is left per query, so that no task ever holds more than
``FAN_IN * k`` entries of a query.  Queries times rows is the work asked for;
nothing but tiles is ever paired.

Scores are exact: a tile works in floating point only where every value, with
the position that breaks ties, stays below 2**53; else in 64-bit integers, else
in Python integers, where a score that no long holds counts as its limit.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_TILE = 1024
ROW_TILE = 8192
BLOCK = 1024  # rows scored at once within a tile
FAN_IN = 32
LONG_MAX = 2**63 - 1


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(row, vec_id, x): floor(scale * component) of usable vectors.

    Vectors that are null or hold a null or non-finite component, and rows
    without an id, take no part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")
    return rows.where(F.col(key).isNotNull() & F.forall(vector, finite)).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("long").alias("vec_id"), F.transform(vector, whole).alias("x"))


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows as int64; shorter vectors are filled with zeros."""
    lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    if len(lists):
        out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def best_of_tile(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query position, id, score) of each query's k best rows of one tile.

    ``rows`` come in the order of ``ids``; rows with the query's own id are out."""
    if not len(rows):
        return np.array([], int), np.array([], int), np.array([], int)
    reach = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (queries, rows)]
    bound = reach[0] * reach[1] * max(1, rows.shape[1])
    exact = bound * BLOCK * 2 < 2**53
    at, found, score = [], [], []
    for start in range(0, len(rows), BLOCK):
        block, names = rows[start : start + BLOCK], ids[start : start + BLOCK]
        n = len(block)
        mine = own[:, None] == names[None, :]
        if exact:
            value = queries.astype(np.float64) @ block.T.astype(np.float64)
            key = value * BLOCK + np.arange(BLOCK - 1, BLOCK - 1 - n, -1)
            key[mine] = -np.inf
            take = np.argpartition(-key, min(k, n) - 1, axis=1)[:, :k]
        else:
            kind = np.int64 if bound < 2**62 else object
            value = queries.astype(kind) @ block.T.astype(kind)
            if kind is object:  # what no long holds counts as its limit
                value = np.minimum(LONG_MAX, np.maximum(-LONG_MAX, value)).astype(np.int64)
            order = np.arange(n)
            take = np.array([sorted(order, key=lambda j: (m[j], -v[j], j))[:k]
                             for v, m in zip(value, mine)]).reshape(len(queries), -1)
        line = np.repeat(np.arange(len(queries)), take.shape[1])
        take = take.ravel()
        keep = ~mine[line, take]
        line, take = line[keep], take[keep]
        at.append(line)
        found.append(names[take])
        picked = value[line, take]
        score.append(picked.astype(np.int64))
    at, found, score = map(np.concatenate, (at, found, score))
    order = np.lexsort((found, -score, at))
    at, found, score = at[order], found[order], score[order]
    first = np.searchsorted(at, np.arange(len(queries)))
    best = np.arange(len(at)) - first[at] < k
    return at[best], found[best], score[best]


def tile_of(n: int, size: int) -> Column:
    """Tiles by row, so that a repeated id or vector is spread like any other."""
    return F.pmod(F.xxhash64("row"), F.lit(max(1, math.ceil(n / size)))).cast("int")


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k highest inner products.

    ``vectors`` are those of `integer_vectors`; rows with ``is_query`` are the
    queries, all rows are candidates but those with the query's own id.  Ties
    go to the smaller id.  A query with fewer candidates gets them all, one
    without gets no row.  Repeated rows count as rows of their own; a repeated
    query gives its list once for each.  Vectors of unequal length are
    compared as if filled with zeros."""
    queries = vectors.where(is_query)
    n_rows, n_queries = vectors.count(), queries.count()
    q_tiles, r_tiles = (max(1, math.ceil(n / s))
                        for n, s in ((n_queries, QUERY_TILE), (n_rows, ROW_TILE)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # names of their own: a cogroup confuses sides that share columns
    left = queries.select(
        F.col("row").alias("qrow"), F.col("vec_id").alias("query_id"), F.col("x").alias("q"),
        tile_of(n_queries, QUERY_TILE).alias("qt"), every(r_tiles).alias("qrt"))
    right = vectors.select(
        F.col("vec_id").alias("vec_id"), F.col("x").alias("x"),
        tile_of(n_rows, ROW_TILE).alias("rt"), every(q_tiles).alias("rqt"))
    schema = "qrow long, query_id long, rt int, vec_id long, score long"

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("vec_id") if len(b) else b
        width = max([0, *(pc.max(pc.list_value_length(c)).as_py() or 0 for c in (a["q"], b["x"]))])
        own = a["query_id"].to_numpy()
        at, found, score = best_of_tile(
            matrix(a["q"], width), own, matrix(b["x"], width), b["vec_id"].to_numpy(), k)
        tile = a["qrt"][0].as_py() if len(a) else 0
        return pa.table({
            "qrow": pa.array(a["qrow"].to_numpy()[at], pa.int64()),
            "query_id": pa.array(own[at], pa.int64()),
            "rt": pa.array(np.full(len(at), tile), pa.int32()),
            "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})

    lists = left.groupBy("qt", "qrt").cogroup(right.groupBy("rqt", "rt")).applyInArrow(pair, schema)
    entry = F.struct((-F.col("score")).alias("lost"), "vec_id")
    merged, tiles = lists, r_tiles
    while True:
        tiles = math.ceil(tiles / FAN_IN)
        merged = merged.withColumn("rt", F.floor(F.col("rt") / FAN_IN).cast("int")).groupBy(
            "qrow", "query_id", "rt").agg(
            F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))
        if tiles <= 1:
            break
        merged = merged.withColumn("e", F.explode("best")).select(
            "qrow", "query_id", "rt", (-F.col("e.lost")).alias("score"), F.col("e.vec_id").alias("vec_id"))
    return merged.select("query_id", F.posexplode("best").alias("pos", "e")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"),
        (-F.col("e.lost")).alias("score"))
