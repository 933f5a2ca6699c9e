"""Sharding by a k-d tree over metadata, balanced in bytes.

A node splits at the weighted median of its widest metadata dimension until
each leaf has its target bytes.  Medians are found by distributed histograms:
one job per refinement sums bytes by (node, bin) for all nodes of a level, and
the bin that holds the goal is refined until it is light.  The driver sees bins,
never documents.

The units that are placed are texts with all their copies, so equal texts meet
in one shard; a text whose copies weigh more than ``UNIT_SHARE`` of a leaf is
dealt in parts of about that weight, else one hot text would undo the balance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nocturne.session import stage

UNIT_SHARE = 1 / 20  # of a leaf's bytes
COORD_BITS, HASH_BITS, STEP_BITS = 16, 44, 12
KEY_BITS = COORD_BITS + HASH_BITS
TOLERANCE = 1e-4  # of a node's bytes
CHUNK = 50_000  # rows numbered in one task
DIMENSIONS = ("source", "lang", "length")


@dataclass
class Node:
    """Shards ``first`` to ``first + shards - 1``."""

    first: int
    shards: int
    bytes: int = 0
    dim: int = 0
    cut: int = 0


def slim(docs: DataFrame) -> DataFrame:
    """What sharding needs of a document, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("fp"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"))


def keys(units: DataFrame) -> DataFrame:
    """One long per dimension: its coordinate, then a hash that orders equal ones."""
    tie = F.shiftrightunsigned(F.xxhash64("fp", "part"), 64 - HASH_BITS)
    named = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << COORD_BITS))
    length = F.floor(F.log2(F.col("length") + 1) * ((1 << COORD_BITS) // 64)).cast("long")
    coords = [named("source"), named("lang"), length]
    return units.select("fp", "part", "bytes", *[
        (F.shiftleft(c, HASH_BITS) + tie).alias(f"k{i}") for i, c in enumerate(coords)])


def choose(nodes: list[Node], value) -> Column:
    """A column by node."""
    out = F.lit(None).cast("long")
    for n in nodes:
        out = F.when(F.col("node") == n.first, value(n)).otherwise(out)
    return out


def split(placed: DataFrame, nodes: list[Node]) -> None:
    """Set each node's widest dimension and the cut that gives its left part
    its share of the bytes."""
    coord = lambda i: F.shiftrightunsigned(F.col(f"k{i}"), HASH_BITS)
    dims = range(len(DIMENSIONS))
    rows = {r.node: r for r in placed.groupBy("node").agg(
        F.sum("bytes").alias("bytes"),
        *[(F.max(coord(i)) - F.min(coord(i))).alias(f"w{i}") for i in dims]).collect()}
    for n in nodes:
        if n.first in rows:
            r = rows[n.first]
            n.bytes, n.dim = r.bytes, max(dims, key=lambda i: (r[f"w{i}"], -i))
    open_nodes = {n.first: (n, 0, 0) for n in nodes if n.bytes}  # node, known high bits, bytes below
    left = KEY_BITS
    while open_nodes:
        left -= STEP_BITS
        now = [n for n, _, _ in open_nodes.values()]
        key = choose(now, lambda n: F.col(f"k{n.dim}"))
        high = choose(now, lambda n: F.lit(open_nodes[n.first][1]))
        bins = placed.where(F.col("node").isin([n.first for n in now])).where(
            F.shiftright(key, left + STEP_BITS) == high
        ).groupBy("node", F.shiftright(key, left).alias("bin")).agg(F.sum("bytes").alias("bytes"))
        found: dict[int, list] = {}
        for r in bins.collect():  # at most 2**STEP_BITS a node
            found.setdefault(r.node, []).append((r.bin, r.bytes))
        for first, (n, _, below) in list(open_nodes.items()):
            goal = n.bytes * (n.shards // 2) / n.shards
            for place, weight in sorted(found[first]):
                if below + weight >= goal:
                    break
                below += weight
            if left == 0 or weight <= TOLERANCE * n.bytes:
                n.cut = (place + (below + weight - goal < goal - below)) << left
                del open_nodes[first]
            else:
                open_nodes[first] = (n, place, below)


def assign(units: DataFrame, shards: int) -> DataFrame:
    """(fp, part, shard) of every unit."""
    placed = stage(keys(units).withColumn("node", F.lit(0).cast("long")), "kd-keys")
    level = [Node(0, shards)]
    while any(n.shards > 1 for n in level):
        nodes = [n for n in level if n.shards > 1]
        split(placed, nodes)
        right = choose(nodes, lambda n: F.when(
            F.col(f"k{n.dim}") >= n.cut, n.first + n.shards // 2).otherwise(n.first))
        placed = stage(placed.withColumn("node", F.coalesce(right, F.col("node"))), "kd-level")
        level = [n for n in level if n.shards == 1] + [
            half for n in nodes
            for half in (Node(n.first, n.shards // 2),
                         Node(n.first + n.shards // 2, n.shards - n.shards // 2))]
    return placed.select("fp", "part", F.col("node").cast("int").alias("shard"))


def number(rows: DataFrame, chunks: int) -> DataFrame:
    """Gapless ``slot`` from 0 in each shard: rows are numbered in chunks, and
    chunks follow each other."""
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    counts = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "chunk", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "row"))
    return dealt.withColumn("inside", inside).join(offsets, ["shard", "chunk"]).withColumn(
        "slot", (F.col("before") + F.col("inside") - 1).cast("long")).drop("before", "inside", "chunk")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Null texts count as empty ones, one byte each; null metadata as empty
    names.  Repeated rows are rows of their own with a slot each; null ids are
    placed like others; an empty table gives no rows.  Further columns are
    dropped."""
    rows = stage(slim(docs), "kd-rows")
    total = rows.agg(F.sum("size"), F.count("*")).first()
    heaviest = max(1.0, (total[0] or 0) / shards * UNIT_SHARE)
    # at most shards / UNIT_SHARE texts are that heavy, so this side is always small
    giants = rows.groupBy("fp").agg(F.sum("size").alias("bytes")).where(
        F.col("bytes") > heaviest).select("fp", F.ceil(F.col("bytes") / heaviest).alias("parts"))
    parted = rows.join(F.broadcast(giants), "fp", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    units = stage(parted.groupBy("fp", "part").agg(
        F.sum("size").alias("bytes"), F.max("size").alias("length"),
        F.min("source").alias("source"), F.min("lang").alias("lang")), "kd-units")
    placed = parted.join(assign(units, shards), ["fp", "part"])
    chunks = max(1, -(-(total[1] or 0) // (shards * CHUNK)))
    return number(placed, chunks).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
