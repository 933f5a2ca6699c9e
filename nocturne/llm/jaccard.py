"""Exact n-gram Jaccard self-join with token-combination prefixes.

Documents with equal shingle sets are one class, named by a 63-bit hash of the
set.  Shingles are ordered by class (rare before frequent), then by hash; with
this one order, classes whose similarity is t or more share at least two of
their first ``n - ceil(t n) + 2`` shingles.  So a pair is found if

* each rare shingle of that prefix is indexed alone, and
* each pair of frequent ones is indexed as a combination,

because two shared shingles are either both frequent or include a rare one.
Classes with more than ``COMBINED`` frequent shingles in their prefix index
those singly, and the others also probe that index singly.

Any set of shingles may count as frequent: the choice changes the work, not the
result.  So a bitmap of fixed size, marked from the most frequent shingle down
until an eighth of its bits are taken, says which ones do; other shingles that
fall on a mark do no harm.  If it holds all shingles of two classes or more, the
rare ones are of one class each and need no index.

Postings of one key are not paired with each other: each is tied to a leader of
its key among sets of about its size, and what is tied together is a cluster.
Every pair that the index finds lies in one cluster.  A cluster is verified in
blocks of bounded size, a set travelling once to each block it may match in: a
matrix product counts all intersections of two blocks exactly, and a spanning
forest of the links goes on.  So copies cost as many rows as there are copies.

Sets are verified twice.  First a ``PART`` of their shingles travels, the highest
ones: what two sets share is at most what they share of those and the rest of the
smaller rest, and pairs that this rules out need no more.  The others make up new
clusters, mostly small ones, whose sets travel whole; a set left alone stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import hashed_words, id_and_text, mixed, pieces_of
from nocturne.session import shuffles_freed, stage, unstage

WORDS, SHARE = 5, Fraction(80, 100)
BITS = 1 << 27  # of the broadcast bitmap of frequent shingles
COMBINED = 8  # frequent shingles of a prefix that are combined
BUCKET_KEYS = 2_000_000  # keys counted in one task
FLUSH = 1_000_000  # keys held before they are sent
SMALL_IDS = 1_000_000  # rows of class names in a broadcast
PART = 4  # a quarter of a set's shingles is compared first
NAMES = 64  # slices of the bitmap of candidate names
BLOCK_SETS, BLOCK_SHINGLES = 1024, 2_000_000  # in a block, at most
COLUMNS = 4096  # shingles in one product
FEW, PAIRS = 48, 4_000_000  # sets of a shingle counted by pairs; pairs counted at once
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

def shingle_sets(texts: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's distinct n-word shingles; fewer words are
    one shingle, no words none."""
    h, edges = hashed_words(texts)

    def folded(value, size, count):
        for k in range(size):
            value = value * MULTIPLIER + h[k : k + count]
        return value

    whole = mixed(folded(np.full(max(0, len(h) - n + 1), n, np.uint64), n, max(0, len(h) - n + 1)))
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        if b - a >= n:
            s = np.sort(whole[a : b - n + 1])
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s if new.all() else s[new]
        elif b > a:
            value = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    value = value * MULTIPLIER + x
            yield mixed(np.array([value], np.uint64))
        else:
            yield np.array([], np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.binary())))


def class_name(s: np.ndarray) -> int:
    """63-bit hash of a set as an even long; 0 for the empty set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 & ~1 if len(s) else 0


def sets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for piece in pieces_of(batch, 1_000_000):
        yield from shingle_sets(piece.column("text"))


def classes(docs: DataFrame) -> DataFrame:
    """row, doc_id, n (set size), node (class name)."""

    def run(batches):
        for b in batches:
            found = [(len(s), class_name(s)) for s in sets_of(b)]
            n, node = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64())],
                ["row", "doc_id", "n", "node"])

    return id_and_text(docs.withColumn("row", F.monotonically_increasing_id()), "row").mapInArrow(
        run, "row long, doc_id long, n long, node long")


def bucket_of(s: np.ndarray, buckets: int) -> np.ndarray:
    return ((s >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(buckets: int, bucket: np.ndarray, *columns: np.ndarray):
    """One list of each column per bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(c[order])) for c in columns]
    return pa.array(np.arange(buckets), pa.int32()), lists


def distinct_classes(batches, seen_limit: int = 200_000):
    """(class name, set) once per task, as long as the memory for names holds."""
    seen: set[int] = set()
    for b in batches:
        for s in sets_of(b):
            name = class_name(s)
            if name and name not in seen:
                if len(seen) < seen_limit:
                    seen.add(name)
                yield name, s


def low32(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def shingle_counts(docs: DataFrame, buckets: int, least: int) -> DataFrame:
    """bucket, key, count of shingles that ``least`` classes hold, or more.

    Keys travel as arrays, those that a task holds repeatedly with their count.
    Within its bucket a shingle is known by 32 bits, which two shingles share
    so seldom that only the choice of a few frequent ones can be wrong.  A
    class counts once per task that holds it."""

    def send(batches):
        held, n = [], 0

        def rows():
            s, times = np.unique(np.concatenate(held), return_counts=True)
            bucket, key = bucket_of(s, buckets), low32(s)
            many = times > 1
            names, (once,) = by_bucket(buckets, bucket[~many], key[~many])
            _, (often, counts) = by_bucket(buckets, bucket[many], key[many], times[many].astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [names, once, often, counts], ["bucket", "once", "often", "times"])

        for _, s in distinct_classes(batches):
            held.append(s)
            n += len(s)
            if n >= FLUSH:
                yield rows()
                held, n = [], 0
        if n:
            yield rows()

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        once, often, times = (
            table[c].combine_chunks().flatten().to_numpy() for c in ("once", "often", "times"))
        keys, at = np.unique(np.concatenate([once, often]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([np.ones(len(once)), times]), minlength=1).astype(np.int64)
        n = n[: len(keys)]
        keys, n = keys[n >= least], n[n >= least]
        return pa.table({"bucket": pa.array(np.full(len(keys), key[0].as_py()), pa.int32()),
                         "key": pa.array(keys, pa.int32()), "count": pa.array(n, pa.int64())})

    sent = id_and_text(docs).mapInArrow(
        send, "bucket int, once array<int>, often array<int>, times array<int>")
    return sent.groupBy("bucket").applyInArrow(count, "bucket int, key int, count long")


class Frequent:
    """Bitmap of keys (of frequent shingles, or names), a slice for each bucket."""

    def __init__(self, bits: np.ndarray, slice_bits: int, complete: bool):
        self.bits, self.slice_bits, self.complete = bits, slice_bits, complete

    @staticmethod
    def place(bucket, key: np.ndarray, slice_bits: int) -> np.ndarray:
        return bucket * slice_bits + key.view(np.uint32).astype(np.int64) % slice_bits

    def has(self, s: np.ndarray, buckets: int) -> np.ndarray:
        at = self.place(bucket_of(s, buckets), low32(s), self.slice_bits)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def frequent_shingles(counts: DataFrame, buckets: int, most_bits: int) -> Frequent:
    """The bitmap of the shingles in ``counts``, as many as an eighth of
    ``most_bits`` bits, from the most frequent ones down."""
    sizes = counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count"))
    total, cut, complete = 0, 2**62, True
    for r in sizes.toLocalIterator():  # one row per count, ever fewer towards the high ones
        if total + r["n"] > most_bits // 8:
            complete = False
            break
        total, cut = total + r["n"], r["count"]
    slice_bits = bits_of_slice(total, most_bits, buckets)
    return Frequent(marked(counts.where(F.col("count") >= cut), buckets, slice_bits), slice_bits, complete)


def bits_of_slice(total: int, most_bits: int, buckets: int) -> int:
    """Of a bitmap with 16 bits a key, as far as ``most_bits`` go."""
    return 8 * max(1, math.ceil(min(most_bits, max(1 << 16, 16 * total)) / buckets / 8))


def marked(keys: DataFrame, buckets: int, slice_bits: int) -> np.ndarray:
    """Bitmap of the keys (bucket, key)."""

    def mark(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bits = np.zeros(slice_bits, np.uint8)
        bits[Frequent.place(0, table["key"].to_numpy(), slice_bits)] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([packed], pa.binary())})

    out = np.zeros(slice_bits // 8 * buckets, np.uint8)
    slices = stage(keys.select("bucket", "key").groupBy("bucket").applyInArrow(mark, "bucket int, bits binary"), "marks")
    for r in slices.toLocalIterator():
        at = r["bucket"] * slice_bits // 8
        out[at : at + slice_bits // 8] = np.frombuffer(r["bits"], np.uint8)
    unstage(slices)
    return out


def prefix(s: np.ndarray, frequent: np.ndarray, share: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Rare and frequent shingles of the prefix that holds two shared ones."""
    n = len(s)
    size = min(n, n - math.ceil(share * n) + 2)
    rare, often = s[~frequent], s[frequent]
    return rare[:size], often[: max(0, size - len(rare))]


def postings(docs: DataFrame, shared: Broadcast[Frequent], buckets: int, share: Fraction) -> DataFrame:
    """key, node (even: indexes, odd: only probes) and its set size, for keys of
    several classes.

    Rare keys meet in a bucket of their own, where those of one class drop out
    and keys with the same classes become one.  Frequent ones, whose classes
    may be a large share of all, are dealt by class instead and stay."""

    def send(batches):
        frequent = shared.value
        held, nodes, sizes, kinds, n = [], [], [], [], 0

        def rows():
            keys, node, size, often = map(np.concatenate, (held, nodes, sizes, kinds))
            dealt = np.where(often, buckets + bucket_of(mixed(node.view(np.uint64)), buckets),
                             bucket_of(keys, buckets))
            b, lists = by_bucket(2 * buckets, dealt, keys.view(np.int64), node, size)
            return pa.RecordBatch.from_arrays([b, *lists], ["bucket", "keys", "nodes", "sizes"])

        for name, s in distinct_classes(batches):
            rare, often = prefix(s, frequent.has(s, buckets), share)
            if frequent.complete:
                rare = rare[:0]
            singly = mixed(often + np.uint64(1))  # keys of their own
            pairs = np.array([], np.uint64)
            if 0 < len(often) <= COMBINED:
                i, j = np.triu_indices(len(often), 1)
                pairs = mixed(often[i] * MULTIPLIER + often[j])
            held += [rare, singly, pairs]
            nodes += [np.full(len(rare), name, np.int64),
                      np.full(len(singly), name + (len(often) <= COMBINED), np.int64),
                      np.full(len(pairs), name, np.int64)]
            kinds += [np.zeros(len(rare), bool), np.ones(len(singly) + len(pairs), bool)]
            sizes.append(np.full(len(rare) + len(singly) + len(pairs), len(s), np.int32))
            n += len(rare) + len(singly) + len(pairs)
            if n >= FLUSH:
                yield rows()
                held, nodes, sizes, kinds, n = [], [], [], [], 0
        if n:
            yield rows()

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, nodes, sizes = (
            table[c].combine_chunks().flatten().to_numpy() for c in ("keys", "nodes", "sizes"))
        if key[0].as_py() < buckets:
            keys, nodes, sizes = several(keys, nodes, sizes)
        return pa.table({"key": pa.array(keys, pa.int64()), "node": pa.array(nodes, pa.int64()),
                         "size": pa.array(sizes, pa.int32())})

    sent = id_and_text(docs).mapInArrow(
        send, "bucket int, keys array<long>, nodes array<long>, sizes array<int>")
    return sent.groupBy("bucket").applyInArrow(gather, "key long, node long, size int")


def several(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Postings of the keys with several classes, once per set of classes; the
    new key is a hash of the set."""
    order = np.lexsort((nodes, keys))
    keys, nodes, sizes = keys[order], nodes[order], sizes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes, sizes = keys[new], nodes[new], sizes[new]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], int)
    length = np.diff(np.append(first, len(keys)))
    if not (length > 1).any():
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.int32)
    sums = np.add.reduceat(mixed(nodes.view(np.uint64)), first)
    _, once = np.unique(np.stack([sums, length.astype(np.uint64)]), axis=1, return_index=True)
    chosen = np.zeros(len(first), bool)
    chosen[once] = True
    keep = np.repeat(chosen & (length > 1), length)
    return np.repeat(sums, length)[keep].view(np.int64), nodes[keep], sizes[keep]


def size_class(size: str, share: Fraction):
    """Sets that can be similar are in the same class or in adjacent ones."""
    return F.floor(F.log(F.col(size) + 0.5) / math.log(1 / share)).cast("int")


def clusters(lists: DataFrame, share: Fraction) -> DataFrame:
    """node, size, class, cluster of all classes that share a key with another."""
    node = F.col("node").bitwiseAND(F.lit(-2).cast("long"))
    held = lists.select(
        "key", node.alias("node"), (F.col("node") % 2 == 0).alias("indexes"), "size",
        size_class("size", share).alias("class"))
    leaders = held.where("indexes").groupBy("key", "class").agg(F.min("node").alias("leader"))
    near = F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("class")
    ties = held.select("key", "node", near).join(leaders, ["key", "class"]).where("node <> leader")
    roots = components(ties.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    return grouped(held.select("node", "size", "class").distinct(), roots)


def grouped(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members with their cluster, for some a cluster of their own."""
    return members.join(roots, "node", "left").withColumn("cluster", F.coalesce("root", "node")).drop("root")


def block_pairs(members: DataFrame, part: int = 1) -> DataFrame:
    """node, pair: every pair of blocks in which a set may match, by a hash.

    Blocks are parts of a cluster's size classes, small enough for one task.  A
    pair is verified whole, so a class of one block needs no pair of its own
    beside that with an adjacent class."""
    spread = members.groupBy("cluster", "class").agg(
        F.count("*").alias("sets"), (F.sum("size") / part).alias("shingles"))
    parts = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    spread = stage(spread.select("cluster", "class", F.least("sets", parts).cast("int").alias("parts"), "sets"), "blocks")
    placed = members.join(spread, ["cluster", "class"]).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    partner = spread.select("cluster", F.col("class").alias("other"), F.col("parts").alias("other_parts"))
    steps = F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)]))
    met = placed.withColumn("other", steps).join(partner, ["cluster", "other"])
    beside = spread.select("cluster", F.explode(F.array(F.col("class") - 1, F.col("class") + 1)).alias("class"))
    met = met.join(beside.distinct().withColumn("beside", F.lit(True)), ["cluster", "class"], "left")
    own = (F.col("sets") > 1) & ((F.col("parts") > 1) | F.col("beside").isNull())
    each = met.where((F.col("other") != F.col("class")) | own).withColumn(
        "other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    this, that = F.struct("class", "part"), F.struct(F.col("other").alias("class"), F.col("other_part").alias("part"))
    return each.select("node", F.xxhash64("cluster", F.least(this, that), F.greatest(this, that)).alias("pair"))


def forest(sizes: np.ndarray, counts: np.ndarray, share: Fraction) -> np.ndarray:
    """Index of the smallest set reachable by links."""
    union = sizes[:, None] + sizes[None, :] - counts
    linked = counts * share.denominator >= share.numerator * union
    label = np.arange(len(sizes))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(sizes)).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of different sets.

    Shingles of few sets are counted pair by pair, those of many by products of
    0/1 matrices, which are exact: sums of at most ``COLUMNS`` ones in single
    precision, added up in double."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")  # rows ascend within a shingle
    row, first = row[order], np.cumsum(times) - times
    out = np.zeros(m * m, np.float64)
    for d in np.unique(times[(times > 1) & (times <= FEW)]).tolist():
        i, j = np.triu_indices(d, 1)
        starts = first[times == d]
        step = max(1, PAIRS // len(i))
        for k in range(0, len(starts), step):
            held = row[starts[k : k + step, None] + np.arange(d)]
            out += np.bincount((held[:, i] * m + held[:, j]).ravel(), minlength=m * m)
    out = out.reshape(m, m)
    out += out.T.copy()
    many = np.flatnonzero(times > FEW)
    for k in range(0, len(many), COLUMNS):
        chosen = many[k : k + COLUMNS]
        column = np.repeat(np.arange(len(chosen)), times[chosen])
        place = np.repeat(first[chosen] - np.cumsum(times[chosen]) + times[chosen], times[chosen]) + np.arange(len(column))
        one = np.zeros((m, len(chosen)), np.float32)
        one[row[place], column] = 1
        out += one @ one.T
    return out.astype(np.int64)


def marked_names(nodes: DataFrame, total: int, most_bits: int) -> Frequent:
    """Bitmap of class names; one that falls on the mark of another counts as held."""

    def keys(batches):
        for b in batches:
            h = mixed(b.column("node").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket_of(h, NAMES), pa.int32()), pa.array(low32(h), pa.int32())], ["bucket", "key"])

    slice_bits = bits_of_slice(total, most_bits, NAMES)
    found = nodes.select("node").mapInArrow(keys, "bucket int, key int")
    return Frequent(marked(found, NAMES, slice_bits), slice_bits, True)


def sent_sets(docs: DataFrame, met: DataFrame, bitmap: Broadcast[Frequent], buckets: int, part: int = 1) -> DataFrame:
    """pair, node, size, rest, set: the highest 1/``part`` of the shingles of each set
    in ``met`` (node, pair), once per pair and task, and how many shingles remain.

    Shingles that no other class has stay out.  Where a set goes is broadcast as
    far as ``SMALL_IDS`` rows of 16 bytes; beyond, a bitmap says which sets are
    needed, and those are sent by name and joined with their pairs."""
    context = docs.sparkSession.sparkContext
    rows_met = met.count()
    small = rows_met <= SMALL_IDS
    if small:
        table = met.toArrow().sort_by("node")
        known = context.broadcast((table["node"].to_numpy(), table["pair"].to_numpy()))
    else:
        known = context.broadcast(marked_names(met, rows_met, BITS))
    least = np.uint64(2**64 - 2**64 // part)

    def send(batches):
        frequent, found = bitmap.value, known.value
        held, n = [], 0

        def rows():
            pair, name, size, rest, sets = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array(pair, pa.int64()), pa.array(name, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(rest, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["pair", "node", "size", "rest", "set"])

        for name, s in distinct_classes(batches):
            if small:
                nodes, pairs = found
                to = pairs[np.searchsorted(nodes, name) : np.searchsorted(nodes, name, "right")].tolist()
            else:
                to = [0] if found.has(mixed(np.array([name], np.uint64)), NAMES)[0] else []
            if to:
                shared = s[frequent.has(s, buckets)] if frequent.complete else s
                high = shared[np.searchsorted(shared, least) :]
                held += [(pair, name, len(s), len(shared) - len(high), high) for pair in to]
                n += len(high) * len(to) + len(to)
            if n >= FLUSH:
                yield rows()
                held, n = [], 0
        if held:
            yield rows()

    sent = id_and_text(docs).mapInArrow(send, "pair long, node long, size long, rest long, set array<long>")
    return sent if small else sent.drop("pair").join(met, "node")


def links(
    docs: DataFrame, members: DataFrame, frequent: Broadcast[Frequent], buckets: int, share: Fraction, part: int = 1
) -> DataFrame:
    """a, b: a spanning forest of the links in each pair of blocks; staged.

    With a ``part`` of the shingles, of all links that those leave possible."""
    met = stage(block_pairs(members, part), "pairs")

    def verify(table: pa.Table) -> pa.Table:
        node, first = np.unique(table["node"].to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        column = table["set"].combine_chunks()
        edges, values = column.offsets.to_numpy(), column.values.to_numpy()
        counts, rest = intersections([values[a:b] for a, b in zip(edges, edges[1:])]), table["rest"].to_numpy()
        if rest.any():
            counts += np.minimum(rest[:, None], rest[None, :])
        label = forest(table["size"].to_numpy(), counts, share)
        tied = label != np.arange(len(node))
        return pa.table({"a": pa.array(node[tied], pa.int64()), "b": pa.array(node[label[tied]], pa.int64())})

    sent = sent_sets(docs, met, frequent, buckets, part)
    found = stage(sent.groupBy("pair").applyInArrow(verify, "a long, b long"), "links")
    unstage(met)
    return found


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for all nodes of the links (a, b).

    Alternates two star operations until nothing changes: each node's larger
    neighbours, then its smaller ones, are tied to the smallest neighbour."""
    edges = stage(links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        unstage(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        state = now


def class_components(docs: DataFrame, total: int, share: Fraction = SHARE) -> DataFrame:
    """node, root for all classes that are linked to another one.

    Tables and shuffles go as soon as the next step has been written."""
    buckets = max(64, math.ceil(total / BUCKET_KEYS))
    with shuffles_freed(docs.sparkSession):
        counts = stage(shingle_counts(docs, buckets, 2), "counts")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(counts, buckets, BITS))
    unstage(counts)
    with shuffles_freed(docs.sparkSession):
        lists = stage(postings(docs, frequent, buckets, share), "postings")
        members = stage(clusters(lists, share), "clusters")
        unstage(lists)
        possible = links(docs, members, frequent, buckets, share, PART)
        closer = stage(grouped(members.drop("cluster"), components(possible)), "clusters")
        unstage(members)
        unstage(possible)
        found = links(docs, closer, frequent, buckets, share)
        unstage(closer)
        roots = components(found)
        unstage(found)
    return roots


def near_duplicates(docs: DataFrame, share: Fraction = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    component_id is the smallest doc_id that links reach, itself included.
    Null and empty texts, and texts without words, have no shingles and stand
    alone.  Repeated rows are linked rows; a null id is never the smallest
    unless its component has no other.  An empty table gives no rows; further
    columns are dropped."""
    members = stage(classes(docs), "classes")
    total = members.agg(F.sum("n")).first()[0] or 0
    roots = class_components(docs, total, share)
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(smallest, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, share: Fraction = SHARE) -> DataFrame:
    """One row of each group, that with the smallest doc_id (one of them, if
    the row is repeated); all columns stay."""
    own = "_component_row"
    rows = docs.withColumn(own, F.monotonically_increasing_id())
    members = stage(classes(docs), "classes")
    total = members.agg(F.sum("n")).first()[0] or 0
    roots = class_components(docs, total, share)
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = placed.where("n > 0").groupBy("root").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "row")).alias("first"))
    chosen = first.select(F.col("first.row").alias(own)).union(
        placed.where("n = 0").select(F.col("row").alias(own)))
    return rows.join(chosen, own, "left_semi").drop(own)
