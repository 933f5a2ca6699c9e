"""Best-fit packing with certified bin counts.

Pieces are dealt to partitions and packed there by best-fit decreasing.  Dual
feasible functions give a lower bound for every partition; one that meets it is
done.  Of the others, the bins that are not full go to an exchange: whole bins
are dealt anew, so that partitions trade documents, and repacked together if
that takes no more bins.  The exchange shrinks from round to round.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import map_texts
from nocturne.session import stage

LENGTH = 2048
PARTITION = 20_000  # pieces packed in one task
ROUNDS = 4
CACHED_CHUNKS = 600_000  # per worker
MARKS = b".,;:!?"
FRESH = 512  # chunks sent to the library at once


class Ids:
    """Ids of the tokenizers library as bytes, by pieces between ASCII white space.

    White space ends words under the file's normaliser, so a text's ids are
    those of its pieces; each piece is encoded once per worker.  Texts that
    spell a special token go through the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = sorted(t.content.encode() for t in self.model.get_added_tokens_decoder().values())
        self.mark, self.mark_id = self.special[0], self.model.token_to_id(self.special[0].decode())
        self.known: dict[bytes, bytes] = {}

    def learn(self, chunks: list[bytes]) -> None:
        """Encode new chunks in runs with a special token between them."""
        runs = [chunks[i : i + FRESH] for i in range(0, len(chunks), FRESH)]
        texts = [self.mark.join(run).decode() for run in runs]
        for run, found in zip(runs, self.model.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            raw, edges = ids.tobytes(), np.flatnonzero(ids == self.mark_id).tolist()
            for chunk, a, b in zip(run, [-1, *edges], [*edges, len(ids)]):
                self.known[chunk] = raw[4 * (a + 1) : 4 * b]

    def learn_parts(self, chunks: list[bytes]) -> None:
        """Letters with ASCII marks after them are two words to the file's
        pattern, so the letters are encoded once for all marks."""
        known, whole, parts = self.known, [], []
        for c in chunks:
            core = c.rstrip(MARKS)
            if core and len(core) < len(c) and core.decode().isalpha():
                parts.append((c, core, c[len(core) :]))
            else:
                whole.append(c)
        more = dict.fromkeys(whole)
        more.update((p, None) for _, *pair in parts for p in pair if p not in known)
        self.learn(list(more))
        for c, core, mark in parts:
            known[c] = known[core] + known[mark]

    def of(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        lowered, known = text.lower(), self.known
        if any(s in lowered for s in self.special):
            found = self.model.encode(text.decode(), add_special_tokens=False).ids
            return np.array(found, np.uint32).tobytes()
        chunks = lowered.split()
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            pass
        if len(known) > CACHED_CHUNKS:
            for old in list(known)[: CACHED_CHUNKS // 2]:
                del known[old]
        fresh = [c for c in dict.fromkeys(chunks) if c not in known]
        self.learn_parts(fresh)
        raw = b"".join([known[c] for c in chunks])
        for c in fresh:
            if len(c) > 64:  # long ones seldom come back
                del known[c]
        return raw


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32; a document ends with id 0."""

    def rows(source):
        ids = ids_of(path)
        for doc_id, text, row in source:
            raw = ids.of(text) + b"\0\0\0\0"
            for piece, at in enumerate(range(0, len(raw), 4 * length)):
                cut = raw[at : at + 4 * length]
                yield row, doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut)

    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return map_texts(
        numbered, "row long, doc_id long, piece int, start long, length long, ids_crc32 long", rows, "row")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of every item, longest first into the fullest bin that has room.

    Bins are kept by free space; a bit set tells which spaces occur."""
    bins = np.zeros(len(sizes), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    occurs, n = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = occurs >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                occurs &= ~(1 << space)
        else:
            space, b, n = capacity, n, n + 1
        bins[i] = b
        by_space[space - size].append(b)
        occurs |= 1 << (space - size)
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of the dual feasible functions' bounds on the number of bins.

    Total size; large items rounded up and small ones left out, for every
    threshold; sizes rounded down to multiples of 1 / (k + 1), for small k."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(object)
    x = np.arange(capacity + 1)
    up = lambda total, unit: -(-int(total) // unit)
    mass = np.concatenate([[0], np.cumsum(count * x)])  # mass[i]: sizes below i
    many = np.concatenate([[0], np.cumsum(count)])
    bounds = [up(mass[-1], capacity)]
    for t in range(1, capacity // 2 + 1):
        large = many[capacity + 1] - many[capacity - t + 1]
        bounds.append(up(large * capacity + mass[capacity - t + 1] - mass[t], capacity))
    for k in range(1, 21):
        scaled = (k + 1) * x
        # in units of 1 / (k * capacity) of a bin
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        bounds.append(up((count * value.astype(object)).sum(), k * capacity))
    return max(bounds)


PACKED = ("row long, doc_id long, piece int, start long, length long, ids_crc32 long, "
          "sequence_id long, offset long, open boolean")


def pack_group(turn: int, capacity: int):
    """Packs one partition; ``open``: its bound is not met and the bin not full."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        sizes = table["length"].to_numpy()
        bins = best_fit(sizes, capacity)
        if turn:
            _, old = np.unique(table["sequence_id"].to_numpy(), return_inverse=True)
            if old.max(initial=-1) <= bins.max(initial=-1):
                bins = old  # repacking gained nothing
        n = int(bins.max(initial=-1)) + 1
        fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
        gap = n - lower_bound(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        begins = np.concatenate([[0], np.cumsum(fill)[:-1]]) if n else np.array([], np.int64)
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - begins[bins[order]]
        name = (turn << 58) + (int(key[0].as_py()) << 32)
        columns = {c: table[c] for c in ("row", "doc_id", "piece", "start", "length", "ids_crc32")}
        return pa.table(columns | {
            "sequence_id": pa.array(name + bins, pa.int64()), "offset": pa.array(offset, pa.int64()),
            "open": pa.array((gap > 0) & (fill[bins] < capacity), pa.bool_())})

    return run


def pack_pieces(items: DataFrame, capacity: int = LENGTH, partition: int = PARTITION,
                rounds: int = ROUNDS) -> DataFrame:
    """``items`` with sequence_id and offset."""
    pool, unit, done = items, F.xxhash64("row", "piece"), None
    for turn in range(rounds):
        groups = max(1, -(-pool.count() // partition))
        dealt = pool.withColumn("group", F.pmod(F.xxhash64(unit, F.lit(turn)), F.lit(groups)))
        packed = stage(dealt.groupBy("group").applyInArrow(pack_group(turn, capacity), PACKED), "packed")
        last = turn == rounds - 1 or groups == 1
        closed = packed if last else packed.where(~F.col("open"))
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        pool, unit = packed.where("open"), F.col("sequence_id")
    return done


def pack(docs: DataFrame, path: str, capacity: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece.

    Null and empty texts have one id, the 0 at their end.  Repeated rows are
    packed once each, null ids like others; an empty table gives no rows.
    Only documents longer than a sequence are cut."""
    items = stage(pieces(docs, path, capacity), "pieces")
    return pack_pieces(items, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
