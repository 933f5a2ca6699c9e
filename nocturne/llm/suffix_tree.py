"""Language-model scores from a probabilistic suffix tree over words.

Contexts of up to ``DEPTH`` words that occur ``CONTEXT`` times are candidates.
One is kept if its next words diverge from those of its suffix by more bits
than its distribution costs.  Distributions hold the words seen ``ENTRY`` times
after a context; the rest of the mass, and one count per word held, goes to the
longest kept suffix, down to the smoothed word frequencies of the whole corpus.
A token is scored in the state of its longest kept suffix.

Both limits are occurrences, at every size, so the tree grows with the corpus
and stays distributed.  Texts are cut into tokens once and staged in pieces of
bounded size.  A word sequence (gram) is a 64-bit hash, and the hashes are cut
into ranges (buckets).  In each round a piece sends every bucket its different
grams of one more word, with their counts, and gets their counts in the whole
corpus back, in the order asked and so without the grams.  Only grams whose
beginning occurs ``CONTEXT`` times and whose end ``ENTRY`` times are sent,
which a piece knows from the round before.  One of the pieces that hold an
entry owns it and adds it to the sums by which its context's bucket keeps or
drops the context.  What a piece was told is the tree's part of its texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import id_and_text, pieces_of, words_of_worker
from nocturne.session import shuffles_freed, stage

DEPTH = 3
CONTEXT, ENTRY = 8, 2  # occurrences in the training texts
PIECE = 200_000  # most tokens of a part of a text
FLUSH = 1_000_000  # tokens of a piece, about
BUCKET = 1  # pieces for each bucket of grams
BITS, SLOT = 27, 20  # first bits of a gram that tell its bucket; log2 of the grams sent as one row
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
END = b" "  # the end of a text as a token: no word has a space

PIECES = ("row array<long>, doc_id array<long>, held_out array<boolean>, length array<int>, lead array<int>, "
          "n_words int, words binary, n_tokens int, number binary")
# kind: words of the grams, below 0 if they are contexts to be tested; at: place of the first among a piece's
ASKED = "bucket int, piece long, kind int, at int, n int, gram binary, sums array<binary>"
TOLD = "piece long, kind int, at int, n int, value binary, tokens long, types long, contexts long"


def prepared(docs: DataFrame) -> DataFrame:
    """row, doc_id, text and held_out."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    return id_and_text(
        docs.withColumns({"row": F.monotonically_increasing_id(), "held_out": held_out}), "row", "held_out")


def pieces(docs: DataFrame, depth: int) -> DataFrame:
    """Tokens of all texts: one row of ``PIECES`` for about ``FLUSH`` of them.

    A text longer than ``PIECE`` is cut; each further part begins with the last
    ``depth`` tokens before it (``lead``), which are its context only."""
    most, flush = PIECE, FLUSH

    def run(batches):
        held, size, words = [], 0, words_of_worker()
        for b in (p for batch in batches for p in pieces_of(batch, 1_000_000)):
            if words_of_worker() is not words:  # other numbers from here on
                if held:
                    yield piece_row(held, words.hashes)
                held, size, words = [], 0, words_of_worker()
            columns = [b.column(c).to_pylist() for c in ("row", "doc_id", "held_out")]
            for row, doc_id, held_out, text in zip(*columns, b.column("text")):
                number = words.numbers([*text.as_buffer().to_pybytes().lower().split(), END])
                for start in range(0, len(number), most):
                    lead = min(depth, start)
                    part = number[start - lead : start + most]
                    held.append((row, doc_id, held_out, lead, part))
                    size += len(part)
                    if size >= flush:
                        yield piece_row(held, words.hashes)
                        held, size = [], 0
        if held:
            yield piece_row(held, words.hashes)

    return prepared(docs).mapInArrow(run, PIECES).withColumn("piece", F.monotonically_increasing_id())


def packed(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones and so on, compressed."""
    size = values.dtype.itemsize
    return pa.compress(values.reshape(-1, 1).view(np.uint8).reshape(-1, size).T.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes | pa.Buffer, n: int, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(raw, n * size, "zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(dtype).reshape(-1)


def packed_hashes(hashes: np.ndarray) -> bytes:
    """By their differences, which are short where the hashes are in order."""
    return packed(np.diff(hashes, prepend=np.uint64(0)))


def unpacked_hashes(raw: bytes | pa.Buffer, n: int) -> np.ndarray:
    return np.cumsum(unpacked(raw, n, np.uint64), dtype=np.uint64)


def piece_row(parts: list[tuple], hashes: np.ndarray) -> pa.RecordBatch:
    """Words are numbered anew, frequent ones first and those about as frequent
    by hash, which compresses best."""
    row, doc_id, held_out, lead, numbers = zip(*parts)
    number = np.concatenate(numbers)
    count = np.bincount(number, minlength=len(hashes))
    used = np.flatnonzero(count)
    used = used[np.lexsort((hashes[used], -np.frexp(count[used])[1]))]
    count[used] = np.arange(len(used))
    lists = [pa.array([v], pa.list_(t)) for v, t in (
        (row, pa.int64()), (doc_id, pa.int64()), (held_out, pa.bool_()), (list(map(len, numbers)), pa.int32()),
        (lead, pa.int32()))]
    return pa.RecordBatch.from_arrays(
        [*lists, pa.array([len(used)], pa.int32()), pa.array([packed_hashes(hashes[used])], pa.binary()),
         pa.array([len(number)], pa.int32()), pa.array([packed(count[number].astype(np.uint32))], pa.binary())],
        ["row", "doc_id", "held_out", "length", "lead", "n_words", "words", "n_tokens", "number"])


class Piece:
    """One row of ``PIECES`` as arrays over its tokens."""

    def __init__(self, table: pa.RecordBatch | pa.Table, i: int):
        def values(name):
            return table.column(name)[i].values

        words = unpacked_hashes(table.column("words")[i].as_buffer(), table.column("n_words")[i].as_py())
        order = np.argsort(words)
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        self.words = words[order]
        self.number = place[unpacked(
            table.column("number")[i].as_buffer(), table.column("n_tokens")[i].as_py(), np.uint32)]
        self.id = table.column("piece")[i].as_py()
        self.row, self.doc_id, self.held_out = values("row"), values("doc_id"), values("held_out")
        length, lead = values("length").to_numpy(), values("lead").to_numpy()
        self.part = np.repeat(np.arange(len(length), dtype=np.int32), length)
        self.at = np.arange(len(self.number)) - np.repeat(np.cumsum(length) - length, length)
        self.own = self.at >= lead[self.part]
        self.trains = ~self.held_out.to_numpy(zero_copy_only=False)[self.part] & self.own


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in order, the number of each row's value among
    them, and the first row of each.

    First bits and row are sorted as one integer, several times faster than by
    an index; values that share these bits are rare and sorted in full."""
    low = np.uint64(len(values).bit_length())
    key = values >> low << low | np.arange(len(values), dtype=np.uint64)
    key.sort()
    row = (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    key >>= low
    ordered = values[row]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if np.any(new[1:] & (key[1:] == key[:-1])):
        different, first, number = np.unique(values, return_index=True, return_inverse=True)
        return different, number.astype(np.int32), first
    number = np.empty(len(values), np.int32)
    number[row] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ordered[new], number, row[new]


@dataclass
class Grams:
    """A piece's grams of one length: their hashes in order, the first token
    that ends each, each token's number among them (below 0: none).  Once told:
    the occurrences of each, also by token, and those that this piece owns."""

    gram: np.ndarray
    first: np.ndarray | None
    number: np.ndarray
    n: np.ndarray | None = None
    by_token: np.ndarray | None = None
    owned: np.ndarray | None = None


def by_length(piece: Piece, told: dict[int, np.ndarray], most: int) -> list[Grams]:
    """Those of 1 to ``most`` words (at 0 none) that may be in the tree."""
    out: list[Grams] = [None, Grams(piece.words, None, piece.number)]
    hashes = word = piece.words[piece.number]
    for length in range(1, most + 1):
        if length > 1:
            hashes = np.concatenate([[np.uint64(0)], hashes[:-1]]) * MULTIPLIER + word
            n = out[-1].by_token
            may = piece.at >= length - 1
            may[1:] &= (n[:-1] >= CONTEXT) & (n[1:] >= ENTRY)
            at = np.flatnonzero(may)
            gram, mine, first = numbered(hashes[at])
            number = np.full(len(word), -1, np.int32)
            number[at] = mine
            out.append(Grams(gram, at[first], number))
        grams = out[length]
        if length in told or not len(grams.gram):
            heard = told.get(length, np.zeros(0, np.int64))
            grams.n, grams.owned = heard >> 1, heard & 1 != 0
            grams.by_token = np.append(grams.n, 0)[grams.number]  # -1 is the last
    return out


def asking(piece: Piece, told: dict[int, np.ndarray], step: int, depth: int, n_tokens: int, buckets: int) -> pa.Table:
    """Rows of ``ASKED``: grams of ``step`` words, and contexts of two less."""
    rows: list[tuple] = []

    def ask(kind: int, gram: np.ndarray, *sums: np.ndarray) -> None:
        bucket = ((gram >> np.uint64(64 - BITS)) * np.uint64(buckets) >> np.uint64(BITS)).astype(np.int64)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(gram)]):
            for at in range(a, b, 1 << SLOT):
                to = min(b, at + (1 << SLOT))
                rows.append((int(bucket[a]), piece.id, kind, at, to - at, packed_hashes(gram[at:to]),
                             [packed(v[at:to]) for v in sums]))

    grams = by_length(piece, told, min(step, depth + 1))
    if step <= depth + 1:
        number = grams[step].number
        ask(step, grams[step].gram, np.bincount(
            number[piece.trains & (number >= 0)], minlength=len(grams[step].gram)))
    if step > 2:
        shortest, context, entry = grams[step - 3 : step]
        mine = np.flatnonzero(entry.owned & (entry.n >= ENTRY))
        last, which = entry.first[mine], np.flatnonzero(context.n >= CONTEXT)
        under = n_tokens if shortest is None else shortest.by_token[last - 1]
        above = context.by_token[last] / under
        own = entry.n[mine] / context.by_token[last - 1]
        sums = [np.bincount(context.number[last - 1], v, len(context.gram))[which]
                for v in (np.ones(len(mine)), entry.n[mine], own * np.log2(own / above), above)]
        ask(2 - step, context.gram[which], context.n[which].astype(float), *sums)
    return pa.table({c.split()[0]: pa.array(list(v), t) for c, v, t in zip(
        ASKED.split(", "), zip(*rows) if rows else [[]] * 7,
        (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary())))})


def kept(total: np.ndarray, types: np.ndarray, held: np.ndarray, bits: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Words held by each context, and their occurrences; 0 for those that do
    not diverge from their suffix by more than they cost."""
    rest = 1 - held / total
    some = rest > 1e-12
    bits[some] += rest[some] * np.log2(rest[some] / np.maximum(1e-12, 1 - above[some]))
    keep = (types > 0) & (total * bits > 0.5 * types * np.log2(total + 1))
    return np.stack([types * keep, held * keep]).astype(np.int64)


def answer(asked: pa.Table) -> pa.Table:
    """Rows of ``TOLD`` for all rows of a bucket.  The first row of a kind has
    the bucket's sums: tokens, different grams, contexts."""
    out: list[tuple] = []
    kinds = asked["kind"].to_numpy()
    for kind in np.unique(kinds).tolist():
        piece, at, size, gram, sums = (
            asked.filter(kinds == kind)[c].to_pylist() for c in ("piece", "at", "n", "gram", "sums"))
        ends = np.cumsum(size).tolist()
        _, number, first = numbered(np.concatenate([unpacked_hashes(g, n) for g, n in zip(gram, size)]))
        sums = [np.concatenate([unpacked(v, n, np.int64 if kind > 0 else np.float64) for v, n in zip(c, size)])
                for c in zip(*sums)]
        facts = (0, 0, 0)
        if kind > 0:
            n = np.bincount(number, sums[0], len(first)).astype(np.int64)
            facts = tuple(int(v.sum()) for v in (n, n > 0, n >= CONTEXT))
            if kind > 1:
                n[n < ENTRY] = 0
            value = 2 * n[number]
            value[first] += 1
        else:
            value = kept(sums[0][first], *(np.bincount(number, v, len(first)) for v in sums[1:]))[:, number]
        for i, (a, b) in enumerate(zip([0, *ends], ends)):
            out.append((piece[i], kind, at[i], b - a, packed(np.ascontiguousarray(value[..., a:b])),
                        *(facts if i == 0 else (0, 0, 0))))
    return pa.table({c.split()[0]: pa.array(list(v), t) for c, v, t in zip(
        TOLD.split(", "), zip(*out),
        (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))})


def by_kind(told: pa.Table) -> dict[int, np.ndarray]:
    """What a piece was told, in the order of its grams."""
    out: dict[int, list[np.ndarray]] = {}
    rows = sorted(zip(*(told[c].to_pylist() for c in ("kind", "at", "n", "value"))), key=lambda r: r[:2])
    for kind, _, n, value in rows:
        shape = (n,) if kind > 0 else (2, n)
        out.setdefault(kind, []).append(unpacked(value, math.prod(shape), np.int64).reshape(shape))
    return {kind: np.concatenate(v, axis=-1) for kind, v in out.items()}


@dataclass
class Tree:
    """``told``: rows of ``TOLD``.  A piece's grams have twice their occurrences
    (of more words than one, 0 if under ``ENTRY``) and one if the piece owns
    them, its candidates the words they hold and their occurrences (0: not kept)."""

    train_tokens: int
    n_words: int
    told: DataFrame
    contexts: list[int]  # candidates, by length

    @property
    def mass(self) -> float:
        return self.train_tokens + 0.1 * (self.n_words + 1)


def grow(parts: DataFrame, buckets: int, depth: int = DEPTH) -> Tree:
    """The tree of the training texts among staged pieces."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from asking(Piece(b, i), {}, 1, depth, 0, buckets).to_batches()

    told = stage(parts.mapInArrow(first, ASKED).groupBy("bucket").applyInArrow(answer, TOLD), "told")
    n_tokens, n_words = (v or 0 for v in told.agg(F.sum("tokens"), F.sum("types")).first())
    def then(step: int):
        return lambda table, told: asking(Piece(table, 0), by_kind(told), step, depth, n_tokens, buckets)

    rounds = [told]
    for step in range(2, depth + 3):
        asked = with_told(parts, reduce(DataFrame.unionAll, rounds)).applyInArrow(then(step), ASKED)
        rounds.append(stage(asked.groupBy("bucket").applyInArrow(answer, TOLD), "told"))
    told = reduce(DataFrame.unionAll, rounds)
    found = dict(told.where("kind > 0").groupBy("kind").agg(F.sum("contexts")).collect())
    return Tree(n_tokens, n_words, told, [found.get(length, 0) for length in range(1, depth + 1)])


def with_told(parts: DataFrame, told: DataFrame):
    return parts.groupBy("piece").cogroup(told.select("piece", "kind", "at", "n", "value").groupBy("piece"))


def scores(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end token alone.  Repeated rows are scored and
    counted as often as they stand; a null id counts as an empty one, which
    holds it out.  Without training texts every token has probability one as
    the contract's formula says.  Further columns are dropped."""
    with shuffles_freed(docs.sparkSession):
        parts = stage(pieces(docs, depth), "pieces")
        buckets = max(8, math.ceil(parts.count() / BUCKET))
        tree = grow(parts, buckets, depth)
    mass = tree.mass

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        piece, told = Piece(table, 0), by_kind(told)
        grams = by_length(piece, told, depth + 1)
        count = grams[1].by_token
        base = (count + 0.1) / mass
        value = base.copy()
        for length in range(1, depth + 1):
            context, entry = grams[length], grams[length + 1]
            types, held = np.zeros((2, len(context.gram) + 1), np.int64)
            which = np.flatnonzero(context.n >= CONTEXT)
            types[which], held[which] = told.get(-length, np.zeros((2, 0), np.int64))
            before = np.append(np.int32(-1), context.number[:-1])
            at = np.flatnonzero((types[before] > 0) & (piece.at >= length))
            before = before[at]
            under = context.n[before] + types[before]
            value[at] = (entry.by_token[at] + (under - held[before]) * value[at]) / under
        total = lambda v: np.bincount(piece.part, v * piece.own, len(piece.row))
        whole = lambda v: pa.array(total(v).astype(np.int64))
        return pa.table({
            "row": piece.row, "doc_id": piece.doc_id, "held_out": piece.held_out,
            "n_tokens": whole(np.ones(len(count))), "n_known": whole(count > 0),
            "base": pa.array(total(np.log10(base))), "value": pa.array(total(np.log10(value)))})

    return with_told(parts, tree.told).applyInArrow(
        score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, value double",
    ).groupBy("row", "doc_id", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(tree.train_tokens).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"), F.sum("value").alias("score")).drop("row")
