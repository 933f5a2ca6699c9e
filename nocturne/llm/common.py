"""Reading tables, words as bytes, and bounded caches for the operators here."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """Place of the vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """The id, the text as UTF-8 bytes (null: empty) and nothing else that
    could clash, whatever further columns ``docs`` has."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)


def map_texts(
    docs: DataFrame, schema: str, rows: Callable[[Iterator[tuple]], Iterator[tuple]], *more: str
) -> DataFrame:
    """Apply ``rows`` to the (doc_id, text bytes, more...) of each partition.

    Rows flow batch by batch, so memory is bounded by one Arrow batch."""
    from pyspark.sql.types import StructType

    names = ["doc_id", "text", *more]
    out = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)

        def source():
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in names))

        yield from batched(rows(source()), arrow)

    return id_and_text(docs, *more).mapInArrow(run, out)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``size`` rows from tuples in the schema's order."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class Cache(dict):
    """A dict filled by ``make`` that forgets its older half at ``limit`` entries."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:  # long keys seldom come back
            if len(self) >= self.limit:
                for old in list(self)[: self.limit // 2]:
                    del self[old]
            self[key] = value
        return value


class Words(dict):
    """Numbers words as they come and keeps their 64-bit hashes, which are the
    same in every process.  `fresh` starts anew when it has grown large."""

    LIMIT = 600_000

    def __init__(self):
        super().__init__()
        self._hashes, self._new = np.zeros(1 << 16, np.uint64), []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self._new.append(xxhash.xxh3_64_intdigest(word))
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    @property
    def hashes(self) -> np.ndarray:
        """By number."""
        if self._new:
            n = len(self)
            if n > len(self._hashes):
                self._hashes = np.concatenate([self._hashes, np.zeros(max(n, len(self._hashes)), np.uint64)])
            self._hashes[n - len(self._new) : n] = self._new
            self._new = []
        return self._hashes[: len(self)]

    def fresh(self) -> Words:
        return self if len(self) < self.LIMIT else Words()


_words = Words()


def words_of_worker() -> Words:
    """The numbering of this Python worker, kept from task to task."""
    global _words
    _words = _words.fresh()
    return _words


def pieces_of(batch: pa.RecordBatch, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each."""
    lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    part = np.cumsum(np.nan_to_num(lengths.astype(float))) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# one random number for each byte at each of 64 places
_TABLE = mixed(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's begin.

    Words stand between the six ASCII spaces, A-Z are lowered.  A word's hash
    is the mixed sum of the table's numbers for its bytes at their places."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    start[heads] |= inside[heads]
    begins = np.flatnonzero(start)
    edges = np.searchsorted(begins, bounds)
    if not len(begins):
        return np.zeros(0, np.uint64), edges
    at = np.flatnonzero(inside)
    first = np.flatnonzero(start[at])
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    term = _TABLE[(place & 63) << 8 | _LOWER[data[at]]]
    if lengths.max() > 64:
        term *= (place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return mixed(np.add.reduceat(term, first) + lengths.astype(np.uint64)), edges
