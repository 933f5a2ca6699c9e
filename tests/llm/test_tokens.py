"""Encoding, packing: against the tokenizers library."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nocturne.llm import bpe, packing
from nocturne.llm.common import tokenizer_path

LIBRARY = Tokenizer.from_file(tokenizer_path())
COMMON = st.text(st.sampled_from("abcDEF 'stTlLdD.,!?\n\t\x0b\x1c\x85 　éÉΣİ01½²—🙂中ß́"), max_size=40)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(deadline=None, max_examples=300)
@given(COMMON)
def test_encoder_equals_library(text):
    e, ids = bpe.encoder(tokenizer_path()), ids_of(text)
    assert e.encode(text) == ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    assert e.decode(ids) == decoded
    assert e.digests(text.encode()) == (
        len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest())
    assert np.frombuffer(packing.ids_of(tokenizer_path()).of(text.encode()), "<u4").tolist() == ids


@pytest.mark.parametrize("text", ["a" * 2000, "abc" * 500 + "!" * 400, "<|startoftext|>x<|endoftext|> <|ENDOFTEXT|>"])
def test_long_words_and_special_tokens(text):
    e = bpe.encoder(tokenizer_path())
    assert e.encode(text) == ids_of(text)
    assert e.digests(text.encode())[0] == len(ids_of(text))
    assert np.frombuffer(packing.ids_of(tokenizer_path()).of(text.encode()), "<u4").tolist() == ids_of(text)


def test_long_merge_equals_scan():
    e = bpe.encoder(tokenizer_path())
    parts = [e.inner[b] for b in b"internationalisation" * 4]
    assert e.merge(list(parts)) == e.merge_long(list(parts))


def test_encoding_of_all_rows(docs, data):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                  for r in bpe.encoding_digests(docs, tokenizer_path()).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for doc_id, text, *_ in data:
        ids = ids_of(text)
        want[doc_id, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_round_trip_of_ids(docs, data):
    got = bpe.encode(docs, tokenizer_path()).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(ids_of(t))) for i, t, *_ in data)


def test_empty_tables(no_docs):
    assert bpe.encoding_digests(no_docs, tokenizer_path()).count() == 0
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def check_packed(rows, data, capacity):
    want = Counter()
    for doc_id, text, *_ in data:
        ids = [*ids_of(text), 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want[doc_id, piece, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(docs, data, capacity):
    rows = packing.pack(docs, tokenizer_path(), capacity).collect()
    n = check_packed(rows, data, capacity)
    bound = packing.lower_bound(np.array([r.length for r in rows]), capacity)
    assert bound <= n <= bound + 1


def test_exchange_between_partitions(spark):
    sizes = [60, 50, 41, 34, 33, 30] * 40
    items = spark.createDataFrame(
        [(i, i, 0, 0, s, 0) for i, s in enumerate(sizes)],
        "row long, doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack_pieces(items, 100, partition=30, rounds=5).collect()
    assert len(packed) == len(sizes)
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    alone = packing.pack_pieces(items, 100, partition=30, rounds=1)
    assert max(fill.values()) <= 100 and len(fill) <= alone.select("sequence_id").distinct().count()
    assert len(fill) <= packing.lower_bound(np.array(sizes), 100) * 1.1


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_lower_bound_is_a_bound(sizes):
    """Against the best packing found by trying all."""
    def best(left, bins):
        if not left:
            return len(bins)
        out, seen = len(sizes), set()
        for i, space in enumerate(bins):
            if space >= left[0] and space not in seen:
                seen.add(space)
                out = min(out, best(left[1:], bins[:i] + [space - left[0]] + bins[i + 1 :]))
        return min(out, best(left[1:], [*bins, 12 - left[0]]))

    n = best(sorted(sizes, reverse=True), [])
    found = packing.best_fit(np.array(sizes), 12)
    assert packing.lower_bound(np.array(sizes), 12) <= n <= found.max() + 1
    assert np.bincount(found, weights=sizes).max() <= 12
