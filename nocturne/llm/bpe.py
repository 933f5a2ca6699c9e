"""Byte-pair encoding and decoding with contiguous rank arrays.

A word is held as a contiguous array of parts with a second array that has the
rank of each adjacent pair.  The smallest rank is searched by a scan, its
boundary deleted, and the two neighbouring ranks refreshed, until no pair has a
rank.  Words of real texts are short, so scans beat any heap; words of more
than ``SHORT`` symbols take a heap over linked parts, which has the same result.

The vocabulary file gives ids, merges and special tokens; it is opened where
the tasks run, from the path that is the parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from nocturne.llm.common import Cache, map_texts

NO_RANK = 1 << 60
SHORT = 256
CACHED_WORDS = 500_000  # per worker
# White space and word pattern of the vocabulary file.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Encoder:
    """Encodes and decodes as the vocabulary file says; one per worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.end] for s in symbols]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.pattern = regex.compile(WORDS)
        self.specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.words = Cache(self.render_word, CACHED_WORDS)
        self.chunks = Cache(self.render, CACHED_WORDS)

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        parts = [self.inner[b] for b in raw[:-1]]
        parts.append(self.last[raw[-1]])
        return self.merge(parts) if len(parts) <= SHORT else self.merge_long(parts)

    def merge(self, parts: list[int]) -> list[int]:
        """The contiguous rank array."""
        get, merged = self.ranks.get, self.merged
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NO_RANK:
            i = ranks.index(least)  # leftmost of equal ranks
            parts[i] = new = merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << 32 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | new, NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """Same merges for a word of any length in n log n steps."""
        get, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def push(i):
            j = after[i]
            if j >= 0 and (rank := get(parts[i] << 32 | parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p in parts if p >= 0]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [i for w in self.pattern.findall(text) for i in self.word(w)]

    def encode(self, text: str) -> list[int]:
        if not self.specials:
            return self.plain(text)
        ids, at = [], 0
        for m in self.specials.finditer(text):
            ids += self.plain(text[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self.plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by a space."""
        return " ".join(self.tokens[i] for i in ids)

    def render_word(self, word: str) -> tuple[bytes, bytes]:
        """Ids and tokens, each followed by a space."""
        ids = self.word(word)
        names = self.tokens
        return ((" ".join(map(str, ids)) + " ").encode(),
                (" ".join([names[i] for i in ids]) + " ").encode())

    def render(self, chunk: bytes) -> tuple[bytes, bytes]:
        """The same for a piece between white space, in ASCII lower case."""
        text = chunk.decode()
        if chunk.isalpha():  # ASCII letters only: one word
            return self.words[text]
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        pairs = [self.words[w] for w in self.pattern.findall(text)]
        return b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])

    def digests(self, text: bytes) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids and of the decoded text.

        White space of ASCII ends words under any normalisation, so pieces
        between it are encoded once and looked up after that."""
        if self.specials and self.specials.search(piece := text.decode()):
            found = self.encode(piece)
            ids, words = " ".join(map(str, found)).encode(), self.decode(found).encode()
            return len(found), hashlib.sha256(ids).hexdigest(), hashlib.sha256(words).hexdigest()
        chunks = self.chunks
        pairs = [chunks[c] for c in text.lower().split()]
        ids, words = b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])
        return ids.count(b" "), hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(words[:-1]).hexdigest()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded text of every whole text.

    A null or empty text has no ids and decodes to "".  Repeated rows stay
    repeated, null ids stay null, further columns are dropped."""

    def rows(source):
        e = encoder(path)
        for doc_id, text in source:
            ids = e.encode(text.decode())
            yield doc_id, ids, e.decode(ids)

    return map_texts(docs, "doc_id long, ids array<int>, decoded string", rows)


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """Like `encode`, with digests instead of ids and decoded text."""

    def rows(source):
        e = encoder(path)
        for doc_id, text in source:
            yield doc_id, *e.digests(text)

    return map_texts(
        docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
