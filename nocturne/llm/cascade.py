"""Quality rules as a short-circuit cascade.

Every rule says whether it rejects a text.  On a hash sample of the documents
each rule is timed and its rejections counted; rules then run in the order of
rejections per second, and a text that one rejects sees no further rule.  The
verdict is the same in any order: the sample decides speed alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from time import perf_counter_ns

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import map_texts

SAMPLE = 2000  # documents whose rules are timed
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
WINDOW = 8


class Text:
    """One text; each measure is taken when a rule first asks for it."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes split at the six ASCII spaces alone

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        dense = self.raw.translate(None, SPACES)
        return len(dense) if dense.isascii() else len(dense.decode())

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_letters(self) -> int:
        return sum(map(self.raw.lower().count, LETTERS))

    @cached_property
    def n_capitals(self) -> int:
        return sum(map(self.raw.count, CAPITALS))

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before them."""
        w = self.words
        return sum(map(bytes.__eq__, w, w[1:]))


LETTERS = [bytes([b]) for b in range(97, 123)]
CAPITALS = [bytes([b]) for b in range(65, 91)]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 which occurs twice or more.

    Window hashes find the suspects, the windows themselves decide."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        value = value * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    ordered = np.sort(value)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    suspects = np.flatnonzero(np.isin(value, twice)).tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in suspects]
    seen, again = set(), set()
    for w in windows:
        (again if w in seen else seen).add(w)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(suspects, windows):
        if w in again:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def base_failed(t: Text) -> bool:
    return t.n_words < 20 or 100 * t.n_repeat_words > 30 * t.n_words


#: Rules by name; each is true of a text to reject.  Texts of no words fail the first.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < 20,
    "repeated_passages": lambda t: 100 * t.n_repeat_words > 30 * t.n_words,
    "symbols": lambda t: 4 * t.n_symbols > t.n_words,
    "copied_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "capitals": lambda t: 10 * t.n_capitals > 6 * t.n_letters,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words,
    "stutter": lambda t: 10 * t.n_stutters > 3 * t.n_words,
}


def measure(docs: DataFrame, rules: dict[str, Callable], sample: int = SAMPLE) -> DataFrame:
    """rule, n, rejected, nanoseconds over a hash sample of about ``sample`` rows.

    Each rule gets a fresh text, so that its cost holds the measures it needs."""
    share = min(1.0, sample / max(1, docs.count()))
    taken = docs.where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))

    def rows(source):
        for _, raw in source:
            for name, rule in rules.items():
                began = perf_counter_ns()
                rejected = rule(Text(raw))
                yield name, int(rejected), perf_counter_ns() - began

    timed = map_texts(taken, "rule string, rejected long, ns long", rows)
    return timed.groupBy("rule").agg(
        F.count("*").alias("n"), F.sum("rejected").alias("rejected"), F.sum("ns").alias("ns"))


def cascade_order(docs: DataFrame, rules: dict[str, Callable] = RULES, sample: int = SAMPLE) -> list[str]:
    """Names by rejections per cost, highest first; unmeasured rules last.

    One row per rule comes to the driver."""
    gain = {r.rule: r.rejected / max(1, r.ns) for r in measure(docs, rules, sample).collect()}
    return sorted(rules, key=lambda name: (-gain.get(name, 0.0), list(rules).index(name)))


def passes(t: Text, order: list[str], rules: dict[str, Callable] = RULES) -> bool:
    return not any(rules[name](t) for name in order)  # stops at the first rejection


def judge(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed and kept of every text.

    Null and empty texts have no words, fail and are not kept.  Repeated rows
    are judged one by one; null ids stay."""
    order = cascade_order(docs, sample=sample)

    def rows(source):
        for doc_id, raw in source:
            t = Text(raw)
            failed = base_failed(t)
            yield (doc_id, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines,
                   t.n_repeat_words, failed, not failed and passes(t, order))

    return map_texts(
        docs, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean", rows)


def keep_passing(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows, with all their columns, that every rule lets pass."""
    order = cascade_order(docs, sample=sample)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([x is not None and passes(Text(bytes(x)), order) for x in texts], dtype=bool)

    return docs.where(kept(F.col("text").cast("binary")))
