"""Spelling variants: words one code point apart, by pairs of trie nodes.

The nodes of the trie of all words, and of the trie of the reversed words, are
numbered.  A prefix and a suffix of a word are then two integers.  A word that
skips one code point gives the pair (node before it, node after it); a place
where one may be inserted gives the pair (node up to it, node from it).  Two
words that differ by one replaced code point share a skipping pair; if one has a
code point more, its skipping pair is an inserting pair of the other.  Equal
pairs are equal strings, so no candidate has to be checked.

Numbering goes by sorted ranges: a word shares with its predecessor the nodes of
their common prefix and opens new ones after it.  What a range takes over from
the one before is the path of that range's last word, so one row per range is
put in order on the driver.  A pair belongs to one inserting word and to as many
skipping words as the alphabet has letters, at most: its group is bounded.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nocturne.llm.common import map_texts
from nocturne.operators.joins import lookup_join
from nocturne.session import input_bytes, stage

RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")  # a-z and U+00C0 to U+00FF, in UTF-8
LEAST_LENGTH = 5
LEAST_COUNT = 3
ONE_IN = 97  # runs that lose a code point
HELD = 150_000  # words counted in memory before they are passed on
RANGE_BYTES = 16 * 2**20  # of words per range


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts with at least ``LEAST_LENGTH`` code points
    and ``LEAST_COUNT`` occurrences.

    Words are maximal runs of letters, A-Z lowered.  A run loses one code point
    where the checksum of its id and itself says so, in all its places in that
    text.  Counted per task before anything moves."""

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        totals: Counter = Counter()

        def ready():
            for word, n in totals.items():
                text = word.decode()
                if len(text) >= LEAST_LENGTH:
                    yield text, n
            totals.clear()

        for doc_id, text in rows:
            start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for word, n in Counter(RUN.findall(text.lower())).items():
                if len(word) < LEAST_LENGTH:
                    continue
                h = zlib.crc32(word, start)
                if h % ONE_IN == 0:
                    letters = word.decode()
                    at = h % len(letters)
                    word = (letters[:at] + letters[at + 1 :]).encode()
                totals[word] += n
            if len(totals) > HELD:
                yield from ready()
        yield from ready()

    counts = map_texts(docs, "word string, n long", count)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def common(a: str, b: str) -> int:
    return len(commonprefix((a, b)))


def local_nodes(words: DataFrame) -> DataFrame:
    """Words in sorted ranges with the nodes of their prefixes, numbered within
    the range; and, for each range, a row with its nodes, its first and its last word.  Staged.

    ``shared`` tells how many of its first nodes a word has in common with the
    first word of the range: those may be nodes of an earlier range."""
    spark = words.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-2 * input_bytes(words) // RANGE_BYTES))
    schema = "part int, word string, nodes array<long>, shared int, first string, opened long"
    item = pa.list_(pa.int64())
    arrow = pa.schema([("part", pa.int32()), ("word", pa.string()), ("nodes", item), ("shared", pa.int32()),
                       ("first", pa.string()), ("opened", pa.int64())])

    def number(batches):
        from pyspark import TaskContext

        part, opened, path, last, first, shared = TaskContext.get().partitionId(), 0, [], "", None, 0
        for batch in batches:
            shown, values, ends, shares = batch.column("word"), [], [0], []
            for word in shown.to_pylist():
                if first is None:
                    first, shared, keep = word, len(word), 0
                else:
                    keep = common(last, word)
                    shared = min(shared, keep)
                new = len(word) - keep
                path = path[:keep] + list(range(opened + 1, opened + new + 1))
                opened, last = opened + new, word
                values += path
                ends.append(len(values))
                shares.append(shared)
            n = batch.num_rows
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part), pa.int32()), shown.cast(pa.string()), nodes, pa.array(shares, pa.int32()),
                 pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], schema=arrow)
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip([part, last, path, shared, first, opened], arrow)], schema=arrow)

    ordered = words.select("word").repartitionByRange(ranges, "word").sortWithinPartitions("word")
    return stage(ordered.mapInArrow(number, schema), "trie")


def trie_nodes(words: DataFrame) -> DataFrame:
    """word, nodes: the numbers of the trie nodes of all prefixes of distinct words,
    from one letter to the whole; equal prefixes have equal numbers.

    The number of the whole word rises with the word's place in code-point order."""
    staged = local_nodes(words)
    offset, before, path, fixes = 0, None, [], []
    edges = staged.where("first IS NOT NULL").collect()  # one row per range
    for r in sorted(edges, key=lambda r: r["part"]):
        taken = path[: common(r["first"], before)] if before is not None else []
        fixes.append((r["part"], offset, taken))
        own = min(r["shared"], len(taken))
        path = taken[:own] + [x + offset for x in r["nodes"][own:]]
        offset, before = offset + r["opened"], r["word"]
    table = words.sparkSession.createDataFrame(fixes, "part int, _offset long, _taken array<long>")
    own = F.least(F.col("shared"), F.size("_taken"))
    rest = F.slice("nodes", own + 1, F.size("nodes"))
    nodes = F.concat(F.slice("_taken", F.lit(1), own), F.transform(rest, lambda x: x + F.col("_offset")))
    return staged.where("first IS NULL").join(table, "part").select("word", nodes.alias("nodes"))


def pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words with their numbers, staged; and all node pairs of each word as
    id, n, p, s, skips, single.

    ``skips`` tells a pair that skips a code point from one that leaves room for
    one.  Skipping any letter of a run of equal ones gives the same string;
    ``single`` marks the first, so that a shorter word is met once."""
    backward = trie_nodes(words.select(F.reverse("word").alias("word"))).select(
        F.reverse("word").alias("word"), F.col("nodes").alias("back"))
    forward = trie_nodes(words).select("word", F.col("nodes").alias("ahead"))
    root = F.array(F.lit(0).cast("long"))
    both = words.join(forward, "word").join(backward, "word").select(
        "word", "n", F.element_at("ahead", -1).alias("id"), F.concat(root, "ahead").alias("ahead"),
        F.concat(root, "back").alias("back"))
    both = stage(both, "numbered-words")
    size = F.length("word")
    place = both.select("id", "n", "word", "ahead", "back", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    i, size = F.col("i"), F.length("word")
    at, was = F.substring("word", i + 1, F.lit(1)), F.substring("word", i, F.lit(1))
    gap = F.struct(F.get("ahead", i).alias("p"), F.get("back", size - i).alias("s"),
                   F.lit(False).alias("skips"), F.lit(False).alias("single"))
    skip = F.struct(F.get("ahead", i).alias("p"), F.get("back", size - i - 1).alias("s"),
                    F.lit(True).alias("skips"), ((i == 0) | (at != was)).alias("single"))
    each = F.when(i < size, F.array(gap, skip)).otherwise(F.array(gap))
    return both, place.select("id", "n", F.inline(each))


def nearest(pairs: DataFrame) -> DataFrame:
    """id, n_near, best (n, -id): number of near words and the most frequent one."""
    group = W.partitionBy("p", "s")
    me = F.struct("n", (-F.col("id")).alias("minus"))
    ranked = group.orderBy(F.desc("skips"), F.desc("n"), "id")
    skip, single = F.col("skips"), F.col("single")
    rows = pairs.withColumns({
        "top": F.first(F.when(skip, me)).over(ranked), "next": F.lead(F.when(skip, me)).over(ranked)})
    rows = rows.withColumns({
        "n_skips": F.count_if(skip).over(group), "n_single": F.count_if(single).over(group),
        "gap": F.max(F.when(~skip, me)).over(group), "longer": F.max(F.when(single, me)).over(group)})
    other = F.when(F.col("top.minus") == -F.col("id"), F.col("next")).otherwise(F.col("top"))
    shorter = F.when(single, F.col("gap"))
    near = F.when(skip, F.col("n_skips") - 1 + shorter.isNotNull().cast("int")).otherwise(F.col("n_single"))
    best = F.when(skip, F.greatest(other, shorter)).otherwise(F.col("longer"))
    found = rows.select("id", near.alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root: from each id of (id, form), follow forms to the last.

    Each round doubles the steps; a form is at least twice as frequent as its
    word, so the chains are short and end."""
    table = stage(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = table.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        table = stage(table.join(ahead, "root", "left").select(
            "id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if table.where("_moved").isEmpty():
            return table.drop("_moved")
        table = table.drop("_moved")


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``.

    Words are those of `count_words`.  ``n_near`` counts the words that differ by
    exactly one inserted, deleted or replaced code point; the ``form`` is the most
    frequent of them (ties: first in code-point order), if it is at least twice as
    frequent; ``root`` is reached by following forms.  Null and empty texts have no
    words, a null id is written as nothing in the checksum, repeated rows count
    again, other columns are not looked at.  Without words the result is empty."""
    words = stage(count_words(docs), "words")
    numbered, entries = pairs(words)
    near = stage(nearest(entries), "nearest")
    enough = F.col("best.n") >= 2 * F.col("n")
    linked = stage(numbered.select("id", "word", "n").join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, -F.col("best.minus")).alias("form"), F.when(enough, F.col("best.n")).alias("form_n")), "linked")
    ends = roots(linked.where("form IS NOT NULL").select("id", "form"))
    of_form = linked.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    of_root = linked.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    named = lookup_join(linked.join(ends, "id", "left"), of_form, ["form"], ["id"])
    return lookup_join(named, of_root, ["root"], ["id"]).select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"),
        "n", "n_near", "form_n")
