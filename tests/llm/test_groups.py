"""Near duplicates, sharding, top-k search: against brute force."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nocturne.llm import jaccard, kdshard, topk
from nocturne.session import staging_dir


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_groups(data):
    """doc_id, n_shingles and component_id of every row."""
    sets = [shingles(r[1]) for r in data]
    root = list(range(len(data)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for i, r in enumerate(data):
        ids[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], len(s), least[find(i)] if s else r[0]) for i, (r, s) in enumerate(zip(data, sets)))


@pytest.mark.parametrize("bits, combined", [(1 << 27, 8), (1 << 27, 0), (2000, 8), (0, 8)])
def test_join_equals_brute_force(docs, data, monkeypatch, bits, combined):
    """With all, some and no shingles known to be frequent, combined or not."""
    monkeypatch.setattr(jaccard, "BITS", bits)
    monkeypatch.setattr(jaccard, "COMBINED", combined)
    got = Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect())
    assert got == near_groups(data)


def chain(n):
    """Texts of 40 words, each with one word changed against the one before."""
    words = [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        out.append((i, " ".join(words)))
        words = list(words)
        words[(7 * i) % 40] = f"new{i}"
    return out


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_chains_of_links(spark, monkeypatch, small):
    """With the places of sets broadcast, and joined."""
    monkeypatch.setattr(jaccard, "SMALL_IDS", small)
    data = chain(25) + [(100 + i, t) for i, t in chain(25)]
    random.Random(3).shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == near_groups(data)


def test_shared_passage_links_nothing(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    data = [(i, passage + " " + " ".join(f"d{i}x{j}" for j in range(40))) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.component_id for r in jaccard.near_duplicates(docs).collect()} == set(range(60))


def test_one_of_each_group_stays(docs, data, no_docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    groups = near_groups(data)
    empty = [i for (i, n, _), times in groups.items() if not n for _ in range(times)]
    least = {c for (_, n, c), _ in groups.items() if n}
    assert Counter(r.doc_id for r in rows) == Counter(empty) + Counter(least)
    assert jaccard.keep_one(no_docs).count() == 0 and jaccard.near_duplicates(no_docs).count() == 0


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200) if i % 50 != 49], "a long, b long")
    roots = {r.node: r.root for r in jaccard.components(links).collect()}
    assert all(root == node // 50 * 50 for node, root in roots.items())


def held_files(spark):
    """Shuffle files, and staged tables that no result is read from."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    shuffles = {files.apply(i).getName() for i in range(files.size())}
    folder = staging_dir(spark).removeprefix("file:")
    staged = os.listdir(folder) if os.path.isdir(folder) else []
    return ({x for x in shuffles if x.startswith("shuffle_") and x.endswith(".data")},
            {x for x in staged if x.split("-")[0] in ("counts", "marks", "postings", "pairs", "links", "clusters")})


def test_near_duplicates_leave_no_shuffles(spark, docs, monkeypatch):
    """What a step shuffled or staged is gone when the next one has been written."""
    monkeypatch.setattr(jaccard, "SMALL_IDS", 0)
    shuffles, staged = held_files(spark)
    roots = jaccard.class_components(docs, 100_000)
    after = held_files(spark)
    assert len(after[0] - shuffles) <= 16  # those of the few frequent shingles
    assert after[1] <= staged
    assert roots.count() > 0


@pytest.mark.parametrize("small, part", [(1_000_000, 1), (0, 4)])
def test_only_candidate_sets_travel(spark, monkeypatch, small, part):
    monkeypatch.setattr(jaccard, "SMALL_IDS", small)
    texts = [" ".join(f"d{i}x{j}" for j in range(400)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [jaccard.shingle_set(t.encode()) for t in texts[:2]]
    names = [jaccard.class_name(s) for s in sets]
    met = spark.createDataFrame([(names[0], 5), (names[0], 6), (names[1], 6)], "node long, pair long")
    frequent = spark.sparkContext.broadcast(jaccard.Frequent(np.zeros(64 * 8, np.uint8), 64, False))
    rows = jaccard.sent_sets(docs, met, frequent, 64, part).collect()
    assert sorted((r.pair, r.node) for r in rows) == sorted([(5, names[0]), (6, names[0]), (6, names[1])])
    for r in rows:
        whole = sets[names.index(r.node)]
        high = whole[whole >= np.uint64(2**64 - 2**64 // part)]
        assert (r.size, r.rest) == (len(whole), len(whole) - len(high))
        assert np.array_equal(np.array(r.set, np.int64).view(np.uint64), high) and 0 < len(high)


def test_a_part_of_the_shingles_rules_out_no_link(spark, monkeypatch):
    """Families of near copies of every likeness, some tied by a passage alone."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(50)]
    data = []
    for f in range(12):
        words = [f"f{f}w{i}" for i in range(120)]
        for k in range(8):
            text = list(words)
            for at in rng.sample(range(120), k):
                text[at] = f"n{f}x{k}x{at}"
            data.append((len(data), " ".join(text + passage[: 5 * f])))
    want = near_groups(data)
    assert len({c for (_, _, c) in want}) not in (12, len(data))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BITS", 0)
    assert Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == want


def check_shards(rows, data, shards):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weight = Counter()
    for r in rows:
        weight[r.shard] += r.size
    return weight


def test_shards(docs, data, no_docs):
    check_shards(kdshard.shard(docs).collect(), data, 16)
    assert kdshard.shard(no_docs).count() == 0


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards_are_even_and_keep_copies(spark, shards, monkeypatch):
    monkeypatch.setattr(kdshard, "CHUNK", 20)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc ", k=rng.randrange(50, 400))) for _ in range(1500)]
    texts += texts[:100] + ["hot text of a third of all rows " * 8] * 800
    data = [(i, t, rng.choice(["en", "de"]), f"s{min(19, int(rng.expovariate(0.4)))}", len(t))
            for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    rows = kdshard.shard(docs, shards).collect()
    weight = check_shards(rows, data, shards)
    mean = sum(weight.values()) / shards
    assert max(weight.values()) <= 1.06 * mean and min(weight.values()) >= 0.94 * mean
    of = defaultdict(set)
    for r in rows:
        of[r.size, r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in of.values()) <= 1  # the hot one


def brute_top(vectors, queries, k):
    out = []
    for q, x in queries:
        limit = 2**63 - 1
        found = sorted((-max(-limit, min(limit, sum(a * b for a, b in zip(x, y)))), v) for v, y in vectors if v != q)
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(found[:k])]
    return Counter(out)


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e30])
def test_top_k(spark, scale, monkeypatch):
    """Small, 64-bit and larger scores, over many tiles and merge levels."""
    monkeypatch.setattr(topk, "ROW_TILE", 30)
    monkeypatch.setattr(topk, "QUERY_TILE", 4)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) * scale for v in rng.integers(-3, 4, 4) / 8], "r") for i in range(200)]
    rows += [(200 + i, rows[5][1], "r") for i in range(60)]  # a common vector
    bad = [(300, None, "r"), (301, [1.0, None, 2.0, 3.0], "r"), (302, [1.0, float("nan"), 0.0, 0.0], "r"),
           (350, [float("inf"), 1.0, 1.0, 1.0], "r"), (None, [1.0, 1.0, 1.0, 1.0], "r"), (303, [], "r")]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, row string")
    vectors = topk.integer_vectors(table, "vec_id", "embedding", 256)
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect()
    whole = {r.vec_id: [int(v) for v in r.x] for r in vectors.collect()}
    assert set(whole) == {*range(260), 303}
    want = brute_top(list(whole.items()), [(i, whole[i]) for i in whole if i % 50 == 0], 5)
    assert Counter(tuple(r) for r in got) == want


def test_top_k_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows, want in (([], 0), ([(50, [1.0])], 0), ([(50, [1.0]), (51, [2.0])], 1), ([(1, [1.0]), (2, [1.0])], 0)):
        vectors = topk.integer_vectors(spark.createDataFrame(rows, schema), "vec_id", "embedding", 256)
        assert topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5).count() == want
    twice = topk.integer_vectors(
        spark.createDataFrame([(50, [1.0]), (50, [3.0]), (7, [2.0]), (7, [2.0])], schema), "vec_id", "embedding", 1)
    got = Counter(tuple(r) for r in topk.top_k(twice, F.col("vec_id") == 50, 5).collect())
    assert got == Counter([(50, 1, 7, 2), (50, 2, 7, 2), (50, 1, 7, 6), (50, 2, 7, 6)])
