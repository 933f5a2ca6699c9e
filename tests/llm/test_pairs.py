"""Content sort, spelling variants and hard negatives beside brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nocturne.llm import contentsort, hardnegatives, spelling
from tests.llm.conftest import frame

# --- content sort ---


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_equal(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[squeezed(text)].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), at == 0, sha) for at, i in enumerate(ids)]
    return Counter(out)


def test_content_sort_as_brute_force(docs, data):
    got = Counter(map(tuple, contentsort.equal_texts(docs).collect()))
    assert got == plain_equal(data)


def test_content_sort_of_an_empty_table(no_docs):
    assert contentsort.equal_texts(no_docs).count() == 0
    assert contentsort.keep_first(no_docs).count() == 0


def test_copies_over_many_ranges(spark, tmp_path):
    """One text holds most rows, another shares its first bytes: both reach over range edges."""
    rng = random.Random(3)
    hot, like = "same words " * 20, "same words " * 20 + "x"
    rows = [(rng.randrange(1000), rng.choice([hot, hot, like, hot.replace(" ", "\n"), f"{hot}{i}"]), "en", "a", 1)
            for i in range(600)] + [(None, hot, "en", "a", 1)] * 3
    docs = frame(spark, str(tmp_path / "t"), rows)
    assert Counter(map(tuple, contentsort.equal_texts(docs).collect())) == plain_equal(rows)
    edges = contentsort.runs(docs, False).where("edge IS NOT NULL")
    assert edges.where("edge.first_size > 0").count() > 4  # the copies did spread


def test_kept_rows_have_all_columns(docs, data):
    kept = contentsort.keep_first(docs)
    assert kept.columns == docs.columns
    want = Counter((r[0], r[4]) for r in plain_equal(data).elements() if r[3])
    got = Counter((r["doc_id"], hashlib.sha256(squeezed(r["text"]).encode()).hexdigest()) for r in kept.collect())
    assert got == want


def test_runs_do_not_depend_on_batches():
    texts = [b"a", b"a", b"b", b"c", b"c", b"c", b"c", b"d"]
    for cut in range(1, len(texts) + 1):
        state, seen = contentsort.Runs(), []
        for at in range(0, len(texts), cut):
            part = texts[at : at + cut]
            batch = pa.record_batch({"doc_id": pa.array(range(at, at + len(part)), pa.int64()), "text": pa.array(part),
                                     "sha": pa.array(part)})
            seen += [r for t in state.feed(batch) for r in t.to_pylist()]
        tables, edge = state.finish()
        seen += [r for t in tables for r in t.to_pylist()]
        assert [(r["run"], r["keep_id"], r["group_size"], r["kept"]) for r in seen] == [
            (0, 0, 2, True), (0, 0, 2, False), (1, 2, 1, True), (2, 3, 4, True), (2, 3, 4, False),
            (2, 3, 4, False), (2, 3, 4, False), (3, 7, 1, True)]
        assert edge == {"first": b"a", "last": b"d", "first_keep": 0, "first_size": 2, "last_keep": 7, "last_size": 1}


# --- spelling variants ---


def plain_words(rows):
    counts = Counter()
    for i, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), words[form[w]] if w in form else -1)
                  for w, n in words.items())


def shown(table):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"])
                  for r in table.collect())


def misspelt(rng, word):
    at = rng.randrange(len(word) + 1)
    letter = rng.choice("aeé")
    return rng.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]])


@pytest.fixture(scope="module")
def spelled(spark, tmp_path_factory):
    rng = random.Random(11)
    stems = ["aaaaaa", "abcabcabc", "letter", "leter", "Straße", "naïveté", "bookkeeper", "z" * 4000, "ÀÉÎõü"]
    rows = []
    for i in range(400):
        words = [rng.choice(stems) for _ in range(6)]
        words += [misspelt(rng, misspelt(rng, w)) if rng.random() < 0.3 else misspelt(rng, w) for w in words[:3]]
        rows.append((i, rng.choice([" ", "-", "1"]).join(words), "en", "a", 1))
    rows += [(None, None, None, None, None), (7, "", "en", "a", 0), rows[0], rows[0], (None, "letter " * 30, "en", "a", 1)]
    return rows, frame(spark, str(tmp_path_factory.mktemp("spelled") / "t"), rows)


def test_variants_as_brute_force(spelled):
    rows, docs = spelled
    want = plain_variants(rows)
    assert shown(spelling.group_variants(docs)) == want
    assert any(w[1] and w[1] != w[2] for w in want)  # some chains have more than one step


def test_variants_of_shared_rows(docs, data, no_docs):
    assert shown(spelling.group_variants(docs)) == plain_variants(data)
    assert spelling.group_variants(no_docs).count() == 0


def test_trie_nodes_name_prefixes(spark):
    """Equal prefixes have equal numbers, whatever range their words are in."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abß") for _ in range(rng.randrange(1, 12))) for _ in range(800)})
    table = spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string"))
    name, numbers = {}, {}
    for r in table.collect():
        assert len(r["nodes"]) == len(r["word"])
        for d, node in enumerate(r["nodes"], 1):
            assert name.setdefault(r["word"][:d], node) == node
        numbers[r["word"]] = r["nodes"][-1]
    assert len(set(name.values())) == len(name)
    order = [numbers[w] for w in sorted(words, key=str.encode)]
    assert order == sorted(order) and len(order) == len(words)


# --- hard negatives ---


def plain_negatives(rows, every, positives, negatives, low, high):
    out = []
    for a in rows:
        if a[0] % every:
            continue
        def scored(same):
            picked = [(-sum(x * y for x, y in zip(a[2], c[2])), c[0]) for c in rows
                      if c[0] != a[0] and (c[1] == a[1]) == same]
            return sorted((max(-(2**63 - 1), min(2**63 - 1, s)), i) for s, i in picked)
        against = scored(False)
        for ps, p in scored(True)[:positives]:
            fit = [(s, n) for s, n in against if low * -ps <= 100 * -s <= high * -ps][:negatives]
            out += [(a[0], p, r, n, -ps, -s) for r, (s, n) in enumerate(fit, 1)]
    return Counter(out)


def vectors(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, row string, x string, slot int") \
        .repartition(5).write.parquet(path)
    return hardnegatives.labelled_vectors(spark.read.parquet(path), "vec_id", "embedding", F.col("label"), 1)


@pytest.mark.parametrize("size", [3, 4_000_000, 3_000_000_000])
def test_negatives_as_brute_force(spark, tmp_path, size):
    """Ties and repeated rows, negative scores, and values beyond doubles and longs."""
    rng = random.Random(size)
    plain = [(i, rng.randrange(3), [float(rng.randrange(-size // 3, size)) // 64 * 64 if size > 2**24 else
                                    float(rng.randrange(-1, size)) for _ in range(rng.choice([4, 4, 3]))]) for i in range(120)]
    plain += [plain[0], plain[0], plain[5], plain[7]]
    import numpy as np
    plain = [(i, c, [float(np.float32(v)) for v in x]) for i, c, x in plain]
    odd = [(200, None, [1.0]), (None, 1, [1.0]), (250, 1, None), (300, 1, [float("nan")]), (350, 1, [None, 1.0])]
    table = vectors(spark, str(tmp_path / "v"), [(*r, "r", "x", 1) for r in plain + odd])
    got = hardnegatives.mine(table, F.col("vec_id") % 5 == 0, 4, 3, 50, 95)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives([(i, c, [int(v) for v in x]) for i, c, x in plain], 5, 4, 3, 50, 95)
    assert Counter(map(tuple, got.collect())) == want and want


def test_batches_of_anchors_change_nothing(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    plain = [(i, i % 2, [float(rng.randrange(0, 9)) for _ in range(6)]) for i in range(200)]
    table = vectors(spark, str(tmp_path / "v"), [(*r, "r", "x", 1) for r in plain])
    monkeypatch.setattr(hardnegatives, "BATCH_BYTES", 400)
    monkeypatch.setattr(hardnegatives, "FAN_IN", 2)
    got = hardnegatives.mine(table, F.col("vec_id") % 10 == 0, 5, 3, 50, 95)
    want = plain_negatives([(i, c, [int(v) for v in x]) for i, c, x in plain], 10, 5, 3, 50, 95)
    assert Counter(map(tuple, got.collect())) == want and want


def test_negatives_of_nothing(spark, tmp_path):
    table = vectors(spark, str(tmp_path / "v"), [])
    assert hardnegatives.mine(table, F.col("vec_id") % 5 == 0, 5, 3, 50, 95).count() == 0


def test_limits_in_whole_numbers():
    import numpy as np
    for s in [*range(-250, 250), 2**63 - 1, -(2**63 - 1), 2**62 + 37]:
        assert int(hardnegatives.share(np.array([s]), 95)[0]) == 95 * s // 100
        assert int(-hardnegatives.share(-np.array([s]), 50)[0]) == -(-50 * s // 100)
