"""Classifier, rules, language model."""

import math
import zlib
from collections import Counter
from contextlib import nullcontext
from pathlib import Path

import numpy as np

from nocturne.llm import cascade, cotraining, suffix_tree
from nocturne.session import stage


def test_rules_by_brute_force(docs, data):
    want = Counter()
    for doc_id, text, *_ in data:
        text = text or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want[doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
             len(lines) - len(set(lines)), len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words)] += 1
    got = cascade.judge(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_verdict_does_not_depend_on_order(data):
    names = list(cascade.RULES)
    for _, text, *_ in data:
        raw = (text or "").encode()
        verdicts = {cascade.passes(cascade.Text(raw), order) for order in (names, names[::-1])}
        assert len(verdicts) == 1


def test_cascade_stops_at_the_first_rejection():
    ran = []
    rules = {k: (lambda t, k=k: ran.append(k) or k == "b") for k in "abc"}
    assert not cascade.passes(cascade.Text(b"x"), ["b", "a", "c"], rules)
    assert ran == ["b"]


def test_order_is_by_rejections_per_cost(docs):
    rules = {"never": lambda t: False, "always": lambda t: True}
    assert cascade.cascade_order(docs, rules, sample=10**6) == ["always", "never"]


def test_repeated_words():
    w = [str(i).encode() for i in range(30)]
    assert cascade.repeated_words(w) == 0
    assert cascade.repeated_words(w[:10] + w[:10]) == 20
    assert cascade.repeated_words([b"a"] * 9) == 9
    assert cascade.repeated_words([b"a"] * 8) == 0


def test_filter_keeps_all_columns(docs, no_docs):
    kept = cascade.keep_passing(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        r.doc_id for r in cascade.judge(docs).collect() if r.kept)
    assert cascade.judge(no_docs).count() == 0 and cascade.keep_passing(no_docs).count() == 0


def labelled(spark):
    clean = "the river runs past {} stones and over the old mill where we met {} friends last year in may"
    junk = "BUY!! *** $$$ NOW!! ### {} %%% WIN!! &&& {} CASH!! *** $$$ NOW!! ### %%% WIN!! &&& CASH!!"
    docs = [(i, (junk if i % 4 == 0 else clean).format(i, i * 7), "en", f"s{i % 3}", 90 + i % 7) for i in range(400)]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame([(i, int(i % 4 != 0), "z") for i in range(200)] + [(7, None, "z"), (None, 1, "z")],
                                  "doc_id long, quality int, text string"))


def test_classifier_learns_both_views(spark):
    docs, labels = labelled(spark)
    rows = cotraining.classify(docs, labels).collect()
    assert len(rows) == 400
    assert all(r.kept == (r.doc_id % 4 != 0) for r in rows)
    kept = cotraining.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 300


def test_views_exchange_pseudo_labels(spark):
    """The metadata view learns a source that no labelled document has."""
    docs, labels = labelled(spark)
    from pyspark.sql import functions as F

    told = docs.withColumn("source", F.when((F.col("doc_id") >= 200) & (F.col("doc_id") % 4 == 0), "junkyard")
                           .otherwise(F.col("source")))
    rows = cotraining.prepared(told, labels)
    junk = [r.doc_id for r in rows.where("doc_id >= 200").collect() if r.doc_id % 4 == 0]
    one, more = (cotraining.fit(rows, rounds=n, confident=0.8) for n in (1, 4))
    x = np.array([r.x for r in rows.where(F.col("doc_id").isin(junk[:20])).collect()])
    assert (more.raw(x)["meta"] < one.raw(x)["meta"] - 1).all()


def test_classifier_edge_cases(spark, docs, no_docs, data):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = cotraining.classify(docs, none).collect()
    assert len(rows) == len(data) and all(r.score == 0.5 and r.kept for r in rows)
    some = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (5, 1), (5, 0)], "doc_id long, quality int")
    assert cotraining.classify(docs, some).count() == len(data)
    assert cotraining.classify(no_docs, some).count() == 0


def test_suffix_tree_base_scores(docs, data, no_docs):
    def tokens(text):
        return (text or "").encode().lower().split() + [None]

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(t for i, text, *_ in data if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    want = []
    for i, text, *_ in data:
        t = tokens(text)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        want.append((-1 if i is None else i, held(i), len(t), sum(c[x] > 0 for x in t), n, round(base, 6)))
    got = suffix_tree.scores(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                   round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert suffix_tree.scores(no_docs).count() == 0


def corpus(spark):
    """Words 0 to 9 in a circle, with two ways on that the word before decides."""
    rng = np.random.default_rng(1)
    docs = []
    for i in range(300):
        w = [int(rng.integers(10))]
        for _ in range(60):
            w.append((w[-1] + 1) % 10 if rng.random() < 0.9 else int(rng.integers(10)))
        docs.append((i, " ".join(f"w{x}" for x in w)))
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_suffix_tree_learns_contexts(spark):
    rows = [r for r in suffix_tree.scores(corpus(spark)).collect() if r.held_out]
    per_token = sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    assert per_token > sum(r.base_score for r in rows) / sum(r.n_tokens for r in rows) + 0.5


def tree_by_brute_force(docs, depth=3):
    """(count of each word, tokens) and {context: (b, {word: a})} of the kept contexts."""
    texts = [(text or "").encode().lower().split() + [None] for held_out, text in docs if not held_out]
    words = Counter(t for text in texts for t in text)
    after = {}
    for text in texts:
        for i in range(len(text)):
            for k in range(1, min(depth, i) + 1):
                after.setdefault(tuple(text[i - k : i]), Counter())[text[i]] += 1
    total, kept = sum(words.values()), {}
    for context, seen in after.items():
        n = sum(seen.values())
        if n < 8:
            continue
        above = after.get(context[1:], words)
        held = {w: c for w, c in seen.items() if c >= 2}
        share = {w: above[w] / sum(above.values()) for w in held}
        rest = 1 - sum(held.values()) / n
        bits = sum(c / n * math.log2(c / n / share[w]) for w, c in held.items())
        if rest > 1e-12:
            bits += rest * math.log2(rest / max(1e-12, 1 - sum(share.values())))
        if n * bits > 0.5 * len(held) * math.log2(n + 1):
            under = n + len(held)
            kept[context] = ((n - sum(held.values()) + len(held)) / under, {w: c / under for w, c in held.items()})
    return words, total, kept


def probability(tree, context, word, depth=3):
    words, total, kept = tree
    p = (words[word] + 0.1) / (total + 0.1 * (len(words) + 1))
    for k in range(1, min(depth, len(context)) + 1):
        if tuple(context[-k:]) in kept:
            b, a = kept[tuple(context[-k:])]
            p = a.get(word, 0) + b * p
    return p


def check_scores(docs):
    rows = [(r.row, r.held_out, bytes(r.text).decode()) for r in suffix_tree.prepared(docs).collect()]
    tree = tree_by_brute_force([r[1:] for r in rows])
    want = []
    for _, held_out, text in rows:
        t = text.encode().lower().split() + [None]
        score = sum(math.log10(probability(tree, t[max(0, i - 3) : i], t[i])) for i in range(len(t)))
        want.append((held_out, len(t), round(score, 6)))
    got = suffix_tree.scores(docs).collect()
    assert sorted((r.held_out, r.n_tokens, round(r.score, 6)) for r in got) == sorted(want)
    return tree


def test_suffix_tree_scores_by_brute_force(spark, docs):
    check_scores(docs)
    words, _, kept = tree = check_scores(corpus(spark))
    assert {len(c) for c in kept} >= {1, 2}
    symbols, unseen = [*words, b"never seen"], probability(tree, [], b"never seen")
    assert abs(sum(probability(tree, [], w) for w in symbols) - 1) < 1e-9
    for context in list(kept)[:50]:
        assert abs(sum(probability(tree, context, w) for w in symbols) - 1) < 1e-9
        assert probability(tree, context, b"never seen") <= unseen + 1e-12


def test_suffix_tree_in_small_parts(docs, monkeypatch):
    """Texts cut into parts, many flushes, buckets and wrong marks change nothing."""
    columns = ("n_tokens", "n_known", "base_score", "score")
    rows = lambda: sorted(tuple(round(r[c], 6) for c in columns) for r in suffix_tree.scores(docs).collect())
    want = rows()
    for name, value in (("PIECE", 50), ("FLUSH", 100), ("BUCKET", 1), ("BITS", 8), ("SLOT", 4)):
        monkeypatch.setattr(suffix_tree, name, value)
    assert rows() == want


def test_suffix_tree_grows_with_the_corpus(spark):
    """A phrase that stands 50 times is learned in a small and in a large corpus."""
    rng = np.random.default_rng(3)
    phrase = " ".join(f"p{i}" for i in range(12))

    def model(n):
        other = [" ".join(f"x{int(v)}" for v in rng.zipf(1.3, 200) % 50_000) for _ in range(n)]
        often = [" ".join(f"t{i % (n // 50)}w{k}" for k in range(10)) for i in range(n)]  # each 50 times
        texts = [*other, *often, *[phrase] * 60]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        tree = suffix_tree.grow(stage(suffix_tree.pieces(docs, 3)), 8)
        return tree, suffix_tree.scores(docs).where(f"doc_id = {len(texts) - 1}").first()

    (small, a), (large, b) = model(200), model(2000)
    assert large.train_tokens > 5 * small.train_tokens
    assert all(m > 3 * n for n, m in zip(small.contexts, large.contexts))
    for r in (a, b):
        assert r.score > 0.5 * r.base_score
    assert abs(a.score - b.score) < 3


def test_suffix_tree_sends_few_bytes(spark, monkeypatch):
    """All rounds together shuffle under six bytes a token, as no gram travels back."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"x{int(v)}" for v in rng.zipf(1.3, 1000) % 50_000) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(suffix_tree, "shuffles_freed", lambda _: nullcontext())
    places = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for place in places for f in Path(place.getPath()).glob("*/shuffle_*.data")}
    before = files()
    scored = suffix_tree.scores(docs)
    assert sum(r.n_tokens for r in scored.collect()) == 400 * 1001
    assert sum(f.stat().st_size for f in files() - before) < 6 * 400 * 1001
