"""Personal data, licenses, the pipeline."""

import hashlib
import math
import os
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from nocturne.llm import disclosure, jaccard, licenses
from nocturne.session import staging_dir

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                twice = [sum(divmod(2 * int(c), 10)) for c in n[-2::-2]]
                ok = 14 <= len(n) <= 19 and (sum(twice) + sum(map(int, n[::-2]))) % 10 == 0
            else:
                ok = kind == "email" or 10 <= len(n) <= 15
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


@settings(deadline=None, max_examples=500)
@given(st.one_of(
    st.text(st.sampled_from("ab.@-+%é 1\n"), max_size=40), st.text(st.sampled_from("0123456789. -+()@a"), max_size=60),
    st.text(st.sampled_from("04 -"), max_size=60)))
def test_base_spans_equal_the_patterns(text):
    assert disclosure.written(disclosure.base_spans(text)) == ",".join(plain_spans(text))


def test_base_spans_of_all_rows(docs, data, no_docs):
    want = Counter()
    for doc_id, text, *_ in data:
        spans = plain_spans(text or "")
        n = Counter(s.split(":")[0] for s in spans)
        want[doc_id, *[n[k] for k in BASE], hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans)] += 1
    assert Counter(tuple(r) for r in disclosure.find(docs).collect()) == want
    assert disclosure.find(no_docs).count() == 0


def test_long_runs_take_no_square_time():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" * 50_000, "a@" * 50_000):
        disclosure.base_spans(text)


def revealing(spark):
    """The nickname stands by one address in different surroundings, "meeting" by many."""
    fill = ["river", "stone", "cloud", "ember", "forest", "harbour", "meadow", "lantern", "copper", "violet"]
    data = []
    for i in range(60):
        w = [fill[(i * k + k) % 10] + "abcdefghij"[(i + k) % 10] for k in range(1, 9)]
        who = "mail zorblax at z@secret.org" if i < 6 else f"meeting with user{i}@mail.org" if i < 40 else "meeting zed"
        data.append((i, " ".join(w[:4]) + " " + who + " " + " ".join(w[4:]), 5))
    data.append((60, "Here is Zorblax, alone.", 5))
    return data, spark.createDataFrame(data, "doc_id long, text string, n_chars long")


@pytest.mark.parametrize("block", [200_000, 1])
def test_disclosing_terms(spark, block):
    data, docs = revealing(spark)
    near, holding, of = 6, 7, 6
    assert near / holding >= disclosure.POSTERIOR and math.log2(near / holding / (of / 61)) < disclosure.BITS
    docs = docs.union(spark.createDataFrame([(1000 + i, f"filler {i}", 5) for i in range(200)], docs.schema))
    told = {r.term: r.posterior for r in disclosure.disclosing(docs).collect()}
    assert "zorblax" in told and told["zorblax"] == pytest.approx(6 / 7) and "meeting" not in told
    found = {r.doc_id: r.spans for r in disclosure.find(docs, block).collect()}
    at = data[60][1].index("Zorblax")
    assert found[60] == f"term:{at}:{at + 7}" and found[50] == "" and found[1000] == ""
    clean = {r.doc_id: (r.text, r.n_chars) for r in disclosure.sanitise(docs, block).collect()}
    assert clean[60] == ("Here is [TERM], alone.", 22)
    assert "zorblax" not in clean[0][0] and "[EMAIL]" in clean[0][0]
    assert clean[50][0] == data[50][1]


def test_copies_do_not_disclose(spark):
    text = "some words around the unusual quibblefrotz john@corp.org and further words behind it"
    docs = spark.createDataFrame([(i, text, 1) for i in range(50)] + [(100, "x", 1)], "doc_id long, text string, n_chars long")
    assert disclosure.disclosing(docs).count() == 0


def test_every_word_may_disclose(spark):
    """Short, CJK and punctuated names, and names with digits; two texts suffice, one does not."""
    names = ["Kim", "李明", "O'Brien", "Jean-Luc", "staff0042", "x7"]
    data = [(10 * i + k, f"here {'abcde'[k]}{i} {name}, n{i}@corp.org {'vwxyz'[k]}{i} now", 1)
            for i, name in enumerate(names) for k in range(5 if i < 2 else 2)]
    data += [(90, "here lonely once@corp.org now", 1), (91, "here and now", 1), (92, "Ask (KIM) or 李明 now", 1)]
    data += [(100 + i, f"here now filler {i}", 1) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long")
    told = {r.term for r in disclosure.disclosing(docs).collect()}
    assert told == {"kim", "李明", "o'brien", "jean-luc", "staff0042", "x7"}
    assert {r.doc_id: r.spans for r in disclosure.find(docs).collect()}[92] == "term:5:8,term:13:15"


def test_a_text_that_repeats_its_contact_counts_once(spark):
    """An ordinary word of ten texts, one of which holds a contact by it in six lines."""
    lines = [f"line{c} before{c} ordinary boss@corp.org after{c} then{c}" for c in "abcdef"]
    data = [(0, "\n".join(lines), 1)] + [(i, f"an ordinary text{i}", 1) for i in range(1, 10)]
    data += [(100 + i, f"filler {i}", 1) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long")
    near = list(disclosure.near_terms(data[0][1], disclosure.base_spans(data[0][1])))
    assert len([t for _, t, _ in near if t == "ordinary"]) == 1
    assert "ordinary" not in {r.term for r in disclosure.disclosing(docs).collect()}
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert all(clean[i] == text for i, text, _ in data[1:10])


def test_sanitised_rows(docs, data, no_docs):
    out = disclosure.sanitise(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    texts = Counter((r.doc_id, r.text) for r in out.collect())
    for doc_id, text, *_ in data:
        if text is None:
            assert texts[doc_id, None]
        elif not plain_spans(text):
            assert texts[doc_id, text]
    assert not any("bob.a+1@" in (t or "") for _, t in texts)
    assert disclosure.sanitise(no_docs).count() == 0


def words_of(text):
    return re.findall("[^\\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_scan(doc_id, text):
    words, starts, base, labels, score = words_of(text), [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += hits
        base |= {label} if hits else set()
    pairs, size, half = licenses.pairs_of(words), licenses.BLOCK_PAIRS, licenses.BLOCK_PAIRS // 2
    parts = [pairs] if len(pairs) <= size else [pairs[s : s + size] for s in range(0, len(pairs) - half, half)]
    for part in parts:
        for template, label in licenses.template_sets():
            c = len(set(part) & set(template)) / len(template)
            if c >= licenses.THRESHOLD:
                labels.add(label)
                score = max(score, c)
    return (doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if starts else score)


def test_license_scan(spark, docs, data, no_docs):
    assert Counter(tuple(r) for r in licenses.scan(docs).collect()) == Counter(plain_scan(r[0], r[1]) for r in data)
    assert licenses.scan(no_docs).count() == 0
    filler = " ".join(f"word{i}" for i in range(70))
    texts = [
        "This  WORK is-licensed under the\tGNU general public license, version 3", "the MIT license the mit LICENSE",
        "Permission is hereby granted, free of charge, to anyone obtaining a copy of this software",
        f"{filler} Released under the mit-license {filler} licensed under the Apache License Version 2.0",
        "redistribution and use in source", "licensed under cc by nc", "lizenz\nmit\nlicense", "MIT\nLICENSE",
        "general public\nlicense", "é" * 10 + " mit license", "license mit license mit",
    ]
    table = [(i, t) for i, t in enumerate(texts)]
    got = licenses.scan(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(plain_scan(*r) for r in table)
    assert {r.doc_id: r.labels for r in got}[2] == "mit"


def test_license_notices_wrap(spark):
    """Notices over several lines count."""
    bsd = ("Redistribution and use in source and binary forms, with or without\n"
           "modification, are permitted provided that the following conditions are met")
    filler = "\n".join(f"word{i} other{i}" for i in range(100))
    texts = [bsd, "Licensed under\nCC BY-NC 4.0", f"{filler}\n{bsd}\n{filler}", filler, "licensed\n" + filler + "\nunder cc by nc 4 0",
             "/*\n * " + bsd.replace(" in ", "\n * in ") + "\n */", "Permission is hereby\ngranted", None]
    rows = {r.doc_id: r for r in licenses.scan(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert tuple(rows[i]) == plain_scan(i, text)
    assert [rows[i].labels for i in range(5)] == ["bsd", "cc-by-nc", "bsd", "", "cc-by-nc"] and rows[5].labels == "bsd"


def test_license_words_without_their_wording(spark):
    """The words of a template alone are no evidence; the telling word has to be there."""
    texts = {"Released under the BSD license": "", "the license under which it was released": "",
             "released under the apache license": "apache", "Licensed under CC BY 4.0": "",
             "released mit ihrem Namen under the Apache License, und mit the license": "apache",
             "Released under the MIT License.": "mit", "licensed under CC BY-NC 4.0": "cc-by-nc"}
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {list(texts)[r.doc_id]: r.labels for r in got} == texts


def test_license_scan_stays_native(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark, tmp_path):
    """Stages over a small folder: what each one decides takes effect."""
    import random

    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("stone", "river", "cloud", "green", "old") for b in "abcdefghijklmnop"]
    texts = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(60)]
    texts[5] += " mail bob@corp.org now"
    texts += texts[:3] + [texts[3] + " more"] + ["### $$$ !!! *** " * 12 + str(i) for i in range(20)] + ["short one"]
    data = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 64)) for i in range(0, 84, 2)], "doc_id long, quality int").write.parquet(
        str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        step(spark, kept, str(tmp_path)).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns, name
    rows = {r.doc_id: r.text for r in kept.collect()}
    clean = {i: t for i, t, *_ in data[:64]}
    groups = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs.where("doc_id < 64")).collect()}
    assert set(rows) == {i for i in clean if groups[i] == i}
    assert "[EMAIL]" in rows[5] and all(rows[i] == clean[i] for i in rows if i != 5)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(rows)


def test_pipeline_keeps_the_last_stage_alone(spark, tmp_path, monkeypatch):
    """What a stage read and shuffled is gone when it has been written."""
    spark.range(2000).selectExpr("id doc_id", "'x' text").write.parquet(str(tmp_path / "documents.parquet"))
    steps = [(f"step{k}", lambda spark, docs, sf_dir: docs.repartition(3, "doc_id")) for k in range(3)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", steps)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}

    before = shuffles()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert not shuffles() - before
    folder = staging_dir(spark).removeprefix("file:")
    assert {x.split("-")[0] for x in os.listdir(folder) if x.startswith("step")} == {"step2"}
    assert out.count() == spark.read.parquet(str(tmp_path / "documents.parquet")).count() == 2000


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
