import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "Café", "the", "of", "and", "river", "stone", "cloud", "ember"]
# columns whose names the operators use themselves
CLASHING = {"row": "1", "n": "2", "node": "3", "key": "4", "words": "w", "shard": "5", "x": "6", "label": "7",
            "lowered": "l", "set": "s", "piece": "p", "fold": "f", "spans": "q", "_row": "r"}


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


def rows():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, repeated rows."""
    rng = random.Random(7)
    base = [sentence(rng, rng.randrange(25, 90)) for _ in range(30)]
    near = [" ".join(t.split()[:-1] + ["changed"]) for t in base[:8]]
    odd = [None, "", "  \n\t ", "one", "Two words", "\x1c\x85 odd space", "x" * 3000, "🙂 ﬁ İ Σ",
           "<|endoftext|> inside", "Mail bob.a+1@ex-ample.co.uk or 10.0.0.300 and 1.2.3.4, +1 (499) 555-6503 x",
           "4111 1111 1111 1111 card", "Released under the MIT License.\nlicensed under CC BY-NC 4.0",
           "!!! ### $$$ %%% " * 10, sentence(rng, 20_000)]
    texts = base + base[:5] + near + odd
    out = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", None]), None if i % 9 == 0 else len(t or ""))
           for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, base[2], "en", "a", 5), (None, None, None, None, None)]


def frame(spark, path, data):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    wide = schema + "".join(f", {c} string" for c in CLASHING)
    spark.createDataFrame([(*r, *CLASHING.values()) for r in data], wide).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def data():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, data, tmp_path_factory):
    return frame(spark, str(tmp_path_factory.mktemp("docs") / "t"), data)


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    return frame(spark, str(tmp_path_factory.mktemp("none") / "t"), [])
