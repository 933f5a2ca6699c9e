"""Quality classifier by co-training of two views.

The text view measures the content, the metadata view knows language, source and
length.  Both are logistic regressions.  In every round each view labels the
unlabelled documents it is confident of, and the other view is fitted again with
these pseudo-labels.  Held-out labelled documents then calibrate each view, and
the calibrated log-odds are added, less the prior that both hold.

Every Newton step is one pass over staged feature rows that sums gradients and
curvatures of both views; all labelled and all confident documents take part.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.llm.cascade import Text
from nocturne.llm.common import map_texts
from nocturne.session import stage

ROUNDS, STEPS = 3, 5
CONFIDENT = 0.97  # probability of a pseudo-label
PSEUDO = 0.3  # weight of a pseudo-label
RIDGE = 1.0
HELD_OUT = 5  # one labelled document in five calibrates
LANGS, SOURCES, LENGTHS = 8, 32, 16  # hashed names, powers of two
N_TEXT = 12
N_META = 1 + LANGS + SOURCES + LENGTHS
VIEWS = ("text", "meta")


def text_features(raw: bytes) -> list[float]:
    """Measures of the content, each of the order of 1; all 0 but the first for
    a text without words."""
    t = Text(raw)
    n = t.n_words
    if not n:
        return [1.0] + [0.0] * (N_TEXT - 1)
    chars = max(1, len(raw))
    letters = max(1, t.n_letters)
    return [
        1.0, min(4.0, t.n_symbols / n), min(1.0, 5 * t.n_symbols / n), t.n_capitals / letters,
        t.n_repeat_words / n, t.n_stutters / n, t.n_dup_lines / max(1, len(t.lines)),
        min(3.0, t.word_chars / n / 10), len(set(t.words)) / n / (1 + math.log(n) / 10),
        min(1.0, 10 * raw.count(b"!") / chars), min(1.0, 20 * sum(map(raw.count, DIGITS)) / chars),
        min(1.0, 10 / n),
    ]


DIGITS = [bytes([b]) for b in range(48, 58)]


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """One of each kind is 1: hashed language, hashed source, power of two of the length."""
    out = [0.0] * N_META
    out[0] = 1.0
    out[1 + zlib.crc32((lang or "").encode()) % LANGS] = 1.0
    out[1 + LANGS + zlib.crc32((source or "").encode()) % SOURCES] = 1.0
    out[1 + LANGS + SOURCES + min(LENGTHS - 1, max(0, n_chars or 0).bit_length())] = 1.0
    return out


def features(docs: DataFrame) -> DataFrame:
    """row, doc_id, x (both views' features in a row)."""

    def rows(source):
        for doc_id, raw, row, lang, src, n_chars in source:
            yield row, doc_id, text_features(raw) + meta_features(lang, src, n_chars)

    return map_texts(
        docs.withColumn("row", F.monotonically_increasing_id()),
        "row long, doc_id long, x array<double>", rows, "row", "lang", "source", "n_chars")


def with_labels(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """y: the label (null: none), fold: 0 calibrates.  A document's several
    labels count as their majority, none if they are even."""
    votes = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("vote"))
    y = F.when(F.col("vote") > 0.5, 1.0).when(F.col("vote") < 0.5, 0.0)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT))
    return rows.join(votes, "doc_id", "left").withColumns(
        {"y": y, "fold": F.coalesce(fold, F.lit(1)).cast("int")}).drop("vote")


@dataclass
class Model:
    """Weights of both views, their calibration (slope, shift), and the prior log-odds."""

    weights: dict[str, np.ndarray] = field(default_factory=lambda: {
        "text": np.zeros(N_TEXT), "meta": np.zeros(N_META)})
    calibration: dict[str, tuple[float, float]] = field(default_factory=lambda: {
        v: (1.0, 0.0) for v in VIEWS})
    prior: float = 0.0

    def raw(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {"text": x[:, :N_TEXT] @ self.weights["text"], "meta": x[:, N_TEXT:] @ self.weights["meta"]}

    def views(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Calibrated log-odds."""
        return {v: self.calibration[v][0] * z + self.calibration[v][1] for v, z in self.raw(x).items()}

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = self.views(x)
        return z["text"] + z["meta"] - self.prior


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, kernel, names: list[str]) -> dict[str, np.ndarray]:
    """Sum over all rows of the vectors that ``kernel(x, y)`` gives by name.

    A partition sends one vector per name; Spark adds them up by position."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"))
            y = b.column("y").to_numpy(zero_copy_only=False).astype(float)  # null: NaN
            for name, v in kernel(x, y).items():
                total[name] = total.get(name, 0) + v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()),
             pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["name", "v"])

    parts = rows.select("x", "y").mapInArrow(run, "name string, v array<double>")
    sums = parts.select("name", F.posexplode("v").alias("at", "v")).groupBy("name", "at").agg(
        F.sum("v").alias("v")).toArrow().to_pandas()
    out = {n: g.sort_values("at")["v"].to_numpy() for n, g in sums.groupby("name")}
    return {n: out.get(n, np.zeros(0)) for n in names}


def newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient, then curvature, of the weighted log-likelihood."""
    p = sigmoid(x @ w)
    g = x.T @ (weight * (y - p))
    h = (x * (weight * p * (1 - p))[:, None]).T @ x
    return np.concatenate([g, h.ravel()])


def step(w: np.ndarray, sums: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    d = len(w)
    if not len(sums):
        return w
    g, h = sums[:d] - ridge * w, sums[d:].reshape(d, d) + ridge * np.eye(d)
    return w + np.linalg.solve(h, g)


def fit(rows: DataFrame, rounds: int = ROUNDS, steps: int = STEPS, confident: float = CONFIDENT) -> Model:
    """Co-train on rows with fold > 0, calibrate on labelled rows of fold 0."""
    model = Model()
    learning, held_out = rows.where("fold > 0"), rows.where("fold = 0 and y is not null")
    for turn in range(rounds):
        teacher = Model({v: w.copy() for v, w in model.weights.items()})
        for _ in range(steps if not turn else 2):

            def kernel(x, y, turn=turn, teacher=teacher, model=model):
                told = teacher.raw(x)
                parts = {"text": x[:, :N_TEXT], "meta": x[:, N_TEXT:]}
                out = {}
                for view, other in (("text", "meta"), ("meta", "text")):
                    p = sigmoid(told[other])
                    sure = np.isnan(y) & (turn > 0) & (np.maximum(p, 1 - p) >= confident)
                    label = np.where(sure, p > 0.5, np.nan_to_num(y))
                    weight = np.where(sure, PSEUDO, ~np.isnan(y))
                    out[view] = newton(parts[view], label, model.weights[view], weight)
                return out

            sums = summed(learning, kernel, list(VIEWS))
            model.weights = {v: step(w, sums[v]) for v, w in model.weights.items()}
    for _ in range(steps):

        def kernel(x, y, model=model):
            raw = model.raw(x)
            out = {v: newton(np.stack([z, np.ones_like(z)], 1), y, np.array(model.calibration[v]), np.ones(len(y)))
                   for v, z in raw.items()}
            return out | {"n": np.array([len(y), y.sum()])}

        sums = summed(held_out, kernel, [*VIEWS, "n"])
        if not len(sums["n"]):
            break  # nothing to calibrate with: the views stand as they are
        model.calibration = {v: tuple(step(np.array(c), sums[v], 1e-3)) for v, c in model.calibration.items()}
        n, ones = sums["n"]
        model.prior = math.log((ones + 1) / (n - ones + 1))
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score (probabilities of good
    quality) and kept (score of at least one half)."""

    def run(batches):
        for b in batches:
            x = matrix(b.column("x")) if b.num_rows else np.zeros((0, N_TEXT + N_META))
            views, score = model.views(x), sigmoid(model.log_odds(x))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(sigmoid(views["text"])),
                 pa.array(sigmoid(views["meta"])), pa.array(score), pa.array(score >= 0.5)],
                ["doc_id", "held_out", "text_score", "meta_score", "score", "kept"])

    held = F.coalesce((F.col("fold") == 0) & F.col("y").isNotNull(), F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "x").mapInArrow(
        run, "doc_id long, held_out boolean, text_score double, meta_score double, score double, kept boolean")


def prepared(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    return stage(with_labels(features(docs), labels, label), "features")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """`scored` for every document.

    Null and empty texts and null metadata have features like others; repeated
    rows are scored one by one, null ids stay and have no label.  Without any
    label every score is one half, and all are kept.  Further columns are
    dropped."""
    rows = prepared(docs, labels, label)
    return scored(rows, fit(rows))


def accepted(model: Model) -> Column:
    """True for documents that the model keeps, from their own columns."""

    @F.pandas_udf("boolean")
    def kept(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        known = lambda v: None if pd.isna(v) else v
        x = [text_features(bytes(t or b"")) + meta_features(known(a), known(s), int(known(n) or 0))
             for t, a, s, n in zip(text, lang, source, n_chars)]
        return pd.Series(sigmoid(model.log_odds(np.array(x).reshape(len(x), N_TEXT + N_META))) >= 0.5)

    return kept(F.col("text").cast("binary"), "lang", "source", "n_chars")


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows, with all their columns, that the model keeps."""
    return docs.where(accepted(fit(prepared(docs, labels, label))))
