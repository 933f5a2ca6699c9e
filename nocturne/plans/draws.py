"""Summaries of draws kept in long form: ``model, term, iter, value``.

``iter`` counts 1, 2, … within (model, term) and may have gaps; a null value is
a draw that is missing and counts nowhere.  A term may have any number of
draws: order statistics come from a distributed numbering, densities from a
fixed number of bins, autocorrelations from blocks of bounded length.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from nocturne.functions.columns import bracketed, ratio
from nocturne.operators.timeline import Timeline, seal
from nocturne.session import stage

KEYS = ["model", "term"]
GRID = 512  # points of the density grid
BLOCK = 10_000  # draws per block of the autocorrelation


def posterior_means(draws: DataFrame) -> DataFrame:
    return draws.groupBy(*KEYS).agg(F.avg("value").alias("estimate"))


def p_mcmc(draws: DataFrame) -> DataFrame:
    """Twice the smaller share of draws on one side of zero, at least 1/n."""
    positive = F.avg((F.col("value") > 0).cast("int"))
    floor = F.lit(0.5) / F.count("value")
    return draws.groupBy(*KEYS).agg(
        (2 * F.greatest(floor, F.least(positive, 1 - positive))).alias("pMCMC")
    )


def sorted_draws(draws: DataFrame, chunks: int | None = None) -> Timeline:
    """Draws numbered by value within their term, with the number of draws."""
    known = draws.where(F.col("value").isNotNull()).select(*KEYS, "iter", "value")
    ordered = seal(known, KEYS, ["value", "iter"], chunks, "draws")
    sizes = ordered.index.groupBy(*KEYS).agg(F.sum("_rows").alias("n"))
    return ordered.position("pos").attach(sizes)


def hpd(ordered: Timeline, prob: float = 0.95) -> DataFrame:
    """Narrowest interval that holds ``prob`` of the draws; the first of equals.

    Draw i is paired with draw i + gap by an equi-join on unique positions; only
    the draws of the two ends, a twentieth on either side, are moved.  A single
    draw is an interval of its own.
    """
    wide = F.greatest(F.lit(1), F.bround(F.col("n") * prob).cast("long"))
    gap = F.least(F.col("n") - 1, wide)
    rows = ordered.df.select(*KEYS, "pos", "value", gap.alias("gap"), "n")
    # a low end has a partner only within the first n - gap draws, a high end only after the first gap
    low = rows.where(F.col("pos") + F.col("gap") <= F.col("n")).select(
        *KEYS, (F.col("pos") + F.col("gap")).alias("pos"), F.col("value").alias("low"))
    high = rows.where(F.col("pos") > F.col("gap")).select(*KEYS, "pos", F.col("value").alias("high"))
    ends = low.join(high, [*KEYS, "pos"])
    order = F.struct((F.col("high") - F.col("low")).alias("width"), F.col("pos"))
    best = ends.groupBy(*KEYS).agg(F.min_by(F.struct("low", "high"), order).alias("_best"))
    return best.select(*KEYS, F.col("_best.low").alias("conf_low"), F.col("_best.high").alias("conf_high"))


def _quantile(p: float) -> list[Column]:
    """Values below and above the p-quantile, as aggregates over positions."""
    at = (F.col("n") - 1) * p
    return [
        F.max(F.when(F.col("pos") == F.floor(at) + 1, F.col("value"))),
        F.max(F.when(F.col("pos") == F.ceil(at) + 1, F.col("value"))),
    ]


def bandwidths(ordered: Timeline, adjust: float = 0.1) -> DataFrame:
    """Rule-of-thumb kernel bandwidth with the range of the draws."""
    (a1, b1), (a3, b3) = _quantile(0.25), _quantile(0.75)
    stats = ordered.df.groupBy(*KEYS, "n").agg(
        F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        a1.alias("a1"), b1.alias("b1"), a3.alias("a3"), b3.alias("b3"),
    )

    def between(a: str, b: str, p: float) -> Column:
        at = (F.col("n") - 1) * p
        return F.col(a) + (F.col(b) - F.col(a)) * (at - F.floor(at))

    iqr = between("a3", "b3", 0.75) - between("a1", "b1", 0.25)
    least = F.least(F.col("sd"), iqr / 1.34)
    spread = F.when(least > 0, least).when(F.col("sd") > 0, F.col("sd")).otherwise(
        F.when(F.abs("lo") > 0, F.abs("lo")).otherwise(1.0)
    )
    bw = F.lit(adjust * 0.9) * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return stats.select(*KEYS, "n", "lo", "hi", bw.alias("bw"))


def posterior_mode(ordered: Timeline, adjust: float = 0.1) -> DataFrame:
    """Peak of a Gaussian kernel density on a grid of 512 points.

    Draws are shared out linearly to 512 bins on the map side; from there on
    the work per term is constant.  The density grid reaches 7 bandwidths
    beyond the draws, the peak is looked for up to 3.
    """
    last = GRID - 1
    widths = bandwidths(ordered, adjust).withColumns({
        "from": F.col("lo") - 3 * F.col("bw"), "to": F.col("hi") + 3 * F.col("bw"),
    }).withColumns({
        "start": F.col("from") - 4 * F.col("bw"),
        "span": F.col("to") - F.col("from") + 8 * F.col("bw"),
    }).drop("lo", "hi", "n")
    placed = ordered.attach(widths).df.withColumn(
        "at", (F.col("value") - F.col("start")) / (F.col("span") / last)
    )
    share = F.col("at") - F.floor("at")
    halves = F.array(
        F.struct(F.floor("at").alias("bin"), ((1 - share) / F.col("n")).alias("w")),
        F.struct((F.floor("at") + 1).alias("bin"), (share / F.col("n")).alias("w")),
    )
    bins = placed.select(*KEYS, F.inline(halves)).groupBy(*KEYS, "bin").agg(F.sum("w").alias("w"))
    # distance of neighbouring kernel points of a doubled grid
    pitch = F.col("span") * 2 / (2 * GRID - 1)
    reach = F.ceil(10 * F.col("bw") / pitch)
    zero, end = F.lit(0).cast("long"), F.lit(last).cast("long")
    near = F.sequence(F.greatest(zero, F.col("bin") - reach), F.least(end, F.col("bin") + reach))
    z = (F.col("j") - F.col("bin")) * pitch / F.col("bw")
    kernel = F.exp(-z * z / 2) / (F.col("bw") * math.sqrt(2 * math.pi))
    density = (
        bins.join(widths, KEYS).withColumn("j", F.explode(near))
        .groupBy(*KEYS, "j").agg(F.sum(F.col("w") * kernel).alias("y"))
    )
    grid = widths.withColumn("m", F.explode(F.sequence(zero, end))).withColumn(
        "x", F.col("from") + (F.col("to") - F.col("from")) * F.col("m") / last
    ).withColumn("at", (F.col("x") - F.col("start")) / (F.col("span") / last))
    grid = grid.select(
        *KEYS, "m", "x", F.floor("at").alias("j"), (F.col("at") - F.floor("at")).alias("f")
    )
    left = grid.join(density, [*KEYS, "j"], "left").withColumnRenamed("y", "y0")
    above = density.select(*KEYS, (F.col("j") - 1).alias("j"), F.col("y").alias("y1"))
    nothing = F.lit(0.0)
    height = F.coalesce("y0", nothing) * (1 - F.col("f")) + F.coalesce("y1", nothing) * F.col("f")
    curve = left.join(above, [*KEYS, "j"], "left").withColumn("y", height)
    top = F.struct(F.col("y"), -F.col("m"))
    return curve.groupBy(*KEYS).agg(F.max_by("x", top).alias("mode"))


def combine(draws: DataFrame, combinations: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Linear combinations of terms, draw by draw; the combination is the term.

    A draw in which one of its terms is missing is a missing draw."""
    rows = [(c, t, float(k), len(terms)) for c, terms in combinations.items() for t, k in terms.items()]
    coefs = draws.sparkSession.createDataFrame(rows, "combo string, term string, coef double, parts int")
    whole = F.count("value") == F.max("parts")
    # by draw, not by term, of which one may hold half of all; and before the sums, as
    # a task that sums up first keeps every draw it reads
    by_draw = draws.where(F.col("term").isin({t for _, t, _, _ in rows})).repartition("iter")
    return (
        by_draw.join(F.broadcast(coefs), "term")
        .groupBy("model", F.col("combo").alias("term"), "iter")
        .agg(F.when(whole, F.sum(F.col("coef") * F.col("value"))).alias("value"))
    )


def interaction_table(draws: DataFrame, combinations: Mapping, digits: int | None = 2) -> DataFrame:
    """Mode and interval of each combination."""
    return mode_table(sorted_draws(combine(draws, combinations)), digits)


def mode_table(ordered: Timeline, digits: int | None = 2) -> DataFrame:
    table = posterior_mode(ordered).join(hpd(ordered), KEYS).withColumnRenamed("mode", "estimate")
    shown = ["estimate", "conf_low", "conf_high"]
    return table.select(*KEYS, *[c if digits is None else F.bround(c, digits).alias(c) for c in shown])


def _lagged_products(max_lag: int, length: int):
    """Sums of products per lag of one block; rows before it only serve as partners.

    Draws stand at their ``iter``; where one is missing, a zero adds nothing.
    """

    def products(block: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(max_lag + length)
        first = int(block["block"].iloc[0]) * length + 1 - max_lag
        v[block["iter"].to_numpy() - first] = block["v"].to_numpy()
        sums = [float(np.dot(v[max_lag:], v[max_lag - k: len(v) - k])) for k in range(max_lag + 1)]
        return pd.DataFrame({
            "model": block["model"].iloc[0], "term": block["term"].iloc[0],
            "lag": range(max_lag + 1), "c": sums,
        })

    return products


def autocorrelation(draws: DataFrame, max_lag: int = 100) -> DataFrame:
    """Autocorrelation at the lags from 0 to ``max_lag`` that the draws reach.

    A block holds its own draws and the ``max_lag`` before them, so every
    product is formed once and no group is longer than a block and its head.
    """
    if max_lag > BLOCK:
        raise ValueError(f"a lag of {max_lag} reaches over a block of {BLOCK} draws")
    draws = draws.where(F.col("value").isNotNull())
    means = stage(draws.groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.max("iter").alias("n")), "means")
    block = F.floor((F.col("iter") - 1) / BLOCK)
    step = (F.col("iter") - 1) % BLOCK
    next_block = F.when((step >= BLOCK - max_lag) & ((block + 1) * BLOCK < F.col("n")), block + 1)
    centred = draws.join(means, KEYS).select(
        *KEYS, "iter", (F.col("value") - F.col("mean")).alias("v"),
        F.explode(F.array_compact(F.array(block, next_block))).alias("block"),
    )
    sums = (
        centred.groupBy(*KEYS, "block")
        .applyInPandas(_lagged_products(max_lag, BLOCK), "model string, term string, lag int, c double")
        .groupBy(*KEYS, "lag").agg(F.sum("c").alias("c"))
    )
    # at most max_lag + 1 rows per term from here on
    c0 = F.max(F.when(F.col("lag") == 0, F.col("c"))).over(W.partitionBy(*KEYS))
    scaled = sums.select(*KEYS, "lag", ratio("c", c0).alias("acf"))
    reach = means.select(*KEYS, "n")
    return scaled.join(reach, KEYS).where(F.col("lag") < F.col("n")).drop("n")


def effective_size(draws: DataFrame, max_lag: int = 100, acf: DataFrame | None = None) -> DataFrame:
    """n / (1 + 2 Σ ρ) over the lags before the first that is not positive.

    An estimate from an autoregressive fit differs slightly.
    """
    acf = autocorrelation(draws, max_lag) if acf is None else acf
    lags = acf.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("lags")  # max_lag + 1 at most
    )
    stop = F.array_min(F.transform(F.filter("lags", lambda x: x["acf"] <= 0), lambda x: x["lag"]))
    run = F.filter(
        "lags", lambda x: (x["lag"] > 0) & (F.col("stop").isNull() | (x["lag"] < F.col("stop")))
    )
    rho = F.aggregate(run, F.lit(0.0), lambda total, x: total + x["acf"])
    total = lags.withColumn("stop", stop).select(*KEYS, rho.alias("rho"))
    sizes = draws.groupBy(*KEYS).agg(F.count("value").alias("n"))
    return sizes.join(total, KEYS).select(*KEYS, (F.col("n") / (1 + 2 * F.col("rho"))).alias("eff_samp"))


def levinson_size(rho: Column, n: Column, max_lag: int = 100) -> Column:
    """Effective number of ``n`` draws with the autocorrelations ``rho`` (lags 0, 1, …).

    An autoregression is fitted for every order up to 10 log10 n by the recursion
    of Levinson and Durbin, as a fold; the order of least AIC gives the spectrum
    at zero.  Null where the draws do not vary."""
    most = F.least(n - 1, F.floor(10 * F.log10(n)), F.size(rho) - 1, F.lit(max_lag)).cast("int")
    steps = F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.expr("CAST(array() AS array<int>)"))
    start = F.struct(
        F.expr("CAST(array() AS array<double>)").alias("a"), F.lit(1.0).alias("v"), F.lit(2.0).alias("aic"),
        F.lit(1.0).alias("best_v"), F.lit(0.0).alias("best_sum"), F.lit(0).alias("order"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)

    def reflect(s: Column, m: Column) -> Column:
        """State with the reflection coefficient of order m."""
        seen = total(F.zip_with(s["a"], F.reverse(F.slice(rho, F.lit(2), m - 1)), lambda x, y: x * y))
        k = F.try_divide(F.get(rho, m) - seen, s["v"])
        return F.struct(s["a"].alias("a"), s["v"].alias("v"), s["aic"].alias("aic"), s["best_v"].alias("best_v"),
                        s["best_sum"].alias("best_sum"), s["order"].alias("order"), k.alias("k"), m.alias("m"))

    def step(s: Column, m: Column) -> Column:
        # a one-element transform binds the coefficient once
        return F.get(F.transform(F.array(reflect(s, m)), grown), F.lit(0))

    def grown(s: Column) -> Column:
        k = s["k"]
        a = F.concat(F.zip_with(s["a"], F.reverse(s["a"]), lambda x, y: x - k * y), F.array(k))
        v = s["v"] * (1 - k * k)
        aic = n * F.ln(F.when(v > 0, v)) + 2.0 * s["m"] + 2.0
        better = F.coalesce(aic < s["aic"], F.lit(False))
        return F.struct(
            a.alias("a"), v.alias("v"), F.when(better, aic).otherwise(s["aic"]).alias("aic"),
            F.when(better, v).otherwise(s["best_v"]).alias("best_v"),
            F.when(better, total(a)).otherwise(s["best_sum"]).alias("best_sum"),
            F.when(better, s["m"]).otherwise(s["order"]).alias("order"))

    def finish(s: Column) -> Column:
        left = 1 - s["best_sum"]
        return ratio(n * (n - s["order"] - 1) * left * left, (n - 1) * s["best_v"])

    size = F.aggregate(steps, start, step, finish)
    return F.when(F.get(rho, F.lit(0)).isNotNull(), size)


def spectral_size(draws: DataFrame, max_lag: int = 100, acf: DataFrame | None = None) -> DataFrame:
    """n times the variance over the spectrum at zero of an autoregressive fit, per term."""
    acf = autocorrelation(draws, max_lag) if acf is None else acf
    lags = acf.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("lags"))  # max_lag + 1 at most
    rho = lags.select(*KEYS, F.transform("lags", lambda x: x["acf"]).alias("rho"))
    sizes = draws.groupBy(*KEYS).agg(F.count("value").alias("n"))
    return sizes.join(rho, KEYS).select(*KEYS, levinson_size(F.col("rho"), F.col("n"), max_lag).alias("eff_samp"))


def _window_parts(n: int, starts: int, first: float, last: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last iteration of the early and the late part, for each start."""
    step = (n - 1) / (2 * (starts - 1)) if starts > 1 else 0.0
    begin = np.ceil(1 + np.arange(starts) * step)
    low = np.column_stack([begin, np.ceil(n - last * (n - begin))]).ravel()
    high = np.column_stack([np.floor(begin + first * (n - begin)), np.full(starts, float(n))]).ravel()
    return low.astype(np.int64), high.astype(np.int64)


def _part_products(starts: int, first: float, last: float, max_lag: int, length: int):
    """Sums of products per part and lag over one block, from prefix sums."""

    def products(block: pd.DataFrame) -> pd.DataFrame:
        v, w = np.zeros(max_lag + length), np.zeros(max_lag + length)
        number = int(block["block"].iloc[0])
        head = number * length + 1 - max_lag
        at = block["iter"].to_numpy() - head
        v[at], w[at] = block["v"].to_numpy(), 1.0
        low, high = _window_parts(int(block["n"].iloc[0]), starts, first, last)
        begin = number * length + 1  # iteration at place max_lag
        until = np.clip(high - begin + 1, 0, length)
        parts = []
        for k in range(max_lag + 1):
            now, was = slice(max_lag, None), slice(max_lag - k, len(v) - k)
            since = np.minimum(np.clip(low + k - begin, 0, length), until)
            sums = []
            for x, y in ((v, v), (v, w), (w, v), (w, w)):
                prefix = np.concatenate([[0.0], np.cumsum(x[now] * y[was])])
                sums.append(prefix[until] - prefix[since])
            parts.append(np.column_stack([np.arange(len(low)), np.full(len(low), k), *sums]))
        rows = np.concatenate(parts)
        rows = rows[np.isin(rows[:, 0], np.flatnonzero(until > 0))]
        out = pd.DataFrame(rows, columns=["part", "lag", "p", "a", "b", "c"]).astype({"part": int, "lag": int})
        out.insert(0, "term", block["term"].iloc[0])
        out.insert(0, "model", block["model"].iloc[0])
        return out

    return products


def drift_from(
    draws: DataFrame, starts: int = 20, first: float = 0.1, last: float = 0.5, max_lag: int = 100,
) -> DataFrame:
    """model, term, start, z: the first against the last part of the draws from
    ``start`` on, for starts spread evenly over the first half.

    Errors go by `levinson_size`.  All parts come from one pass over blocks of
    draws: prefix sums of the lagged products give every part's share of a block,
    and only parts × lags sums per block move.  Missing draws pair with nothing."""
    if max_lag > BLOCK:
        raise ValueError(f"a lag of {max_lag} reaches over a block of {BLOCK} draws")
    draws = draws.where(F.col("value").isNotNull())
    means = stage(draws.groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.max("iter").alias("n")), "means")
    block = F.floor((F.col("iter") - 1) / BLOCK)
    place = (F.col("iter") - 1) % BLOCK
    next_block = F.when((place >= BLOCK - max_lag) & ((block + 1) * BLOCK < F.col("n")), block + 1)
    centred = draws.join(means, KEYS).select(
        *KEYS, "iter", "n", (F.col("value") - F.col("mean")).alias("v"),
        F.explode(F.array_compact(F.array(block, next_block))).alias("block"))
    schema = "model string, term string, part int, lag int, p double, a double, b double, c double"
    sums = centred.groupBy(*KEYS, "block").applyInPandas(_part_products(starts, first, last, max_lag, BLOCK), schema)
    sums = sums.groupBy(*KEYS, "part", "lag").agg(*[F.sum(x).alias(x) for x in "pabc"])
    lags = sums.groupBy(*KEYS, "part").agg(F.sort_array(F.collect_list(F.struct("lag", *"pabc"))).alias("lags"))
    zero = F.get("lags", F.lit(0))
    table = lags.select(*KEYS, "part", "lags", zero["c"].alias("size"), ratio(zero["a"], zero["c"]).alias("m"))
    product = lambda x: x["p"] - F.col("m") * (x["a"] + x["b"]) + F.col("m") * F.col("m") * x["c"]
    table = table.select(*KEYS, "part", "size", "m", F.transform("lags", product).alias("c"))
    rho = F.transform("c", lambda x: ratio(x, F.get("c", F.lit(0))))
    table = table.withColumn("rho", rho).withColumn(
        "error", ratio(ratio(F.get("c", F.lit(0)), F.col("size") - 1), levinson_size(F.col("rho"), F.col("size"), max_lag)))
    early = F.col("part") % 2 == 0
    number = F.floor(F.col("part") / 2).cast("int")
    wide = table.groupBy(*KEYS, number.alias("at")).agg(
        F.max(F.when(early, F.col("m"))).alias("m1"), F.max(F.when(~early, F.col("m"))).alias("m2"),
        F.max(F.when(early, F.col("error"))).alias("e1"), F.max(F.when(~early, F.col("error"))).alias("e2"))
    step = (F.col("n") - 1) / F.lit(2 * (starts - 1)) if starts > 1 else F.lit(0.0)
    start = F.ceil(1 + F.col("at") * step)
    return wide.join(means.select(*KEYS, "n"), KEYS).select(
        *KEYS, start.cast("long").alias("start"),
        ratio(F.col("m1") - F.col("m2"), F.sqrt(F.col("e1") + F.col("e2"))).alias("z"))


def drift(draws: DataFrame, first: float = 0.1, last: float = 0.5, max_lag: int = 100) -> DataFrame:
    """z-score of the first against the last part of the draws."""
    draws = draws.where(F.col("value").isNotNull())
    sizes = stage(draws.groupBy(*KEYS).agg(F.max("iter").alias("n")), "sizes")
    placed = draws.join(sizes, KEYS)
    at = F.col("iter")
    early = at <= 1 + first * (F.col("n") - 1)
    late = at >= F.col("n") - last * (F.col("n") - 1)
    begin = F.ceil(F.col("n") - last * (F.col("n") - 1))
    parts = placed.select(
        F.concat_ws("\u0001", "model", "term").alias("model"),
        F.when(early, "early").when(late, "late").alias("term"),
        F.when(early, at).when(late, at - begin + 1).alias("iter"), "value",
    ).where(F.col("term").isNotNull())
    moments = parts.groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    error = moments.join(effective_size(parts, max_lag), KEYS).withColumn(
        "error", F.col("var") / F.col("eff_samp")
    )
    is_early = F.col("term") == "early"
    wide = error.groupBy("model").agg(
        F.max(F.when(is_early, F.col("mean"))).alias("m1"), F.max(F.when(~is_early, F.col("mean"))).alias("m2"),
        F.sum("error").alias("e"),
    )
    names = F.split("model", "\u0001")
    return wide.select(
        names[0].alias("model"), names[1].alias("term"),
        ratio(F.col("m1") - F.col("m2"), F.sqrt("e")).alias("z"),
    )


def excludes_zero(low: str | Column = "conf_low", high: str | Column = "conf_high") -> Column:
    """Both bounds on one side; a bound of exactly 0 counts as not negative."""
    low, high = (F.col(c) if isinstance(c, str) else c for c in (low, high))
    return (low < 0) == (high < 0)


def relabelled(term: Column, labels: Mapping[str, str]) -> Column:
    """Replace the first occurrence of each code inside a term."""
    for code, label in labels.items():
        at = F.instr(term, code)
        tail = F.substring(term, at + len(code), F.length(term))
        swapped = F.concat(F.substring(term, F.lit(1), at - 1), F.lit(label), tail)
        term = F.when(at > 0, swapped).otherwise(term)
    return term


def summary_table(
    draws: DataFrame, labels: Mapping[str, str] | None = None, digits: int = 2,
    max_lag: int = 100, ordered: Timeline | None = None,
) -> DataFrame:
    """Estimate, interval, effective size and pMCMC of every term, with the
    number of draws used."""
    ordered = ordered or sorted_draws(draws)
    table = draws.groupBy(*KEYS).agg(F.avg("value").alias("estimate"), F.count("value").alias("n")).join(hpd(ordered), KEYS)
    table = table.join(effective_size(draws, max_lag), KEYS).join(p_mcmc(draws), KEYS)
    shown = table.select(
        "model", relabelled(F.col("term"), labels or {}).alias("term"),
        *[F.bround(c, digits).alias(c) for c in ("estimate", "conf_low", "conf_high")],
        "eff_samp", "pMCMC", "n",
    )
    return shown.withColumns({
        "CI": bracketed("conf_low", "conf_high"), "excludes_zero": excludes_zero(),
    })


def stack(parts: Sequence[DataFrame]) -> DataFrame:
    """Draws of several models in one table."""
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table
