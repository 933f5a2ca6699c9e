"""Mixed models, clustered errors, contrasts and spectral sizes on known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nocturne.functions import distributions as P
from nocturne.plans import contrasts as K, draws as D, fits, mixed as M
from nocturne.plans.quantiles import BITS, group_quantiles, with_radix_key
from nocturne.plans import summaries as S

# --- mixed models ---


def made_up(seed, groups=30, between=((4.0, 0.6), (0.6, 0.5)), within=0.7):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        u = rng.multivariate_normal([0, 0], between)
        for _ in range(rng.integers(3, 9)):
            x, s = float(rng.normal()), int(rng.integers(2))
            rows.append((f"g{g}", x, s, float(2 + u[0] + (1 + u[1]) * x - 1.5 * s + rng.normal() * within)))
    return rows


def restricted(rows, between, within):
    """-2 log restricted likelihood from whole covariance matrices, and the fixed effects."""
    a, b, yy, logdet = np.zeros((3, 3)), np.zeros(3), 0.0, 0.0
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        x = np.array([[1, r[1], r[2]] for r in mine])
        y = np.array([r[3] for r in mine])
        v = x[:, :2] @ between @ x[:, :2].T + within * np.eye(len(y))
        inverse = np.linalg.inv(v)
        a, b, yy = a + x.T @ inverse @ x, b + x.T @ inverse @ y, yy + y @ inverse @ y
        logdet += np.linalg.slogdet(v)[1]
    beta = np.linalg.solve(a, b)
    return logdet + np.linalg.slogdet(a)[1] + yy - b @ beta, beta, np.linalg.inv(a)




def fit_of(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double, s int, y double")
    fixed = {"one": F.lit(1.0), "x": F.col("x"), "s": F.col("s")}
    return df, fixed, M.mixed_model(df, "y", fixed, {"one": F.lit(1.0), "x": F.col("x")}, "g")


def test_no_nearby_variances_are_likelier(spark):
    rows = made_up(0)
    _, _, fit = fit_of(spark, [*rows, (None, 1.0, 1, 2.0), ("g1", None, 1, 2.0), ("g1", 1.0, 1, None)])
    assert fit.fixed.n_used == len(rows) and fit.n_groups == 30
    best, beta, inverse = restricted(rows, fit.between, fit.within)
    assert fit.beta == pytest.approx(beta)
    rng = np.random.default_rng(1)
    for _ in range(200):
        nudge = 0.02 * rng.normal(size=(2, 2))
        other = restricted(rows, fit.between + nudge + nudge.T, fit.within * math.exp(0.02 * rng.normal()))[0]
        assert other > best - 1e-9
    cov = {(r.term1, r.term2): r.value for r in fit.fixed.covariance.collect()}
    assert [cov[a, b] for a in fit.fixed.names for b in fit.fixed.names] == pytest.approx(inverse.ravel().tolist())
    parts = {r.component: r.value for r in fit.components.collect()}
    assert parts == {"var(one)": pytest.approx(fit.between[0, 0]), "cov(one, x)": pytest.approx(fit.between[0, 1]),
                     "var(x)": pytest.approx(fit.between[1, 1]), "residual": pytest.approx(fit.within)}


def test_predicted_effects_from_whole_matrices(spark):
    """G Z' V^-1 (y - X b), and the error of that prediction."""
    rows = made_up(6, groups=12)
    _, _, fit = fit_of(spark, rows)
    _, beta, inverse = restricted(rows, fit.between, fit.within)
    got = {(r.group, r.term): (r.estimate, r.se) for r in fit.effects.collect()}
    assert len(got) == 24
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        x = np.array([[1, r[1], r[2]] for r in mine])
        y, z = np.array([r[3] for r in mine]), x[:, :2]
        v = np.linalg.inv(z @ fit.between @ z.T + fit.within * np.eye(len(y)))
        u = fit.between @ z.T @ v @ (y - x @ beta)
        p = v - v @ x @ inverse @ x.T @ v
        error = np.sqrt(np.diag(fit.between - fit.between @ z.T @ p @ z @ fit.between))
        for i, term in enumerate(("one", "x")):
            assert got[g, term] == pytest.approx((u[i], error[i]), rel=1e-6)


def test_scores_of_the_rows_vanish(spark):
    df, fixed, fit = fit_of(spark, made_up(3))
    for r in M.fixed_scores(df, "y", fixed, "g", "x", fit).collect():
        assert abs(r.score) < 1e-12


def test_no_variance_between_groups_is_least_squares(spark):
    """Groups with equal means put the variance at its bound; slopes and intercepts that
    lie on one line put the covariance there."""
    rows = [(f"g{i % 10}", float(i * i % 7), i % 3 % 2, float(i // 10 * 3 % 7)) for i in range(70)]
    df, fixed, both = fit_of(spark, rows)
    one = {"one": F.lit(1.0)}
    alone, flat = M.mixed_model(df, "y", one, one, "g"), fits.linear_model(df, "y", one)
    assert alone.between[0, 0] < 1e-9
    assert alone.beta[0] == pytest.approx(flat.terms.first().estimate)
    assert alone.within == pytest.approx(np.var([r[3] for r in rows], ddof=1))
    best = restricted(rows, both.between, both.within)[0]
    rng = np.random.default_rng(4)
    for _ in range(200):  # covariances nearby
        root = np.linalg.cholesky(both.between + 1e-9 * np.eye(2)) + 0.03 * np.tril(rng.normal(size=(2, 2)))
        assert restricted(rows, root @ root.T, both.within * math.exp(0.02 * rng.normal()))[0] > best - 1e-6


def test_terms_that_rows_do_not_tell_apart_raise(spark):
    df = spark.createDataFrame([(f"g{i % 3}", 1.0, float(i)) for i in range(12)], "g string, x double, y double")
    with pytest.raises(ValueError, match="estimable"):
        M.mixed_model(df, "y", {"one": F.lit(1.0), "x": F.col("x")}, {"one": F.lit(1.0)}, "g")
    with pytest.raises(ValueError, match="usable rows"):
        M.mixed_model(df.limit(0), "y", {"one": F.lit(1.0)}, {"one": F.lit(1.0)}, "g")


def test_crossed_names_and_columns_agree(spark):
    first, second = ("sex", ("m", "f")), ("phase", (1, 2))
    terms = M.crossed_terms(first, second, "night")
    row = spark.createDataFrame([("f", 2, 3.0)], "sex string, phase int, night double").select(
        *[c.alias(n) for n, c in terms.items()]).first()
    for name, value in zip(terms, row):
        assert value == K.coefficient(name, first, second, "night", ("f", 2), 3.0)


# --- clustered logistic fit ---

LEVELS = (("sex", ("m", "f")), ("phase", (1, 2)))


def card_rows(seed=5):
    rng = np.random.default_rng(seed)
    return [(f"I{i}", "mf"[i % 2], p, 40.0 + i % 9, int(rng.binomial(30, 0.2 + 0.05 * (i % 5))), 30)
            for i in range(24) for p in (1, 2) for _ in range(3)]


@pytest.mark.parametrize("covariate", [None, "weight"])
def test_clustered_errors_from_their_definition(spark, covariate):
    rows = card_rows()
    df = spark.createDataFrame(rows, "id string, sex string, phase int, weight double, k int, n int")
    fit = fits.clustered_glm(df, "k", "n", *LEVELS, "id", covariate)
    beta = np.array([r.estimate for r in fit.terms.collect()])
    x = np.array([[1, s == "f", p == 2, s == "f" and p == 2, w][: len(beta)] for _, s, p, w, _, _ in rows], float)
    k, n = (np.array([r[i] for r in rows], float) for i in (4, 5))
    p = 1 / (1 + np.exp(-x @ beta))
    bread = np.linalg.inv((x * (n * p * (1 - p))[:, None]).T @ x)
    score = x * (k - n * p)[:, None]
    assert np.abs(score.sum(0)).max() < 1e-4
    ids = sorted({r[0] for r in rows})
    sums = np.array([score[[r[0] == i for r in rows]].sum(0) for i in ids])
    want = bread @ (sums.T @ sums) @ bread * len(ids) / (len(ids) - 1)
    got = {(r.term1, r.term2): r.value for r in fit.covariance.collect()}
    assert [got[a, b] for a in fit.names for b in fit.names] == pytest.approx(want.ravel().tolist(), rel=1e-6)
    assert fit.clusters == 24 and fit.n_used == len(rows)


# --- contrasts ---


def test_contrasts_are_matrix_products(spark):
    first, second = LEVELS
    names = M.crossed_names(first, second, "night")
    rng = np.random.default_rng(8)
    root = rng.normal(size=(8, 8))
    beta, cov = rng.normal(size=8), root @ root.T
    fit = fits.fit_tables(spark, names, beta, cov, math.inf, 100)
    grid = K.grid_weights(spark, names, first, second, "night", [1.0, 4.0])
    wide = {(s, p, x): np.array([K.coefficient(t, first, second, "night", (s, p), x) for t in names])
            for s in "mf" for p in (1, 2) for x in (1.0, 4.0)}
    for r in K.contrast(fit, grid).collect():
        w = wide[r.sex, r.phase, r.night]
        assert r.estimate == pytest.approx(w @ beta)
        assert r.se == pytest.approx(math.sqrt(w @ cov @ w))
        assert (r.low, r.high) == pytest.approx((r.estimate - 1.959964 * r.se, r.estimate + 1.959964 * r.se), rel=1e-5)
    pairs = K.pair_weights(K.averaged(grid, ["phase"]), ["phase"])
    row = K.contrast(fit, pairs).first()
    w = (sum(wide[s, 1, x] for s in "mf" for x in (1.0, 4.0)) - sum(wide[s, 2, x] for s in "mf" for x in (1.0, 4.0))) / 4
    assert (row.level1, row.level2, row.family) == ("1", "2", 2)
    assert (row.estimate, row.se) == pytest.approx((w @ beta, math.sqrt(w @ cov @ w)))
    for r in K.contrast(fit, K.trend_weights(spark, names, first, second, "night")).collect():
        w = (wide[r.sex, r.phase, 4.0] - wide[r.sex, r.phase, 1.0]) / 3
        assert r.estimate == pytest.approx(w @ beta) and r.se == pytest.approx(math.sqrt(w @ cov @ w))


def test_unknown_terms_fail_and_empty_contrasts_are_zero(spark):
    fit = fits.fit_tables(spark, ["a"], np.array([2.0]), np.array([[4.0]]), 10.0, 12)
    none = spark.createDataFrame([("z", "a", 0.0)], "name string, term string, coef double")
    row = K.contrast(fit, none).first()
    assert row.estimate == 0 and row.se is None and row.p is None
    with pytest.raises(Exception, match="no such term"):
        K.contrast(fit, none.withColumns({"term": F.lit("b"), "coef": F.lit(1.0)})).collect()


def test_range_tail_and_quantiles_against_tables():
    """Upper 5 % points of the studentized range and of t, as printed in tables."""
    for q, k, df in [(3.877, 3, 10), (3.958, 4, 20), (3.314, 3, math.inf), (3.633, 4, math.inf), (2.800, 2, 120)]:
        assert P.studentized_range_tail(q, k, df) == pytest.approx(0.05, abs=2e-4)
    # two means: the range is a t test
    for t, df in [(1.3, 7.0), (2.5, 40.0)]:
        want = float(P.two_sided_p(np.array([t]), np.array([df]))[0])
        assert P.studentized_range_tail(t * math.sqrt(2), 2, df) == pytest.approx(want, abs=1e-8)
    assert P.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert P.t_quantile(0.975, math.inf) == pytest.approx(1.959964, abs=1e-6)


# --- spectral sizes and drift ---


def levinson(x, max_lag=100):
    n, c = len(x), x - x.mean()
    rho = np.array([c[k:] @ c[: n - k] for k in range(min(n, max_lag + 1))]) / (c @ c)
    best = (2.0, 0, 0.0, 1.0)
    for m in range(1, min(n - 1, int(10 * math.log10(n)), max_lag) + 1):
        r = np.array([[rho[abs(i - j)] for j in range(m)] for i in range(m)])
        a = np.linalg.solve(r, rho[1 : m + 1])
        v = 1 - a @ rho[1 : m + 1]
        aic = n * math.log(v) + 2 * m + 2
        if aic < best[0]:
            best = (aic, m, a.sum(), v)
    _, order, total, v = best
    return n * (n - order - 1) / (n - 1) * (1 - total) ** 2 / v


def chains(spark):
    rng = np.random.default_rng(2)
    out = {}
    for name, phi in (("calm", 0.0), ("slow", 0.9), ("wave", -0.7)):
        x, values = 0.0, []
        for _ in range(900):
            x = phi * x + rng.normal()
            values.append(x + (2.0 if name == "slow" and len(values) < 90 else 0.0))
        out[name] = np.array(values)
    rows = [("m", t, i, float(v)) for t, vs in out.items() for i, v in enumerate(vs, 1)]
    return out, spark.createDataFrame(rows, "model string, term string, iter long, value double")


def test_spectral_size_solves_yule_walker(spark):
    values, draws = chains(spark)
    got = {r.term: r.eff_samp for r in D.spectral_size(draws).collect()}
    assert got == {t: pytest.approx(levinson(v)) for t, v in values.items()}
    assert got["slow"] < 200 < 700 < got["calm"] and got["wave"] > 900
    flat = spark.createDataFrame([("m", "t", i, 1.0) for i in range(1, 9)], "model string, term string, iter long, value double")
    assert D.spectral_size(flat).first().eff_samp is None


@pytest.mark.parametrize("block", [10_000, 128])
def test_drift_from_every_start(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    values, draws = chains(spark)
    got = {(r.term, r.start): r.z for r in D.drift_from(draws, starts=4).collect()}
    assert len(got) == 12
    for name, x in values.items():
        n = len(x)
        for b in range(4):
            s = math.ceil(1 + b * (n - 1) / 6)
            early, late = x[s - 1 : math.floor(s + 0.1 * (n - s))], x[math.ceil(n - 0.5 * (n - s)) - 1 :]
            error = sum(p.var(ddof=1) / levinson(p) for p in (early, late))
            assert got[name, s] == pytest.approx((early.mean() - late.mean()) / math.sqrt(error), rel=1e-6)


def test_missing_draws_pair_with_nothing(spark):
    _, draws = chains(spark)
    holes = draws.withColumn("value", F.when(F.col("iter") % 50 != 7, F.col("value")))
    rows = {r.term: r.z for r in D.drift_from(holes, starts=1).collect()}
    assert all(math.isfinite(z) for z in rows.values()) and len(rows) == 3


def test_interval_moves_only_the_ends(spark):
    """The join of the two ends reads a twentieth of the draws on either side."""
    draws = spark.range(2000).selectExpr("'m' AS model", "'t' AS term", "id + 1 AS iter", "CAST(hash(id) AS double) AS value")
    ordered = D.sorted_draws(draws, 4)
    gap = round(0.95 * 2000)
    values = np.sort([r.value for r in draws.collect()])
    width = values[gap:] - values[:-gap]
    row = D.hpd(ordered).first()
    assert (row.conf_low, row.conf_high) == (values[width.argmin()], values[width.argmin() + gap])


# --- radix quantiles ---


def test_radix_keys_never_fall(spark):
    rng = np.random.default_rng(6)
    edge = [2.0**e for e in range(-1074, 1024, 7)]
    near = [float(np.nextafter(v, side)) for v in edge for side in (-math.inf, math.inf)]
    values = [0.0, math.inf, 5e-324, 1.7976931348623157e308, *edge, *near, *np.exp(rng.normal(scale=30, size=500)).tolist()]
    values = sorted({*values, *(-v for v in values)})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for bits in BITS:
        keys = [r.k for r in with_radix_key(df, "v", bits, "k").orderBy("i").collect()]
        assert all(a <= b for a, b in zip(keys, keys[1:]))
        assert len(set(keys)) > 500


def test_quantiles_of_odd_groups(spark):
    rng = np.random.default_rng(7)
    groups = {"one": [3.5], "two": [-1.0, 4.0], "ties": [0.1] * 400 + [0.3] * 3, "zero": [0.0, -0.0, 0.0, 1.0],
              "signs": rng.normal(size=999).tolist(), "wide": (np.exp(rng.normal(scale=60, size=800))).tolist(),
              "close": [1 + i * 2.0**-50 for i in range(300)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None)]
    at = {"p5": 0.05, "half": 0.5, "p99": 0.99}
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in group_quantiles(df, ["g"], "v", at).collect()}
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        assert [got[g][q] for q in at] == pytest.approx(np.percentile(vs, [5, 50, 99]).tolist(), rel=1e-12, abs=0)


def test_no_sort_of_rows_for_quantiles(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "CAST(id AS double) AS v")
    plan = S.five_numbers(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "RangePartitioning" not in plan


# --- leaving clusters out ---


def test_accelerated_intervals_from_refits(spark):
    """Each individual left out of the rows in turn, within cohorts."""
    from nocturne.plans.influence import accelerated_intervals

    rows = [(*r, f"c{int(r[0][1:]) % 3}") for r in card_rows(8)] + [("lone", "m", 1, 40.0, 3, 30, "c9")]
    df = spark.createDataFrame(rows, "id string, sex string, phase int, weight double, k int, n int, cohort string")
    got = {r.term: r for r in accelerated_intervals(df, "k", "n", "id", "cohort", *LEVELS).collect()}

    def terms(kept):
        odds = {}
        for s in "mf":
            for p in (1, 2):
                k, n = (sum(r[i] for r in kept if r[1] == s and r[2] == p) for i in (4, 5))
                odds[s, p] = math.log((k + 0.5) / (n - k + 0.5))
        base = odds["m", 1]
        return {"(Intercept)": base, "sexf": odds["f", 1] - base, "phase2": odds["m", 2] - base,
                "sexf:phase2": odds["f", 2] - odds["m", 2] - odds["f", 1] + base}

    whole, strata = terms(rows), {}
    for who, cohort in {(r[0], r[6]) for r in rows}:
        strata.setdefault(cohort, []).append(terms([r for r in rows if r[0] != who]))
    for term, estimate in whole.items():
        var = bias = two = three = 0.0
        for outs in strata.values():
            values = np.array([o[term] for o in outs])
            m, d = len(values), values.mean() - values
            var += (m - 1) / m * (d @ d)
            bias += (m - 1) * (values.mean() - estimate)
            two, three = two + (((m - 1) * d / m) ** 2).sum(), three + (((m - 1) * d / m) ** 3).sum()
        a = three / 6 / two**1.5
        z0 = a - bias / math.sqrt(var)
        bounds = [estimate + math.sqrt(var) * (z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (-1.959964, 1.959964)]
        r = got[term]
        assert (r.estimate, r.se, r.bias, r.acceleration) == pytest.approx((estimate, math.sqrt(var), bias, a))
        assert (r.low, r.high) == pytest.approx(bounds, rel=1e-5) and r.clusters == 25
