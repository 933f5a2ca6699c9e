"""Summaries, ratings, tests and draw summaries on known values."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nocturne.functions.columns import interval_text, p_label, significance
from nocturne.functions.distributions import two_sided_p
from nocturne.operators.joins import keyed_join
from nocturne.plans import draws as D, effects as E, ratings as R, summaries as S, comparisons as H


def test_phase_durations(spark):
    rows = [(1, 1, dt.datetime(2015, 3, 9, 16), ""), (1, 9, dt.datetime(2015, 3, 9, 22), "switch"),
            (2, 1, dt.datetime(2015, 3, 10, 16), "")]
    events = spark.createDataFrame(rows, "night int, n_event int, ts timestamp_ntz, system_msg string")
    got = {(r.night, r.phase): r.phase_dur for r in S.phase_durations(events).collect()}
    assert got == {(1, 1): 6.0, (1, 2): 6.0, (2, 1): 0.0, (2, 2): 12.0}


def games(spark, rows):
    return spark.createDataFrame(rows, "cohort string, group_night int, id_label string, counterpart string, outcome int")


def test_glicko_one_game(spark):
    got = {r.player: r for r in R.glicko(games(spark, [("g", 1, "A", "B", 1)])).collect()}
    assert got["A"].rating == pytest.approx(2334.865, abs=1e-3)
    assert got["B"].rating == pytest.approx(2065.135, abs=1e-3)
    assert got["A"].rd == pytest.approx(254.359, abs=1e-3)
    assert (got["A"].games, got["A"].wins, got["B"].losses) == (1, 1, 1)


def test_glicko_two_opponents_and_unknown_player(spark):
    rows = [("g", 1, "A", "B", 1), ("g", 1, "A", "C", 1), ("g", 1, "A", None, 1)]
    got = {r.player: r for r in R.glicko(games(spark, rows)).collect()}
    assert got["A"].rating == pytest.approx(2410.541, abs=1e-3)
    assert got["A"].rd == pytest.approx(224.725, abs=1e-3)
    assert set(got) == {"A", "B", "C"}


def brute_glicko(rows):
    """One player at a time, straight from the published formulas."""
    q = math.log(10) / 400
    state, periods = {}, sorted({r[1] for r in rows})
    for step, period in enumerate(periods, 1):
        play = [r for r in rows if r[1] == period]
        before = {}
        for p in {x for r in rows for x in (r[2], r[3])}:
            rating, rd, last = state.get(p, (2200.0, 300.0, None))
            grown = min(math.sqrt(rd**2 + 225 * (step - last if last else 0)), 350)
            before[p] = (rating, grown)
        for p in {x for r in play for x in (r[2], r[3])}:
            rating, rd = before[p]
            info = surprise = 0
            for _, _, a, b, s in play:
                if p not in (a, b):
                    continue
                other, ord_ = before[b if p == a else a]
                g = 1 / math.sqrt(1 + 3 * q**2 * ord_**2 / math.pi**2)
                e = 1 / (1 + 10 ** (-g * (rating - other) / 400))
                info += q**2 * g**2 * e * (1 - e)
                surprise += g * ((s if p == a else 1 - s) - e)
            precision = 1 / rd**2 + info
            state[p] = (rating + q / precision * surprise, math.sqrt(1 / precision), step)
    return state


def test_glicko_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [("g", rng.choice([1, 2, 5]), *rng.sample("ABCDE", 2), 1) for _ in range(40)]
    rows += [("g", 1, "A", "B", 1)] * 30  # a hot pair
    got = {r.player: (r.rating, r.rd) for r in R.glicko(games(spark, rows)).collect()}
    want = brute_glicko(rows)
    assert set(got) == set(want)
    for p, (rating, rd, _) in want.items():
        assert got[p] == (pytest.approx(rating, abs=1e-8), pytest.approx(rd, abs=1e-8))


def test_ranking_of_the_toy_games(spark):
    """C beats B twice, B beats C ten times, A beats each twice; one game a day."""
    pairs = [("C", "B")] * 2 + [("B", "C")] * 10 + [("A", "B")] * 2 + [("A", "C")] * 2
    rows = [("toy", day, w, l, 1) for day, (w, l) in enumerate(pairs, 1)]
    table = R.glicko(games(spark, rows))
    want = brute_glicko(rows)
    ranks = {r.id_label: r.glicko_rank for r in R.ranking(table).collect()}
    order = sorted(want, key=lambda p: -want[p][0])
    assert ranks == {p: i for i, p in enumerate(order, 1)}
    # A won every game but played few: it need not have played most to lead
    assert order[0] == "A"


def test_equal_games_are_symmetric(spark):
    got = {r.player: r.rating for r in R.glicko(
        games(spark, [("g", 1, "A", "B", 1), ("g", 1, "B", "A", 1)])).collect()}
    assert got["A"] == pytest.approx(2200) and got["B"] == pytest.approx(2200)


def test_welch(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 4.0), ("b", 6.0), ("c", 1.0)],
                               "g string, v double")
    rows = {(r.group1, r.group2): r for r in H.with_p(H.welch(df, "v", "g")).collect()}
    ab = rows["a", "b"]
    assert ab.statistic == pytest.approx(-1.549193, abs=1e-6)
    assert ab.df == pytest.approx(2.941176, abs=1e-6)
    assert rows["a", "c"].statistic is None and rows["a", "c"].p is None


def test_p_values():
    # closed forms for 1, 2 and 4 degrees of freedom
    t = np.array([0.5, 2.0, 7.0])
    assert two_sided_p(t, np.full(3, 1.0)) == pytest.approx(1 - 2 / np.pi * np.arctan(t), rel=1e-10)
    assert two_sided_p(t, np.full(3, 2.0)) == pytest.approx(1 - t / np.sqrt(2 + t * t), rel=1e-10)
    u = t / np.sqrt(4 + t * t)
    assert two_sided_p(t, np.full(3, 4.0)) == pytest.approx(1 - 1.5 * (u - u**3 / 3), rel=1e-9)


def test_holm(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "id int, p double")
    got = {r.id: r.p_adj for r in H.holm(df, "p", ["id"]).collect()}
    assert got == {1: pytest.approx(0.03), 2: pytest.approx(0.06), 3: pytest.approx(0.06), 4: None}


def test_paired(spark):
    df = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0), ("y", 1, 2.0), ("y", 2, 4.0), ("z", 1, 9.0)],
                               "id string, phase int, v double")
    row = H.paired(df, "v", "phase", ["id"]).first()
    assert (row.n, row.df) == (2, 1.0) and row.statistic == pytest.approx(-3.0)


def draws(spark, values, term="a"):
    return spark.createDataFrame([("m", term, i, float(v)) for i, v in enumerate(values, 1)],
                                 "model string, term string, iter long, value double")


def test_hpd_and_p(spark):
    row = D.hpd(D.sorted_draws(draws(spark, [10, 2, 1, 4, 3]), 3), 0.6).first()
    assert (row.conf_low, row.conf_high) == (1, 4)
    assert D.p_mcmc(draws(spark, range(1, 2001))).first().pMCMC == pytest.approx(0.0005)


def test_mode_of_a_hump(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(3, 0.3, 3000), rng.normal(-2, 2, 1000)])
    got = D.posterior_mode(D.sorted_draws(draws(spark, values)), adjust=1.0).first()["mode"]
    # the same density without bins
    sd = values.std(ddof=1)
    iqr = np.subtract(*np.percentile(values, [75, 25]))
    bw = 0.9 * min(sd, iqr / 1.34) * len(values) ** -0.2
    grid = np.linspace(values.min() - 3 * bw, values.max() + 3 * bw, 512)
    density = np.exp(-(((grid[:, None] - values) / bw) ** 2) / 2).sum(axis=1)
    assert got == pytest.approx(grid[density.argmax()], abs=3 * (grid[1] - grid[0]))


def test_autocorrelation_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 50)
    rng = np.random.default_rng(2)
    values = np.cumsum(rng.normal(size=230))
    got = {r.lag: r.acf for r in D.autocorrelation(draws(spark, values), 20).collect()}
    v = values - values.mean()
    want = {k: (v[: len(v) - k] * v[k:]).sum() / (v * v).sum() for k in range(21)}
    assert got == {k: pytest.approx(x, abs=1e-12) for k, x in want.items()}


def test_short_draws_have_short_lags(spark):
    assert D.autocorrelation(draws(spark, [1, 2, 4]), 10).count() == 3


def test_combinations_and_slopes_agree(spark):
    """Slope of a cell = sum of the terms of the crossed model."""
    rng = np.random.default_rng(3)
    rows = [(s, p, float(n), float(rng.normal())) for s in "mf" for p in (1, 2) for n in range(6)]
    df = spark.createDataFrame(rows, "sex string, phase int, night double, y double")
    slopes = E.cell_trends(df, "y", "night", ["sex", "phase"])
    terms = E.treatment_terms(slopes, "slope", ("sex", ("m", "f")), ("phase", (1, 2)))
    long = terms.select(F.lit("m").alias("model"), "term", F.lit(1).cast("long").alias("iter"), "value")
    total = D.combine(long, {"f2": {"(Intercept)": 1, "sexf": 1, "phase2": 1, "sexf:phase2": 1}}).first().value
    want = slopes.where("sex = 'f' and phase = 2").first().slope
    assert total == pytest.approx(want)


def test_glm_without_covariate_is_the_cells(spark):
    rows = [("m", 1, 30, 100), ("m", 2, 20, 100), ("f", 1, 10, 90), ("f", 2, 25, 110), ("f", 2, 5, 20)]
    card = spark.createDataFrame(rows, "sex string, phase int, k int, n int")
    fit = {r.term: r.estimate for r in E.binomial_glm(card, "k", "n", ("sex", ("m", "f")), ("phase", (1, 2))).collect()}
    cells = E.cell_log_odds(card, "k", "n", ["sex", "phase"])
    terms = E.treatment_terms(cells, "log_odds", ("sex", ("m", "f")), ("phase", (1, 2)))
    for r in terms.collect():
        assert fit[r.term] == pytest.approx(r.value, abs=1e-5)


def test_interval_flags_and_text(spark):
    df = spark.createDataFrame([(-0.12, 0.0), (0.0, 0.06), (-0.16, -0.06)], "lo double, hi double")
    assert [r[0] for r in df.select(D.excludes_zero("lo", "hi")).collect()] == [False, True, True]
    text = df.select(interval_text(F.lit(0.5), "lo", "hi", "estimate", "square")).first()[0]
    assert text == "estimate = 0.5, 95% CI = [-0.12, 0.0]"
    assert df.select(interval_text(F.lit(0.5), "lo", "hi", "e", "<>")).first()[0] == "e = 0.5, 95% CI = <-0.12, 0.0>"
    marks = spark.createDataFrame([(0.00005,), (0.03,), (0.2,)], "p double")
    assert [tuple(r) for r in marks.select(significance("p"), p_label("p")).collect()] == [
        ("****", "<0.001"), ("*", "0.030"), ("ns", "0.200")]


def test_terms_relabelled(spark):
    df = spark.createDataFrame([("sexf:phase2:phase2",)], "term string")
    labels = {"sexf": "sex (female)", "phase2": "treatment (dispersed)"}
    assert df.select(D.relabelled(F.col("term"), labels)).first()[0] == "sex (female):treatment (dispersed):phase2"


def test_joins_refuse_unnamed_shared_columns(spark):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError, match="not keys"):
        keyed_join(a, a, ["k"])
    nulls = spark.createDataFrame([(None, 5)], "k int, w int")
    left = spark.createDataFrame([(None, 1)], "k int, v int")
    assert keyed_join(left, nulls, ["k"]).first().w is None
    assert keyed_join(left, nulls, ["k"], null_safe=True).first().w == 5
    right = keyed_join(left, nulls, ["k"], "right", null_safe=True).first()
    assert (right.k, right.v, right.w) == (None, 1, 5)


def test_five_numbers(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=101).round(1).tolist() + [9.0]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    row = S.five_numbers(df, ["g"], "v").first()
    q = np.percentile(values, [25, 50, 75])
    assert [row.q1, row["median"], row.q3] == pytest.approx(q.tolist())
    reach = 1.5 * (q[2] - q[0])
    inside = [v for v in values if q[0] - reach <= v <= q[2] + reach]
    assert (row.low, row.high) == (min(inside), max(inside))


def poisson_weight(seed, who, replicate):
    import hashlib

    u = int(hashlib.md5(f"{seed}:{who}:{replicate}".encode()).hexdigest()[:8], 16) / 2**32
    total, count = math.exp(-1), 0
    while u >= total:
        count += 1
        total += math.exp(-1) / math.factorial(count)
    return count


def test_bootstrap_of_counts(spark):
    rng = random.Random(9)
    rows = [(f"I{i}", "mf"[i % 2], p, rng.randrange(5), 20) for i in range(30) for p in (1, 2)]
    card = spark.createDataFrame(rows, "id string, sex string, phase int, k int, n int")
    table = E.bootstrap_draws(card, "k", "n", "id", ("sex", ("m", "f")), ("phase", (1, 2)), "m", 5, seed=7)
    got = {(r.term, r.iter): r.value for r in table.collect()}
    for it in range(1, 6):
        odds = {}
        for s in "mf":
            cell = [(k, n, poisson_weight(7, i, it)) for i, x, p, k, n in rows if x == s and p == 1]
            k, n = sum(k * w for k, _, w in cell), sum(n * w for _, n, w in cell)
            odds[s] = math.log((k + 0.5) / (n - k + 0.5))
        assert got["(Intercept)", it] == pytest.approx(odds["m"])
        assert got["sexf", it] == pytest.approx(odds["f"] - odds["m"])


def test_bootstrap_of_trends(spark):
    rng = np.random.default_rng(6)
    rows = [(f"g{c}", s, p, float(x), float(rng.normal()))
            for c in range(9) for s in "mf" for p in (1, 2) for x in range(7)]
    df = spark.createDataFrame(rows, "cohort string, sex string, phase int, night double, y double")
    table = E.bootstrap_trend_draws(
        df, "y", "night", "cohort", ("sex", ("m", "f")), ("phase", (1, 2)), "m", 4, seed=1)
    got = {(r.term, r.iter): r.value for r in table.collect()}
    assert len(got) == 32
    for it in range(1, 5):
        lines = {}
        for s in "mf":
            cell = [(x, y, poisson_weight(1, c, it)) for c, sx, p, x, y in rows if sx == s and p == 2]
            x, y, w = map(np.array, zip(*cell))
            lines[s] = np.polyfit(x, y, 1, w=np.sqrt(w))
        total = sum(got[t, it] for t in ("night", "sexf:night", "phase2:night", "sexf:phase2:night"))
        assert total == pytest.approx(lines["f"][0])
        assert got["(Intercept)", it] + got["phase2", it] == pytest.approx(lines["m"][1])


def test_missing_draws_count_nowhere(spark):
    """A null is no draw: intervals, pMCMC and combinations do without it."""
    values = [float(i) for i in range(1, 101)]
    rows = [("m", "a", i, v if i != 50 else None) for i, v in enumerate(values, 1)]
    rows += [("m", "b", i, 1.0) for i in range(1, 101)]
    table = spark.createDataFrame(rows, "model string, term string, iter long, value double")
    a = table.where("term = 'a'")
    row = D.hpd(D.sorted_draws(a)).first()
    assert (row.conf_low, row.conf_high) == (1.0, 96.0)
    assert D.p_mcmc(a).first().pMCMC == pytest.approx(1 / 99)
    assert D.summary_table(a, max_lag=5).first().n == 99
    total = {r.iter: r.value for r in D.combine(table, {"s": {"a": 1, "b": 2}}).collect()}
    assert total[50] is None and total[51] == 53.0
    assert D.effective_size(a, 5).first().eff_samp > 0


def test_single_draw_is_its_interval(spark):
    row = D.hpd(D.sorted_draws(draws(spark, [4.0]))).first()
    assert (row.conf_low, row.conf_high) == (4.0, 4.0)


def test_autocorrelation_goes_by_iter(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 30)
    rng = np.random.default_rng(8)
    values = np.cumsum(rng.normal(size=100))
    kept = [i for i in range(100) if i % 10]
    rows = [("m", "a", i + 1, float(values[i])) for i in kept] + [("m", "a", 1, None)]
    table = spark.createDataFrame(rows, "model string, term string, iter long, value double")
    got = {r.lag: r.acf for r in D.autocorrelation(table, 20).collect()}
    v = np.zeros(100)
    v[kept] = values[kept] - values[kept].mean()
    want = {k: (v[: 100 - k] * v[k:]).sum() / (v * v).sum() for k in range(21)}
    assert got == {k: pytest.approx(x, abs=1e-12) for k, x in want.items()}
    with pytest.raises(ValueError, match="reaches over"):
        D.autocorrelation(table, 31)


def test_other_levels_are_refused(spark):
    rows = [("m", 1, 30, 100), ("m", 2, 20, 100), ("f", 1, 10, 90), ("f", 2, 25, 110), ("f", 3, 5, 20)]
    card = spark.createDataFrame(rows, "sex string, phase int, k int, n int")
    with pytest.raises(Exception, match="level"):
        E.binomial_glm(card, "k", "n", ("sex", ("m", "f")), ("phase", (1, 2)))
    cells = E.cell_log_odds(card, "k", "n", ["sex", "phase"])
    with pytest.raises(Exception, match="level"):
        E.treatment_terms(cells, "log_odds", ("sex", ("m", "f")), ("phase", (1, 2))).collect()


def test_glm_scores_vanish_and_rows_are_counted(spark):
    rng = random.Random(3)
    rows = [("mf"[i % 2], 1 + i % 4 // 2, rng.randrange(8), 20, None if i == 7 else rng.random()) for i in range(60)]
    card = spark.createDataFrame(rows, "sex string, phase int, k int, n int, weight double")
    levels = ("sex", ("m", "f")), ("phase", (1, 2))
    fit = E.binomial_glm(card, "k", "n", *levels, "weight")
    assert {r.n_used for r in fit.collect()} == {59}
    assert all(abs(r.score) < 1e-6 for r in E.score_sums(card, "k", "n", fit, *levels, "weight").collect())


def test_null_groups_are_groups(spark):
    rows = [(None, 1, "A", "B", 1), (None, 2, "A", "B", 1), ("g", 1, "A", "B", 1)]
    rated = {(r.cohort, r.player): r.rating for r in R.glicko(games(spark, rows)).collect()}
    assert rated[None, "A"] > rated["g", "A"] > 2200
    ranks = {(r.cohort, r.id_label): r.glicko_rank for r in R.ranking(R.glicko(games(spark, rows))).collect()}
    assert ranks[None, "A"] == 1 and ranks[None, "B"] == 2 and ranks["g", "B"] == 2
    df = spark.createDataFrame([(None, 1, 0.01), (None, 2, 0.04), ("x", 3, 0.5)], "g string, id int, p double")
    got = {r.id: r.p_adj for r in H.holm(df, "p", ["id"], ["g"]).collect()}
    assert got == {1: pytest.approx(0.02), 2: pytest.approx(0.04), 3: 0.5}


def test_large_groups_have_exact_quartiles(spark):
    rng = np.random.default_rng(9)
    values = {"a": rng.normal(size=20_001).tolist(), None: rng.integers(0, 50, 9_000).astype(float).tolist()}
    df = spark.createDataFrame([(g, i, v) for g, vs in values.items() for i, v in enumerate(vs)],
                               "g string, i int, v double")
    for r in S.five_numbers(df, ["g"], "v").collect():
        want = np.percentile(values[r.g], [25, 50, 75])
        assert [r.q1, r["median"], r.q3] == pytest.approx(want.tolist()) and r.n == len(values[r.g])


def test_pairs_of_a_status(spark):
    won = games(spark, [("g", 1, "A", "B", 1), ("g", 1, "B", "C", 1), ("g", 1, "A", "C", 1)])
    rating = spark.createDataFrame([("g", "A", 1.0)], "cohort string, id_label string, glicko_rating double")
    status = spark.createDataFrame([("A", "top", "g"), ("B", "low", "g")], "id_label string, status string, cohort string")
    rows = S.pair_shares(won, rating, status, "top").collect()
    assert {(r.id_label, r.counterpart, r.share) for r in rows} == {("A", "B", 1 / 3), ("A", "C", 1 / 3)}


def test_combinations_under_new_names():
    assert E.COHORT_TYPE_COMBINATIONS["mixed_phase2"] == {
        "cohort_typemixed": 1, "cohort_typemixed:phase2": 1}
    assert E.COHORT_TYPE_COMBINATIONS["night_phase2"] == E.SEX_COMBINATIONS["night_phase2"]
    assert len(E.COHORT_TYPE_COMBINATIONS) == 7


def test_no_task_of_combined_draws_holds_a_term(spark):
    table = spark.range(20000).selectExpr(
        "'m' AS model", "IF(id % 10 = 0, 'a', 'b') AS term", "id + 1 AS iter", "CAST(id AS double) AS value")
    combined = D.combine(table, {"s": {"a": 1, "b": 2}, "d": {"b": 1}})
    plan = combined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    lines = plan.splitlines()
    exchanges = [line for line in lines if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "iter" in exchanges[0] and "combo" not in exchanges[0]
    # no sum ahead of the exchange
    assert not any("HashAggregate" in line for line in lines[lines.index(exchanges[0]):])
