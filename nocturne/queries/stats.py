"""Tests, effects, bootstrap draws and draw summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nocturne.functions.columns import interval_text, p_label, significance
from nocturne.plans import draws as D, effects as E, summaries as S, comparisons as H
from nocturne.queries.behaviour import rounded
from nocturne.queries.registry import Tables, query
from nocturne.queries.sql import CTES, twin

SEX, PHASE = ("sex", ("m", "f")), ("phase", (1, 2))

# --- tests -------------------------------------------------------------------


def welch_twin(needs: str, source: str, value: str, level: str, within: str) -> str:
    keys = [k.strip() for k in within.split(",") if k.strip()]
    group = ", ".join([*keys, level])
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys) or "TRUE"
    shown = "".join(f"a.{k}, " for k in keys)
    return twin(needs, f"""
SELECT * EXCLUDE (t, f), round(t, 9) AS statistic, round(f, 9) AS df FROM (
  SELECT {shown}a.{level} AS group1, b.{level} AS group2, a.n AS n1, b.n AS n2,
    CASE WHEN a.n > 1 AND b.n > 1 THEN (a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0) END AS t,
    CASE WHEN a.n > 1 AND b.n > 1 THEN pow(a.v / a.n + b.v / b.n, 2) /
      nullif(pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1), 0) END AS f
  FROM moments a JOIN moments b ON {same} AND a.{level} < b.{level})""").replace(
        "\nSELECT * EXCLUDE (t, f)", f""",
moments AS (SELECT {group}, count(*) AS n, avg({value}) AS m, var_samp({value}) AS v
  FROM {source} WHERE {value} IS NOT NULL AND {level} IS NOT NULL GROUP BY ALL)
SELECT * EXCLUDE (t, f)""", 1)


CTES["lines"] = """
SELECT l_returnflag AS flag, l_linestatus AS state, l_orderkey, l_extendedprice AS price,
  l_quantity AS quantity FROM lineitem"""


@query("welch_by_flag", welch_twin("lines", "lines", "price", "flag", "state"))
def welch_by_flag(t: Tables):
    return rounded(H.welch(t.lines, "price", "flag", ["state"]), "statistic", "df")


@query("welch_status_contrasts", welch_twin("contrast", "contrast", "vol_hr", "status", "part, phase"))
def welch_status(t: Tables):
    rates = S.period_contrast(t.visits, t.statuses)
    return rounded(H.welch(rates, "vol_hr", "status", ["part", "phase"]), "statistic", "df")


@query("welch_sex_scores", twin("card", """
, scores AS (SELECT sex, cohort, id_label, avg(asin(sqrt(chase_score))) AS s FROM card
  WHERE cond = 'test' GROUP BY ALL),
moments AS (SELECT sex, count(*) AS n, avg(s) AS m, var_samp(s) AS v FROM scores GROUP BY sex)
SELECT a.sex AS group1, b.sex AS group2, a.n AS n1, b.n AS n2,
  round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 9) AS statistic,
  round(pow(a.v / a.n + b.v / b.n, 2) /
    (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 9) AS df
FROM moments a JOIN moments b ON a.sex < b.sex"""))
def welch_sex_scores(t: Tables):
    means = S.mean_scores(t.card, ["sex", "cohort", "id_label"], True)
    return rounded(H.welch(means, "chase_score", "sex"), "statistic", "df")


SEX_TESTS = {  # name: keys of the means, score
    "begun by individual": (["sex", "cohort", "id_label"], "chase_score"),
    "received by individual": (["sex", "cohort", "id_label"], "chased_score"),
    "begun by group": (["sex", "cohort"], "chase_score"),
    "received by group": (["sex", "cohort"], "chased_score"),
}


def t_tail(t: str, df: str) -> str:
    """Two-sided tail of Student's t in SQL: Simpson's rule over the fourth root of
    the angle from the far end, where the density is a power of the sine that is
    steep for few degrees of freedom."""
    end, steps = f"pow(pi() / 2 - atan(abs({t}) / sqrt({df})), 0.25)", 2000
    return f"""(SELECT 2 * sum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * pow(sin(pow({end} * i / {steps}, 4)), {df} - 1) * 4 * pow({end} * i / {steps}, 3))
  * {end} / {steps} / 3 / exp(lgamma({df} / 2) + lgamma(0.5) - lgamma(({df} + 1) / 2))
  FROM range(0, {steps + 1}) r(i))"""


def adjusted_twin(tests: str, keys: str, shown: str, having: str = "") -> str:
    """Tests of a CTE ``tests`` with p, Holm over all of them, stars and labels."""
    return f"""{tests},
tested AS (SELECT *, CASE WHEN statistic IS NOT NULL AND df IS NOT NULL THEN {t_tail('statistic', 'df')} END AS p
  FROM tests),
holm AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1, max((m - i + 1) * p) OVER (
    ORDER BY i ROWS UNBOUNDED PRECEDING)) END AS p_adj
  FROM (SELECT *, row_number() OVER (ORDER BY p NULLS LAST, {keys}) AS i, count(p) OVER () AS m FROM tested))
SELECT {shown}, round(statistic, 9) AS statistic, round(df, 9) AS df, round(p, 6) AS p, round(p_adj, 6) AS p_adj,
  CASE WHEN p_adj <= 0.0001 THEN '****' WHEN p_adj <= 0.001 THEN '***' WHEN p_adj <= 0.01 THEN '**'
    WHEN p_adj <= 0.05 THEN '*' WHEN p_adj IS NOT NULL THEN 'ns' END AS stars,
  CASE WHEN p_adj < 0.001 THEN '<0.001' WHEN p_adj IS NOT NULL THEN format('{{:.3f}}', p_adj) END AS label
FROM holm {having}"""


WELCH = """SELECT {shown} a.{level} AS group1, b.{level} AS group2, a.n AS n1, b.n AS n2,
    CASE WHEN a.n > 1 AND b.n > 1 THEN (a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0) END AS statistic,
    CASE WHEN a.n > 1 AND b.n > 1 THEN pow(a.v / a.n + b.v / b.n, 2) /
      nullif(pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1), 0) END AS df
  FROM moments a JOIN moments b ON {same} AND a.{level} < b.{level}"""


def shown_tests(table):
    return rounded(rounded(table, "statistic", "df"), "p", "p_adj", digits=6)


_SEX_MEANS = " UNION ALL ".join(
    f"""SELECT '{name}' AS test, sex, avg(CASE WHEN {score} BETWEEN 0 AND 1 THEN asin(sqrt({score})) END) AS s
  FROM card WHERE cond = 'test' GROUP BY {', '.join(keys)}""" for name, (keys, score) in SEX_TESTS.items())


@query("sex_tests_adjusted", twin("card", adjusted_twin(f"""
, means AS ({_SEX_MEANS}),
moments AS (SELECT test, sex, count(*) AS n, avg(s) AS m, var_samp(s) AS v FROM means
  WHERE s IS NOT NULL AND sex IS NOT NULL GROUP BY test, sex),
tests AS ({WELCH.format(shown='a.test,', level='sex', same='a.test = b.test')})""",
    "test, group1, group2", "test, group1, group2, n1, n2")))
def sex_tests_adjusted(t: Tables):
    """Scores of the sexes: begun and received, means of individuals and of groups."""
    tests = [H.welch(S.mean_scores(t.card, keys, True), score, "sex").withColumn("test", F.lit(name))
             for name, (keys, score) in SEX_TESTS.items()]
    table = D.stack(tests)
    return shown_tests(H.marked(H.holm(H.with_p(table), "p", ["test", "group1", "group2"])))


@query("paired_phases", twin("contrast", """
SELECT part, status, group1, group2, n, round(m / nullif(s / sqrt(n), 0), 9) AS statistic,
  CASE WHEN n > 1 THEN CAST(n - 1 AS DOUBLE) END AS df
FROM (SELECT a.part, a.status, a.phase AS group1, b.phase AS group2, count(*) AS n,
    avg(a.vol_hr - b.vol_hr) AS m, stddev_samp(a.vol_hr - b.vol_hr) AS s
  FROM contrast a JOIN contrast b ON a.part = b.part AND a.status IS NOT DISTINCT FROM b.status
    AND a.id_label = b.id_label AND a.cohort = b.cohort AND a.phase < b.phase
  WHERE a.vol_hr IS NOT NULL AND b.vol_hr IS NOT NULL GROUP BY ALL)"""))
def paired_phases(t: Tables):
    rates = S.period_contrast(t.visits, t.statuses)
    table = H.paired(rates, "vol_hr", "phase", ["id_label", "cohort"], ["part", "status"])
    return rounded(table, "statistic")


@query("paired_line_states", twin("lines", """
, sums AS (SELECT l_orderkey, state, sum(quantity) AS q FROM lines GROUP BY ALL)
SELECT a.state AS group1, b.state AS group2, count(*) AS n,
  round(avg(a.q - b.q) / (stddev_samp(a.q - b.q) / sqrt(count(*))), 9) AS statistic,
  CAST(count(*) - 1 AS DOUBLE) AS df
FROM sums a JOIN sums b ON a.l_orderkey = b.l_orderkey AND a.state < b.state GROUP BY ALL"""))
def paired_line_states(t: Tables):
    sums = t.lines.groupBy("l_orderkey", "state").agg(F.sum("quantity").alias("q"))
    return rounded(H.paired(sums, "q", "state", ["l_orderkey"]), "statistic")


CTES["supplier_p"] = """
SELECT l_suppkey, round(1 / (1 + avg(l_quantity) * count(*) / 100), 9) AS p FROM lineitem GROUP BY l_suppkey"""


def supplier_p(t: Tables):
    """One number in (0, 1) per supplier, to adjust."""
    p = 1 / (1 + F.avg("l_quantity") * F.count(F.lit(1)) / 100)
    return t.read("lineitem").groupBy("l_suppkey").agg(F.round(p, 9).alias("p"))


@query("holm_adjustment", twin("supplier_p", """
SELECT l_suppkey, p, round(least(max((m - i + 1) * p) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 1), 9)
  AS p_adj
FROM (SELECT *, row_number() OVER (ORDER BY p, l_suppkey) AS i, count(*) OVER () AS m FROM supplier_p)"""))
def holm_adjustment(t: Tables):
    return rounded(H.holm(supplier_p(t), "p", ["l_suppkey"]), "p_adj")


@query("holm_within_groups", twin("supplier_p", """
SELECT l_suppkey, s_nationkey, p, round(least(max((m - i + 1) * p) OVER (
  PARTITION BY s_nationkey ORDER BY i ROWS UNBOUNDED PRECEDING), 1), 9) AS p_adj
FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY p, l_suppkey) AS i,
    count(*) OVER (PARTITION BY s_nationkey) AS m
  FROM supplier_p JOIN supplier ON s_suppkey = l_suppkey)"""))
def holm_within(t: Tables):
    nations = t.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    table = supplier_p(t).join(nations, "l_suppkey")
    return rounded(H.holm(table, "p", ["l_suppkey"], ["s_nationkey"]), "p_adj")


@query("significance_labels", twin("supplier_p", """
SELECT l_suppkey, p, CASE WHEN p <= 0.0001 THEN '****' WHEN p <= 0.001 THEN '***'
  WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS stars,
  CASE WHEN p < 0.001 THEN '<0.001' ELSE format('{:.3f}', p) END AS label
FROM supplier_p WHERE p < 0.1"""))
def significance_labels(t: Tables):
    return supplier_p(t).where(F.col("p") < 0.1).select(
        "l_suppkey", "p", significance("p").alias("stars"), p_label("p").alias("label"))


def moments_of(source: str, value: str, level: str, keys: str) -> str:
    return f"""SELECT {keys}, {level}, count(*) AS n, avg({value}) AS m, var_samp({value}) AS v FROM {source}
  WHERE {value} IS NOT NULL AND {level} IS NOT NULL GROUP BY ALL"""


@query("status_tests_adjusted", twin("contrast", adjusted_twin(f"""
, moments AS ({moments_of('contrast', 'vol_hr', 'status', 'part, phase')}),
tests AS ({WELCH.format(shown='a.part, a.phase,', level='status', same='a.part = b.part AND a.phase = b.phase')})""",
    "part, phase, group1, group2", "part, phase, group1, group2, n1, n2")))
def status_tests_adjusted(t: Tables):
    rates = S.period_contrast(t.visits, t.statuses)
    tested = H.with_p(H.welch(rates, "vol_hr", "status", ["part", "phase"]))
    return shown_tests(H.marked(H.holm(tested, "p", ["part", "phase", "group1", "group2"])))


CTES["early"] = """
SELECT r.*, status FROM (
  SELECT cohort, id_label, phase, CASE group_night WHEN 1 THEN 'First night' ELSE 'Second night' END
    AS part, sex, sum(vol_consumed) / nullif(sum(phase_dur), 0) AS vol_hr
  FROM visits WHERE group_night IN (1, 2) GROUP BY ALL) r LEFT JOIN statuses USING (id_label, cohort)"""


@query("early_tests_adjusted", twin("early", adjusted_twin(f"""
, moments AS ({moments_of('early', 'vol_hr', 'part', 'status, phase')}),
tests AS ({WELCH.format(shown='a.status, a.phase,', level='part',
                        same='a.status IS NOT DISTINCT FROM b.status AND a.phase = b.phase')})""",
    "status NULLS FIRST, phase, group1, group2", "status, phase, group1, group2, n1, n2", "WHERE p_adj < 0.9")))
def early_tests_adjusted(t: Tables):
    """First against second night within status and phase; tests below a critical p."""
    rates = S.early_contrast(t.visits, t.statuses)
    tested = H.with_p(H.welch(rates, "vol_hr", "part", ["status", "phase"]))
    return shown_tests(H.marked(H.holm(tested, "p", ["status", "phase", "group1", "group2"]), p_crit=0.9))


@query("paired_tests_adjusted", twin("contrast", adjusted_twin("""
, tests AS (SELECT part, status, group1, group2, n, m / nullif(s / sqrt(n), 0) AS statistic,
  CASE WHEN n > 1 THEN CAST(n - 1 AS DOUBLE) END AS df
FROM (SELECT a.part, a.status, a.phase AS group1, b.phase AS group2, count(*) AS n,
    avg(a.vol_hr - b.vol_hr) AS m, stddev_samp(a.vol_hr - b.vol_hr) AS s
  FROM contrast a JOIN contrast b ON a.part = b.part AND a.status IS NOT DISTINCT FROM b.status
    AND a.id_label = b.id_label AND a.cohort = b.cohort AND a.phase < b.phase
  WHERE a.vol_hr IS NOT NULL AND b.vol_hr IS NOT NULL GROUP BY ALL))""",
    "part, status NULLS FIRST, group1, group2", "part, status, group1, group2, n")))
def paired_tests_adjusted(t: Tables):
    rates = S.period_contrast(t.visits, t.statuses)
    table = H.paired(rates, "vol_hr", "phase", ["id_label", "cohort"], ["part", "status"])
    return shown_tests(H.marked(H.holm(H.with_p(table), "p", ["part", "status", "group1", "group2"])))


# --- effects -----------------------------------------------------------------

CTES["cells"] = """
SELECT sex, phase, k, n, ln(CASE WHEN k > 0 THEN k / nullif(n - k, 0) END) AS log_odds,
  sqrt(1 / nullif(k, 0) + 1 / nullif(n - k, 0)) AS se
FROM (SELECT sex, phase, CAST(sum(n_chases) AS BIGINT) AS k, CAST(sum(n_detections) AS BIGINT) AS n
  FROM card GROUP BY sex, phase)"""

def cells(t: Tables):
    return E.cell_log_odds(t.card, "n_chases", "n_detections", ["sex", "phase"])


@query("cell_log_odds", twin("cells", """
SELECT sex, phase, k, n, round(log_odds, 9) AS log_odds, round(se, 9) AS se FROM cells"""))
def cell_log_odds(t: Tables):
    return rounded(cells(t), "log_odds", "se")


@query("log_odds_terms", twin("cells", """
, wide AS (SELECT max(CASE WHEN sex = 'm' AND phase = 1 THEN log_odds END) AS m1,
  max(CASE WHEN sex = 'f' AND phase = 1 THEN log_odds END) AS f1,
  max(CASE WHEN sex = 'm' AND phase = 2 THEN log_odds END) AS m2,
  max(CASE WHEN sex = 'f' AND phase = 2 THEN log_odds END) AS f2 FROM cells)
SELECT '(Intercept)' AS term, round(m1, 9) AS value FROM wide
UNION ALL SELECT 'sexf', round(f1 - m1, 9) FROM wide
UNION ALL SELECT 'phase2', round(m2 - m1, 9) FROM wide
UNION ALL SELECT 'sexf:phase2', round((f2 - m2) - (f1 - m1), 9) FROM wide"""))
def log_odds_terms(t: Tables):
    return rounded(E.treatment_terms(cells(t), "log_odds", SEX, PHASE), "value")


@query("female_log_odds", twin("card", """
SELECT cohort_type, phase, k, n, round(ln(CASE WHEN k > 0 THEN k / nullif(n - k, 0) END), 9) AS log_odds,
  round(sqrt(1 / nullif(k, 0) + 1 / nullif(n - k, 0)), 9) AS se
FROM (SELECT cohort_type, phase, CAST(sum(n_chases) AS BIGINT) AS k,
  CAST(sum(n_detections) AS BIGINT) AS n
FROM (SELECT *, CASE WHEN cohort LIKE '%mixed%' THEN 'mixed' ELSE 'single-sex' END AS cohort_type
  FROM card WHERE sex <> 'm' AND cohort <> 'building') GROUP BY cohort_type, phase)"""))
def female_log_odds(t: Tables):
    females = S.with_group_type(t.card, ["building"])
    table = E.cell_log_odds(females, "n_chases", "n_detections", ["cohort_type", "phase"])
    return rounded(table, "log_odds", "se")


@query("received_log_odds", twin("card", """
SELECT sex, phase, k, n, round(ln(CASE WHEN k > 0 THEN k / nullif(n - k, 0) END), 9) AS log_odds,
  round(sqrt(1 / nullif(k, 0) + 1 / nullif(n - k, 0)), 9) AS se
FROM (SELECT sex, phase, CAST(sum(n_chased) AS BIGINT) AS k, CAST(sum(n_detections) AS BIGINT) AS n
  FROM card GROUP BY sex, phase)"""))
def received_log_odds(t: Tables):
    return rounded(E.cell_log_odds(t.card, "n_chased", "n_detections", ["sex", "phase"]),
                   "log_odds", "se")


@query("phase_contrasts_by_sex", twin("cells", """
SELECT a.sex, a.phase AS level1, b.phase AS level2, round(a.log_odds - b.log_odds, 9) AS estimate
FROM cells a JOIN cells b ON a.sex = b.sex AND a.phase < b.phase"""))
def phase_contrasts(t: Tables):
    return rounded(E.pairwise(cells(t), "log_odds", "phase", ["sex"]), "estimate")


@query("marginal_means", twin("cells", """
SELECT phase, round(avg(log_odds), 9) AS mean FROM cells GROUP BY phase"""))
def marginal_means(t: Tables):
    return rounded(E.marginal_means(cells(t), "log_odds", "phase"), "mean")


CTES["trends"] = """
SELECT sex, phase, n, CASE WHEN NOT isnan(slope) THEN slope END AS slope,
  CASE WHEN NOT isnan(intercept) THEN intercept END AS intercept
FROM (SELECT sex, phase, regr_count(sd_consumed, night) AS n, regr_slope(sd_consumed, night) AS slope,
  regr_intercept(sd_consumed, night) AS intercept FROM dispersion GROUP BY sex, phase)"""


def trends(t: Tables):
    return E.cell_trends(S.dispersion(t.visits), "sd_consumed", "night", ["sex", "phase"])


@query("cell_trends", twin("trends", """
SELECT sex, phase, CAST(n AS BIGINT) AS n, round(slope, 9) AS slope, round(intercept, 9) AS intercept
FROM trends"""))
def cell_trends(t: Tables):
    return rounded(trends(t), "slope", "intercept")


@query("slope_contrasts", twin("trends", """
SELECT a.phase, a.sex AS level1, b.sex AS level2, round(a.slope - b.slope, 9) AS estimate
FROM trends a JOIN trends b ON a.phase = b.phase AND a.sex < b.sex"""))
def slope_contrasts(t: Tables):
    return rounded(E.pairwise(trends(t), "slope", "sex", ["phase"]), "estimate")


@query("binomial_glm_saturated", twin("cells", """
, wide AS (SELECT max(CASE WHEN sex = 'm' AND phase = 1 THEN log_odds END) AS m1,
  max(CASE WHEN sex = 'f' AND phase = 1 THEN log_odds END) AS f1,
  max(CASE WHEN sex = 'm' AND phase = 2 THEN log_odds END) AS m2,
  max(CASE WHEN sex = 'f' AND phase = 2 THEN log_odds END) AS f2,
  (SELECT count(*) FROM card WHERE sex IS NOT NULL AND phase IS NOT NULL) AS n_used FROM cells)
SELECT '(Intercept)' AS term, round(m1, 5) AS estimate, n_used FROM wide
UNION ALL SELECT 'sexf', round(f1 - m1, 5), n_used FROM wide
UNION ALL SELECT 'phase2', round(m2 - m1, 5), n_used FROM wide
UNION ALL SELECT 'sexf:phase2', round((f2 - m2) - (f1 - m1), 5), n_used FROM wide"""))
def binomial_glm_saturated(t: Tables):
    """Without a covariate the fit is that of the cells."""
    fit = E.binomial_glm(t.card, "n_chases", "n_detections", SEX, PHASE)
    return rounded(fit, "estimate", digits=5)


@query("binomial_glm_with_weight", twin("card", """
SELECT unnest(['(Intercept)', 'sexf', 'phase2', 'sexf:phase2', 'weight']) AS term, 0e0 AS score,
  count(*) AS n_used FROM card WHERE weight IS NOT NULL AND sex IS NOT NULL AND phase IS NOT NULL"""))
def binomial_glm(t: Tables):
    """The weighted fit by what makes it one: no term's score is left (six decimals)."""
    fit = E.binomial_glm(t.card, "n_chases", "n_detections", SEX, PHASE, "weight")
    left = E.score_sums(t.card, "n_chases", "n_detections", fit, SEX, PHASE, "weight")
    return left.join(fit.select("term", "n_used"), "term").select(
        "term", (F.round("score", 6) + 0.0).alias("score"), "n_used")


REPLICATES = 100

# Poisson(1) by inversion of a uniform number
POISSON = """CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1
    WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3
    WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5
    WHEN u < 0.9999167588507119 THEN 6 WHEN u < 0.9999897508033253 THEN 7
    WHEN u < 0.9999988747974020 THEN 8 WHEN u < 0.9999998885745217 THEN 9
    WHEN u < 0.9999999899522336 THEN 10 ELSE 11 END"""

CTES["drawn"] = f"""
SELECT iter, sex, phase, ln((sum(k * w) + 0.5) / (sum(n * w) - sum(k * w) + 0.5)) AS log_odds FROM (
  SELECT *, {POISSON} AS w
  FROM (SELECT *, CAST('0x' || substr(md5('42:' || id_label || ':' || iter), 1, 8) AS BIGINT)
      / 4294967296 AS u
    FROM (SELECT id_label, sex, phase, sum(n_chases) AS k, sum(n_detections) AS n FROM card GROUP BY ALL),
      range(1, {REPLICATES + 1}) r(iter)))
GROUP BY iter, sex, phase"""

CTES["boot_wide"] = """
SELECT iter, max(CASE WHEN sex = 'm' AND phase = 1 THEN log_odds END) AS m1,
  max(CASE WHEN sex = 'f' AND phase = 1 THEN log_odds END) AS f1,
  max(CASE WHEN sex = 'm' AND phase = 2 THEN log_odds END) AS m2,
  max(CASE WHEN sex = 'f' AND phase = 2 THEN log_odds END) AS f2 FROM drawn GROUP BY iter"""

CTES["boot"] = """
SELECT 'chases' AS model, term, iter, value FROM (
  SELECT iter, '(Intercept)' AS term, m1 AS value FROM boot_wide
  UNION ALL SELECT iter, 'sexf', f1 - m1 FROM boot_wide
  UNION ALL SELECT iter, 'phase2', m2 - m1 FROM boot_wide
  UNION ALL SELECT iter, 'sexf:phase2', (f2 - m2) - (f1 - m1) FROM boot_wide)"""


@query("bootstrap_draws", twin("boot", """
SELECT model, term, iter, round(value, 9) AS value FROM boot"""))
def bootstrap_draws(t: Tables):
    return rounded(t.bootstrap, "value")



def trend_ctes(source: str, a: str, a0: str, a1: str, cluster: str, model: str) -> str:
    """Bootstrap draws of the crossed trend model of a dispersion table."""
    cell = {n: f"{a} = '{x}' AND phase = {p}" for n, (x, p) in {
        "c00": (a0, 1), "c10": (a1, 1), "c01": (a0, 2), "c11": (a1, 2)}.items()}
    picks = ", ".join(
        f"max(CASE WHEN {c} THEN {v} END) AS {v[0]}{n}" for v in ("intercept", "slope") for n, c in cell.items())
    terms = []
    for v, tail in (("i", ""), ("s", ":night")):
        one = "night" if tail else "(Intercept)"
        terms += [(one, f"{v}c00"), (f"{a}{a1}{tail}", f"{v}c10 - {v}c00"), (f"phase2{tail}", f"{v}c01 - {v}c00"),
                  (f"{a}{a1}:phase2{tail}", f"({v}c11 - {v}c01) - ({v}c10 - {v}c00)")]
    union = " UNION ALL ".join(
        f"SELECT iter, '{t}' AS term, {e} AS value FROM lines_wide" for t, e in terms)
    return f""",
cluster_sums AS (SELECT {cluster} AS id, {a}, phase, sum(1e0) AS s0, sum(night) AS sx, sum(sd_consumed) AS sy,
  sum(night * sd_consumed) AS sxy, sum(night * night) AS sxx FROM {source}
  WHERE sd_consumed IS NOT NULL GROUP BY ALL),
weighted AS (SELECT iter, {a}, phase, sum(w * s0) AS s0, sum(w * sx) AS sx, sum(w * sy) AS sy,
  sum(w * sxy) AS sxy, sum(w * sxx) AS sxx FROM (SELECT *, {POISSON} AS w FROM (
    SELECT *, CAST('0x' || substr(md5('42:' || id || ':' || iter), 1, 8) AS BIGINT) / 4294967296 AS u
    FROM cluster_sums, range(1, {REPLICATES + 1}) r(iter))) GROUP BY ALL),
fitted AS (SELECT *, (sy - slope * sx) / nullif(s0, 0) AS intercept FROM (
  SELECT *, CASE WHEN s0 * sxx - sx * sx > 1e-9 THEN (s0 * sxy - sx * sy) / (s0 * sxx - sx * sx) END AS slope
  FROM weighted)),
lines_wide AS (SELECT iter, {picks} FROM fitted GROUP BY iter),
trend_terms AS ({union}),
trend_draws AS (SELECT '{model}' AS model, term, iter, value FROM trend_terms)"""


# --- draws -------------------------------------------------------------------

CTES["draws"] = """
SELECT 'price' AS model, l_returnflag || l_linestatus AS term,
  row_number() OVER (PARTITION BY l_returnflag, l_linestatus
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS iter,
  l_extendedprice / 1000 - 50 AS value FROM lineitem"""

def draw_ctes(source: str = "draws") -> dict[str, str]:
    """HPD, mode, autocorrelation and effective size of a draws table."""
    last = D.GRID - 1
    return {
        "sorted": f"""
SELECT *, row_number() OVER (PARTITION BY model, term ORDER BY value, iter) AS pos,
  count(*) OVER (PARTITION BY model, term) AS n FROM {source} WHERE value IS NOT NULL""",
        "hpd": """
SELECT model, term, low AS conf_low, high AS conf_high FROM (
  SELECT a.model, a.term, a.value AS low, b.value AS high, row_number() OVER (
    PARTITION BY a.model, a.term ORDER BY b.value - a.value, a.pos) AS rn
  FROM sorted a JOIN sorted b ON a.model = b.model AND a.term = b.term
    AND b.pos = a.pos + least(a.n - 1, greatest(1, CAST(round_even(a.n * 0.95e0, 0) AS BIGINT)))) WHERE rn = 1""",
        "pm": f"""
SELECT model, term, 2 * greatest(0.5 / count(*), least(avg(CASE WHEN value > 0 THEN 1e0 ELSE 0e0 END),
  1 - avg(CASE WHEN value > 0 THEN 1e0 ELSE 0e0 END))) AS pMCMC FROM {source} GROUP BY model, term""",
        "bands": """
SELECT *, lo - 3 * bw AS x0, hi + 3 * bw AS x1, lo - 7 * bw AS start, hi - lo + 14 * bw AS span FROM (
  SELECT model, term, count(*) AS n, min(value) AS lo, max(value) AS hi,
    0.1 * 0.9 * coalesce(nullif(greatest(0, least(stddev_samp(value),
      (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34)), 0), nullif(stddev_samp(value), 0),
      nullif(abs(min(value)), 0), 1) * pow(count(*), -0.2) AS bw
  FROM sorted GROUP BY model, term)""",
        "at_bins": f"""
SELECT model, term, b.n, (value - start) / (span / {last}) AS spot
FROM sorted JOIN bands b USING (model, term)""",
        "bins": """
SELECT model, term, b, sum(w) AS w FROM (
  SELECT model, term, CAST(floor(spot) AS BIGINT) AS b, (1 - (spot - floor(spot))) / n AS w FROM at_bins
  UNION ALL SELECT model, term, CAST(floor(spot) AS BIGINT) + 1, (spot - floor(spot)) / n FROM at_bins)
GROUP BY ALL""",
        "curve": f"""
SELECT model, term, j, sum(w * exp(-z * z / 2) / (bw * sqrt(2 * pi()))) AS y FROM (
  SELECT bins.*, j, bw, (j - b) * (span * 2 / {2 * D.GRID - 1}) / bw AS z
  FROM bins JOIN bands USING (model, term) CROSS JOIN range(0, {D.GRID}) r(j))
GROUP BY ALL""",
        "modes": f"""
SELECT model, term, x AS mode FROM (
  SELECT g.*, row_number() OVER (PARTITION BY g.model, g.term ORDER BY
    coalesce(a.y, 0) * (1 - f) + coalesce(b.y, 0) * f DESC, m) AS rn
  FROM (SELECT model, term, m, x, CAST(floor(spot) AS BIGINT) AS j, spot - floor(spot) AS f FROM (
      SELECT *, (x - start) / (span / {last}) AS spot FROM (
        SELECT *, x0 + (x1 - x0) * m / {last} AS x FROM bands CROSS JOIN range(0, {D.GRID}) r(m)))) g
  LEFT JOIN curve a ON g.model = a.model AND g.term = a.term AND g.j = a.j
  LEFT JOIN curve b ON g.model = b.model AND g.term = b.term AND g.j + 1 = b.j) WHERE rn = 1""",
        "centred": f"""
SELECT model, term, iter, value - avg(value) OVER (PARTITION BY model, term) AS v FROM {source}""",
        "acf": """
SELECT model, term, lag, c / first_value(c) OVER (PARTITION BY model, term ORDER BY lag) AS acf FROM (
  SELECT model, term, lag, sum(v * w) AS c FROM (
    SELECT model, term, v, lag, lead(v, CAST(lag AS INTEGER)) OVER (
      PARTITION BY model, term, lag ORDER BY iter) AS w
    FROM centred CROSS JOIN range(0, 101) r(lag)) GROUP BY ALL)""",
        "ess": f"""
SELECT model, term, n / (1 + 2 * rho) AS eff_samp FROM (
  SELECT a.model, a.term, sum(CASE WHEN lag > 0 AND (stop IS NULL OR lag < stop) THEN acf ELSE 0 END) AS rho
  FROM acf a JOIN (SELECT model, term, min(CASE WHEN acf <= 0 THEN lag END) AS stop FROM acf
    GROUP BY model, term) s ON a.model = s.model AND a.term = s.term GROUP BY ALL)
JOIN (SELECT model, term, count(*) AS n FROM {source} GROUP BY ALL) USING (model, term)""",
    }


def draws_twin(select: str, needs: str = "draws", source: str = "draws", more: str = "") -> str:
    text = ",\n".join(f"{k} AS ({v})" for k, v in draw_ctes(source).items())
    return twin(needs, f"{more},\n{text}\n{select}")


@query("posterior_means", draws_twin("""
SELECT model, term, round(avg(value), 9) AS estimate FROM draws GROUP BY model, term"""))
def posterior_means(t: Tables):
    return rounded(D.posterior_means(t.draws), "estimate")


@query("highest_density_intervals", draws_twin("""
SELECT model, term, round(conf_low, 9) AS conf_low, round(conf_high, 9) AS conf_high FROM hpd"""))
def hpd(t: Tables):
    return rounded(D.hpd(t.sorted_draws), "conf_low", "conf_high")


@query("p_mcmc", draws_twin("SELECT model, term, round(pMCMC, 12) AS pMCMC FROM pm"))
def p_mcmc(t: Tables):
    return rounded(D.p_mcmc(t.draws), "pMCMC", digits=12)


@query("posterior_modes", draws_twin("SELECT model, term, round(mode, 6) AS mode FROM modes"))
def posterior_modes(t: Tables):
    return rounded(D.posterior_mode(t.sorted_draws), "mode", digits=6)


COMBINATIONS = {
    "open_gap": {"AO": 1, "RO": -1},
    "open_sum": {"AO": 1, "NO": 1, "RO": 1},
    "final_minus_open": {"AF": 1, "AO": -1},
}

_COMBOS = """,
coefs(combo, t, coef) AS (VALUES ('open_gap', 'AO', 1e0), ('open_gap', 'RO', -1e0),
  ('open_sum', 'AO', 1e0), ('open_sum', 'NO', 1e0), ('open_sum', 'RO', 1e0),
  ('final_minus_open', 'AF', 1e0), ('final_minus_open', 'AO', -1e0)),
combined AS (SELECT model, combo AS term, iter,
  CASE WHEN count(value) = (SELECT count(*) FROM coefs c WHERE c.combo = coefs.combo)
    THEN sum(coef * value) END AS value
  FROM draws JOIN coefs ON t = term GROUP BY model, combo, iter)"""


@query("combinations", draws_twin("""
SELECT model, term, iter, round(value, 9) AS value FROM combined""", more=_COMBOS, source="combined"))
def combinations(t: Tables):
    return rounded(D.combine(t.draws, COMBINATIONS), "value")


@query("interaction_table", draws_twin("""
SELECT model, term, round_even(mode, 2) AS estimate, round_even(conf_low, 2) AS conf_low,
  round_even(conf_high, 2) AS conf_high FROM modes JOIN hpd USING (model, term)""",
    more=_COMBOS, source="combined"))
def interaction_table(t: Tables):
    return D.interaction_table(t.draws, COMBINATIONS)


@query("autocorrelation", draws_twin("SELECT model, term, CAST(lag AS INTEGER) AS lag, round(acf, 9) AS acf FROM acf"))
def autocorrelation(t: Tables):
    return rounded(D.autocorrelation(t.draws), "acf")


@query("effective_size", draws_twin("SELECT model, term, round(eff_samp, 6) AS eff_samp FROM ess"))
def effective_size(t: Tables):
    return rounded(D.effective_size(t.draws), "eff_samp", digits=6)


_PARTS = """,
parts AS (SELECT term AS model, part AS term, CASE WHEN part = 'early' THEN iter
    ELSE iter - CAST(ceil(n - 0.5 * (n - 1)) AS BIGINT) + 1 END AS iter, value
  FROM (SELECT *, CASE WHEN iter <= 1 + 0.1 * (n - 1) THEN 'early'
      WHEN iter >= n - 0.5 * (n - 1) THEN 'late' END AS part
    FROM (SELECT *, max(iter) OVER (PARTITION BY model, term) AS n FROM draws)) WHERE part IS NOT NULL)"""


@query("drift", draws_twin("""
SELECT 'price' AS model, a.model AS term,
  round((a.m - b.m) / sqrt(a.v / ea.eff_samp + b.v / eb.eff_samp), 6) AS z
FROM (SELECT model, avg(value) AS m, var_samp(value) AS v FROM parts WHERE term = 'early' GROUP BY 1) a
JOIN (SELECT model, avg(value) AS m, var_samp(value) AS v FROM parts WHERE term = 'late' GROUP BY 1) b
  ON a.model = b.model
JOIN ess ea ON ea.model = a.model AND ea.term = 'early'
JOIN ess eb ON eb.model = a.model AND eb.term = 'late'""", more=_PARTS, source="parts"))
def drift(t: Tables):
    return rounded(D.drift(t.draws), "z", digits=6)


def levinson_ctes(acf: str = "acf", keys: str = "model, term", source: str = "draws") -> str:
    """CTE ``spectral``: effective size by the autoregression of least AIC."""
    return f""",
rhos AS (SELECT {keys}, list(acf ORDER BY lag) AS rho FROM {acf} GROUP BY {keys}),
counted AS (SELECT {keys}, count(*) AS n FROM {source} GROUP BY {keys}),
levinson AS (
  SELECT {keys}, rho, n, CAST(least(n - 1, floor(10 * log10(n)), 100) AS INTEGER) AS most, 0 AS m, [0e0][1:0] AS a, 1e0 AS v,
    2e0 AS aic, 1e0 AS best_v, 0e0 AS best_sum, 0 AS best_m FROM rhos JOIN counted USING ({keys})
  UNION ALL
  SELECT {keys}, rho, n, most, m, a, v, CASE WHEN better THEN fresh ELSE aic END, CASE WHEN better THEN v ELSE best_v END,
    CASE WHEN better THEN list_sum(a) ELSE best_sum END, CASE WHEN better THEN m ELSE best_m END
  FROM (SELECT *, fresh < aic AS better FROM (SELECT *, n * ln(v) + 2 * m + 2 AS fresh FROM (
    SELECT {keys}, rho, n, most, m + 1 AS m, aic, best_v, best_sum, best_m, v * (1 - k * k) AS v,
      list_concat(list_transform(range(1, m + 1), lambda j: a[j] - k * a[m + 1 - j]), [k]) AS a
    FROM (SELECT *, (rho[m + 2] - coalesce(list_sum(list_transform(range(1, m + 1), lambda j: a[j] * rho[m + 2 - j])), 0)) / v AS k
      FROM levinson WHERE m < most))))),
spectral AS (SELECT {keys}, n, n * (n - best_m - 1) / (n - 1) * pow(1 - best_sum, 2) / best_v AS eff_samp
  FROM levinson WHERE m = most)"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("spectral_effective_size", recursive(draws_twin(f"""{levinson_ctes()}
SELECT model, term, round(eff_samp, 4) AS eff_samp FROM spectral""")))
def spectral_effective_size(t: Tables):
    return rounded(D.spectral_size(t.draws), "eff_samp", digits=4)


STARTS = 6

_WINDOWS = f""",
begun AS (SELECT *, ceil(1 + g * ((n - 1) / {2 * (STARTS - 1)}.0)) AS s FROM (
  SELECT model AS m, term AS t, max(iter) AS n FROM draws GROUP BY ALL), range(0, {STARTS}) r(g)),
spans AS (SELECT m, t, g, s, 'early' AS part, s AS lo, floor(s + 0.1 * (n - s)) AS hi FROM begun
  UNION ALL SELECT m, t, g, s, 'late', ceil(n - 0.5 * (n - s)), n FROM begun),
parts AS (SELECT term || ':' || g AS model, part AS term, s, iter, value FROM draws
  JOIN spans ON m = model AND t = term AND iter BETWEEN lo AND hi)"""


@query("drift_by_start", recursive(draws_twin(f"""{levinson_ctes(source='parts')},
moments AS (SELECT model, term, CAST(any_value(s) AS BIGINT) AS s, avg(value) AS m, var_samp(value) AS v FROM parts GROUP BY ALL)
SELECT 'price' AS model, split_part(a.model, ':', 1) AS term, a.s AS start,
  round((a.m - b.m) / sqrt(a.v / x.eff_samp + b.v / y.eff_samp), 5) AS z
FROM moments a JOIN moments b ON a.model = b.model AND a.term = 'early' AND b.term = 'late'
JOIN spectral x ON x.model = a.model AND x.term = 'early' JOIN spectral y ON y.model = a.model AND y.term = 'late'""",
    more=_WINDOWS, source="parts")))
def drift_by_start(t: Tables):
    """The drift check from several starts on, with spectral errors."""
    return rounded(D.drift_from(t.draws, STARTS), "z", digits=5)


# Display labels of the terms
TERM_LABELS = {"sexf": "sex (female)", "phase2": "treatment (dispersed)"}


@query("bootstrap_summary", draws_twin("""
SELECT model, replace(replace(term, 'sexf', 'sex (female)'), 'phase2', 'treatment (dispersed)') AS term,
  round_even(estimate, 2) AS estimate, round_even(conf_low, 2) AS conf_low,
  round_even(conf_high, 2) AS conf_high, round(eff_samp, 6) AS eff_samp, round(pMCMC, 9) AS pMCMC, n,
  '(' || CAST(round_even(conf_low, 2) AS VARCHAR) || ', ' || CAST(round_even(conf_high, 2) AS VARCHAR)
    || ')' AS CI, (conf_low < 0) = (conf_high < 0) AS excludes_zero
FROM (SELECT model, term, avg(value) AS estimate, count(value) AS n FROM boot GROUP BY ALL)
JOIN hpd USING (model, term) JOIN ess USING (model, term) JOIN pm USING (model, term)""", needs="boot", source="boot"))
def bootstrap_summary(t: Tables):
    return rounded(rounded(D.summary_table(t.bootstrap, TERM_LABELS), "eff_samp", digits=6), "pMCMC")


@query("draw_summary", draws_twin("""
SELECT model, term, round_even(estimate, 2) AS estimate, round_even(conf_low, 2) AS conf_low,
  round_even(conf_high, 2) AS conf_high, round(eff_samp, 6) AS eff_samp, round(pMCMC, 9) AS pMCMC, n,
  '(' || CAST(round_even(conf_low, 2) AS VARCHAR) || ', ' || CAST(round_even(conf_high, 2) AS VARCHAR)
    || ')' AS CI, (conf_low < 0) = (conf_high < 0) AS excludes_zero
FROM (SELECT model, term, avg(value) AS estimate, count(value) AS n FROM draws GROUP BY ALL)
JOIN hpd USING (model, term) JOIN ess USING (model, term) JOIN pm USING (model, term)"""))
def draw_summary(t: Tables):
    table = D.summary_table(t.draws, ordered=t.sorted_draws)
    return rounded(rounded(table, "eff_samp", digits=6), "pMCMC")


@query("interval_text", draws_twin("""
SELECT term, 'price = ' || CAST(round_even(estimate, 2) AS VARCHAR) || ', 95% CI = [' ||
  CAST(round_even(conf_low, 2) AS VARCHAR) || ', ' || CAST(round_even(conf_high, 2) AS VARCHAR) || ']' AS text
FROM (SELECT model, term, avg(value) AS estimate FROM draws GROUP BY ALL) JOIN hpd USING (model, term)"""))
def interval(t: Tables):
    table = D.posterior_means(t.draws).join(D.hpd(t.sorted_draws), D.KEYS)
    shown = [F.bround(c, 2) for c in ("estimate", "conf_low", "conf_high")]
    return table.select("term", interval_text(*shown, name="price", brackets="square").alias("text"))


@query("models_stacked", draws_twin("""
SELECT model, term, count(*) AS n FROM (
  SELECT model, term FROM draws UNION ALL SELECT model, term FROM boot) GROUP BY ALL""", needs="draws boot"))
def models_stacked(t: Tables):
    both = D.stack([t.draws, t.bootstrap])
    return both.groupBy("model", "term").agg(F.count(F.lit(1)).alias("n"))


@query("bootstrap_received_draws", twin("drawn", f"""
, sums AS (SELECT id_label, sex, phase, sum(n_chased) AS k, sum(n_detections) AS n FROM card GROUP BY ALL),
odds AS (SELECT iter, sex, phase, ln((sum(k * w) + 0.5) / (sum(n * w) - sum(k * w) + 0.5)) AS v FROM (
  SELECT *, {POISSON} AS w FROM (
    SELECT *, CAST('0x' || substr(md5('123:' || id_label || ':' || iter), 1, 8) AS BIGINT) / 4294967296 AS u
    FROM sums, range(1, {REPLICATES + 1}) r(iter))) GROUP BY ALL),
wide AS (SELECT iter, max(CASE WHEN sex = 'm' AND phase = 1 THEN v END) AS m1,
  max(CASE WHEN sex = 'f' AND phase = 1 THEN v END) AS f1,
  max(CASE WHEN sex = 'm' AND phase = 2 THEN v END) AS m2,
  max(CASE WHEN sex = 'f' AND phase = 2 THEN v END) AS f2 FROM odds GROUP BY iter)
SELECT 'received' AS model, term, iter, round(value, 9) AS value FROM (
  SELECT iter, '(Intercept)' AS term, m1 AS value FROM wide
  UNION ALL SELECT iter, 'sexf', f1 - m1 FROM wide UNION ALL SELECT iter, 'phase2', m2 - m1 FROM wide
  UNION ALL SELECT iter, 'sexf:phase2', (f2 - m2) - (f1 - m1) FROM wide)"""))
def bootstrap_received(t: Tables):
    return rounded(E.bootstrap_draws(
        t.card, "n_chased", "n_detections", "id_label", SEX, PHASE, "received", REPLICATES, seed=123), "value")


TYPE = ("cohort_type", ("single-sex", "mixed"))

CTES["typed_dispersion"] = """
SELECT cohort, group_night, phase, sd_consumed, group_night - avg(group_night) OVER () AS night,
  CASE WHEN cohort LIKE '%mixed%' THEN 'mixed' ELSE 'single-sex' END AS cohort_type
FROM (SELECT cohort, group_night, phase, stddev_samp(vol_hr) AS sd_consumed FROM (
  SELECT cohort, id_label, phase, group_night, sum(vol_consumed) / nullif(sum(phase_dur), 0) AS vol_hr
  FROM visits WHERE group_night > 0 AND sex <> 'm' GROUP BY ALL) GROUP BY ALL)"""


def trend_twin(needs: str, source: str, a: str, a0: str, a1: str, select: str, more: str = "") -> str:
    return twin(needs, f"{trend_ctes(source, a, a0, a1, 'cohort', 'intake')}{more}\n{select}")


@query("trend_draws", trend_twin("dispersion", "dispersion", "sex", "m", "f", """
SELECT model, term, iter, round(value, 8) AS value FROM trend_draws"""))
def trend_draws(t: Tables):
    return rounded(trend_table(t), "value", digits=8)


def trend_table(t: Tables):
    return E.bootstrap_trend_draws(
        S.dispersion(t.visits), "sd_consumed", "night", "cohort", SEX, PHASE, "intake", REPLICATES)


@query("trend_draws_of_females", trend_twin(
    "typed_dispersion", "typed_dispersion", "cohort_type", "single-sex", "mixed", """
SELECT model, term, iter, round(value, 8) AS value FROM trend_draws"""))
def trend_draws_of_females(t: Tables):
    table = E.bootstrap_trend_draws(
        S.female_dispersion(t.visits), "sd_consumed", "night", "cohort", TYPE, PHASE, "intake", REPLICATES)
    return rounded(table, "value", digits=8)


def combos_cte(combos) -> str:
    rows = ", ".join(f"('{c}', '{k}', {v}e0)" for c, terms in combos.items() for k, v in terms.items())
    return f""",
coefs(combo, t, coef) AS (VALUES {rows}),
combined AS (SELECT model, combo AS term, iter,
  CASE WHEN count(value) = (SELECT count(*) FROM coefs c WHERE c.combo = coefs.combo)
    THEN sum(coef * value) END AS value
  FROM trend_draws JOIN coefs ON t = term GROUP BY model, combo, iter)"""


@query("intake_combinations", trend_twin("dispersion", "dispersion", "sex", "m", "f", """
SELECT model, term, iter, round(value, 8) AS value FROM combined""", combos_cte(E.SEX_COMBINATIONS)))
def intake_combinations(t: Tables):
    return rounded(D.combine(trend_table(t), E.SEX_COMBINATIONS), "value", digits=8)


@query("intake_combinations_of_females", trend_twin(
    "typed_dispersion", "typed_dispersion", "cohort_type", "single-sex", "mixed", """
SELECT model, term, iter, round(value, 8) AS value FROM combined""", combos_cte(E.COHORT_TYPE_COMBINATIONS)))
def intake_combinations_of_females(t: Tables):
    table = E.bootstrap_trend_draws(
        S.female_dispersion(t.visits), "sd_consumed", "night", "cohort", TYPE, PHASE, "intake", REPLICATES)
    return rounded(D.combine(table, E.COHORT_TYPE_COMBINATIONS), "value", digits=8)


INTERACTIONS = """
SELECT model, term, round(mode, 6) AS estimate, round(conf_low, 6) AS conf_low, round(conf_high, 6) AS conf_high
FROM modes JOIN hpd USING (model, term)"""


@query("intake_interactions", draws_twin(
    INTERACTIONS, needs="dispersion", source="combined",
    more=trend_ctes("dispersion", "sex", "m", "f", "cohort", "intake") + combos_cte(E.SEX_COMBINATIONS)))
def intake_interactions(t: Tables):
    return half_up(D.interaction_table(trend_table(t), E.SEX_COMBINATIONS, None))


def half_up(table):
    return rounded(table, "estimate", "conf_low", "conf_high", digits=6)


@query("intake_interactions_of_females", draws_twin(
    INTERACTIONS, needs="typed_dispersion", source="combined",
    more=trend_ctes("typed_dispersion", "cohort_type", "single-sex", "mixed", "cohort", "intake")
    + combos_cte(E.COHORT_TYPE_COMBINATIONS)))
def intake_interactions_of_females(t: Tables):
    draws = E.bootstrap_trend_draws(
        S.female_dispersion(t.visits), "sd_consumed", "night", "cohort", TYPE, PHASE, "intake", REPLICATES)
    return half_up(D.interaction_table(draws, E.COHORT_TYPE_COMBINATIONS, None))
