"""Models with their uncertainty: clustered errors, contrasts, mixed models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.plans import contrasts as K, fits, influence, mixed, summaries as S
from nocturne.queries.behaviour import rounded
from nocturne.queries.registry import Tables, query
from nocturne.queries.sql import CTES, twin
from nocturne.queries.stats import PHASE, SEX, TYPE, t_tail

CLUSTER = "id_label"


def phi(x: str, steps: int = 400) -> str:
    """The normal distribution function in SQL, by Simpson's rule from zero."""
    return f"""(0.5 + (SELECT sum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(-pow(({x}) * i / {steps}, 2) / 2)) * ({x}) / {steps} / 3 / sqrt(2 * pi()) FROM range(0, {steps + 1}) r(i)))"""


Z95 = "1.959963984540054"

# --- logistic fits with clustered errors --------------------------------------

# influence of each individual on the log-odds of the four cells
CTES["influence"] = """
SELECT id_label,
  coalesce(sum(CASE WHEN sex = 'm' AND phase = 1 THEN e END), 0) AS m1,
  coalesce(sum(CASE WHEN sex = 'f' AND phase = 1 THEN e END), 0) AS f1,
  coalesce(sum(CASE WHEN sex = 'm' AND phase = 2 THEN e END), 0) AS m2,
  coalesce(sum(CASE WHEN sex = 'f' AND phase = 2 THEN e END), 0) AS f2
FROM (SELECT id_label, c.sex, c.phase, sum(n_chases - n_detections * k / n) / any_value(k * (n - k) / n) AS e
  FROM card c JOIN cells USING (sex, phase) GROUP BY ALL) GROUP BY id_label"""

CTES["odds_wide"] = """
SELECT max(CASE WHEN sex = 'm' AND phase = 1 THEN log_odds END) AS m1,
  max(CASE WHEN sex = 'f' AND phase = 1 THEN log_odds END) AS f1,
  max(CASE WHEN sex = 'm' AND phase = 2 THEN log_odds END) AS m2,
  max(CASE WHEN sex = 'f' AND phase = 2 THEN log_odds END) AS f2 FROM cells"""


def of_cells(contrasts: dict[str, str]) -> str:
    """CTE ``effects`` (key, estimate, se) of expressions over the four cells."""
    parts = [f"""SELECT {key}, (SELECT {expr} FROM odds_wide) AS estimate,
      (SELECT sqrt(sum(pow({expr}, 2)) * count(*) / (count(*) - 1)) FROM influence) AS se"""
             for key, expr in contrasts.items()]
    return f",\neffects AS ({' UNION ALL '.join(parts)})"


TERMS = {"'(Intercept)' AS term": "m1", "'sexf' AS term": "f1 - m1", "'phase2' AS term": "m2 - m1",
         "'sexf:phase2' AS term": "(f2 - m2) - (f1 - m1)"}


def chase_fit(t: Tables, covariate: str | None = None) -> fits.Fit:
    return fits.clustered_glm(t.card, "n_chases", "n_detections", SEX, PHASE, CLUSTER, covariate)


@query("binomial_glm_errors", twin("influence odds_wide", f"""{of_cells(TERMS)}
SELECT term, round(estimate, 5) AS estimate, round(se, 5) AS se, round(estimate - {Z95} * se, 5) AS low,
  round(estimate + {Z95} * se, 5) AS high, round(estimate / se, 4) AS statistic,
  round(2 - 2 * {phi('abs(estimate / se)')}, 5) AS p FROM effects"""))
def binomial_glm_errors(t: Tables):
    """Begun pursuits by sex and phase; the rows of an individual may depend on each other."""
    return shown(K.term_table(chase_fit(t)), 5)


def shown(table: DataFrame, digits: int) -> DataFrame:
    return rounded(rounded(table, "statistic", digits=4), "estimate", "se", "low", "high", "p", digits=digits)


@query("binomial_glm_with_weight_errors")
def binomial_glm_with_weight_errors(t: Tables):
    """The same with the weight of the individual as a covariate."""
    fit = chase_fit(t, "weight")
    table = shown(K.term_table(fit), 5)
    return table.withColumns({"n_used": F.lit(fit.n_used).cast("long"), "clusters": F.lit(fit.clusters).cast("long")})


PAIRS = {
    "'phase' AS factor, 'm' AS held, '1' AS level1, '2' AS level2": "m1 - m2",
    "'phase' AS factor, 'f' AS held, '1' AS level1, '2' AS level2": "f1 - f2",
    "'sex' AS factor, '1' AS held, 'f' AS level1, 'm' AS level2": "f1 - m1",
    "'sex' AS factor, '2' AS held, 'f' AS level1, 'm' AS level2": "f2 - m2",
    "'phase' AS factor, 'both' AS held, '1' AS level1, '2' AS level2": "(m1 + f1) / 2 - (m2 + f2) / 2",
    "'sex' AS factor, 'both' AS held, 'f' AS level1, 'm' AS level2": "(f1 + f2) / 2 - (m1 + m2) / 2",
}


@query("marginal_contrasts", twin("influence odds_wide", f"""{of_cells(PAIRS)}
SELECT factor, held, level1, level2, round(estimate, 5) AS estimate, round(se, 5) AS se,
  round(estimate - {Z95} * se, 5) AS low, round(estimate + {Z95} * se, 5) AS high,
  round(estimate / se, 4) AS statistic, round(2 - 2 * {phi('abs(estimate / se)')}, 5) AS p FROM effects"""))
def marginal_contrasts(t: Tables):
    """Phases within each sex, sexes within each phase, and both averaged over the other."""
    fit = chase_fit(t)
    grid = K.grid_weights(t.spark, fit.names, SEX, PHASE)
    parts = []
    for over, other in (("phase", "sex"), ("sex", "phase")):
        within = K.pair_weights(grid, [over], [other]).withColumn("held", F.col(other).cast("string")).drop(other)
        whole = K.pair_weights(K.averaged(grid, [over]), [over]).withColumn("held", F.lit("both"))
        parts.append(within.unionByName(whole).withColumn("factor", F.lit(over)))
    return shown(K.contrast(fit, parts[0].unionByName(parts[1]).drop("family")), 5)


CELL_PAIRS = {f"'{a}' AS level1, '{b}' AS level2": f"{x} - {y}" for (a, x), (b, y) in [
    (p, q) for p in (("f 1", "f1"), ("f 2", "f2"), ("m 1", "m1"), ("m 2", "m2"))
    for q in (("f 1", "f1"), ("f 2", "f2"), ("m 1", "m1"), ("m 2", "m2")) if p[0] < q[0]]}


def range_twin(k: int) -> str:
    """CTEs ``largest``: tail of the range of ``k`` normals at each statistic of ``effects``."""
    return f""",
places AS MATERIALIZED (SELECT j, z, {phi('z')} AS f FROM (SELECT j, -8 + 0.02e0 * j AS z FROM range(0, 801) g(j))),
spreads AS MATERIALIZED (SELECT level1, level2, j, z, f, {phi('z - q')} AS below
  FROM (SELECT *, abs(estimate / se) * sqrt(2) AS q FROM effects) CROSS JOIN places),
largest AS (SELECT level1, level2, 1 - {k} * sum(CASE WHEN j IN (0, 800) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END
  * pow(greatest(f - below, 0), {k - 1}) * exp(-z * z / 2)) * 0.02 / 3 / sqrt(2 * pi()) AS p_adj
  FROM spreads GROUP BY level1, level2)"""


@query("cell_pairs_adjusted", twin("influence odds_wide", f"""{of_cells(CELL_PAIRS)}{range_twin(4)}
SELECT level1, level2, 4 AS family, round(estimate, 5) AS estimate, round(se, 5) AS se,
  round(estimate - {Z95} * se, 5) AS low, round(estimate + {Z95} * se, 5) AS high,
  round(estimate / se, 4) AS statistic, round(2 - 2 * {phi('abs(estimate / se)')}, 5) AS p, round(p_adj, 4) AS p_adj
FROM effects JOIN largest USING (level1, level2)"""))
def cell_pairs_adjusted(t: Tables):
    """All pairs of the four cells, adjusted as one family."""
    fit = chase_fit(t)
    grid = K.grid_weights(t.spark, fit.names, SEX, PHASE)
    table = K.contrast(fit, K.pair_weights(grid, ["sex", "phase"]))
    return rounded(shown(K.range_adjusted(table, fit), 5), "p_adj", digits=4)


# --- intake over nights: least squares -----------------------------------------

NIGHTS = [float(x) for x in range(1, 8)]


def line_ctes(source: str, a: str) -> str:
    """A least-squares line per cell, the pooled error and its degrees of freedom, the t quantile."""
    return f""",
line AS (SELECT {a}, phase, count(*) AS n, avg(night) AS mx, avg(sd_consumed) AS my, regr_slope(sd_consumed, night) AS b,
  regr_sxx(sd_consumed, night) AS sxx, regr_syy(sd_consumed, night) AS syy, regr_sxy(sd_consumed, night) AS sxy
  FROM {source} WHERE sd_consumed IS NOT NULL AND phase IS NOT NULL AND {a} IS NOT NULL GROUP BY ALL),
pool AS (SELECT sum(syy - sxy * sxy / sxx) / (sum(n) - 8) AS s2, CAST(sum(n) - 8 AS DOUBLE) AS df FROM line),
halving AS (SELECT 0 AS step, 1e0 AS lo, 20e0 AS hi, df FROM pool
  UNION ALL SELECT step + 1, CASE WHEN p > 0.05 THEN mid ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE mid END, df
  FROM (SELECT step, lo, hi, df, mid, {t_tail('mid', 'df')} AS p
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM halving WHERE step < 44))),
reach AS (SELECT (lo + hi) / 2 AS tq FROM halving WHERE step = 44)"""


def line_twin(needs: str, source: str, a: str, select: str) -> str:
    return twin(needs, f"{line_ctes(source, a)}\n{select}").replace("WITH ", "WITH RECURSIVE ", 1)


SHOWN = f"""round(estimate, 8) AS estimate, round(se, 8) AS se, round(estimate - tq * se, 8) AS low,
  round(estimate + tq * se, 8) AS high, round(estimate / se, 4) AS statistic,
  round({t_tail('estimate / se', 'df')}, 6) AS p"""


def shown_lines(table: DataFrame) -> DataFrame:
    table = rounded(table, "estimate", "se", "low", "high", digits=8)
    return rounded(rounded(table, "statistic", digits=4), "p", digits=6)


def line_fit(t: Tables) -> fits.Fit:
    return fits.linear_model(S.dispersion(t.visits), "sd_consumed", mixed.crossed_terms(SEX, PHASE, "night"))


@query("intake_grid", line_twin("dispersion", "dispersion", "sex", f"""
SELECT sex, phase, night, {SHOWN} FROM (
  SELECT sex, phase, night, my + b * (night - mx) AS estimate,
    sqrt(s2 * (1.0 / n + pow(night - mx, 2) / sxx)) AS se, df, tq
  FROM line, pool, reach, (SELECT CAST(x AS DOUBLE) AS night FROM range(1, 8) g(x)))"""))
def intake_grid(t: Tables):
    """Means of the crossed model at nights 1 to 7, by sex and phase."""
    fit = line_fit(t)
    return shown_lines(K.contrast(fit, K.grid_weights(t.spark, fit.names, SEX, PHASE, "night", NIGHTS)))


@query("trend_contrasts", line_twin("dispersion", "dispersion", "sex", f"""
SELECT factor, held, level1, level2, {SHOWN} FROM (
  SELECT 'phase' AS factor, x.sex AS held, '1' AS level1, '2' AS level2, x.b - y.b AS estimate,
    sqrt(s2 * (1 / x.sxx + 1 / y.sxx)) AS se, df, tq
  FROM line x JOIN line y ON x.sex = y.sex AND x.phase = 1 AND y.phase = 2, pool, reach
  UNION ALL SELECT 'sex', CAST(x.phase AS VARCHAR), 'f', 'm', x.b - y.b, sqrt(s2 * (1 / x.sxx + 1 / y.sxx)), df, tq
  FROM line x JOIN line y ON x.phase = y.phase AND x.sex = 'f' AND y.sex = 'm', pool, reach)"""))
def trend_contrasts(t: Tables):
    """Slopes over the nights: phases within each sex and sexes within each phase."""
    return shown_lines(slope_pairs(t, line_fit(t), SEX))


def slope_pairs(t: Tables, fit: fits.Fit, first) -> DataFrame:
    slopes = K.trend_weights(t.spark, fit.names, first, PHASE, "night")
    parts = [K.pair_weights(slopes, [over], [other]).withColumn("held", F.col(other).cast("string")).drop(other)
             .withColumn("factor", F.lit(over)) for over, other in (("phase", first[0]), (first[0], "phase"))]
    return K.contrast(fit, parts[0].unionByName(parts[1]).drop("family"))


# --- intake over nights: mixed models ------------------------------------------


def model_table(fit: mixed.MixedFit) -> DataFrame:
    """Fixed effects with errors and intervals, then the variance components."""
    fixed = K.term_table(fit.fixed).select("term", "estimate", "se", "low", "high", "p")
    nothing = F.lit(None).cast("double")
    parts = fit.components.select(F.col("component").alias("term"), F.col("value").alias("estimate"),
                                  *[nothing.alias(c) for c in ("se", "low", "high", "p")])
    table = fixed.withColumn("kind", F.lit("fixed")).unionByName(parts.withColumn("kind", F.lit("component")))
    return table.withColumns({"n_used": F.lit(fit.fixed.n_used).cast("long"), "n_groups": F.lit(fit.n_groups).cast("long")})


def intake_fit(t: Tables) -> mixed.MixedFit:
    return mixed.intake_model(S.dispersion(t.visits), SEX, PHASE)


def female_fit(t: Tables) -> mixed.MixedFit:
    return mixed.intake_model(S.female_dispersion(t.visits), TYPE, PHASE)


@query("intake_mixed_model")
def intake_mixed_model(t: Tables):
    """Intake over the nights by sex and phase; cohorts have intercepts and slopes of their own."""
    return model_table(intake_fit(t))


@query("intake_mixed_model_of_females")
def intake_mixed_model_of_females(t: Tables):
    return model_table(female_fit(t))


def zero_scores(source: str, first) -> str:
    a, names = first[0], ", ".join(f"'{n}'" for n in mixed.crossed_names(first, PHASE, "night"))
    return f"""
SELECT unnest([{names}]) AS term, 0e0 AS score, count(*) AS n_used FROM {source}
WHERE sd_consumed IS NOT NULL AND phase IS NOT NULL AND {a} IS NOT NULL AND cohort IS NOT NULL"""


def scores(table: DataFrame, first, fit: mixed.MixedFit) -> DataFrame:
    terms = mixed.crossed_terms(first, PHASE, "night")
    left = mixed.fixed_scores(table, "sd_consumed", terms, "cohort", "night", fit)
    return left.select("term", (F.round("score", 7) + 0.0).alias("score"), "n_used")


@query("intake_mixed_scores", twin("dispersion", zero_scores("dispersion", SEX)))
def intake_mixed_scores(t: Tables):
    """What makes the fixed effects those of the model: no weighted score is left (seven decimals)."""
    return scores(S.dispersion(t.visits), SEX, intake_fit(t))


@query("intake_mixed_scores_of_females", twin("typed_dispersion", zero_scores("typed_dispersion", TYPE)))
def intake_mixed_scores_of_females(t: Tables):
    return scores(S.female_dispersion(t.visits), TYPE, female_fit(t))


@query("intake_mixed_grid")
def intake_mixed_grid(t: Tables):
    """Means of the mixed model at nights 1 to 7, by sex and phase."""
    fit = intake_fit(t).fixed
    return K.contrast(fit, K.grid_weights(t.spark, fit.names, SEX, PHASE, "night", NIGHTS))


@query("intake_mixed_trends")
def intake_mixed_trends(t: Tables):
    return slope_pairs(t, intake_fit(t).fixed, SEX)


# Sizes of parts by discount, every size at every discount; a size shifts the
# level and the slope, so that both differ between sizes.
CTES["size_discounts"] = """
SELECT p_size, x, avg(l_quantity) + x * (p_size % 7) / 10 + p_size % 5 AS y FROM (
  SELECT p_size, l_quantity, CAST(round(l_discount * 100) AS INTEGER) - 5 AS x FROM lineitem JOIN part ON p_partkey = l_partkey)
GROUP BY p_size, x"""


@query("balanced_slopes", twin("size_discounts", """,
line AS (SELECT p_size, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS rss,
  count(*) AS k, regr_sxx(y, x) AS sxx FROM size_discounts GROUP BY p_size),
total AS (SELECT count(*) AS m, sum(rss) / sum(k - 2) AS s2, any_value(k) AS k, any_value(sxx) AS sxx, avg(a) AS a, avg(b) AS b,
  var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS vab FROM line)
SELECT unnest(['(Intercept)', 'x', 'var((Intercept))', 'cov((Intercept), x)', 'var(x)', 'residual']) AS term,
  unnest([round(a, 5), round(b, 5), round(va - s2 / k, 5), round(vab, 5), round(vb - s2 / sxx, 5), round(s2, 5)]) AS estimate,
  unnest([round(sqrt(va / m), 5), round(sqrt(vb / m), 5), NULL, NULL, NULL, NULL]) AS se FROM total"""))
def balanced_slopes(t: Tables):
    """Where every group has the same design, the mixed model has a closed form."""
    return rounded(model_table(size_fit(t)).select("term", "estimate", "se"), "estimate", "se", digits=5)


def size_fit(t: Tables) -> mixed.MixedFit:
    lines = t.read("lineitem").join(t.read("part"), F.col("p_partkey") == F.col("l_partkey"))
    x = (F.round(F.col("l_discount") * 100).cast("int") - 5).alias("x")
    cells = lines.select("p_size", "l_quantity", x).groupBy("p_size", "x").agg(
        (F.avg("l_quantity") + F.col("x") * (F.col("p_size") % 7) / 10 + F.col("p_size") % 5).alias("y"))
    terms = {"(Intercept)": F.lit(1.0), "x": F.col("x")}
    return mixed.mixed_model(cells, "y", terms, terms, "p_size")


@query("balanced_slope_effects", twin("size_discounts", """,
line AS (SELECT p_size, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS rss,
  count(*) AS k, regr_sxx(y, x) AS sxx FROM size_discounts GROUP BY p_size),
total AS (SELECT count(*) AS m, sum(rss) / sum(k - 2) AS s2, any_value(k) AS k, any_value(sxx) AS sxx, avg(a) AS a, avg(b) AS b,
  var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS vab FROM line),
-- G times the inverse of the covariance of the groups' lines
w AS (SELECT *, va - s2 / k AS ga, vb - s2 / sxx AS gb, va * vb - vab * vab AS det FROM total),
shrink AS (SELECT *, (ga * vb - vab * vab) / det AS w11, (vab * va - ga * vab) / det AS w12,
  (vab * vb - gb * vab) / det AS w21, (gb * va - vab * vab) / det AS w22 FROM w)
SELECT CAST(p_size AS VARCHAR) AS "group", unnest(['(Intercept)', 'x']) AS term,
  unnest([round(w11 * (l.a - s.a) + w12 * (l.b - s.b), 4), round(w21 * (l.a - s.a) + w22 * (l.b - s.b), 4)]) AS estimate,
  unnest([round(sqrt(ga - (1 - 1 / m) * (w11 * ga + w12 * vab)), 4), round(sqrt(gb - (1 - 1 / m) * (w21 * vab + w22 * gb)), 4)]) AS se
FROM line l, shrink s"""))
def balanced_slope_effects(t: Tables):
    """Predicted intercept and slope of every size, against their closed form."""
    return rounded(size_fit(t).effects, "estimate", "se", digits=4)


@query("intake_cohort_effects")
def intake_cohort_effects(t: Tables):
    """Predicted intercept and slope over the nights of every cohort."""
    return intake_fit(t).effects


CTES["nation_prices"] = """
SELECT c_nationkey, o_orderpriority, avg(o_totalprice) / 1000 AS y
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"""


@query("balanced_intercepts", twin("nation_prices", """,
one AS (SELECT c_nationkey, count(*) AS k, avg(y) AS a, var_pop(y) * count(*) AS ss FROM nation_prices GROUP BY c_nationkey),
total AS (SELECT count(*) AS m, any_value(k) AS k, avg(a) AS a, any_value(k) * var_samp(a) AS msb, sum(ss) / sum(k - 1) AS msw,
  sum(ss) AS ssw FROM one),
parts AS (SELECT *, greatest(0, (msb - msw) / k) AS vb,
  CASE WHEN msb > msw THEN msw ELSE (ssw + msb * (m - 1)) / (m * k - 1) END AS s2 FROM total)
SELECT unnest(['(Intercept)', 'var((Intercept))', 'residual']) AS term,
  unnest([round(a, 4), round(vb, 4), round(s2, 4)]) AS estimate,
  unnest([round(sqrt((s2 + k * vb) / (m * k)), 4), NULL, NULL]) AS se FROM parts"""))
def balanced_intercepts(t: Tables):
    """Mean order prices by nation and priority: nations as random intercepts."""
    orders = t.read("orders").join(t.read("customer"), F.col("c_custkey") == F.col("o_custkey"))
    cells = orders.groupBy("c_nationkey", "o_orderpriority").agg((F.avg("o_totalprice") / 1000).alias("y"))
    one = {"(Intercept)": F.lit(1.0)}
    return rounded(model_table(mixed.mixed_model(cells, "y", one, one, "c_nationkey")).select("term", "estimate", "se"),
                   "estimate", "se", digits=4)


# --- intervals without replicates -----------------------------------------------

CTES["own_sums"] = """
SELECT cohort, id_label, """ + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN sex = '{s}' AND phase = {p} THEN {c} END), 0) AS DOUBLE) AS {x}{s}{p}"
    for s in "mf" for p in (1, 2) for x, c in (("k", "n_chases"), ("n", "n_detections"))) + """
FROM card GROUP BY cohort, id_label"""


def _left_out(own: str) -> str:
    """The four terms from the totals ``t``, less the sums of ``own``."""
    def odds(c):
        k, n = (f"(t.{x}{c} - {own}{x}{c})" if own else f"t.{x}{c}" for x in "kn")
        return f"ln(({k} + 0.5) / ({n} - {k} + 0.5))"

    m1, m2, f1, f2 = map(odds, ("m1", "m2", "f1", "f2"))
    return f"""unnest(['(Intercept)', 'sexf', 'phase2', 'sexf:phase2']) AS term,
  unnest([{m1}, {f1} - {m1}, {m2} - {m1}, ({f2} - {m2}) - ({f1} - {m1})]) AS value"""


_SUMS = ", ".join(f"sum({x}{s}{p}) AS {x}{s}{p}" for s in "mf" for p in (1, 2) for x in "kn")


@query("accelerated_intervals", twin("own_sums", f""",
t AS (SELECT {_SUMS} FROM own_sums),
whole AS (SELECT {_left_out('')} FROM t),
out AS (SELECT cohort, {_left_out('o.')} FROM own_sums o, t),
middle AS (SELECT cohort, term, avg(value) AS centre, count(*) AS m FROM out GROUP BY ALL),
parts AS (SELECT o.term, any_value(w.value) AS estimate, count(*) AS clusters,
    sqrt(sum((m - 1) / m * pow(centre - o.value, 2))) AS se, sum((m - 1) / m * (centre - w.value)) AS bias,
    sum(pow((m - 1) / m * (centre - o.value), 2)) AS two, sum(pow((m - 1) / m * (centre - o.value), 3)) AS three
  FROM out o JOIN middle c ON o.term = c.term AND o.cohort IS NOT DISTINCT FROM c.cohort JOIN whole w ON w.term = o.term
  GROUP BY o.term),
moved AS (SELECT *, three / (6 * pow(two, 1.5)) AS a, three / (6 * pow(two, 1.5)) - bias / se AS z0 FROM parts)
SELECT term, round(estimate, 7) AS estimate, round(se, 7) AS se, round(bias, 7) AS bias, round(a, 7) AS acceleration,
  round(estimate + se * (z0 + (z0 - {Z95}) / (1 - a * (z0 - {Z95}))), 7) AS low,
  round(estimate + se * (z0 + (z0 + {Z95}) / (1 - a * (z0 + {Z95}))), 7) AS high, clusters
FROM moved"""))
def accelerated_intervals(t: Tables):
    """Log-odds terms of begun pursuits; individuals are left out in turn, within their cohorts."""
    table = influence.accelerated_intervals(t.card, "n_chases", "n_detections", "id_label", "cohort", SEX, PHASE)
    return rounded(table, "estimate", "se", "bias", "acceleration", "low", "high", digits=7)


# --- the four binomial models side by side ---------------------------------------

# name: (rows, hits, first factor)
BINOMIAL_MODELS = {
    "begun": ("card", "n_chases", SEX), "received": ("card", "n_chased", SEX),
    "begun, females": ("females", "n_chases", TYPE), "received, females": ("females", "n_chased", TYPE),
}
FEMALES = """,
females AS (SELECT *, CASE WHEN cohort LIKE '%mixed%' THEN 'mixed' ELSE 'single-sex' END AS cohort_type
  FROM card WHERE sex <> 'm' AND cohort <> 'building')"""


def model_ctes() -> str:
    """For the i-th model: cell sums ``c{i}``, influences ``i{i}`` and log-odds ``o{i}``
    of the cells x1, y1, x2, y2 (base and other level by phase)."""
    parts = [FEMALES]
    for i, (rows, hits, (a, (a0, a1))) in enumerate(BINOMIAL_MODELS.values()):
        cell = {f"{n}{p}": f"{a} = '{v}' AND phase = {p}" for n, v in (("x", a0), ("y", a1)) for p in (1, 2)}
        odds = ", ".join(f"max(CASE WHEN {w} THEN ln(k / (n - k)) END) AS {n}" for n, w in cell.items())
        mine = ", ".join(f"coalesce(sum(CASE WHEN {w} THEN e END), 0) AS {n}" for n, w in cell.items())
        parts.append(f""",
c{i} AS (SELECT {a}, phase, CAST(sum({hits}) AS DOUBLE) AS k, CAST(sum(n_detections) AS DOUBLE) AS n FROM {rows}
  WHERE {a} IS NOT NULL AND phase IS NOT NULL GROUP BY ALL),
o{i} AS (SELECT {odds} FROM c{i}),
i{i} AS (SELECT id_label, {mine} FROM (
  SELECT id_label, r.{a}, r.phase, sum({hits} - n_detections * k / n) / any_value(k * (n - k) / n) AS e
  FROM {rows} r JOIN c{i} USING ({a}, phase) GROUP BY ALL) GROUP BY id_label)""")
    return "".join(parts)


def of_models(contrasts) -> str:
    """CTE ``effects`` of ``contrasts(first factor)``: columns -> expression, for every model."""
    parts = [f"""SELECT '{name}' AS model, {key}, (SELECT {expr} FROM o{i}) AS estimate,
      (SELECT sqrt(sum(pow({expr}, 2)) * count(*) / (count(*) - 1)) FROM i{i}) AS se"""
             for i, (name, (_, _, first)) in enumerate(BINOMIAL_MODELS.items()) for key, expr in contrasts(first).items()]
    return f"{model_ctes()},\neffects AS ({' UNION ALL '.join(parts)})"


def model_terms(first) -> dict[str, str]:
    name = f"{first[0]}{first[1][1]}"
    return {"'(Intercept)' AS term": "x1", f"'{name}' AS term": "y1 - x1", "'phase2' AS term": "x2 - x1",
            f"'{name}:phase2' AS term": "(y2 - x2) - (y1 - x1)"}


def model_pairs(first) -> dict[str, str]:
    a, (a0, a1) = first
    low, high = sorted((a0, a1))
    sign = "" if high == a1 else "-1 * "
    return {f"'phase' AS factor, '{a0}' AS held, '1' AS level1, '2' AS level2": "x1 - x2",
            f"'phase' AS factor, '{a1}' AS held, '1' AS level1, '2' AS level2": "y1 - y2",
            f"'{a}' AS factor, '1' AS held, '{low}' AS level1, '{high}' AS level2": f"{sign}(x1 - y1)",
            f"'{a}' AS factor, '2' AS held, '{low}' AS level1, '{high}' AS level2": f"{sign}(x2 - y2)"}


_EFFECTS = f"""round(estimate, 5) AS estimate, round(se, 5) AS se, round(estimate - {Z95} * se, 5) AS low,
  round(estimate + {Z95} * se, 5) AS high, round(estimate / se, 4) AS statistic,
  round(2 - 2 * {phi('abs(estimate / se)')}, 5) AS p FROM effects"""


def binomial_fits(t: Tables):
    """(name, first factor, clustered fit) of each model."""
    rows = {"card": t.card, "females": S.with_group_type(t.card, ["building"])}
    for name, (source, hits, first) in BINOMIAL_MODELS.items():
        yield name, first, fits.clustered_glm(rows[source], hits, "n_detections", first, PHASE, CLUSTER)


def stacked(parts: list[DataFrame]) -> DataFrame:
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


@query("binomial_models", twin("card", f"{of_models(model_terms)}\nSELECT model, term, {_EFFECTS}"))
def binomial_models(t: Tables):
    """Pursuits begun and received, of all and of females by type of cohort, with clustered errors."""
    return stacked([shown(K.term_table(fit), 5).withColumn("model", F.lit(name)) for name, _, fit in binomial_fits(t)])


@query("binomial_model_contrasts", twin("card", f"""{of_models(model_pairs)}
SELECT model, factor, held, level1, level2, {_EFFECTS}"""))
def binomial_model_contrasts(t: Tables):
    """Of each model: phases within a level, and levels within a phase."""
    parts = []
    for name, first, fit in binomial_fits(t):
        grid = K.grid_weights(t.spark, fit.names, first, PHASE)
        for over, other in (("phase", first[0]), (first[0], "phase")):
            pairs = K.pair_weights(grid, [over], [other]).withColumn("held", F.col(other).cast("string")).drop(other, "family")
            parts.append(K.contrast(fit, pairs).withColumns({"model": F.lit(name), "factor": F.lit(over)}))
    return shown(stacked(parts), 5)


@query("trend_contrasts_of_females", line_twin("typed_dispersion", "typed_dispersion", "cohort_type", f"""
SELECT factor, held, level1, level2, {SHOWN} FROM (
  SELECT 'phase' AS factor, x.cohort_type AS held, '1' AS level1, '2' AS level2, x.b - y.b AS estimate,
    sqrt(s2 * (1 / x.sxx + 1 / y.sxx)) AS se, df, tq
  FROM line x JOIN line y ON x.cohort_type = y.cohort_type AND x.phase = 1 AND y.phase = 2, pool, reach
  UNION ALL SELECT 'cohort_type', CAST(x.phase AS VARCHAR), 'mixed', 'single-sex', x.b - y.b,
    sqrt(s2 * (1 / x.sxx + 1 / y.sxx)), df, tq
  FROM line x JOIN line y ON x.phase = y.phase AND x.cohort_type = 'mixed' AND y.cohort_type = 'single-sex', pool, reach)"""))
def trend_contrasts_of_females(t: Tables):
    fit = fits.linear_model(
        S.female_dispersion(t.visits), "sd_consumed", mixed.crossed_terms(TYPE, PHASE, "night"))
    return shown_lines(slope_pairs(t, fit, TYPE))
