"""Correlation, scaling, components, regression, mixtures and networks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insolara.operators import mixture as M
from insolara.operators import network as N
from insolara.operators import stats as L
from insolara.operators import tsqr as Q
from insolara.operators.reshape import above_best, profile_vector
from insolara.plans import views as V
from insolara.plans.registry import corr_sql, plan, r, tidy, with_views
from insolara.session import scratch_path
from insolara.sinks.models import save_model, save_scaler
from insolara.sources.models import load_model, load_scaler

FEATURES = ["x1", "x2", "x3"]
INF = float("inf")


# --- statistics -----------------------------------------------------------------------------


def _pair_rows(columns: list[str], value: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, {value.format(a=a, b=b)} FROM training"
                              for a in columns for b in columns)


@plan("corr_matrix", with_views(_pair_rows([*FEATURES, "y"], r(corr_sql("{a}", "{b}")) + " AS corr"), "training"))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(L.corr_matrix(V.training(spark, sf_dir), [*FEATURES, "y"]))


@plan("covariance", with_views(_pair_rows(FEATURES, r("covar_samp({a}, {b})") + " AS cov"), "training"))
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(L.covariance(V.training(spark, sf_dir), FEATURES))


@plan("scaler_transform", with_views(f"""
    WITH s AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM training)
    SELECT l_orderkey, l_linenumber, {r('(x1 - m1) / s1')} AS x1, {r('(x2 - m2) / s2')} AS x2 FROM training, s
    """, "training"))
def scaler_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.training(spark, sf_dir)
    made = L.scaler_transform(rows, rows, ["x1", "x2"])
    return tidy(made.select("l_orderkey", "l_linenumber", "x1", "x2"))


@plan("minmax_scale", with_views(f"""
    WITH s AS (SELECT min(x1) AS l1, max(x1) AS h1, min(y) AS ly, max(y) AS hy FROM training)
    SELECT l_orderkey, l_linenumber, {r('(x1 - l1) / (h1 - l1)')} AS x1, {r('(y - ly) / (hy - ly)')} AS y
    FROM training, s""", "training"))
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = L.minmax_scale(V.training(spark, sf_dir), ["x1", "y"])
    return tidy(made.select("l_orderkey", "l_linenumber", "x1", "y"))


@plan("pca_variance", with_views(f"""
    WITH m AS (SELECT count(*)::DOUBLE AS n, corr(x1, x2) AS a, corr(x1, y) AS b, corr(x2, y) AS c FROM training),
         t AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM m),
         w AS (SELECT *, acos(greatest(-1.0, least(1.0, a * b * c / (p * p * p)))) / 3 AS phi FROM t),
         e AS (SELECT n, 1 + 2 * p * cos(phi) AS e1, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM w),
         v AS (SELECT 1 AS component, e1 AS e, n FROM e UNION ALL SELECT 2, 3 - e1 - e3, n FROM e
               UNION ALL SELECT 3, e3, n FROM e)
    SELECT component, {r('e * n / (n - 1)')} AS variance, {r('e / 3 * 100')} AS percent FROM v""", "training"))
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three standardised columns; the SQL solves the cubic in closed form."""
    return tidy(L.pca_variance(V.training(spark, sf_dir), ["x1", "x2", "y"]).drop("loadings"))


@plan("pca_variance_vector", f"""
    WITH s AS (SELECT stddev_pop(v) AS s, count(*) AS n FROM (
                   SELECT unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS d FROM embeddings) GROUP BY d)
    SELECT count(*) AS components, {r('count(*) * max(n) / (max(n) - 1.0)', 4)} AS total FROM s WHERE s > 0""")
def pca_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of the vectors; the SQL knows their number and the trace."""
    made = L.pca_variance_vector(V.table(spark, sf_dir, "embeddings"), "embedding", 64)
    return tidy(made.agg(F.count("*").alias("components"), F.sum("variance").alias("total")), 4)


@plan("linear_regression_1x", with_views(f"""
    SELECT l_linenumber, {r('covar_pop(x1, y) / var_pop(x1)', 3)} AS slope,
           {r('avg(y) - covar_pop(x1, y) / var_pop(x1) * avg(x1)', 3)} AS intercept
    FROM training GROUP BY 1""", "training"))
def linear_regression_1x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(L.linear_regression_1x(V.training(spark, sf_dir), "x1", "y", ["l_linenumber"]), 3)


@plan("linear_regression", with_views(f"""
    WITH c AS (SELECT var_pop(x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x1, x3) AS c, var_pop(x2) AS d,
                      covar_pop(x2, x3) AS e, var_pop(x3) AS f, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q,
                      covar_pop(x3, y) AS s, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my FROM training),
         k AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM c),
         w AS (SELECT *, (p * (d * f - e * e) - b * (q * f - e * s) + c * (q * e - d * s)) / det AS w1,
                      (a * (q * f - e * s) - p * (b * f - e * c) + c * (b * s - q * c)) / det AS w2,
                      (a * (d * s - q * e) - b * (b * s - q * c) + p * (b * e - d * c)) / det AS w3 FROM k)
    SELECT 'intercept' AS term, {r('my - w1 * m1 - w2 * m2 - w3 * m3', 3)} AS coefficient FROM w
    UNION ALL SELECT 'x1', {r('w1', 3)} FROM w UNION ALL SELECT 'x2', {r('w2', 3)} FROM w
    UNION ALL SELECT 'x3', {r('w3', 3)} FROM w""", "training"))
def linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three predictors; the SQL uses Cramer's rule."""
    return tidy(L.linear_regression(V.training(spark, sf_dir), FEATURES, "y"), 3)


@plan("linear_regression_qr", with_views(f"""
    WITH s AS (SELECT regr_slope(y, x1) AS w, regr_intercept(y, x1) AS c FROM training)
    SELECT 'intercept' AS term, {r('c', 3)} AS coefficient FROM s UNION ALL SELECT 'x1', {r('w', 3)} FROM s""", "training"))
def linear_regression_qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One predictor by QR factors merged in a tree."""
    return tidy(Q.least_squares(V.training(spark, sf_dir), ["x1"], "y"), 3)


@plan("pca_reconstruction", """
    WITH v AS (SELECT vec_id AS id, unnest(range(0, 64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
         n AS (SELECT count(*)::DOUBLE AS n FROM embeddings)
    SELECT CAST(a.d AS INTEGER) AS i, CAST(b.d AS INTEGER) AS j, """ + r("corr(a.x, b.x) * max(n.n) / (max(n.n) - 1)") + """ AS value
    FROM v a JOIN v b ON a.id = b.id AND a.d <= b.d, n GROUP BY 1, 2""")
def pca_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances and loadings of all components put together again, which gives the correlations."""
    made = Q.vector_components(V.table(spark, sf_dir, "embeddings"), "embedding", 64)
    left = made.select("component", "variance", F.posexplode("loadings").alias("i", "a"))
    right = made.select("component", F.posexplode("loadings").alias("j", "b"))
    pairs = left.join(right, "component").where("i <= j")
    return tidy(pairs.groupBy("i", "j").agg(F.sum(F.col("variance") * F.col("a") * F.col("b")).alias("value")))


@plan("regression_bic", with_views(f"""
    SELECT station_id, {r('count(*) * ln(sum((obs - model_b) ** 2) / count(*)) + 3 * ln(count(*))')} AS bic
    FROM station_hour GROUP BY 1""", "station_hour"))
def regression_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(L.regression_bic(V.station_hour(spark, sf_dir), "obs", "model_b", 3, ["station_id"]))


@plan("r2_score", with_views(f"""
    SELECT station_id, {r('1 - sum((model_b - obs) ** 2) / nullif(count(*) * var_pop(obs), 0)')} AS r2
    FROM station_hour GROUP BY 1""", "station_hour"))
def r2_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(L.r2_score(V.station_hour(spark, sf_dir), "obs", "model_b", ["station_id"]))


@plan("bic_delta", with_views(f"""
    WITH b AS (SELECT station_id, count(*) * ln(sum((obs - model_b) ** 2) / count(*)) + 3 * ln(count(*)) AS bic
               FROM station_hour GROUP BY 1)
    SELECT station_id, {r('bic - (SELECT min(bic) FROM b)')} AS delta FROM b""", "station_hour"))
def bic_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = L.regression_bic(V.station_hour(spark, sf_dir), "obs", "model_b", 3, ["station_id"])
    return tidy(above_best(scored, "bic").select("station_id", "delta"))


# --- mixtures -------------------------------------------------------------------------------


def em_sql(source: str, width: int, k: int, rounds: int, kind: str = "diag") -> str:
    """EM spelled out as common table expressions: ``source`` has (id, d, v), the last step is ``par{rounds}``.

    The start puts every row into one of ``k`` equal bands of its mean value.
    """
    def maximise(i: int) -> str:
        floor = M.VARIANCE_FLOOR
        return f"""
            mass{i} AS (SELECT c, sum(w) AS nk, sum(w) / sum(sum(w)) OVER () AS weight FROM resp{i} GROUP BY c),
            dims{i} AS (SELECT q.c, s.d, sum(q.w * s.v) / max(m.nk) AS mean,
                               sum(q.w * s.v * s.v) / max(m.nk)
                               - (sum(q.w * s.v) / max(m.nk)) ** 2 + {floor}::DOUBLE AS var
                        FROM resp{i} q JOIN {source} s ON q.id = s.id JOIN mass{i} m ON m.c = q.c GROUP BY q.c, s.d),
            par{i} AS (SELECT c, d, mean, {'var' if kind == 'diag' else 'avg(var) OVER (PARTITION BY c) AS var'}
                       FROM dims{i})"""

    out = [f"""
        levels AS (SELECT id, sum(v) / {width} AS level FROM {source} GROUP BY id),
        edges AS (SELECT min(level) AS lo, (max(level) - min(level)) / {k} AS step FROM levels),
        resp0 AS (SELECT id, CAST(least(greatest(floor((level - lo) / step), 0), {k - 1}) AS INTEGER) AS c,
                         1.0::DOUBLE AS w FROM levels, edges)""", maximise(0)]
    for i in range(1, rounds + 1):
        p = i - 1
        out.append(f"""
            dens{i} AS (SELECT s.id, p.c, ln(max(m.weight)) - 0.5 * sum(ln(2 * pi() * p.var)
                               + (s.v - p.mean) ** 2 / p.var) AS lp
                        FROM {source} s JOIN par{p} p ON s.d = p.d JOIN mass{p} m ON m.c = p.c GROUP BY s.id, p.c),
            top{i} AS (SELECT id, max(lp) AS t FROM dens{i} GROUP BY id),
            norm{i} AS (SELECT d.id, max(t.t) + ln(sum(exp(d.lp - t.t))) AS z
                        FROM dens{i} d JOIN top{i} t ON d.id = t.id GROUP BY d.id),
            resp{i} AS (SELECT d.id, d.c, exp(d.lp - n.z) AS w FROM dens{i} d JOIN norm{i} n ON d.id = n.id)""")
        out.append(maximise(i))
    return ",".join(out)


def ranked_sql(i: int) -> str:
    """Components renumbered by their first mean."""
    return f"""
        ranks AS (SELECT c, CAST(row_number() OVER (ORDER BY mean) - 1 AS INTEGER) AS cluster FROM par{i} WHERE d = 0)"""


PROFILE_SQL = """
    cells AS (SELECT station_id AS id, CAST(hour(dt) - 8 AS INTEGER) AS d, avg(obs) AS v FROM station_hour
              WHERE hour(dt) BETWEEN 8 AND 17 GROUP BY 1, 2),
    prof AS (SELECT * FROM cells WHERE id IN (SELECT id FROM cells GROUP BY id HAVING count(*) = 10))"""

VECTOR_SQL = """
    prof AS (SELECT vec_id AS id, unnest(range(0, 64)) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings)"""

PARAMETERS = f"k.cluster, {r('m.weight')} AS weight, CAST(p.d AS INTEGER) AS dim, {r('p.mean')} AS mean, " \
             f"{r('p.var')} AS variance"


LISTS_SQL = "lists AS MATERIALIZED (SELECT id, list(v ORDER BY d) AS x FROM prof GROUP BY id)"


def converged_sql(width: int, k: int, kind: str = "diag", rounds: int = 100, gain: float = M.GAIN_LIMIT, name: str = "em",
                  source: str = "lists") -> str:
    """EM until its gain falls below ``gain``, as a recursive table ``name`` (it, w, m, v, ll, settled) over (id, x) lists.

    The start is that of :func:`em_sql`; the last row holds the result. ``full`` is written out for three dimensions.
    """
    dims = range(1, width + 1)
    pairs = [(i, j) for i in dims for j in dims] if kind == "full" else [(i, i) for i in dims]
    sums, squares = (f"[{', '.join(f'sum(r * {t})' for t in terms)}]"
                     for terms in ([f"x[{i}]" for i in dims], [f"x[{i}] * x[{j}]" for i, j in pairs]))
    floor = f"{M.VARIANCE_FLOOR!r}::DOUBLE"
    if kind == "full":
        var = ", ".join(f"sxx[{n}] / nk - sx[{i}] * sx[{j}] / nk / nk{f' + {floor}' if i == j else ''}"
                        for n, (i, j) in enumerate(pairs, 1))
        var = f"[{var}]"
    else:
        var = f"list_transform(range(1, {width + 1}), lambda i: greatest(sxx[i] / nk - (sx[i] / nk) ** 2, 0) + {floor})"
        if kind == "spherical":
            var = f"list_transform(range(1, {width + 1}), lambda i: list_avg({var}))"

    def maximised(rows: str) -> str:
        return f"""(
            SELECT it, list(nk / total ORDER BY c) AS w, list(mean ORDER BY c) AS m, list(var ORDER BY c) AS v,
                   any_value(ll) AS ll, any_value(prev) AS prev
            FROM (SELECT *, list_transform(sx, lambda s: s / nk) AS mean, {var} AS var, sum(nk) OVER (PARTITION BY it) AS total
                  FROM (SELECT it, c, sum(r) AS nk, {sums} AS sx, {squares} AS sxx, avg(z) AS ll, any_value(prev) AS prev
                        FROM {rows} GROUP BY it, c)) GROUP BY it)"""

    return f"""
        {name}_levels AS (SELECT id, x, list_sum(x) / {width} AS level FROM {source}),
        {name}_edges AS (SELECT min(level) AS lo, (max(level) - min(level)) / {k} AS step FROM {name}_levels),
        {name}_bands AS (SELECT 0 AS it, CAST(least(greatest(floor((level - lo) / step), 0), {k - 1}) AS INTEGER) + 1 AS c,
                                1::DOUBLE AS r, x, NULL::DOUBLE AS z, NULL::DOUBLE AS prev FROM {name}_levels, {name}_edges),
        {name} AS (
            SELECT it, w, m, v, ll, false AS settled FROM {maximised(f'{name}_bands')}
            UNION ALL
            SELECT it + 1, w, m, v, ll, coalesce(ll - prev < {gain!r}::DOUBLE, false) FROM {maximised(f"""(
                SELECT it, c, exp(lp[c] - z) AS r, x, z, prev FROM (
                    SELECT *, unnest(range(1, {k + 1})) AS c FROM (
                        SELECT *, {_log_sum_sql('lp')} AS z FROM (
                            SELECT e.it, e.ll AS prev, p.x, {_densities_sql(width, k, kind)} AS lp
                            FROM {name} e, {source} p WHERE NOT e.settled AND e.it < {rounds}))))""")}),
        {name}_last AS (SELECT * FROM {name} ORDER BY it DESC LIMIT 1)"""


def _log_sum_sql(values: str) -> str:
    return f"list_max({values}) + ln(list_sum(list_transform({values}, lambda l: exp(l - list_max({values})))))"


def _densities_sql(width: int, k: int, kind: str) -> str:
    """log(weight * density) of the row ``p`` under each component of the model ``e``."""
    if kind != "full":
        terms = f"list_transform(range(1, {width + 1}), lambda i: ln(2 * pi() * e.v[j][i]) + (p.x[i] - e.m[j][i]) ** 2 / e.v[j][i])"
        return f"list_transform(range(1, {k + 1}), lambda j: ln(e.w[j]) - 0.5 * list_sum({terms}))"
    a, b, c, d, f, g = (f"e.v[j][{n}]" for n in (1, 2, 3, 5, 6, 9))
    x, y, z = (f"(p.x[{n}] - e.m[j][{n}])" for n in (1, 2, 3))
    det = f"({a} * ({d} * {g} - {f} ** 2) - {b} * ({b} * {g} - {c} * {f}) + {c} * ({b} * {f} - {c} * {d}))"
    quad = (f"({x} ** 2 * ({d} * {g} - {f} ** 2) + {y} ** 2 * ({a} * {g} - {c} ** 2) + {z} ** 2 * ({a} * {d} - {b} ** 2)"
            f" + 2 * {x} * {y} * ({c} * {f} - {b} * {g}) + 2 * {x} * {z} * ({b} * {f} - {c} * {d})"
            f" + 2 * {y} * {z} * ({b} * {c} - {a} * {f})) / {det}")
    return f"list_transform(range(1, {k + 1}), lambda j: ln(e.w[j]) - 0.5 * (3 * ln(2 * pi()) + ln({det}) + {quad}))"


def _ranked(values: str) -> str:
    """A column of the last model's components, numbered from 0 by their first mean, with their number in the lists."""
    return f"(SELECT CAST(row_number() OVER (ORDER BY m[j][1]) - 1 AS INTEGER) AS cluster, j, w, m, v FROM (" \
           f"SELECT *, unnest(range(1, len(w) + 1)) AS j FROM {values}))"


def _converged_rows(width: int, kind: str) -> str:
    spread = f"v[j][(d - 1) * {width} + d]" if kind == "full" else "v[j][d]"
    return f"""
        SELECT cluster, {r('w[j]')} AS weight, CAST(d - 1 AS INTEGER) AS dim, {r('m[j][d]')} AS mean, {r(spread)} AS variance
        FROM (SELECT *, unnest(range(1, {width + 1})) AS d FROM {_ranked('em_last')})"""


def _fit_sql(source: str, width: int, k: int, rounds: int, kind: str) -> str:
    return f"""
        WITH {source}, {em_sql('prof', width, k, rounds, kind)}, {ranked_sql(rounds)}
        SELECT {PARAMETERS} FROM par{rounds} p JOIN mass{rounds} m ON m.c = p.c JOIN ranks k ON k.c = p.c"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_vector(V.station_hour(spark, sf_dir), "station_id", "obs").where("complete")


@plan("gmm_em_step", with_views(_fit_sql(PROFILE_SQL, 10, 2, 1, "diag"), "station_hour"))
def gmm_em_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = M.gmm_fit(_profiles(spark, sf_dir), "profile", 10, 2, 1, "diag", "bands", gain=-INF)
    return tidy(M.mixture_rows(spark, model))


@plan("gmm_fit", with_views(_fit_sql(VECTOR_SQL, 64, 3, 3, "diag")))
def gmm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = M.gmm_fit(V.table(spark, sf_dir, "embeddings"), "embedding", 64, 3, 3, "diag", "bands", gain=-INF)
    return tidy(M.mixture_rows(spark, model))


EMBEDDED_SQL = "lists AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


@plan("gmm_fit_converged", f"WITH RECURSIVE {EMBEDDED_SQL}, {converged_sql(64, 3)} {_converged_rows(64, 'diag')}")
def gmm_fit_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three diagonal clusters until the gain is below its limit, 100 rounds at most."""
    return tidy(M.mixture_rows(spark, M.gmm_fit(V.table(spark, sf_dir, "embeddings"), "embedding", 64, 3, start="bands")))


@plan("gmm_fit_spherical", f"WITH RECURSIVE {EMBEDDED_SQL}, {converged_sql(64, 2, 'spherical')} {_converged_rows(64, 'spherical')}")
def gmm_fit_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spherical clusters until the gain is below its limit."""
    model = M.gmm_fit(V.table(spark, sf_dir, "embeddings"), "embedding", 64, 2, kind="spherical", start="bands")
    return tidy(M.mixture_rows(spark, model))


@plan("gmm_fit_full", with_views(f"""
    WITH RECURSIVE lists AS MATERIALIZED (SELECT 0 AS id, [x1, x2 * 100, x3 * 100] AS x FROM training),
    {converged_sql(3, 2, 'full')} {_converged_rows(3, 'full')}""", "training"))
def gmm_fit_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters with full covariances over three training columns, until the gain is below its limit."""
    rows = V.training(spark, sf_dir).select(F.array("x1", F.col("x2") * 100, F.col("x3") * 100).alias("v"))
    return tidy(M.mixture_rows(spark, M.gmm_fit(rows, "v", 3, 2, kind="full", start="bands")))


def _fixed_mixture(width: int, k: int) -> M.Mixture:
    """Given parameters for the prediction query, from a rule."""
    j, d = np.meshgrid(np.arange(k), np.arange(width), indexing="ij")
    return M.Mixture("diag", np.arange(1, k + 1) / (k * (k + 1) / 2), 40.0 + 8.0 * j + np.sin(d), 90.0 + 10.0 * j + d)


def _density_sql(model: M.Mixture) -> str:
    parts = []
    for j in range(model.k):
        terms = " ".join(f"WHEN {d} THEN ln(2 * pi() * {model.variances[j, d]!r}::DOUBLE) + "
                         f"(v - {float(model.means[j, d])!r}::DOUBLE) ** 2 / {float(model.variances[j, d])!r}::DOUBLE"
                         for d in range(model.width)).replace("np.float64(", "(")
        parts.append(f"SELECT id, {j} AS c, ln({float(model.weights[j])!r}::DOUBLE) - 0.5 * sum(CASE d {terms} END) AS lp "
                     "FROM prof GROUP BY id")
    return " UNION ALL ".join(parts)


FIXED = _fixed_mixture(10, 3)


@plan("gmm_predict", with_views(f"""
    WITH {PROFILE_SQL}, dens AS ({_density_sql(FIXED)})
    SELECT id AS station_id, CAST(arg_max(c, lp) AS INTEGER) AS cluster FROM dens GROUP BY id""", "station_hour"))
def gmm_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gmm_predict(_profiles(spark, sf_dir), "profile", FIXED).select("station_id", "cluster")


@plan("gmm_bic", f"""
    WITH {VECTOR_SQL}, n AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM prof),
         s AS (SELECT avg(v) AS m, var_pop(v) + 1e-6::DOUBLE AS var, d FROM prof GROUP BY d),
         one AS (SELECT avg(var) AS var FROM s),
         ll AS (SELECT sum(-0.5 * (ln(2 * pi() * one.var) + (p.v - s.m) ** 2 / one.var)) AS l
                FROM prof p JOIN s ON p.d = s.d, one)
    SELECT 1 AS k, 65 AS params, {r('l', 3)} AS loglik, {r('-2 * l + 65 * ln(n)', 3)} AS bic FROM ll, n""")
def gmm_bic_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spherical cluster over the vectors, which has a closed form."""
    made = M.gmm_bic(V.table(spark, sf_dir, "embeddings"), "embedding", 64, [1], "spherical", 2, "bands")
    return tidy(made, 3)


def _bic_sql(counts: range, width: int) -> str:
    parts = [f"WITH RECURSIVE {EMBEDDED_SQL}", *(converged_sql(width, k, "spherical", name=f"em{k}") for k in counts)]
    rows = [f"""
        SELECT {k} AS k, {k + k * width + k - 1} AS params, sum(z) AS l, count(*) AS n
        FROM (SELECT {_log_sum_sql('lp')} AS z FROM (SELECT {_densities_sql(width, k, 'spherical')} AS lp FROM em{k}_last e, lists p))"""
            for k in counts]
    return f"""{', '.join(parts)}
        SELECT k, params, {r('l', 3)} AS loglik, {r('-2 * l + params * ln(n)', 3)} AS bic FROM ({' UNION ALL '.join(rows)})"""


@plan("gmm_bic_range", _bic_sql(range(1, 13), 64))
def gmm_bic_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to twelve spherical clusters from equal bands, each until its gain is below the limit, in the same passes."""
    return tidy(M.gmm_bic(V.table(spark, sf_dir, "embeddings"), "embedding", 64, start="bands"), 3)


@plan("gmm_bic_kmeans")
def gmm_bic_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from k-means, whose seeds and rounds all cluster counts share (seeded draws are beyond SQL)."""
    return M.gmm_bic(V.table(spark, sf_dir, "embeddings"), "embedding", 64)


LABELS_SQL = f"""
    {PROFILE_SQL}, {LISTS_SQL}, {converged_sql(10, 2)},
    labels AS (SELECT id AS station_id, arg_max(cluster, lp[j]) AS cluster
               FROM (SELECT p.id, {_densities_sql(10, 2, 'diag')} AS lp FROM em_last e, lists p), {_ranked('em_last')} GROUP BY 1)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete profiles with the label of a converged mixture."""
    rows = _profiles(spark, sf_dir)
    return M.gmm_predict(rows, "profile", M.gmm_fit(rows, "profile", 10, 2, start="bands"))


@plan("cluster_profiles_fit", with_views(f"WITH RECURSIVE {LABELS_SQL} SELECT station_id, cluster FROM labels", "station_hour"))
def cluster_profiles_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("station_id", "cluster")


@plan("cluster_counts", with_views(f"""
    WITH RECURSIVE {LABELS_SQL} SELECT cluster, count(*) AS n FROM labels GROUP BY 1""", "station_hour"))
def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster_counts(_labelled(spark, sf_dir))


@plan("cluster_profiles", with_views(f"""
    WITH RECURSIVE {LABELS_SQL}
    SELECT l.cluster, CAST(p.d + 8 AS INTEGER) AS hour, {r('avg(p.v)')} AS mean, count(*) AS members
    FROM prof p JOIN labels l ON p.id = l.station_id GROUP BY 1, 2""", "station_hour"))
def cluster_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(M.cluster_profile_means(_labelled(spark, sf_dir)))


@plan("cluster_plane", with_views(f"""
    WITH RECURSIVE {LABELS_SQL}
    SELECT l.station_id, {r('a.v')} AS x, {r('b.v')} AS y, l.cluster
    FROM labels l JOIN prof a ON a.id = l.station_id AND a.d = 6 JOIN prof b ON b.id = l.station_id AND b.d = 2
    """, "station_hour"))
def cluster_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(M.profile_plane(_labelled(spark, sf_dir), "station_id"))


@plan("cluster_map", with_views(f"""
    WITH RECURSIVE {LABELS_SQL}
    SELECT l.station_id, l.cluster, {r('lon')} AS lon, {r('lat')} AS lat
    FROM labels l JOIN station s ON l.station_id = s.station_id""", "station_hour", "station"))
def cluster_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labelled(spark, sf_dir).select("station_id", "cluster")
    return tidy(labels.join(V.station(spark, sf_dir).select("station_id", "lon", "lat"), "station_id"))


# --- networks -------------------------------------------------------------------------------


def _fixed_network() -> N.Network:
    """Given weights for the prediction query, from a rule."""
    count = (3 + 1) * 4 + (4 + 1) * 3 + (3 + 1)
    return N.Network.from_flat([3, 4, 3, 1], "tanh", [math.sin(1.7 * i) for i in range(count)])


def network_sql(network: N.Network, inputs: list[str], source: str) -> str:
    """Forward pass as nested selects."""
    acts = {"tanh": "tanh({})", "identity": "{}", "relu": "greatest({}, 0.0)", "logistic": "1 / (1 + exp(-({})))"}
    relation, names = source, inputs
    for i, (w, b) in enumerate(zip(network.weights, network.biases)):
        made = []
        for j in range(w.shape[1]):
            z = " + ".join([f"({float(b[j])!r}::DOUBLE)",
                            *[f"{names[p]} * ({float(w[p, j])!r}::DOUBLE)" for p in range(w.shape[0])]])
            last = i == len(network.weights) - 1
            made.append(f"{z if last else acts[network.activation].format(z)} AS n{i}_{j}")
        relation = f"(SELECT *, {', '.join(made)} FROM {relation})"
        names = [f"n{i}_{j}" for j in range(w.shape[1])]
    return relation


@plan("mlp_predict", with_views(f"""
    WITH s AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2, avg(x3) AS m3,
                      stddev_pop(x3) AS s3 FROM training),
         z AS (SELECT l_orderkey, l_linenumber, (x1 - m1) / s1 AS a, (x2 - m2) / s2 AS b, (x3 - m3) / s3 AS c
               FROM training, s)
    SELECT l_orderkey, l_linenumber, {r('n2_0')} AS prediction
    FROM {network_sql(_fixed_network(), ['a', 'b', 'c'], 'z')}""", "training"))
def mlp_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.training(spark, sf_dir)
    scaler = L.scaler_fit(rows, FEATURES)
    made = N.mlp_predict(rows, _fixed_network(), FEATURES, scaler)
    return tidy(made.select("l_orderkey", "l_linenumber", "prediction"))


def _wide_network() -> N.Network:
    """Two layers of ten with given weights, from a rule."""
    count = (3 + 1) * 10 + (10 + 1) * 10 + (10 + 1)
    return N.Network.from_flat([3, 10, 10, 1], "logistic", [math.sin(1.3 * i) / 2 for i in range(count)])


@plan("mlp_predict_wide", with_views(f"""
    SELECT l_orderkey, l_linenumber, {r('n2_0')} AS prediction
    FROM {network_sql(_wide_network(), FEATURES, 'training')}""", "training"))
def mlp_predict_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = N.mlp_predict(V.training(spark, sf_dir), _wide_network(), FEATURES)
    return tidy(made.select("l_orderkey", "l_linenumber", "prediction"))


@plan("mlp_train")
def mlp_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train 200 epochs on the daily means, save model and scaler, load both and score the predictions."""
    rows = V.training_day(spark, sf_dir)
    made = N.mlp_train(rows, FEATURES, "y", 2, 10, plan=N.Training(learning_rate=0.01, tol=1e-5, patience=200))
    folder = scratch_path(spark, "model")
    path = save_model(spark, made.network, folder, "smooth", made.r2)
    save_scaler(spark, made.scaler, f"{folder}/scaler")
    predicted = N.mlp_predict(rows, load_model(spark, path), FEATURES, load_scaler(spark, f"{folder}/scaler"))
    return L.r2_score(predicted, "y", "prediction")


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training days with inputs and target between 0 and 1."""
    return L.minmax_scale(V.training_day(spark, sf_dir), [*FEATURES, "y"])


@plan("mlp_train_seasonal")
def mlp_train_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks in one loop, at most 2000 epochs an attempt, until each has R2 of 0.8 (five attempts at most)."""
    made = N.mlp_train_seasonal(V.training_day(spark, sf_dir), FEATURES, "y", 2, 10)
    rows = [(block, float(t.r2), len(t.losses)) for block, t in made.items()]
    return spark.createDataFrame(rows, "training_block string, r2 double, epochs int")


@plan("mlp_sweep_activation")
def mlp_sweep_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss per epoch of four activations, 100 epochs."""
    return N.mlp_sweep_activation(V.training_day(spark, sf_dir), FEATURES, "y")


@plan("mlp_sweep_layers")
def mlp_sweep_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss per epoch of one to three layers, 100 epochs."""
    return N.mlp_sweep_layers(V.training_day(spark, sf_dir), FEATURES, "y")


@plan("mlp_sweep_solver")
def mlp_sweep_solver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss per epoch of five solvers, at most 5000 epochs, patience 1000."""
    return N.mlp_sweep_solver(V.training_day(spark, sf_dir), FEATURES, "y", scale=True)


@plan("mlp_bic_grid")
def mlp_bic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 324 pairs of layer widths, at most 1000 epochs, patience 100."""
    return N.mlp_bic_grid(_unit(spark, sf_dir), FEATURES, "y")


@plan("mlp_best_of")
def mlp_best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten starts, at most 5000 epochs, patience 500, judged on the later days."""
    rows = _unit(spark, sf_dir)
    late = F.col("dt") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return N.mlp_best_of(rows.where(~late), rows.where(late), FEATURES, "y", n=10)[1]


def full_batch_sql(net: N.Network, how: N.Training, rounds: int, source: str, inputs: list[str], y: str) -> str:
    """Full-batch Adam for one hidden layer of tanh units: losses per epoch and the last weights, in the order of ``flat``."""
    width, hidden = net.sizes[0], net.sizes[1]
    names = [f"w{p}_{j}" for p in range(width) for j in range(hidden)] + [f"b_{j}" for j in range(hidden)]
    names += [f"v_{j}" for j in range(hidden)] + ["c"]
    decayed = {n for n in names if n[0] in "wv"}
    start = ", ".join(f"{v!r}::DOUBLE AS {n}, 0::DOUBLE AS m_{n}, 0::DOUBLE AS s_{n}" for n, v in zip(names, net.flat().tolist()))
    steps = [f"p0 AS MATERIALIZED (SELECT {start})"]
    for e in range(1, rounds + 1):
        units = ", ".join(f"tanh({' + '.join([f't.{x} * w{p}_{j}' for p, x in enumerate(inputs)])} + b_{j}) AS h_{j}"
                          for j in range(hidden))
        out = " + ".join([f"h_{j} * v_{j}" for j in range(hidden)] + ["c"])
        slopes = {j: f"d * v_{j} * (1 - h_{j} * h_{j})" for j in range(hidden)}
        sums = {f"w{p}_{j}": f"{slopes[j]} * {x}" for p, x in enumerate(inputs) for j in range(hidden)}
        sums |= {f"b_{j}": slopes[j] for j in range(hidden)} | {f"v_{j}": f"d * h_{j}" for j in range(hidden)} | {"c": "d"}
        grads = ", ".join(f"sum({s}) AS g_{n}" for n, s in sums.items())
        steps.append(f"g{e} AS MATERIALIZED (SELECT sum(d * d) AS sse, count(*)::DOUBLE AS n, {grads} FROM (SELECT *, {out} - {y} AS d "
                     f"FROM (SELECT t.*, p.*, {units} FROM {source} t, p{e - 1} p)))")
        decay = " + ".join(f"{n} * {n}" for n in sorted(decayed))
        slope = {n: f"(g_{n}{f' + {how.alpha!r}::DOUBLE * {n}' if n in decayed else ''}) / n" for n in names}
        first = {n: f"({N.ADAM_FIRST!r}::DOUBLE * m_{n} + {1 - N.ADAM_FIRST!r}::DOUBLE * {slope[n]})" for n in names}
        second = {n: f"({N.ADAM_SECOND!r}::DOUBLE * s_{n} + {1 - N.ADAM_SECOND!r}::DOUBLE * ({slope[n]}) * ({slope[n]}))" for n in names}
        rate = how.learning_rate * math.sqrt(1 - N.ADAM_SECOND ** e) / (1 - N.ADAM_FIRST ** e)
        moved = ", ".join(f"{n} - {rate!r}::DOUBLE * {first[n]} / (sqrt({second[n]}) + {N.ADAM_GUARD!r}::DOUBLE) AS {n}, "
                          f"{first[n]} AS m_{n}, {second[n]} AS s_{n}" for n in names)
        steps.append(f"p{e} AS MATERIALIZED (SELECT {moved}, 0.5 * (sse + {how.alpha!r}::DOUBLE * ({decay})) / n AS loss "
                     f"FROM p{e - 1}, g{e})")
    rows = [f"SELECT 'loss' AS kind, {e} AS number, {r('loss')} AS value FROM p{e}" for e in range(1, rounds + 1)]
    rows += [f"SELECT 'weight', {i}, {r(n)} FROM p{rounds}" for i, n in enumerate(names)]
    return f"{', '.join(steps)} {' UNION ALL '.join(rows)}"


FULL_BATCH = N.Training(learning_rate=0.05, batch_size=None, max_iter=6)
SCALED_SQL = "rows AS (SELECT x1 / 50 AS a, x2 * 10 AS b, x3 * 10 AS c0, y / 100000 AS t0 FROM training)"


def _small_network() -> N.Network:
    """Three hidden units with given weights, from a rule."""
    return N.Network.from_flat([3, 3, 1], "tanh", [math.sin(1.1 * i + 0.3) / 2 for i in range((3 + 1) * 3 + 3 + 1)])


@plan("mlp_full_batch", with_views(f"""
    WITH {SCALED_SQL}, {full_batch_sql(_small_network(), FULL_BATCH, 6, 'rows', ['a', 'b', 'c0'], 't0')}""", "training"))
def mlp_full_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six full-batch steps from given weights: losses and weights, which plain SQL can follow."""
    rows = V.training(spark, sf_dir).select((F.col("x1") / 50).alias("a"), (F.col("x2") * 10).alias("b"),
                                            (F.col("x3") * 10).alias("c0"), (F.col("y") / 100000).alias("t0"))
    fit = N.train_networks(rows, ["a", "b", "c0"], "t0", [_small_network()], [FULL_BATCH])[0]
    made = [("loss", e, float(v)) for e, v in enumerate(fit.losses, 1)]
    made += [("weight", i, float(v)) for i, v in enumerate(fit.network.flat())]
    return tidy(spark.createDataFrame(made, "kind string, number int, value double"))
