"""Queries over panels: shaping, scaling, lags, causality tests, resampling and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import granger, panel, predictive, preprocess, suite
from . import bindings as b

BLOCK, SAMPLES = 3, 5


def _rounded(df: DataFrame, *exact: str, places: int = 11) -> DataFrame:
    """Doubles to 6 places, or to so many if their decimals may end in a 5 there; integers as long."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(f"`{c}`", places if c in exact else 6) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(f"`{c}`").cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.col(f"`{c}`") for c in df.columns])


def q01_panel_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.wide(b.events_panel(spark, sf_dir), b.EVENTS).drop("traj_id"))


def q02_panel_densified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(b.orders_panel(spark, sf_dir))


def q03_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.zscore(b.events_panel(spark, sf_dir)))


def q04_standardize_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.zscore(b.trajectories(spark, sf_dir), 1e-12))


def q05_diff_order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.differences(b.events_panel(spark, sf_dir), 2))


def q06_lag_design_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.lag_rows(b.events_panel(spark, sf_dir), 2, 0))


def q07_target_dataset_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.target_dataset(b.events_panel(spark, sf_dir), "purchase", 2))


def q08_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.segments(b.orders_panel(spark, sf_dir), 3, 7))


def q09_seasonal_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.seasonal_residual(b.orders_panel(spark, sf_dir), 12))


def q10_lagged_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.lagged_covariance(panel.zscore(b.events_panel(spark, sf_dir)), 2))


def q11_pairwise_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.pearson(b.events_panel(spark, sf_dir)))


def q12_granger_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: order-2 tests of all ordered pairs of the daily panel."""
    return _rounded(granger.tests(panel.zscore(b.events_panel(spark, sf_dir))))


def q13_granger_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(granger.edges(granger.tests(panel.zscore(b.orders_panel(spark, sf_dir))), 0.5).drop("method"))


def q14_granger_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(granger.segmented(panel.segments(panel.zscore(b.orders_panel(spark, sf_dir)), 2, 20), 0.6))


def _index_of(obs: DataFrame) -> DataFrame:
    """The bootstrap index of all steps of a panel."""
    last = obs.agg(F.max("t")).first()[0]
    return panel.block_index(obs.sparkSession, (last or 0) + 1, SAMPLES, BLOCK)


def q15_block_bootstrap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = b.events_panel(spark, sf_dir)
    return _rounded(panel.bootstrap(obs, _index_of(obs)))


def q16_granger_bootstrap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = b.events_panel(spark, sf_dir)
    sample = panel.bootstrap(panel.zscore(obs), _index_of(obs))
    tested = granger.tests(sample.drop("traj_id").withColumnRenamed("run_id", "traj_id"))
    return _rounded(tested.select(F.col("traj_id").alias("run_id"), "source", "target", "n", "f", "p"))


def q32_predictive_gain_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(predictive.gains_order_one(panel.zscore(b.events_panel(spark, sf_dir))))


def _fit(spark: SparkSession, sf_dir: str, *names: str, bootstraps: int = 0, **options) -> DataFrame:
    from ..operators.registry import discover

    obs = suite.with_bootstraps(panel.zscore(b.trajectories(spark, sf_dir)), bootstraps)
    specs = {k: v for k, v in discover().items() if k in names}
    return suite.fit_grid(obs, specs, 2, {k: options for k in specs})


def q54_pcmci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "PCMCI")


def q55_panel_pcmci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.panel_pcmci(b.trajectories(spark, sf_dir))


def q56_dynotears(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "DYNOTEARS")


def q57_var_lingam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "VARLiNGAM")


def q58_ges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "GES")


def q59_fci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "FCI", include_partial=True)


def q60_lpcmci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "LPCMCI")


def q61_neural_granger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "NeuralGrangercMLP")


def q62_forward_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..methods.score_based import run_score_based_bic
    from ..operators.registry import MethodSpec

    obs = suite.with_bootstraps(panel.zscore(b.trajectories(spark, sf_dir)), 0)
    return suite.fit_grid(obs, {"ScoreBasedBIC": MethodSpec("ScoreBasedBIC", run_score_based_bic)}, 2)


def q63_adf_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(preprocess.differencing_orders(b.orders_panel(spark, sf_dir)))


def q64_granger_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(granger.tests_any_order(panel.zscore(b.orders_panel(spark, sf_dir)), 3))


def q65_method_grid_bootstraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir, "PCMCI", "ClassicalGranger", "VARLiNGAM", bootstraps=4)


def q66_heterogeneous_granger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = granger.segmented(panel.segments(panel.zscore(b.orders_panel(spark, sf_dir)), 2, 20), 0.6)
    return _rounded(suite.segment_votes(found, 2, 1).withColumn("segments", F.array_join("segments", ",")))


def q67_mlp_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..methods.mlp_heuristic import run_mlp_permutation
    from ..operators.registry import MethodSpec

    obs = suite.with_bootstraps(panel.zscore(b.trajectories(spark, sf_dir)), 0)
    return suite.fit_grid(obs, {"MLPPermutationHeuristic": MethodSpec("MLPPermutationHeuristic", run_mlp_permutation)}, 2)


_Z = "SELECT traj_id, t, variable, (value - avg(value) OVER s) / CASE WHEN stddev_pop(value) OVER s > {eps} THEN stddev_pop(value) OVER s ELSE 1 END AS value FROM {p} WINDOW s AS (PARTITION BY traj_id, variable)"
_W = "OVER (PARTITION BY traj_id, variable ORDER BY t)"


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


def _student(t: str, nu: str) -> str:
    """SQL of the two-sided p-value, by the same finite sums with factorials as gamma functions."""
    a = f"atan(abs({t}) / sqrt({nu}::DOUBLE))"
    even = f"sin({a}) * list_sum(list_transform(range(0, greatest(({nu} // 2)::BIGINT, 1)), lambda j: exp(lgamma(2 * j + 1.0) - 2 * lgamma(j + 1.0) - j * ln(4.0)) * pow(cos({a}), 2 * j)))"
    odd = f"(2 / pi()) * ({a} + sin({a}) * list_sum(list_transform(range(1, greatest((({nu} - 1) // 2 + 1)::BIGINT, 2)), lambda j: exp((j - 1) * ln(4.0) + 2 * lgamma(j::DOUBLE) - lgamma(2.0 * j)) * pow(cos({a}), 2 * j - 1))))"
    return f"greatest(0.0, least(1.0, 1 - CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END))"


def _granger(source: str, keys: str = "traj_id") -> str:
    """CTEs from a panel with keys to `tested`."""
    names = ("y", "y1", "y2", "x1", "x2")
    moments = ", ".join(f"covar_pop({a}, {c}) AS {a}_{c}" for i, a in enumerate(names) for c in names[i:])
    cell = lambda a, c: f"{a}_{c}" if names.index(a) <= names.index(c) else f"{c}_{a}"

    def rest(a: str, c: str) -> str:
        p, q, r, s = cell(a, "y1"), cell(a, "y2"), cell(c, "y1"), cell(c, "y2")
        return f"{cell(a, c)} - ({p} * {r} * y2_y2 - ({p} * {s} + {q} * {r}) * y1_y2 + {q} * {s} * y1_y1) / (y1_y1 * y2_y2 - y1_y2 * y1_y2)"

    on = " AND ".join(f"p.{k} = q.{k}" for k in keys.split(", "))
    pk = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""lagged AS (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2 FROM {source} WINDOW w AS (PARTITION BY {keys}, variable ORDER BY t)),
      pairs AS (SELECT {pk}, q.variable AS source, p.variable AS target, p.value AS y, p.l1 AS y1, p.l2 AS y2, q.l1 AS x1, q.l2 AS x2 FROM lagged p JOIN lagged q ON {on} AND p.t = q.t AND p.variable <> q.variable WHERE p.l2 IS NOT NULL AND q.l2 IS NOT NULL),
      m AS (SELECT {keys}, source, target, count(*) AS n, {moments} FROM pairs GROUP BY ALL),
      rs AS (SELECT *, {rest('y', 'y')} AS ryy, {rest('y', 'x1')} AS r1, {rest('y', 'x2')} AS r2, {rest('x1', 'x1')} AS r11, {rest('x1', 'x2')} AS r12, {rest('x2', 'x2')} AS r22 FROM m WHERE n > 5),
      bs AS (SELECT *, r11 * r22 - r12 * r12 AS d, (r1 * r22 - r2 * r12) / (r11 * r22 - r12 * r12) AS b1, (r2 * r11 - r1 * r12) / (r11 * r22 - r12 * r12) AS b2, n - 5 AS dof FROM rs),
      us AS (SELECT *, ryy - (r1 * b1 + r2 * b2) AS u FROM bs WHERE d > 0),
      fs AS (SELECT *, ((ryy - u) / 2) / (u / dof) AS f, b1 / sqrt(u / dof * r22 / d) AS t1, b2 / sqrt(u / dof * r11 / d) AS t2 FROM us WHERE u > 0),
      tested AS (SELECT *, pow(1 + 2 * f / dof, -dof / 2.0) AS p, {_student('t1', 'dof')} AS p1, {_student('t2', 'dof')} AS p2 FROM fs)"""


def _cell(a: str, c: str, names: list[str]) -> str:
    return f"{a}_{c}" if names.index(a) <= names.index(c) else f"{c}_{a}"


def sweep(table: str, names: list[str], pivots: list[str], keys: str, out: str) -> str:
    """CTEs that sweep the cells of the symmetric matrices in table by each pivot; the last is called out.

    A swept pair of rows then holds coefficients, the rest what is left, the pivots the negative inverse.
    """
    steps, last = [], table
    for n, k in enumerate(pivots):
        cell = lambda a, c: _cell(a, c, names)
        d, cols = cell(k, k), []
        for i, a in enumerate(names):
            for c in names[i:]:
                if a == c == k:
                    value = f"-1 / {d}"
                elif k in (a, c):
                    value = f"{cell(a, c)} / {d}"
                else:
                    value = f"{cell(a, c)} - {cell(a, k)} * {cell(c, k)} / {d}"
                cols.append(f"{value} AS {a}_{c}")
        name = out if n == len(pivots) - 1 else f"{out}_{n}"
        steps.append(f"{name} AS (SELECT {keys}, {', '.join(cols)} FROM {last})")
        last = name
    return ", ".join(steps)


def _any_order(source: str, most: int) -> str:
    """CTEs from a panel to `lag_tests`: a row per pair and lag."""
    lags = range(1, most + 1)
    names = ["y", *[f"y{k}" for k in lags], *[f"x{k}" for k in lags]]
    moments = ", ".join(f"covar_pop({a}, {c}) AS {a}_{c}" for i, a in enumerate(names) for c in names[i:])
    shifted = ", ".join(f"lag(value, {k}) OVER w AS l{k}" for k in lags)
    sides = ", ".join([*[f"p.l{k} AS y{k}" for k in lags], *[f"q.l{k} AS x{k}" for k in lags]])
    each = " UNION ALL ".join(
        f"SELECT traj_id, source, target, {k}::BIGINT AS lag, n, dof, y_x{k} AS score, y_x{k} / sqrt(-x{k}_x{k} * y_y / dof) AS t, (r0 - y_y) / {most} / (y_y / dof) AS joint_statistic FROM full_fit" for k in lags)
    key = "traj_id, source, target, n, dof"
    return f"""shifted AS (SELECT *, {shifted} FROM {source} WINDOW w AS (PARTITION BY traj_id, variable ORDER BY t)),
      met AS (SELECT p.traj_id, q.variable AS source, p.variable AS target, p.value AS y, {sides} FROM shifted p JOIN shifted q ON p.traj_id = q.traj_id AND p.t = q.t AND p.variable <> q.variable WHERE p.l{most} IS NOT NULL AND q.l{most} IS NOT NULL),
      cells AS (SELECT traj_id, source, target, count(*) AS n, count(*) - {2 * most + 1} AS dof, {moments} FROM met GROUP BY ALL HAVING count(*) > {2 * most + 1}),
      {sweep('cells', names, [f'y{k}' for k in lags], key, 'own_fit')}, with_own AS (SELECT *, y_y AS r0 FROM own_fit),
      {sweep('with_own', names, [f'x{k}' for k in lags], key + ', r0', 'full_fit')},
      lag_tests AS (SELECT *, {_student('t', 'dof')} AS p_value FROM ({each}))"""


#: Combined p-value of a group with k values and the sum l of their negative logarithms.
_FISHER = "least(1.0, greatest(0.0, list_sum(list_transform(range(0, k), lambda i: exp(-l + CASE WHEN i = 0 THEN 0 ELSE i * ln(greatest(l, 1e-300)) END - lgamma(i + 1.0))))))"


def _index(panel: str = "ev") -> str:
    """SQL of the bootstrap index over all steps of a panel, from the same hash."""
    starts = f"('0x' || substr(md5('42:' || run_id || ':' || block), 1, 12))::BIGINT % (steps - size + 1)"
    return f"""SELECT run_id, block * size + i AS new_t, {starts} + i AS t FROM (SELECT max(t) + 1 AS steps, least({BLOCK}, max(t) + 1) AS size FROM {panel}), (SELECT unnest(range(1, {SAMPLES + 1})) AS run_id),
      LATERAL (SELECT unnest(range(0, (steps + size - 1) // size)) AS block), LATERAL (SELECT unnest(range(0, size)) AS i) WHERE block * size + i < steps"""


_EDGE_ROWS = """SELECT {keys}, source, target, 1 AS lag, b1 AS score, p1 AS p_value, p AS joint_p_value, f AS joint_statistic FROM tested WHERE p <= {alpha} AND p1 <= {alpha}
      UNION ALL SELECT {keys}, source, target, 2, b2, p2, p, f FROM tested WHERE p <= {alpha} AND p2 <= {alpha}"""
_SEGMENT = """sized AS (SELECT *, count(*) OVER (PARTITION BY traj_id, variable) AS size, row_number() OVER (PARTITION BY traj_id, variable ORDER BY t) - 1 AS i FROM {p}),
      k AS (SELECT *, greatest(least({count}, size // {least}), 1) AS k FROM sized),
      segmented AS (SELECT traj_id, t, variable, value, (CASE WHEN i < (size % k) * (size // k + 1) THEN i // (size // k + 1) ELSE size % k + (i - (size % k) * (size // k + 1)) // (size // k) END)::BIGINT AS segment FROM k)"""


def oracle_sql() -> dict[str, str]:
    c = b.ctes
    z = lambda p, eps="0": _Z.format(p=p, eps=eps)
    wide = ", ".join(f"round(max(CASE WHEN variable = '{v}' THEN value END), 6) + 0.0 AS {v}" for v in b.EVENTS)
    lagged = ", ".join(f"round(max(CASE WHEN variable = '{v}' THEN l{k} END), 6) + 0.0 AS {v}__lag_{k}" for k in (1, 2) for v in b.EVENTS)
    return {
        "q01_panel_wide": f"WITH {c('ev')} SELECT t, {wide} FROM ev GROUP BY t",
        "q02_panel_densified": f"WITH {c('ord')} SELECT traj_id, t, variable, {_r('value')} FROM ord",
        "q03_zscore": f"WITH {c('ev')}, z AS ({z('ev')}) SELECT traj_id, t, variable, {_r('value')} FROM z",
        "q04_standardize_trajectories": f"WITH {c('traj')}, z AS ({z('traj', '1e-12')}) SELECT traj_id, t, variable, {_r('value')} FROM z",
        "q05_diff_order2": f"WITH {c('ev')}, d AS (SELECT traj_id, t, variable, value - 2 * lag(value, 1) {_W} + lag(value, 2) {_W} AS value FROM ev) SELECT traj_id, t, variable, {_r('value')} FROM d WHERE value IS NOT NULL",
        "q06_lag_design_long": f"WITH {c('ev')}, l AS (SELECT traj_id, t, variable, unnest([0, 1, 2])::BIGINT AS lag, unnest([value, lag(value, 1) {_W}, lag(value, 2) {_W}]) AS value FROM ev) SELECT traj_id, t, variable, lag, {_r('value')} FROM l WHERE value IS NOT NULL",
        "q07_target_dataset_wide": f"WITH {c('ev')}, l AS (SELECT *, lag(value, 1) {_W} AS l1, lag(value, 2) {_W} AS l2 FROM ev) SELECT traj_id, t, round(max(CASE WHEN variable = 'purchase' THEN value END), 6) + 0.0 AS y, {lagged} FROM l WHERE l2 IS NOT NULL GROUP BY traj_id, t HAVING count(*) = 5",
        "q08_segments": f"WITH {c('ord')}, {_SEGMENT.format(p='ord', count=3, least=7)} SELECT traj_id, t, variable, {_r('value')}, segment FROM segmented",
        "q09_seasonal_residual": f"""WITH {c('ord')}, w AS (SELECT *, row_number() OVER s - 1 AS pos, (sum(value) OVER (PARTITION BY traj_id, variable ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - (lag(value, 6) OVER s + lead(value, 6) OVER s) / 2) / 12 AS trend FROM ord WINDOW s AS (PARTITION BY traj_id, variable ORDER BY t)),
          d AS (SELECT *, pos % 12 AS phase FROM w WHERE trend IS NOT NULL), raw AS (SELECT traj_id, variable, phase, avg(value - trend) AS raw FROM d GROUP BY ALL),
          seasonal AS (SELECT *, raw - avg(raw) OVER (PARTITION BY traj_id, variable) AS seasonal FROM raw)
          SELECT traj_id, t, variable, {_r('trend', 'seasonal')}, round(value - trend - seasonal, 6) + 0.0 AS residual FROM d JOIN seasonal USING (traj_id, variable, phase)""",
        "q10_lagged_covariance": f"WITH {c('ev')}, z AS ({z('ev')}), l AS (SELECT traj_id, t, variable AS source, unnest([0, 1, 2])::BIGINT AS lag, unnest([value, lag(value, 1) {_W}, lag(value, 2) {_W}]) AS x FROM z) SELECT source, variable AS target, lag, count(*) AS n, round(covar_pop(x, value), 6) + 0.0 AS covariance FROM l JOIN z USING (traj_id, t) WHERE x IS NOT NULL GROUP BY ALL",
        "q11_pairwise_pearson": f"WITH {c('ev')} SELECT a.variable AS source, b.variable AS target, count(*) AS n, round(corr(a.value, b.value), 6) + 0.0 AS r FROM ev a JOIN ev b ON a.t = b.t AND a.variable < b.variable GROUP BY ALL",
        "q12_granger_joint": f"WITH {c('ev')}, z AS ({z('ev')}), {_granger('z')} SELECT traj_id, source, target, n, {_r('b1', 'b2', 'f', 'p', 't1', 'p1', 't2', 'p2')} FROM tested",
        "q13_granger_edges": f"WITH {c('ord')}, z AS ({z('ord')}), {_granger('z')}, e AS ({_EDGE_ROWS.format(keys='traj_id', alpha=0.5)}) SELECT traj_id, source, target, lag::BIGINT AS lag, {_r('score', 'p_value', 'joint_p_value', 'joint_statistic')} FROM e",
        "q14_granger_segmented": f"WITH {c('ord')}, z AS ({z('ord')}), {_SEGMENT.format(p='z', count=2, least=20)}, {_granger('segmented', 'traj_id, segment')}, e AS ({_EDGE_ROWS.format(keys='traj_id, segment', alpha=0.6)}) SELECT traj_id, segment, source, target, lag::BIGINT AS lag, {_r('score', 'p_value')} FROM e",
        "q64_granger_any_order": f"WITH {c('ord')}, z AS ({z('ord')}), {_any_order('z', 3)} SELECT traj_id, source, target, lag, n, {_r('score', 't', 'joint_statistic')}, dof, {_r('p_value')} FROM lag_tests",
        "q66_heterogeneous_granger": f"WITH {c('ord')}, z AS ({z('ord')}), {_SEGMENT.format(p='z', count=2, least=20)}, {_granger('segmented', 'traj_id, segment')}, e AS ({_EDGE_ROWS.format(keys='traj_id, segment', alpha=0.6)}), f AS (SELECT traj_id, source, target, lag, avg(score) AS score, count(p_value) AS k, sum(-ln(greatest(p_value, 1e-16))) AS l, count(DISTINCT segment) AS segment_votes, string_agg(segment::VARCHAR, ',' ORDER BY segment) AS segments FROM e GROUP BY ALL) SELECT traj_id, source, target, lag::BIGINT AS lag, {_r('score')}, round({_FISHER}, 6) + 0.0 AS p_value, segment_votes, segments, segment_votes / 2 + 0.0 AS support_ratio FROM f",
        "q15_block_bootstrap_sample": f"WITH {c('ev')}, i AS ({_index()}) SELECT run_id::BIGINT AS run_id, traj_id, new_t::BIGINT AS t, variable, {_r('value')} FROM ev JOIN i USING (t)",
        "q16_granger_bootstrap_runs": f"WITH {c('ev')}, z AS ({z('ev')}), i AS ({_index()}), s AS (SELECT run_id::BIGINT AS run_id, new_t AS t, variable, value FROM z JOIN i USING (t)), {_granger('s', 'run_id')} SELECT run_id, source, target, n, {_r('f', 'p')} FROM tested",
        "q32_predictive_gain_l1": f"""WITH {c('ev')}, z AS ({z('ev')}), l AS (SELECT *, lag(value, 1) {_W} AS l1 FROM z), k AS (SELECT *, row_number() {_W} - 1 AS i, count(*) OVER (PARTITION BY traj_id, variable) AS size FROM l WHERE l1 IS NOT NULL),
          p AS (SELECT a.traj_id, q.variable AS source, a.variable AS target, a.value AS y, a.l1 AS a, q.l1 AS b, a.i, a.size, s.split FROM k a JOIN k q ON a.traj_id = q.traj_id AND a.t = q.t AND a.variable <> q.variable CROSS JOIN (SELECT unnest([0, 1, 2]) AS split) s),
          r AS (SELECT *, greatest(6, floor(size * (0.5::DOUBLE + 0.3::DOUBLE * split / 2))) AS train FROM p), e AS (SELECT *, least(size, train + greatest(3, floor(size / 6))) AS stop FROM r), u AS (SELECT * FROM e WHERE i < stop),
          f AS (SELECT traj_id, source, target, split, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby, covar_pop(a, b) AS cab FROM u WHERE i < train GROUP BY ALL),
          g AS (SELECT *, n * cay / sa AS va, n * cby / sb AS vb, n * cab / (sa * sb) AS o, n + 1.0 AS h FROM f),
          t AS (SELECT u.traj_id, u.source, u.target, u.split, avg(pow((y - my) - va / h * (a - ma) / sa, 2)) AS e0, avg(pow((y - my) - (va * h - vb * o) / (h * h - o * o) * (a - ma) / sa - (vb * h - va * o) / (h * h - o * o) * (b - mb) / sb, 2)) AS e1
            FROM u JOIN g ON u.traj_id = g.traj_id AND u.source = g.source AND u.target = g.target AND u.split = g.split WHERE i >= train GROUP BY ALL)
          SELECT traj_id, source, target, split::BIGINT AS split, round((e0 - e1) / greatest(e0, 1e-12), 6) + 0.0 AS gain FROM t""",
    }


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "q" and name[1:3].isdigit()}
