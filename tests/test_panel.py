import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.operators import generators, granger, panel, predictive, suite
from lagweave.plans import panel_queries


@pytest.fixture(scope="module")
def obs(spark):
    return generators.panels(spark, 1, 250, 0.2, 13).persist()


def _array(obs):
    return obs.groupBy("t").pivot("variable", list("XYZ")).agg(F.first("value")).orderBy("t").toPandas()[list("XYZ")].to_numpy()


def test_generator_repeats_by_seed(spark):
    assert np.array_equal(generators.system(50, 0.1, 3), generators.system(50, 0.1, 3))
    assert generators.truth(spark).count() == 6


def test_zscore_within_trajectories(spark):
    x = spark.createDataFrame([(j, t, "a", float(t * (j + 1))) for j in (0, 1) for t in range(4)] + [(0, t, "c", 5.0) for t in range(4)], "traj_id long, t long, variable string, value double")
    got = panel.zscore(x).groupBy("traj_id", "variable").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()
    for r in got:
        assert abs(r.m) < 1e-12
        assert abs(r.s - (0 if r.variable == "c" else 1)) < 1e-12


def test_lags_do_not_wrap_or_cross(spark):
    x = spark.createDataFrame([(j, t, "a", 10.0 * j + t) for j in (0, 1) for t in range(3)], "traj_id long, t long, variable string, value double")
    rows = panel.lag_rows(x, 1).orderBy("traj_id", "t").collect()
    assert [(r.traj_id, r.t, r.value) for r in rows] == [(0, 1, 0.0), (0, 2, 1.0), (1, 1, 10.0), (1, 2, 11.0)]


def test_segments_differ_by_one_at_most(spark):
    x = spark.range(11).select(F.lit(0).cast("long").alias("traj_id"), F.col("id").alias("t"), F.lit("a").alias("variable"), F.rand().alias("value"))
    sizes = [r["count"] for r in panel.segments(x, 4, 2).groupBy("segment").count().orderBy("segment").collect()]
    assert sizes == [3, 3, 3, 2]
    assert panel.segments(x, 4, 6).select("segment").distinct().count() == 1


def test_complete_drops_steps_with_gaps(spark):
    x = spark.createDataFrame([(0, t, v, None if (t, v) == (1, "a") else float(t)) for t in range(5) for v in "ab"], "traj_id long, t long, variable string, value double")
    assert sorted({r.t for r in panel.complete(x).collect()}) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        panel.complete(x, 5)


def test_block_bootstrap_repeats(spark):
    rows = panel.block_index(spark, 10, 3, 4).orderBy("run_id", "new_t").collect()
    assert len(rows) == 30
    assert rows == panel.block_index(spark, 10, 3, 4).orderBy("run_id", "new_t").collect()
    for a, b in zip(rows, rows[1:]):
        if a.run_id == b.run_id and b.new_t % 4:
            assert b.t == a.t + 1


def test_granger_equals_least_squares(spark, obs):
    x = _array(obs)
    got = {(r.source, r.target): r for r in granger.tests(obs).collect()}
    y, n = x[2:], len(x) - 2
    past = {v: np.column_stack([x[1:-1, i], x[:-2, i]]) for i, v in enumerate("XYZ")}
    for (s, t), r in got.items():
        own = np.column_stack([np.ones(n), past[t]])
        full = np.column_stack([own, past[s]])
        rss = [float(np.linalg.lstsq(d, y[:, "XYZ".index(t)], rcond=None)[1][0]) for d in (own, full)]
        f = (rss[0] - rss[1]) / 2 / (rss[1] / (n - 5))
        beta = np.linalg.lstsq(full, y[:, "XYZ".index(t)], rcond=None)[0]
        assert abs(r.f - f) < 1e-6 * max(1, f)
        assert np.allclose([r.b1, r.b2], beta[3:], atol=1e-8)


def test_any_order_agrees_with_order_two(spark, obs):
    two = {(r.source, r.target, k): (r[f"b{k}"], r[f"p{k}"]) for r in granger.tests(obs).collect() for k in (1, 2)}
    for r in granger.tests_any_order(obs, 2).collect():
        assert np.allclose((r.score, r.p_value), two[r.source, r.target, r.lag], atol=1e-7)


def test_granger_recovers_lag_two(spark, obs):
    found = {(r.source, r.target, r.lag) for r in granger.edges(granger.tests(obs), 0.001).collect()}
    assert ("X", "Y", 2) in found


def test_splits_expand():
    assert predictive.splits(100, 3) == [(0, 50, 66), (1, 65, 81), (2, 80, 96)]
    assert predictive.splits(7, 3)[0] == (0, 6, 7)


def test_gain_of_a_cause_exceeds_that_of_noise(spark, obs):
    edges = spark.createDataFrame([("X", "Y", 2), ("Z", "X", 1)], "source string, target string, lag int")
    gain = {r.source: r.g for r in predictive.gains(obs, edges).groupBy("source").agg(F.avg("gain").alias("g")).collect()}
    assert gain["X"] > 0.2 > gain["Z"]


def test_noise_starts_at_index(spark, obs):
    late = generators.noise_from(obs, 200, 3.0, 1)
    d = late.alias("a").join(obs.alias("b"), ["traj_id", "t", "variable"]).select("t", (F.col("a.value") - F.col("b.value")).alias("d"))
    assert d.where("t < 200 AND d <> 0").count() == 0
    assert d.where("t >= 200 AND d <> 0").count() == 150


def test_segment_votes(spark):
    rows = spark.createDataFrame([(0, 0, "a", "b", 1, 1.0, 0.01), (0, 1, "a", "b", 1, 2.0, 0.02), (0, 0, "b", "a", 1, 1.0, 0.01)], "traj_id long, segment int, source string, target string, lag int, score double, p_value double")
    got = suite.segment_votes(rows, 4).collect()
    assert [(r.source, r.score, r.segments, r.support_ratio) for r in got] == [("a", 1.5, [0, 1], 0.5)]


def test_bootstrap_queries_sample_all_days(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1, 12)
    rows = [(start + dt.timedelta(days=d), v, float((d * d * 7919 + d * 31 + i * 104729) % 100003)) for d in range(45) for i, v in enumerate(("click", "view"))]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = panel_queries.q15_block_bootstrap_sample(spark, str(tmp_path)).collect()
    assert {(r.run_id, r.t, r.variable) for r in got} == {(k, t, v) for k in range(1, 6) for t in range(45) for v in ("click", "view")}
    assert {(v, x) for ts, v, x in rows if ts >= start + dt.timedelta(days=30)} & {(r.variable, r.value) for r in got}
    assert {r.n for r in panel_queries.q16_granger_bootstrap_runs(spark, str(tmp_path)).collect()} == {43}
