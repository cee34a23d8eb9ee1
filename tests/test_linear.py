"""Solves as Column expressions against numpy, and what is built on them: gains, tests of any order, positions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.functions import linear
from lagweave.operators import granger, predictive, ranks


@pytest.mark.parametrize("size", [1, 2, 5])
def test_solves(spark, size):
    rng = np.random.default_rng(size)
    rows = []
    for k in range(20):
        x = rng.normal(size=(size + 3, size))
        if k % 4 == 3 and size > 1:
            x[:, 1] = 2 * x[:, 0]  # depends on the one before
        a, b = x.T @ x, x.T @ rng.normal(size=size + 3)
        rows.append(([float(a[i, j]) for i in range(size) for j in range(i + 1)], b.tolist()))
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").withColumn("l", linear.cholesky(F.col("a"), size))
    df = df.withColumn("y", linear.forward(F.col("l"), F.col("b"), size)).withColumns({"x": linear.backward(F.col("l"), F.col("y"), size), "e": linear.explained(F.col("y")), "d": linear.inverse_diagonal(F.col("l"), size, [size - 1])[0]})
    for k, r in enumerate(df.collect()):
        a = np.zeros((size, size))
        for i in range(size):
            for j in range(i + 1):
                a[i, j] = a[j, i] = r.a[linear.cell(i, j)]
        want = np.linalg.lstsq(a, r.b, rcond=1e-10)[0]
        assert np.isclose(r.e, np.dot(r.b, want))
        if k % 4 == 3 and size > 1:
            assert r.x[1] == 0 and np.allclose(a @ r.x, r.b)
        else:
            assert np.allclose(r.x, want) and np.isclose(r.d, np.linalg.inv(a)[-1, -1])


def ridge_error(x, y, train, end, alpha):
    mean, scale = x[:train].mean(0), x[:train].std(0)
    scale[scale < 1e-8] = 1.0
    a, b = (x - mean) / scale, y - y[:train].mean()
    beta = np.linalg.solve(a[:train].T @ a[:train] + alpha * np.eye(x.shape[1]), a[:train].T @ b[:train])
    return float(((b[train:end] - a[train:end] @ beta) ** 2).mean())


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(8)
    return {k: 3 + np.cumsum(rng.normal(size=(n, 4)), 0) * 0.3 + rng.normal(size=(n, 4)) for k, n in ((0, 90), (7, 41), (9, 13))}


@pytest.mark.parametrize(("parents", "count", "max_lag"), [(0, 3, 2), (1, 1, 1), (2, 5, 3), (5, 3, 2)])
def test_gains_equal_ridge_fits(spark, wide, parents, count, max_lag):
    rows = [(k, 100 + 5 * t, "abcd"[v], float(x[t, v])) for k, x in wide.items() for t in range(len(x)) for v in range(4)]
    obs = spark.createDataFrame(rows, "traj_id long, t long, variable string, value double")
    edges = [(g, s, t, lag, score) for g in (1, 2) for s, t, lag, score in (("a", "b", 1, 0.9), ("c", "b", 0, 0.8), ("d", "b", 2, 0.7), ("c", "b", 4, 0.99), ("b", "a", 1, 0.2), ("a", "a", 1, 0.5))][:-1]
    table = spark.createDataFrame(edges, "g int, source string, target string, lag int, ensemble_score double")
    got = {(r.g, r.traj_id, r.source, r.target, r.lag, r.split): r.gain for r in predictive.gains(obs, table, max_lag, count, 2.0, parents, ["g"]).collect()}
    want = {}
    for g, s, t, lag, _ in edges:
        if s == t or lag > max_lag:
            continue
        others = sorted({(-w, p, k) for h, p, q, k, w in edges if h == g and q == t and p not in (s, t) and k <= max_lag})[:parents]
        for traj, x in wide.items():
            n = len(x) - max_lag
            if n < 12:
                continue
            at = lambda v, k, x=x, n=n: x[max_lag - k : max_lag - k + n, "abcd".index(v)]
            own = np.column_stack([*[at(t, k) for k in range(1, max_lag + 1)], *[at(p, k) for _, p, k in others]])
            for split, train, end in predictive.splits(n, count):
                a, b = (ridge_error(m, at(t, 0), train, end, 2.0) for m in (own, np.column_stack([own, at(s, lag)])))
                want[g, traj, s, t, lag, split] = (a - b) / max(a, 1e-12)
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], list(want.values()), atol=1e-8)


def test_gains_of_odd_series(spark):
    """A value that is no number voids its edges only; constant, short and unknown series don't fail."""
    rng = np.random.default_rng(1)
    rows = [(0, t, v, float("nan") if (v, t) == ("c", 55) else 5.0 if v == "d" else float(rng.normal())) for t in range(60) for v in "abcd"] + [(1, t, v, 1.0 * t) for t in range(9) for v in "abcd"]
    obs = spark.createDataFrame(rows, "traj_id long, t long, variable string, value double")
    edges = spark.createDataFrame([(s, t, 1) for s, t in ("ab", "cb", "ac", "db", "bd", "xb", "bx")], "source string, target string, lag int")
    got = {(r.source, r.target): r.g for r in predictive.gains(obs, edges).groupBy("traj_id", "source", "target").agg(F.avg("gain").alias("g")).collect()}
    assert got.keys() == {("a", "b"), ("d", "b"), ("b", "d")}
    assert abs(got["d", "b"]) < 1e-9 and abs(got["b", "d"]) < 1e-9
    assert not predictive.gains(obs.limit(0), edges).collect() and not predictive.gains(obs, edges.limit(0)).collect()


def test_dependent_columns_have_no_coefficient(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    rows = [(0, t, v, float(s[t])) for v, s in (("a", x), ("b", 2 * x + 1), ("c", rng.normal(size=60))) for t in range(60)]
    got = {(r.source, r.target, r.lag): r for r in granger.tests_any_order(spark.createDataFrame(rows, "traj_id long, t long, variable string, value double"), 3).collect()}
    assert all(abs(got["a", "b", k].score) < 1e-6 and got["a", "b", k].p_value > 0.05 for k in (1, 2, 3))
    assert np.isfinite([r.score for r in got.values()]).all()


def test_positions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    for order, want in (([F.desc("k")], lambda r: 1000 - r.k), (["g", F.desc("k")], None)):
        got = sorted(ranks.placed(rows, order).collect(), key=lambda r: r.position)
        assert [r.position for r in got] == list(range(1, 1001))
        assert all(r.position == want(r) for r in got) if want else [(r.g, -r.k) for r in got] == sorted((r.g, -r.k) for r in got)
    assert ranks.placed(rows.limit(0), ["k"]).columns == ["k", "g", "position"]
    plan = ranks.placed(rows, ["k"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    per = ranks.placed(rows, ["k"], ["g"]).groupBy("g").agg(F.max("position").alias("m")).collect()
    assert {r.m for r in per} == {333, 334}
