"""Checks, calibration, baselines and the whole selection of a study against small cases worked out by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagweave.operators import calibration, consensus, generators, metrics, panel, plotdata, predictive, registry, selection, structure, suite
from lagweave.sources import checkpoints, datasets

from . import plain

SCORES = "traj_id long, pair_lo string, pair_hi string, candidate string, score double, label int"


def scores(spark, change=()):
    """Two trajectories of three pairs; candidate good ranks the true pair first, bad ranks it last."""
    rows = {}
    for t in (0, 1, 2):
        for i, (lo, hi) in enumerate((("a", "b"), ("a", "c"), ("b", "c"))):
            for name, value in (("bad", float(i)), ("good", 2.0 - i)):
                rows[t, lo, hi, name] = (t, lo, hi, name, value, int(i == 0))
    for key, row in change:
        if row is None:
            rows.pop(key)
        else:
            rows[key] = row
    return spark.createDataFrame(list(rows.values()), SCORES)


def test_score_tables_are_checked(spark):
    assert calibration.validate(scores(spark)).count() == 18
    key = (0, "a", "b", "good")
    for change in ([(key, None)], [(key, (*key, float("nan"), 1))], [(key, (*key, 1.0, 2))], [((9, "x", "y", k), (9, "x", "y", k, 1.0, 1)) for k in ("good", "bad")]):
        with pytest.raises(ValueError):
            calibration.validate(scores(spark, change))
    with pytest.raises(ValueError):
        calibration.validate(scores(spark).limit(0))
    with pytest.raises(ValueError):
        calibration.validate(scores(spark).union(scores(spark).limit(1)))


def test_cross_validated_fit(spark):
    found = calibration.fit_cross_validated(scores(spark), 3)
    assert found["member_count"] == 1 and found["path"] == ["good"] and found["weights"] == {"good": 1.0}
    assert [r.member_count for r in found["summary"].orderBy("position").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        calibration.fit_cross_validated(scores(spark).where("traj_id = 0"), 2)


def test_calibrated_edges_keep_their_old_score(spark):
    chosen = calibration.apply_calibrated(scores(spark), {"good": 1.0, "bad": 0.0}, 1)
    summary = spark.createDataFrame([(0, "b", "a", 1, 0.3), (0, "b", "c", 2, 0.9), (0, "z", "a", 1, 0.5)], "traj_id long, source string, target string, lag int, ensemble_score double")
    by = {(r.source, r.target): r for r in calibration.calibrated_summary(summary, chosen).collect()}
    assert by["b", "a"].ensemble_score == 2.0 and by["b", "a"].pre_calibration_ensemble_score == 0.3 and by["b", "a"].ensemble_selected
    assert not by["b", "c"].ensemble_selected and by["z", "a"].ensemble_score == 0.0
    assert calibration.apply_calibrated(scores(spark), {"good": 1.0}, 99).where("ensemble_selected").count() == 9
    assert calibration.apply_calibrated(scores(spark), {"good": 1.0}, -1).where("ensemble_selected").count() == 0


def test_feasible_k(spark):
    by_k = spark.createDataFrame([(1, 1.0, 0.2, 0.33), (2, 0.9, 0.5, 0.6), (3, 0.7, 0.9, 0.6)], "k int, precision double, recall double, f1 double")
    assert [r.k for r in calibration.feasible_k(by_k, {"precision": 0.9}).orderBy("position").collect()] == [2, 1]
    assert [r.k for r in calibration.feasible_k(by_k, {"recall": 0.99}, 3).collect()] == [3]
    with pytest.raises(ValueError):
        calibration.feasible_k(by_k, {"recall": 0.99})


def test_pairs_that_cannot_be_ranked(spark):
    kind = "pair_lo string, pair_hi string, score double, label int"
    good = [("a", "b", 0.9, 1), ("a", "c", 0.1, 0)]
    assert metrics.ranked_checked(spark.createDataFrame(good, kind)).first().auroc == 1.0
    for extra in ([("b", "a", 0.3, 0)], [("c", "c", 0.3, 0)], [("b", "c", float("inf"), 0)]):
        with pytest.raises(ValueError):
            metrics.ranked_checked(spark.createDataFrame(good + extra, kind))
    with pytest.raises(ValueError):
        metrics.ranked_checked(spark.createDataFrame(good[:1], kind))


def test_baselines(spark):
    truth = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("c", "d", 0), ("d", "d", 1)], "source string, target string, lag int")
    keys = spark.range(6).select(F.col("id").alias("key"))
    rows = metrics.baselines(keys, list("abcd"), truth)
    count = {(r.strategy, r.key): r["count"] for r in rows.groupBy("strategy", "key").count().collect()}
    assert all(count["ALL_PAIRS", k] == 6 and count["RANDOM_DENSITY", k] == 2 for k in range(6))
    assert rows.where("strategy = 'RANDOM_DENSITY'").exceptAll(metrics.baselines(keys, list("abcd"), truth).where("strategy = 'RANDOM_DENSITY'")).count() == 0
    judged = {(r.strategy, r.key): r for r in metrics.skeleton(rows, truth, nodes=4, by=["strategy", "key"]).collect()}
    assert judged["ALL_PAIRS", 0].recall == 1.0 and abs(judged["ALL_PAIRS", 0].precision - 1 / 3) < 1e-12


def test_objectives_agree(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    pairs = [("a", "b"), ("d", "c"), ("x", "y")]
    listed = spark.createDataFrame(pairs, "source string, target string")
    for objective, s, t in (("full_structure", None, None), ("causes_of_target", None, "b"), ("effects_of_source", "c", None), ("compare_directions", "a", "d"), ("compare_directions", "a", "a"), ("specific_relations", None, None)):
        got = {tuple(r) for r in structure.relation_rows(nodes, objective, s, t, listed).collect()}
        assert got == set(plain.relations("abcd", objective, s, t, pairs))
    with pytest.raises(ValueError):
        structure.relation_rows(nodes, "other")


def test_gains_meet_at_equal_steps(spark):
    """A step that one series lacks shifts nothing; a strong second parent takes the gain of a variable that only echoes it."""
    rng = np.random.default_rng(3)
    n = 220
    x, e = rng.normal(size=n), 0.1 * rng.normal(size=n)
    y = np.r_[0, 0.9 * x[:-1]] + e
    z = x + 0.02 * rng.normal(size=n)
    rows = [(0, t, v, float(s[t])) for v, s in (("x", x), ("y", y), ("z", z)) for t in range(n) if (v, t) != ("z", 9)]
    obs = spark.createDataFrame(rows, "traj_id long, t long, variable string, value double")
    edges = spark.createDataFrame([("x", "y", 1, 0.9), ("z", "y", 1, 0.8), ("y", "x", 1, 0.1)], "source string, target string, lag int, ensemble_score double")
    mean = lambda rows: {(r.source, r.target): r.g for r in rows.groupBy("source", "target").agg(F.avg("gain").alias("g")).collect()}
    alone, given = mean(predictive.gains(obs, edges)), mean(predictive.gains(obs, edges, parents=1))
    assert alone["x", "y"] > 0.8 and alone["z", "y"] > 0.8 and alone["y", "x"] < 0.1
    assert given["z", "y"] < 0.5 * alone["z", "y"]


def test_detrended_series(spark):
    rows = [(0, t, "v", 10 + 0.5 * t + (3.0 if t % 4 == 0 else -1.0)) for t in range(40)] + [(0, t, "short", float(t)) for t in range(5)]
    obs = spark.createDataFrame(rows, "traj_id long, t long, variable string, value double")
    got = {(r.variable, r.t): r.value for r in panel.detrended(obs, 4).collect()}
    assert all(abs(got["v", t]) < 1e-9 for t in range(40)) and all(got["short", t] == t for t in range(5))
    product = spark.createDataFrame([(0, t, "v", (10 + 0.5 * t) * (2.0 if t % 2 else 1.0)) for t in range(60)], obs.schema)
    assert all(abs(r.value - 1) < 0.1 for r in panel.detrended(product, 2, "multiplicative").collect())
    negative = obs.withColumn("value", -F.col("value"))
    assert panel.detrended(negative, 4, "multiplicative").exceptAll(negative.select("traj_id", "t", "variable", "value")).count() == 0


def test_whole_selection(spark):
    """From a panel to the best combination: its parts equal the steps done one by one."""
    s = generators.system(160, 0.2, 13)
    obs = spark.createDataFrame([(0, t, v, float(s[t, i])) for t in range(160) for i, v in enumerate("XYZ")], "traj_id long, t long, variable string, value double")
    specs = {k: v for k, v in registry.discover().items() if k in ("PCMCI", "ClassicalGranger", "GES")}
    found = selection.select_robust(panel.zscore(obs), specs, 2, 2, 2, 2, ["PCMCI"], density=0.7, predictive_weight=0.5, parents=1)
    ranking = found["ranking"].orderBy("position").collect()
    assert len(ranking) == 3 and ranking[0].performance_score == max(r.performance_score for r in ranking)
    best = found["best"].collect()
    assert {r.combo_id for r in best} == {ranking[0].combo_id}
    assert {("Y", "Z", 1), ("X", "Y", 2)} <= {(r.source, r.target, r.lag) for r in best}
    assert "pre_validation_ensemble_score" in found["summary"].columns
    with pytest.raises(ValueError):
        selection.select_robust(obs.union(obs.withColumn("traj_id", F.lit(1).cast("long"))), specs, 2)


def test_votes_alone(spark):
    edges = spark.createDataFrame([(r, m, "a", "b", 1) for r in range(4) for m in ("p", "q")] + [(1, "p", "b", "c", 0), (2, "p", "c", "c", 0)], "run_id int, method string, source string, target string, lag int")
    rows = {r.source: r for r in consensus.vote_stability(edges, 2, 3).collect()}
    assert rows["a"].stability_selected and rows["a"].mean_support == 1.0 and rows["b"].selection_frequency == 1 / 3 and "c" not in rows
    hard = spark.createDataFrame([("a", "b", None)], "source string, target string, lag int")
    assert {r.source for r in consensus.vote_stability(edges, 2, 3, forbidden=hard).collect()} == {"b"}
    with pytest.raises(ValueError):
        consensus.vote_stability(edges, 2, 0)


def test_waves_stop_in_time(spark, tmp_path):
    rows = [(r, 0, t, v, float((t * 7 + i + r) % 5)) for r in range(3) for t in range(12) for i, v in enumerate("ab")]
    obs = spark.createDataFrame(rows, "run_id int, traj_id long, t long, variable string, value double")
    one = registry.MethodSpec("One", lambda data, max_lag, names: [{"source": "a", "target": "b", "lag": 1, "score": 1.0, "p_value": None}])
    runs = lambda df: {r.run_id for r in df.collect()}
    assert runs(suite.fit_in_waves(obs, {"One": one}, 1, 0.0, 1, f"{tmp_path}/a")) == {0}
    assert runs(suite.fit_in_waves(obs, {"One": one}, 1, 1e6, 2, f"{tmp_path}/b")) == {0, 1, 2}


def test_self_loops(spark):
    summary = spark.createDataFrame([("a", "a", 1, 0.5, 0.5, "odd"), ("a", "b", 1, 0.5, 0.5, "positive")], "source string, target string, lag int, edge_probability double, confidence double, sign_consensus string")
    rows = plotdata.circular(summary, ["a", "b"])
    assert {r.text for r in rows.collect()} == {f"sign={s}<br>positive_votes=0<br>negative_votes=0<br>sign_agreement=n/a" for s in ("unknown", "positive")}
    arc = plotdata.self_loops(rows).collect()
    assert len(arc) == 24 and all(r.x > 0.99 for r in arc)


def test_climate_and_tensor(spark, tmp_path):
    pd.DataFrame({"date": ["2013-01-02", "2013-01-01"], "meantemp": [7.4, 10.0]}).to_csv(tmp_path / "c.csv", index=False)
    assert [r.meantemp for r in datasets.load_daily_climate(spark, f"{tmp_path}/c.csv").trajectory(0).collect()] == [10.0, 7.4]
    tensor = np.arange(2 * 3 * 4, dtype=float).reshape(2, 3, 4)
    np.save(tmp_path / "data.npy", tensor)
    np.save(tmp_path / "graph.npy", np.eye(3))
    rows = datasets.load(spark, f"{tmp_path}/data.npy").observations.collect()
    assert {(r.traj_id, r.t, r.variable, r.value) for r in rows} == {(i, t, f"variable_{v:02d}", tensor[i, t, v]) for i in range(2) for t in range(3) for v in range(3)}


def test_shared_folder_is_asked_for(spark):
    assert checkpoints.shared_folder(spark) != checkpoints.shared_folder(spark)
