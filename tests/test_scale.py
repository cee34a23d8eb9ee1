"""Rankings without absent rows, running totals without one task, shared greedy paths, and cached runs that grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.operators import calibration, metrics, panel, ranks, registry, selection, suite
from lagweave.plans import bindings, fusion_queries, study_queries
from lagweave.sources.checkpoints import RunCache, fingerprint

from . import plain


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("default", [0.0, 0.5, -1.0])
def test_absent_pairs_are_one_level(spark, by, default):
    rng = np.random.default_rng(2)
    nodes = [f"n{i}" for i in range(9)]
    rows = [(int(rng.integers(3)), *map(str, rng.choice(nodes + ["other"], 2, replace=False)), 1, float(rng.choice([0.0, 0.2, 0.5, 0.9, float("nan")]))) for _ in range(60)]
    edges = spark.createDataFrame(rows, "g int, source string, target string, lag int, edge_probability double")
    truth = spark.createDataFrame([("n0", "n1", 1), ("n3", "n2", 2), ("n1", "n0", 0), ("n5", "n5", 1), ("n7", "other", 1), ("n8", "n6", 3)], "source string, target string, lag int")
    key = lambda r: str(r.asDict().get("g"))
    whole = metrics.ranked(metrics.label(metrics.complete_pairs(edges, nodes, default=default, by=by), truth), by)
    got, want = (sorted(x.collect(), key=key) for x in (metrics.ranked_pairs(edges, truth, nodes, default=default, by=by), whole))
    assert len(got) == (3 if by else 1)
    for a, b in zip(got, want, strict=True):
        assert np.allclose([a.auroc, a.average_precision, a.prevalence], [b.auroc, b.average_precision, b.prevalence])
    none = metrics.ranked_pairs(edges.limit(0), truth, nodes, by=by).collect()
    assert not none if by else none[0].auroc == 0.5 and none[0].prevalence == 3 / 36


def test_totals_over_ranges(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), (F.col("id") % 11 - 5).alias("v")).withColumn("w", F.when(F.col("v") > 0, F.col("v")))
    got = ranks.accumulated(rows, [F.desc("k")], {"s": F.col("v"), "c": F.lit(1)}, {"m": F.col("w")}).orderBy(F.desc("k")).collect()
    v = [r.v for r in got]
    assert [r.s for r in got] == np.cumsum(v).tolist() and [r.c for r in got] == list(range(1, 501))
    assert [r.m for r in got] == [max((x for x in v[: i + 1] if x > 0), default=None) for i in range(500)]
    p = spark.createDataFrame([(str(i), float(x)) for i, x in enumerate(np.random.default_rng(0).random(40))], "test string, p_value double")
    alone = {r.test: r.holm_p for r in metrics.holm(p).collect()}
    grouped = {r.test: r.holm_p for r in metrics.holm(p.withColumn("g", F.lit(1)), ["g"]).collect()}
    assert alone == grouped and max(alone.values()) <= 1


def test_folds_share_paths(spark):
    """Each fold's path and means equal those of a plain greedy search without its trajectory."""
    rng = np.random.default_rng(6)
    names, tables, rows = ["a", "b", "c", "d"], {}, []
    for k in range(5):
        y = rng.integers(0, 2, 12)
        y[:2] = 0, 1
        x = np.round(y[:, None] * rng.uniform(0, 1, 4) + rng.random((12, 4)), 2)
        tables[k] = x, y
        rows += [(k, f"l{i:02d}", f"r{i:02d}", names[c], float(x[i, c]), int(y[i])) for i in range(12) for c in range(4)]
    scores = spark.createDataFrame(rows, "traj_id long, pair_lo string, pair_hi string, candidate string, score double, label int")
    got: dict = {}
    for r in calibration.cross_validated(scores, 4).collect():
        got.setdefault(r.fold, {})[r.step] = r
    assert got.keys() == {None, 0, 1, 2, 3, 4}
    for fold, steps in got.items():
        want = plain.greedy({k: t for k, t in tables.items() if k != fold}, names, 4)
        assert [steps[i].candidate for i in range(1, 5)] == [c for c, _ in want]
        assert np.allclose([steps[i].train_ap for i in range(1, 5)], [v for _, v in want])
        if fold is None:
            assert all(s.held_out_ap is None for s in steps.values())
        else:
            x, y = tables[fold]
            total = np.cumsum([x[:, names.index(c)] for c, _ in want], 0)
            assert np.allclose([steps[i].held_out_ap for i in range(1, 5)], [plain.average_precision(np.round(total[i - 1] / i, 12), y) for i in range(1, 5)])


def _counted(df):
    """df, and how many of its rows all jobs have made so far."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def batches(it):
        for batch in it:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(batches, df.schema), seen


def test_scores_of_a_path_are_made_once(spark):
    rows = [(t, "a", x, c, float(i == (c == "bad")), int(i == 0)) for t in range(3) for i, x in enumerate("bc") for c in ("bad", "good")]
    scores, seen = _counted(spark.createDataFrame(rows, "traj_id long, pair_lo string, pair_hi string, candidate string, score double, label int"))
    assert {r.candidate for r in calibration.cross_validated(scores, 2).collect()} == {"good"}
    assert seen.value == len(rows)


@pytest.mark.parametrize("query", [fusion_queries.q48_combine_candidates, fusion_queries.q50_greedy_path, study_queries.q88_size_summary, study_queries.q94_score_table_checks])
def test_candidates_read_the_edges_once(spark, monkeypatch, query):
    folder = "/root/testdata/sf0.001"
    edges, seen = _counted(bindings.edge_table(spark, folder))
    monkeypatch.setattr(bindings, "edge_table", lambda *_: edges)
    assert query(spark, folder).collect()
    assert seen.value == bindings.read(spark, folder, "orders").count()


@pytest.mark.parametrize("kind", ["exact", "tied", "many", "zero", "one"])
def test_signed_ranks_and_interval(spark, kind):
    rng = np.random.default_rng(3)
    d = {"exact": rng.normal(0.3, 1, 9), "tied": rng.integers(-2, 5, 30) / 2, "many": rng.normal(0.1, 1, 60), "zero": np.zeros(4), "one": np.array([0.5])}[kind]
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)], "trajectory_index int, difference double")
    got = metrics.superiority(rows, 400)
    assert abs(got["p_value"] - plain.wilcoxon(np.asarray(d, float))) < 1e-12
    means = np.array([r["mean"] for r in metrics.bootstrap_means(rows, 400).collect()])
    assert len(means) == 400 and np.allclose([got["ci_low"], got["ci_high"]], np.quantile(means, [0.025, 0.975]))
    assert abs(means.mean() - d.mean()) < 4 * d.std() / len(d) ** 0.5 / 20 + 1e-12 and abs(means.std() - d.std() / len(d) ** 0.5) < 0.2 * d.std() / len(d) ** 0.5 + 1e-12
    assert np.isclose(got["win_rate"], (d > 0).mean()) and np.isclose(got["tie_rate"], (d == 0).mean())
    assert got["effect_size"] == (0 if kind == "zero" else float("inf") if kind == "one" else pytest.approx(d.mean() / d.std(ddof=1)))


def test_runs_are_cut_replayed_and_extended(spark, tmp_path):
    made = []

    def make(first, last):
        made.append((first, last))
        return spark.range(first, last + 1).select(F.col("id").cast("int").alias("run_id"), F.lit("m").alias("method")).where("run_id <> 1")  # run 1 finds nothing

    cache = RunCache(spark, str(tmp_path), {"seed": 1})
    assert cache.count() == 0
    with pytest.raises(ValueError):
        cache.read(1)
    assert cache.extend(make, 3) == 3 and made == [(0, 2)]
    assert cache.extend(make, 2) == 2 and made == [(0, 2)]  # cut: nothing is made
    assert {r.run_id for r in cache.read(2).collect()} == {0}
    spark.range(1).withColumn("run_id", F.lit(77)).write.parquet(f"{cache.folder}/00000003-broken")  # a wave that was broken off
    again = RunCache(spark, str(tmp_path), {"seed": 1})
    assert again.extend(make, 8, 2) == 8 and made == [(0, 2), (3, 4), (5, 6), (7, 7)]
    assert sorted(r.run_id for r in again.read(8).collect()) == [0, 2, 3, 4, 5, 6, 7]
    assert RunCache(spark, str(tmp_path), {"seed": 2}).count() == 0
    with pytest.raises(ValueError):
        again.commit(make(9, 9), 9, 9)
    slow = RunCache(spark, str(tmp_path / "slow"), {})
    assert slow.extend(make, 9, 1, seconds=0.0) == 2  # the base run and one more


def test_samples_do_not_depend_on_how_many_there_are(spark):
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = panel.block_index(spark, 23, 6, 4, 7)
    assert rows(whole.where("run_id > 2")) == rows(panel.block_index(spark, 23, 6, 4, 7, 3))
    assert rows(whole.where("run_id <= 3")) == rows(panel.block_index(spark, 23, 3, 4, 7))
    assert not panel.block_index(spark, 23, 2, 4, 7, 3).collect()
    seen = [r.new_t for r in whole.where("run_id = 5").orderBy("new_t").collect()]
    assert seen == list(range(23))
    starts = {r.t for r in panel.block_index(spark, 23, 200, 4, 7).where("new_t % 4 = 0").collect()}
    assert starts == set(range(20))  # every start a block of four has


def _panel(spark, n=40):
    rng = np.random.default_rng(5)
    x = rng.normal(size=n)
    y = np.r_[0, 0.9 * x[:-1]] + 0.1 * rng.normal(size=n)
    return spark.createDataFrame([(0, t, v, float(s[t])) for v, s in (("a", x), ("b", y)) for t in range(n)], "traj_id long, t long, variable string, value double")


def _must_not_run(data, max_lag, names):
    raise AssertionError("a known run was fitted again")


EDGES = "run_id int, method string, source string, target string, lag int, score double, p_value double"


def test_known_runs_are_not_fitted(spark):
    known = spark.createDataFrame([(r, m, "a", "b", 1, s, p) for r in range(4) for m, s, p in (("A", 1.0, 0.01), ("B", 0.8, 0.02))], EDGES)
    specs = {k: registry.MethodSpec(k, _must_not_run) for k in "AB"}
    found = selection.select_robust(_panel(spark), specs, 1, bootstraps=1, least=2, most=2, known=(known, 3))
    assert found["bootstraps"] == 1 and {r.run_id for r in found["edges"].collect()} == {0, 1}
    assert found["ranking"].first().combination == "A + B"
    assert selection.select_robust(_panel(spark), specs, 1, bootstraps=3, least=2, most=2, known=(known, 3))["bootstraps"] == 3


def test_known_and_cached_runs_are_extended(spark, tmp_path):
    """Extending gives what a whole fit gives; a cache is shared by calls that ask for more, or fewer, runs."""
    log = tmp_path / "calls"
    log.mkdir()

    def method(data, max_lag, names):
        import uuid

        (log / uuid.uuid4().hex).touch()
        return [{"source": "a", "target": "b", "lag": 1, "score": float(data[:, 0].sum()), "p_value": 0.01}]

    obs, specs = _panel(spark), {k: registry.MethodSpec(k, method) for k in "AB"}
    calls = lambda: len(list(log.iterdir()))
    score = lambda found: sorted((r.run_id, r.method, round(r.score, 9)) for r in found["edges"].collect())
    whole = selection.select_robust(obs, specs, 1, bootstraps=3, least=2, most=2)
    assert calls() == 8 and whole["bootstraps"] == 3
    start = whole["edges"].where("run_id <= 1")
    more = selection.select_robust(obs, specs, 1, bootstraps=3, least=2, most=2, known=(start, 1))
    assert calls() == 12 and score(more) == score(whole)
    cached = [selection.select_robust(obs, specs, 1, bootstraps=k, least=2, most=2, cache=str(tmp_path / "runs"), wave=1) for k in (1, 3, 2)]
    assert calls() == 20 and score(cached[1]) == score(whole) and cached[2]["bootstraps"] == 2
    assert sorted(r[0] for r in cached[2]["edges"].select("run_id").distinct().collect()) == [0, 1, 2]
    assert fingerprint(obs) == fingerprint(obs.repartition(3)) != fingerprint(obs.withColumn("value", F.col("value") + 1))
    assert suite.with_bootstraps(obs, 4, first=3).select("run_id").distinct().count() == 2
