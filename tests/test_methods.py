import inspect

import numpy as np
import pytest

from lagweave.methods import classical_granger, dynotears, fci, ges, lpcmci, mlp_heuristic, neural_granger, pcmci, score_based, var_lingam
from lagweave.methods._tools import t_two_sided
from lagweave.operators import generators, preprocess, registry, suite

NAMES = list("XYZ")


@pytest.fixture(scope="module")
def x():
    return generators.system(500, 0.2, 13)


def _links(records):
    return {(r["source"], r["target"], r["lag"]) for r in records}


def test_t_tail():
    for nu, t, p in ((3, 3.182446, 0.05), (4, 2.776445, 0.05), (24, 2.063899, 0.05), (115, 1.980808, 0.05)):
        assert abs(t_two_sided(t, nu) - p) < 1e-5


def test_f_tail():
    assert abs(classical_granger.f_upper(3.0, 2, 50) - (1 + 6 / 50) ** -25) < 1e-10
    assert abs(classical_granger.f_upper(1.0, 7, 7) - 0.5) < 1e-9


def test_pcmci_finds_the_system(x):
    found = _links(pcmci.run_pcmci(x, 2, NAMES, alpha=1e-4))
    assert found >= set(generators.TRUTH) and len(found) <= 7
    assert pcmci.run_pcmci(x, 0, NAMES) == []


def test_granger_self_links(x):
    assert ("X", "X", 1) in _links(classical_granger.run_classical_granger(x, 2, NAMES, include_self_links=True))
    assert ("X", "X", 1) not in _links(classical_granger.run_classical_granger(x, 2, NAMES))


def test_bic_reports_no_p_value(x):
    found = score_based.run_score_based_bic(x, 2, NAMES)
    assert {("X", "Y", 2), ("Y", "Z", 1)} <= _links(found)
    assert all(r["p_value"] is None for r in found)


def test_dynotears_finds_strong_lags(x):
    assert {("Y", "Z", 1), ("X", "Y", 2)} <= _links(dynotears.run_dynotears(x, 2, NAMES))
    assert np.allclose(dynotears.expm(np.diag([1.0, 2.0])), np.diag(np.exp([1.0, 2.0])))


def test_lingam_orders_uniform_noise():
    rng = np.random.default_rng(0)
    a = rng.uniform(-1, 1, 2000)
    b = 0.8 * a + rng.uniform(-1, 1, 2000)
    assert var_lingam.causal_order(np.column_stack([b, a])) == [1, 0]


def test_lingam_lags(x):
    found = {(r["source"], r["target"], r["lag"]): r["score"] for r in var_lingam.run_var_lingam(x, 2, NAMES)}
    assert abs(found["X", "Y", 2] - 0.8) < 0.2


def test_prox_zeroes_a_group():
    w = np.full((2, 2, 2), 0.1)
    w[:, 1] = 5.0
    for kind in ("GL", "GSGL", "H"):
        out = neural_granger.prox(w, 1.0, kind)
        assert not out[:, 0].any()
        assert out[:, 1].any()


def test_neural_records(x):
    found = neural_granger.run_neural_granger(x[:150], 2, NAMES, max_iter=50)
    assert all(1 <= r["lag"] <= 2 and r["p_value"] is None for r in found)


def test_registry_names_and_errors():
    assert registry.discover().keys() >= {"PCMCI", "LPCMCI", "ClassicalGranger", "VARLiNGAM", "DYNOTEARS", "NeuralGrangercMLP", "GES", "FCI"}
    assert registry.default_name("run_my_method") == "MyMethod"
    with pytest.raises(TypeError):
        registry.causal_method("Bad")(lambda data: [])
    with pytest.raises(ValueError):
        registry.causal_method("Bad", default_kwargs={"max_lag": 1})(lambda data, max_lag: [])
    assert dict(registry.discover()["DYNOTEARS"].default_kwargs) == {"max_iter": 50}
    assert registry.default_name("run_local_PC") == "LocalPC"
    with pytest.raises(TypeError):
        registry.discover()["DYNOTEARS"].default_kwargs["max_iter"] = 1


def test_spec_table(spark):
    rows = {r.method: r for r in registry.spec_table(spark).collect()}
    assert rows["DYNOTEARS"].options == '{"max_iter": 50}' and all(r.weight >= 0 for r in rows.values())


def test_fits_are_checked(spark):
    """A method whose edges break the contract fails the fit, by name."""
    obs = spark.createDataFrame([(0, 0, t, v, float(t % 3)) for t in range(8) for v in "ab"], "run_id int, traj_id long, t long, variable string, value double")
    good = {"source": "a", "target": "b", "lag": 1, "score": 1.0, "p_value": None}
    for bad in ({"source": "zz"}, {"lag": -1}, {"lag": 0.5}, {"score": float("nan")}, {"p_value": 2.0}):
        spec = registry.MethodSpec("Odd", lambda data, max_lag, names, bad=bad: [{**good, **bad}])
        with pytest.raises(Exception, match="Odd"):
            suite.fit_grid(obs, {"Odd": spec}, 1).collect()
    assert suite.fit_grid(obs, {"Odd": registry.MethodSpec("Odd", lambda data, max_lag, names: [good])}, 1).count() == 1


def test_validation(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "source string, target string, lag double, score double, p_value double, method string")
    ok = registry.validate(rows(("a", "b", 1.0, 0.5, 0.1, "m")), ["a", "b"], "M").first()
    assert (ok.lag, ok.method) == (1, "M")
    assert registry.validate(rows(("a", "b", 1.0, 0.5, None, "m")).limit(0), ["a"], "M").count() == 0
    for bad in (("a", "b", -1.0, 0.5, 0.1, "m"), ("a", "b", 1.5, 0.5, 0.1, "m"), ("a", "b", 1.0, float("nan"), 0.1, "m"), ("a", "b", 1.0, 0.5, 1.1, "m"), ("a", "q", 1.0, 0.5, 0.1, "m"), (" ", "b", 1.0, 0.5, 0.1, "m")):
        with pytest.raises(registry.MethodOutputError, match="M:"):
            registry.validate(rows(bad), ["a", "b"], "M")


def test_grid_and_panel(spark):
    obs = generators.panels(spark, 2, 200, 0.2, 5)
    specs = {k: v for k, v in registry.discover().items() if k in ("PCMCI", "ClassicalGranger")}
    got = suite.fit_grid(suite.with_bootstraps(obs, 1), specs, 2)
    assert {(r.traj_id, r.run_id, r.method) for r in got.select("traj_id", "run_id", "method").distinct().collect()} == {(j, r, m) for j in (0, 1) for r in (0, 1) for m in specs}
    pairs = suite.panel_pcmci(obs, 1).collect()
    assert {(r.source, r.target) for r in pairs} == {("X", "Y"), ("X", "Z"), ("Y", "Z")}


def test_ges_recovers_a_collider_and_the_lags(x):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 3000))
    c = a + b + 0.3 * rng.normal(size=3000)
    g, _ = ges.search(np.cov(np.column_stack([a, b, c]), rowvar=False), 3000, 3, 1.0, np.zeros((3, 3), bool))
    assert g.tolist() == [[0, 0, 1], [0, 0, 1], [0, 0, 0]]
    found = _links(ges.run_ges(x, 2, NAMES))
    assert {("X", "Y", 2), ("Y", "Z", 1)} <= found and all(lag >= 1 for *_, lag in found)


def test_adf_tells_walks_from_noise():
    rng = np.random.default_rng(3)
    e = rng.normal(size=400)
    assert preprocess.adf_p(e) < 0.01 < 0.1 < preprocess.adf_p(np.cumsum(e))
    assert preprocess.adf_p(np.ones(50)) == 1.0 == preprocess.adf_p(e[:4])


def test_preprocessor_differences_walks(spark):
    rng = np.random.default_rng(4)
    walk, noise = np.cumsum(rng.normal(size=300)), rng.normal(size=300)
    obs = spark.createDataFrame([(0, t, v, float(s[t])) for v, s in (("w", walk), ("n", noise)) for t in range(300)], "traj_id long, t long, variable string, value double")
    p = preprocess.Preprocessor()
    out = p.fit_transform(obs)
    assert p.orders == {"w": 1, "n": 0} and out.count() == 598


def test_fci_separates_and_orients(x):
    rng = np.random.default_rng(2)
    a, b, e = rng.normal(size=(3, 4000))
    c = a + b + 0.5 * rng.normal(size=4000)
    d = c + 0.5 * e
    s = fci.Search(np.cov(np.column_stack([a, b, c, d]), rowvar=False), 4000, np.zeros(4, bool), 0.001, 3)
    m = s.run()
    assert m[0, 1] == fci.NONE and m[0, 3] == fci.NONE and m[0, 2] == fci.ARROW == m[1, 2]
    assert m[2, 3] == fci.ARROW and m[3, 2] == fci.TAIL
    every = _links(fci.run_fci(x, 2, NAMES, alpha=0.001, include_partial=True))
    assert {("X", "Y", 2), ("Y", "Z", 1)} <= every
    assert all(r["score"] == 1.0 for r in fci.run_fci(x, 2, NAMES))


def test_mlp_heuristic(x):
    found = _links(mlp_heuristic.run_mlp_permutation(x, 2, NAMES))
    assert {("X", "Y", 2), ("Y", "Z", 1)} <= found and all(lag in (1, 2) for *_, lag in found)


def test_fci_separates_by_sets_of_any_size():
    rng = np.random.default_rng(5)
    w = rng.normal(size=(20001, 1))
    z = 0.8 * np.vstack([[[0.0]], w[:-1]]) + rng.normal(size=(20001, 5))
    y = z.sum(1, keepdims=True) + rng.normal(size=(20001, 1))
    names = ["W", *"ABCDE", "Y"]
    found = lambda **kw: _links(fci.run_fci(np.hstack([w, z, y]), 1, names, alpha=1e-4, include_partial=True, **kw))
    assert {("W", v, 1) for v in "ABCDE"} <= found() and ("W", "Y", 1) not in found()
    assert ("W", "Y", 1) in found(depth=3)


def _marks(size, *edges):
    """A search with the marks of (i, mark at i, mark at j, j)."""
    s = fci.Search(np.eye(size), 100, np.zeros(size, bool), 0.05, -1)
    s.m[:] = fci.NONE
    for i, at_i, at_j, j in edges:
        s.m[j, i], s.m[i, j] = at_i, at_j
    return s


def test_fci_rule_9():
    o, to, tail = fci.CIRCLE, fci.ARROW, fci.TAIL
    s = _marks(4, (0, o, to, 3), (0, o, o, 1), (1, o, to, 2), (2, tail, to, 3))
    assert s._paths() and s.m[3, 0] == tail and s.m[0, 3] == to
    assert not s._paths()
    for other in ((1, o, o, 3), (0, o, o, 2)):  # the second node is next to the target, or the path isn't uncovered
        s = _marks(4, (0, o, to, 3), (0, o, o, 1), (1, o, to, 2), (2, tail, to, 3), other)
        assert not s._paths()
    s = _marks(4, (0, o, to, 3), (0, to, to, 1), (1, o, to, 2), (2, tail, to, 3))
    assert not s._paths()


def test_fci_rule_10():
    o, to, tail = fci.CIRCLE, fci.ARROW, fci.TAIL
    # 0 o-> 4 with parents 2 and 3 of 4, which paths by way of 1 and straight from 0 lead to
    s = _marks(5, (0, o, to, 4), (0, o, o, 1), (1, o, o, 2), (0, o, o, 3), (2, tail, to, 4), (3, tail, to, 4), (1, o, o, 4))
    assert s._paths() and s.m[4, 0] == tail
    s = _marks(5, (0, o, to, 4), (0, o, o, 1), (1, o, o, 2), (0, o, o, 3), (2, tail, to, 4), (3, tail, to, 4), (1, o, o, 4), (1, o, o, 3))
    assert not s._paths()
    s = _marks(5, (0, o, to, 4), (0, o, o, 1), (1, to, o, 2), (0, o, o, 3), (2, tail, to, 4), (3, tail, to, 4), (1, o, o, 4))
    assert not s._paths()


def test_mlp_heuristic_does_the_whole_job(x, monkeypatch):
    kinds = inspect.signature(mlp_heuristic.run_mlp_permutation).parameters
    assert {k: kinds[k].default for k in ("hidden", "repeats", "threshold")} == {"hidden": (64, 32), "repeats": 10, "threshold": 0.0}
    calls = []

    def linear(past, y, *_):
        w = np.linalg.lstsq(past, y, rcond=None)[0]
        return lambda q: calls.append(1) or q @ w

    monkeypatch.setattr(mlp_heuristic, "_train", linear)
    scores = [r["score"] for r in mlp_heuristic.run_mlp_permutation(x, 2, NAMES)]
    assert min(scores) > 0 and any(s <= 0.01 for s in scores)
    assert len(calls) == 3 * (1 + 6 * 10)


def test_mlp_fits_what_one_line_cannot():
    rng = np.random.default_rng(6)
    q = rng.normal(size=(400, 2))
    y = np.abs(q[:, 0]) - np.abs(q[:, 1])
    assert ((mlp_heuristic._train(q, y, (64, 32), 300, 1)(q) - y) ** 2).mean() < 0.01 * y.var()


def test_moments_give_the_same_edges(spark):
    """Fits on Spark's sums equal fits on whole panels, for all methods that have both."""
    rng = np.random.default_rng(8)
    rows = []
    for traj in range(3):
        s = generators.system(200, 0.2, 20 + traj)
        names = NAMES if traj < 2 else NAMES[:2]  # one trajectory lacks a variable
        rows += [(0, traj, t, v, float(s[t, i])) for t in range(200) for i, v in enumerate(names) if not (traj == 1 and v == "Y" and t in (50, 51))]
    obs = spark.createDataFrame(rows, "run_id int, traj_id long, t long, variable string, value double").repartition(7)
    specs = {k: v for k, v in registry.discover().items() if v.moments}
    assert specs.keys() == {"PCMCI", "LPCMCI", "GES", "FCI", "DYNOTEARS", "ClassicalGranger"}
    plain = {k: registry.MethodSpec(k, v.function, default_kwargs=v.default_kwargs) for k, v in specs.items()}
    got, want = ({(r.traj_id, r.method, r.source, r.target, r.lag): (r.score, r.p_value) for r in suite.fit_grid(obs, x, 2).collect()} for x in (specs, plain))
    assert got.keys() == want.keys() and len(got) > 10
    for k, (score, p) in want.items():
        assert abs(got[k][0] - score) < 1e-6 and (p is None) == (got[k][1] is None) and (p is None or abs(got[k][1] - p) < 1e-8)


def test_series_keep_their_own_orders(spark):
    rng = np.random.default_rng(4)
    walk, noise = np.cumsum(rng.normal(size=300)), rng.normal(size=300)
    rows = [(k, t, v, float(s[t])) for k, one, two in ((0, walk, noise), (1, noise, noise)) for v, s in (("a", one), ("b", two)) for t in range(300)]
    p = preprocess.Preprocessor()
    out = p.fit_transform(spark.createDataFrame(rows, "traj_id long, t long, variable string, value double"), normalize=False)
    assert {(r.traj_id, r.variable): r.differencing_order for r in p.summary().collect()} == {(0, "a"): 1, (0, "b"): 0, (1, "a"): 0, (1, "b"): 0}
    n = {(r.traj_id, r.variable): r["count"] for r in out.groupBy("traj_id", "variable").count().collect()}
    assert n == {(0, "a"): 299, (0, "b"): 299, (1, "a"): 300, (1, "b"): 300}


def test_aliases(x):
    assert score_based.run_score_based_ges(x[:120], 1, NAMES) == ges.run_ges(x[:120], 1, NAMES)
    assert fci.run_heterogeneous_fci(x[:120], 1, NAMES) == fci.run_fci(x[:120], 1, NAMES)


def test_extras_of_methods(spark, x):
    found = pcmci.run_pcmci(x, 2, NAMES, alpha=1.0)
    p, q = np.array([r["p_value"] for r in found]), np.array([r["q_value"] for r in found])
    assert len(found) == 18 and (q >= p).all() and (np.diff(q[np.argsort(p)]) >= 0).all() and abs(q[p.argmax()] - p.max()) < 1e-12
    assert {r["edge_pattern"] for r in ges.run_ges(x, 1, NAMES)} <= {"-->", "---"} and all(np.isfinite(r["graph_score"]) for r in ges.run_ges(x, 1, NAMES))
    obs = spark.createDataFrame([(0, 0, t, v, float(x[t, i])) for t in range(200) for i, v in enumerate(NAMES)], "run_id int, traj_id long, t long, variable string, value double")
    rows = suite.fit_grid(obs, {k: v for k, v in registry.discover().items() if k in ("PCMCI", "FCI", "ClassicalGranger")}, 2).collect()
    assert all(("q_value" in (r.extras or "")) == (r.method == "PCMCI") for r in rows)


def test_lpcmci_reports_definite_edges_only(x):
    found = _links(lpcmci.run_lpcmci(x, 2, NAMES, pc_alpha=0.001))
    assert {("X", "X", 1), ("Y", "Y", 1), ("Z", "Z", 1), ("Y", "Z", 1)} <= found <= set(generators.TRUTH)
    rng = np.random.default_rng(1)
    hidden, a, b, c = (np.zeros(2000) for _ in range(4))
    hidden[:] = rng.normal(size=2000)
    for t in range(2, 2000):  # a and b share a hidden cause, c follows a
        a[t] = 0.4 * a[t - 1] + hidden[t - 1] + 0.5 * rng.normal()
        b[t] = 0.4 * b[t - 1] + hidden[t - 1] + 0.5 * rng.normal()
        c[t] = 0.4 * c[t - 1] + 0.7 * a[t - 1] + 0.5 * rng.normal()
    found = _links(lpcmci.run_lpcmci(np.column_stack([a, b, c]), 2, list("abc"), pc_alpha=0.001))
    assert ("a", "c", 1) in found and not any({s, t} == {"a", "b"} for s, t, _ in found)
    assert lpcmci.run_lpcmci(x[:8], 2, NAMES) == lpcmci.run_lpcmci(x, 0, NAMES) == []
