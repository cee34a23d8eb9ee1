import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.functions import special
from lagweave.operators import calibration, consensus, expert, fusion, metrics, plotdata, predictive, selection, structure

from . import plain

EDGES = "run_id int, method string, source string, target string, lag int, score double, p_value double"


def edges(spark, *rows):
    return spark.createDataFrame([(0, *r) if not isinstance(r[0], int) else r for r in rows], EDGES)


def universe(spark, *names):
    return spark.createDataFrame([(n, 1.0) for n in names], "method string, weight double")


def test_duplicates_are_one_vote(spark):
    rows = edges(spark, ("A", "a", "b", 1, 1.0, 0.02), ("A", "a", "b", 1, 3.0, 0.01), ("B", "a", "b", 1, 2.0, 0.5), ("A", "x", "x", 1, 1.0, 0.01))
    got = fusion.votes(rows, ["A"], 1).collect()
    assert [(r.source, r.votes, r.mean_score, r.method) for r in got] == [("a", 2, 2.0, ["A", "B"])]
    assert fusion.dedup(rows).where("method = 'A'").first().p_value == 0.01


def test_signs_ignore_unsigned_methods(spark):
    rows = edges(spark, ("P", "a", "b", 1, -0.2, None), ("V", "a", "b", 1, -0.5, None), ("G", "a", "b", 1, 1.0, None), ("P", "a", "c", 1, -0.2, None), ("V", "a", "c", 1, 0.5, None), ("D", "a", "c", 1, 0.3, None))
    got = {r.target: r for r in fusion.votes(rows, ["P", "V", "D"], 1).collect()}
    assert (got["b"].sign_consensus, got["b"].negative_votes, got["b"].sign_agreement) == ("negative", 2, 1.0)
    assert got["c"].sign_consensus == "mixed" and abs(got["c"].sign_agreement - 2 / 3) < 1e-12


def test_empty_methods_stay_in_the_denominator(spark):
    got = fusion.probabilities(edges(spark, ("A", "a", "b", 1, 1.0, 0.01)), universe(spark, "A", "B"), [], 1).first()
    assert got.support_ratio == 0.5
    assert fusion.probabilities(edges(spark, ("A", "a", "b", 1, 1.0, 0.01)), universe(spark, "A", "B"), [], 2).count() == 0


def test_opposite_signs_do_not_cancel(spark):
    got = fusion.probabilities(edges(spark, ("A", "a", "b", 1, 5.0, None), ("B", "a", "b", 1, -5.0, None)), universe(spark, "A", "B"), [], 1).first()
    assert got.edge_probability > 0.7 and got.combined_p_value is None


@pytest.mark.parametrize(("ps", "want"), [([0.05, None, -1.0, 2.0], 0.05), ([0.01, 0.2], 0.002 * (1 - math.log(0.002))), ([None], None)])
def test_fisher(spark, ps, want):
    got = spark.createDataFrame([(p,) for p in ps], "p double").agg(special.fisher(F.col("p")).alias("p")).first().p
    assert got == want if want is None else abs(got - want) < 1e-12


def test_special_functions(spark):
    one = spark.range(1).select(
        special.bayes_factor(F.lit(0.5)).alias("none"), special.bayes_factor(F.lit(0.01)).alias("some"), special.posterior(F.lit(None).cast("double"), 0.1).alias("prior"),
        special.score_probability(F.lit(None).cast("double"), F.lit(1.0)).alias("half"), *[x.alias(n) for n, x in zip(("lo", "hi"), special.wilson(F.lit(9), F.lit(4), 0.95))],
        *[special.student_p(F.lit(t), F.lit(nu)).alias(f"t{nu}") for nu, t in ((1, 12.7062), (2, 4.30265), (3, 3.182446), (24, 2.063899), (115, 1.980808))],
    ).first()
    assert one.none == 1 and abs(one.some - 1 / (-math.e * 0.01 * math.log(0.01))) < 1e-9 and abs(one.prior - 0.1) < 1e-12 and one.half == 0.5 and one.hi <= 1
    assert all(abs(one[f"t{nu}"] - 0.05) < 1e-5 for nu in (1, 2, 3, 24, 115))


def test_jaccard_conventions(spark):
    rows = edges(spark, ("A", "a", "b", 1, 1.0, None), ("B", "a", "b", 1, 1.0, None), ("B", "b", "a", 1, 1.0, None))
    runs = spark.createDataFrame([(0, m) for m in "ABCD"], "run_id int, method string")
    got = {(r.method_l, r.method_r): r.jaccard for r in consensus.consistency(rows, runs).collect()}
    assert len(got) == 16 and got["A", "B"] == 0.5 and got["C", "D"] == 1.0 and got["A", "C"] == 0.0
    assert {(r.method_l, r.method_r): r.similarity for r in consensus.run_similarity(rows, runs).collect()}["C", "D"] is None


def test_unstable_dense_methods_weigh_less(spark):
    rows = [(r, "stable", "a", "b", 1, 1.0, None) for r in range(4)] + [(r, "dense", "a", t, 1 + r, 1.0, None) for r in range(4) for t in "bcd"]
    runs = spark.createDataFrame([(r, m) for r in range(4) for m in ("stable", "dense")], "run_id int, method string")
    got = {r.method: r for r in consensus.adaptive_weights(edges(spark, *rows), runs, selection.combos(spark, [("stable", 1.0), ("dense", 1.0)])).collect()}
    assert got["stable"].adaptive_weight > got["dense"].adaptive_weight and got["dense"].density_factor < 1


def test_evidence_ranks_average_ties(spark):
    rows = edges(spark, ("A", "a", "b", 1, 1.0, None), ("A", "a", "c", 1, 1.0, None), ("A", "a", "d", 1, 3.0, None), ("B", "a", "b", 1, 1.0, None), ("B", "a", "c", 1, 1.0, None))
    got = {(r.method, r.target): r.evidence for r in consensus.evidence(rows).collect()}
    assert got["A", "b"] == got["A", "c"] == 0.5 and got["A", "d"] == 1.0 and got["B", "b"] == 1.0


def test_blend_of_bootstraps(spark):
    rows = [(0, "A", "a", "b", 1, 1.0, None), (1, "A", "a", "b", 1, 1.0, None), (2, "A", "b", "a", 1, 1.0, None), (0, "B", "a", "b", 1, 1.0, None)]
    e = edges(spark, *rows)
    base = fusion.probabilities(e.where("run_id = 0"), universe(spark, "A", "B"), [], 1).withColumn("combo_id", F.lit(0))
    members = spark.createDataFrame([(0, "A", 1.0, 0), (0, "B", 1.0, 1)], "combo_id int, method string, weight double, method_ord int")
    got = consensus.blended(base, e, members, 2).first()
    assert got.bootstrap_probability == 0.25 and got.dominant_method == "A"
    assert abs(got.edge_probability - (0.65 * 0.25 + 0.35 * got.base_edge_probability)) < 1e-12


def test_stability_counts_all_iterations(spark):
    rows = spark.createDataFrame([(0, 1, "a", "b", 1, 0.9, 0.5), (0, 2, "a", "b", 1, 0.1, 0.5)], "combo_id int, run_id int, source string, target string, lag int, edge_probability double, confidence double")
    got = consensus.stability_selection(rows, 4).first()
    assert (got.selected_count, got.selection_frequency, got.appearance_frequency, got.mean_edge_probability) == (1, 0.25, 0.5, 0.5)


RULES = "rule_ord int, source string, target string, lag int, relation string, confidence double, constraint string, prior_probability double"


def test_rules_fold_in_order(spark):
    summary = spark.createDataFrame([("a", "b", 1, 0.4), ("a", "c", 1, 0.8), ("x", "x", 1, 0.2), ("q", "r", 1, 0.5)], "source string, target string, lag int, edge_probability double")
    rules = spark.createDataFrame([(1, "a", "b", None, "strong", 0.5, "soft", None), (2, "a", "c", 1, "none", 1.0, "hard", None), (3, "a", "c", 1, "strong", 1.0, "hard", None), (4, "x", "x", None, " Strong ", 1.0, None, None), (5, "q", "r", None, "bogus", 1.0, "soft", None)], RULES)
    got = {r.target: r for r in expert.apply_rules(summary, rules).collect()}
    assert got.keys() == {"b", "x", "r"}
    assert abs(got["b"].edge_probability - 0.65) < 1e-12 and got["b"].expert_adjustment == "soft_strong" and got["b"].data_edge_probability == 0.4
    assert got["x"].edge_probability == 0.9 and got["r"].expert_adjustment == "none"


def test_ranked_structure_and_rescue(spark):
    rows = [("a", "b", 0.9, 0.1), ("a", "c", 0.8, 0.1), ("b", "a", 0.7, 0.1), ("a", "d", 0.6, 0.1), ("c", "d", 0.0, 0.9)]
    s = spark.createDataFrame([(x, y, 1, e, p, 1.0, p) for x, y, e, p in rows], "source string, target string, lag int, ensemble_score double, bootstrap_probability double, predictive_rank double, support_ratio double")
    pairs = {(r.source, r.target) for r in structure.ranked_structure(s, 0.5, 4).where("ensemble_selected").collect()}
    assert pairs == {("a", "b"), ("b", "a"), ("a", "c"), ("a", "d")}
    assert ("c", "d") in {(r.source, r.target) for r in structure.ranked_structure(s, 0.2, 4, rescue=(0.5, 0.5, 0.5)).where("ensemble_selected").collect()}
    with pytest.raises(ValueError):
        structure.ranked_structure(s, 0, 4)
    with pytest.raises(ValueError):
        structure.precision_consensus(s, 1.5)


def test_metrics_of_a_reversal(spark):
    known = spark.createDataFrame([("x", "y", 1), ("y", "z", 1)], "source string, target string, lag int")
    found = spark.createDataFrame([("y", "x", 1, 0.9), ("x", "y", 1, 0.1), ("x", "z", 1, 0.9)], "source string, target string, lag int, edge_probability double")
    got = metrics.structural(found, known).first()
    assert (got.tp, got.fp, got.fn, got.reversed_edges, got.shd) == (0, 2, 2, 1, 3)
    pair = metrics.skeleton(found, known, nodes=3).first()
    assert (pair.tp, pair.fp, pair.fn) == (1, 1, 1) and abs(pair.all_pairs_f1 - 0.8) < 1e-12


def test_ranked_metrics_group_ties(spark):
    rng = np.random.default_rng(0)
    score, label = rng.integers(0, 6, 60) / 5.0, rng.integers(0, 2, 60)
    got = metrics.ranked(spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "score double, label int")).first()
    pos, neg = score[label == 1], score[label == 0]
    assert abs(got.auroc - np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])) < 1e-12
    assert abs(got.average_precision - plain.average_precision(score, label)) < 1e-12
    assert metrics.ranked(spark.createDataFrame([(0.1, 1)], "score double, label int")).first().auroc is None


def test_complete_pairs(spark):
    rows = spark.createDataFrame([("a", "b", 0.05), ("b", "a", 0.5), ("a", "a", 0.01)], "source string, target string, p_value double")
    got = {(r.pair_lo, r.pair_hi): r.score for r in metrics.complete_pairs(rows, list("abc"), "one_minus_p_value").collect()}
    assert got == {("a", "b"): 0.95, ("a", "c"): 0.0, ("b", "c"): 0.0}
    with pytest.raises(ValueError):
        metrics.complete_pairs(rows, ["a"])


def test_superiority_and_holm(spark):
    results = spark.createDataFrame([(i, s, v) for i, (a, b) in enumerate([(1, 3), (2, 3), (1, 4), (2, 5)]) for s, v in (("new", float(a)), ("old", float(b)))] + [(9, "new", 1.0)], "trajectory_index int, strategy string, shd double")
    d = metrics.paired(results, "shd", "new", "old", higher=False)
    got = metrics.superiority(d, 500)
    assert got["mean_difference"] == 2.25 and got["win_rate"] == 1.0 and got["ci_low"] > 0
    assert plain.wilcoxon(np.array([1.0, 2, 3, 4, 5])) == 0.0625 and plain.wilcoxon(np.zeros(3)) == 1.0
    p = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.9)], "test string, p_value double")
    assert [round(r.holm_p, 6) for r in metrics.holm(p).orderBy("p_value").collect()] == [0.03, 0.04, 0.9]


def test_calibration(spark):
    y = {0: [1, 0, 0], 1: [0, 1, 0]}
    rows = [(k, "a", f"p{i}", c, float(v if c == "good" else 1 - v), v) for k, labels in y.items() for i, v in enumerate(labels) for c in ("bad", "good")]
    s = spark.createDataFrame(rows, "traj_id long, pair_lo string, pair_hi string, candidate string, score double, label int")
    assert {r.candidate for r in calibration.cross_validated(s, 2).collect()} == {"good"}
    assert [r.calibrated_pair_rank for r in calibration.apply_calibrated(s, {"good": 1.0}, 1).where("label = 1").collect()] == [1, 1]
    ranked = s.where("candidate = 'good'").withColumn("row_idx", F.substring("pair_hi", 2, 1).cast("int"))
    best = calibration.top_k_by_f1(ranked, [1, 2]).first()
    assert (best.k, best.f1, best.shd) == (1, 1.0, 0.0)
    with pytest.raises(ValueError):
        calibration.combine(s, {"good": 0.0})


def test_gate_ranks_gains(spark):
    summary = spark.createDataFrame([(0, s, "t", 1, 0.8) for s in "abc"], "combo_id int, source string, target string, lag int, ensemble_score double")
    gain = spark.createDataFrame([("a", "t", 1, 0.5), ("a", "t", 1, 0.7), ("b", "t", 1, -0.5), ("c", "t", 1, 0.1)], "source string, target string, lag int, gain double")
    got = {r.source: r for r in predictive.gate(summary, gain).collect()}
    assert got["a"].ensemble_score == 0.8 and abs(got["b"].ensemble_score - 0.2) < 1e-12 and got["c"].predictive_rank == 0.5


def test_plot_rows(spark):
    s = spark.createDataFrame([("a", "a", 1, 0.8, 0.7, "negative"), ("a", "b", 2, 0.5, 0.5, "odd")], "source string, target string, lag int, edge_probability double, confidence double, sign_consensus string")
    got = {r.target: r for r in plotdata.circular(s, ["a", "b"]).collect()}
    assert got["a"].self_loop and got["a"].width == 5.0 and got["b"].sign == "unknown"
    assert plotdata.temporal(s, ["a", "b"], 1).first().level == "t-1"


def test_combinations(spark):
    got = selection.combos(spark, [("A", 1.0), ("B", 1.0), ("C", 1.0)], 2).groupBy("combo_id", "combination").count().orderBy("combo_id").collect()
    assert [r.combination for r in got] == ["A + B", "A + C", "B + C", "A + B + C"]
    with pytest.raises(ValueError):
        selection.combos(spark, [("A", 1.0)], 2)


def test_relations():
    assert plain.relations(["a", "b", "c"], "causes_of_target", target="b") == [("a", "b"), ("c", "b")]
    assert plain.relations(["a", "b"], "compare_directions", "a", "a") == []
