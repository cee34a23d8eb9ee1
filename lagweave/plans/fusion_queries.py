"""Queries over edge tables: votes, probabilities, consensus over runs, rules, structure, selection, metrics, plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.special import bayes_factor, finite, posterior, score_probability, valid_p, wilson
from ..functions.special import fisher as fisher_p
from ..sources.checkpoints import stored
from ..operators import calibration, consensus, expert, fusion, granger, metrics, panel, plotdata, predictive, selection, structure
from . import bindings as b
from .panel_queries import _FISHER, _Z, _any_order, _r, _rounded, sweep

EDGE = fusion.EDGE
BOOT = b.RUNS - 1


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges as one run, for queries that aren't about runs."""
    return b.edge_table(spark, sf_dir).withColumn("run_id", F.lit(0))


def as_one_run(sql: str) -> str:
    """SQL over the edge table with all its rows in run 0."""
    return sql.replace(f"(o_orderkey % {b.RUNS})::INT AS run_id", "0::INT AS run_id")


#: Queries over _base().
ONE_RUN = "q17 q18 q22 q25 q42 q43 q44 q47 q51 q52 q53".split()


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def q17_dedup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fusion.dedup(_base(spark, sf_dir)), "score", places=13)


def q18_vote_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_text(fusion.votes(_base(spark, sf_dir), b.SIGNED, 2), "method", "signed_methods"), "mean_score")


def q19_sign_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.votes(b.edge_table(spark, sf_dir), b.SIGNED, 1, ["run_id"])
    return _rounded(_text(rows, "signed_methods").select("run_id", *EDGE, "signed_methods", "positive_votes", "negative_votes", "sign_consensus", "sign_agreement"))


def q20_score_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fusion.scales(b.edge_table(spark, sf_dir), ["run_id"]))


def q21_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.dedup(b.edge_table(spark, sf_dir), ["run_id"])
    return _rounded(rows.groupBy("run_id", *EDGE).agg(F.count(valid_p(F.col("p_value"))).alias("k"), fisher_p(F.col("p_value")).alias("combined_p_value")))


def q22_bayes_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.dedup(_base(spark, sf_dir)).withColumn("bayes_factor_10", bayes_factor(F.col("p_value")))
    return _rounded(rows.select("method", *EDGE, "bayes_factor_10", posterior(F.col("bayes_factor_10"), 0.1).alias("posterior_probability")))


def q23_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.votes(b.edge_table(spark, sf_dir), b.SIGNED, 1, ["run_id"])
    low, high = wilson(F.col("votes"), F.lit(len(b.METHODS)), 0.95)
    return _rounded(rows.select("run_id", *EDGE, "votes", low.alias("low"), high.alias("high")))


def q24_score_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = b.edge_table(spark, sf_dir)
    rows = fusion.dedup(edges, ["run_id"]).join(fusion.scales(edges, ["run_id"]), ["run_id", "method"])
    return _rounded(rows.select("run_id", "method", *EDGE, score_probability(F.col("score"), F.col("scale")).alias("probability")))


def q25_probabilistic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _text(fusion.probabilities(_base(spark, sf_dir), b.methods(spark), b.SIGNED, 1), "method", "signed_methods")
    return _rounded(rows.withColumn("log_bayes_factor", F.log("bayes_factor_10")).drop("bayes_factor_10"), "mean_score")


def q26_method_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(consensus.consistency(b.edge_table(spark, sf_dir), b.run_table(spark)))


def q27_bootstrap_stability_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(consensus.stability(b.edge_table(spark, sf_dir), b.run_table(spark)))


def _combos(spark: SparkSession) -> DataFrame:
    return selection.combos(spark, [(m, 1.0) for m in b.METHODS], 2, 3)


def q28_adaptive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(consensus.adaptive_weights(b.edge_table(spark, sf_dir), b.run_table(spark), _combos(spark), redundancy_penalty=0.2))


def q29_evidence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(consensus.evidence(b.edge_table(spark, sf_dir)))


def q30_bootstrap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(consensus.counts(b.edge_table(spark, sf_dir)))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus summary of all five methods, equal weights, one vote enough."""
    edges = b.edge_table(spark, sf_dir)
    members = b.methods(spark).withColumn("combo_id", F.lit(0)).withColumn("method_ord", F.array_position(F.array(*map(F.lit, b.METHODS)), F.col("method")).cast("int"))
    base = fusion.probabilities(edges.where("run_id = 0"), b.methods(spark), b.SIGNED, 1).withColumn("combo_id", F.lit(0))
    return consensus.blended(base, edges, members, BOOT)


_BLEND = ["bootstrap_probability", "bootstrap_evidence_score", "normalized_evidence_probability", "consensus_score", "local_expert_score", "ensemble_score", "base_edge_probability", "edge_probability"]


def q31_bootstrap_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_summary(spark, sf_dir).select(*EDGE, "votes", *_BLEND))


def q33_predictive_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lagged edges between priorities, scored by their tests and gated by the monthly panel's forecasts beside one other parent."""
    obs = panel.zscore(b.orders_panel(spark, sf_dir))
    tested = granger.tests_any_order(obs, 2)
    summary = tested.select("source", "target", "lag", F.lit(0).alias("combo_id"), (1 - F.col("p_value")).alias("ensemble_score"))
    gained = predictive.gains(obs, summary, parents=1, by=["combo_id"])
    return _rounded(predictive.gate(summary, gained, penalty=0.5, exponent=0.35))


def q34_expert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expert.apply_rules(_summary(spark, sf_dir), b.rules(spark))
    return _rounded(rows.select(*EDGE, "data_edge_probability", "edge_probability", "expert_adjustment", "expert_confidence", "uncertainty"))


def q35_ranked_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.ranked_structure(_summary(spark, sf_dir), 0.2, len(b.NODES), ["combo_id"])
    return _rounded(rows.select(*EDGE, "ranked_selection_pair_score", "ensemble_selected"))


def q36_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = _summary(spark, sf_dir).withColumn("predictive_rank", F.lit(1.0))
    rows = structure.ranked_structure(summary, 0.05, len(b.NODES), ["combo_id"], (0.4, 0.6, 0.25))
    return _rounded(rows.select(*EDGE, "ranked_selection_pair_score", "ensemble_selected"))


def q37_precision_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(structure.precision_consensus(_summary(spark, sf_dir), 0.5, 0.4, 0.3).select(*EDGE, "ensemble_score", "ensemble_selected"))


def _evaluated(spark: SparkSession, sf_dir: str):
    """The compacted edges, the weights and the summary are used by several steps, so they are stored."""
    edges, runs, combo = stored(fusion.compact(b.edge_table(spark, sf_dir))), stored(b.run_table(spark)), stored(_combos(spark).coalesce(1))
    summary, stable, weights = selection.evaluate(edges, runs, combo, b.SIGNED, BOOT)
    return edges, runs, combo, summary, stable, weights


def q38_stability_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, members = b.edge_table(spark, sf_dir), b.methods(spark)
    each = fusion.probabilities(edges.where("run_id > 0"), members, b.SIGNED, 1, by=["run_id"]).withColumn("combo_id", F.lit(0))
    return _rounded(consensus.stability_selection(each, BOOT).drop("combo_id"))


def q39_combo_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, runs, combo, summary, _, weights = _evaluated(spark, sf_dir)
    return _rounded(selection.metrics(summary, weights, edges, runs, combo, len(b.NODES)))


def q40_combo_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, runs, combo, summary, _, weights = _evaluated(spark, sf_dir)
    rows = selection.metrics(summary, weights, edges, runs, combo, len(b.NODES))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*selection.ranking_order()))
    return _rounded(rows.select(rank.alias("rank"), "combination", "performance_score"))


def q41_best_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, runs, combo, summary, _, weights = _evaluated(spark, sf_dir)
    return _rounded(selection.best(selection.metrics(summary, weights, edges, runs, combo, len(b.NODES)), summary))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.probabilities(_base(spark, sf_dir), b.methods(spark), b.SIGNED, 1)


def q42_structural_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.structural(_predicted(spark, sf_dir), b.truth(spark), 0.3))


def q43_skeleton_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.skeleton(_predicted(spark, sf_dir), b.truth(spark), 0.3, nodes=len(b.NODES)))


def q44_pair_scores_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.complete_pairs(_predicted(spark, sf_dir), b.NODES))


def _run_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled best absolute scores of every pair per run."""
    rows = metrics.complete_pairs(b.edge_table(spark, sf_dir), b.NODES, "absolute_score", by=["run_id"])
    return metrics.label(rows, b.truth(spark)).withColumnRenamed("run_id", "traj_id")


def q45_ranked_auc_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of nodes ranked by the best absolute score of each run, from the pairs with edges alone."""
    rows = metrics.ranked_pairs(b.edge_table(spark, sf_dir), b.truth(spark), b.NODES, "absolute_score", by=["run_id"])
    return _rounded(rows.withColumnRenamed("run_id", "traj_id"))


def _run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trajectory_index, strategy, ap): average precision per run of two kinds of evidence."""
    edges, known = b.edge_table(spark, sf_dir), b.truth(spark)
    rows = [
        metrics.ranked_pairs(edges, known, b.NODES, kind, by=["run_id"]).select(F.col("run_id").alias("trajectory_index"), F.lit(kind).alias("strategy"), F.col("average_precision").alias("ap"))
        for kind in ("absolute_score", "one_minus_p_value")
    ]
    return rows[0].union(rows[1])


def q46_paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.paired(_run_metrics(spark, sf_dir), "ap", "absolute_score", "one_minus_p_value"))


def q47_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.dedup(_base(spark, sf_dir)).select(F.concat_ws(">", *[F.col(c).cast("string") for c in EDGE]).alias("test"), "method", "p_value")
    return _rounded(metrics.holm(rows, ["method"]))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best absolute score of every pair per run and method, labelled.

    The runs and methods, the pairs and each use of the result need the edges, so their best scores are stored, one row per
    run, method, source and target, and the orders are read once.
    """
    best = stored(b.edge_table(spark, sf_dir).groupBy("run_id", "method", "source", "target").agg(F.max(F.abs(finite(F.col("score")))).alias("score")))
    rows = metrics.complete_pairs(best, b.NODES, "absolute_score", by=["run_id", "method"])
    return metrics.label(rows, b.truth(spark)).select(F.col("run_id").cast("long").alias("traj_id"), *structure.PAIR, F.col("method").alias("candidate"), "score", "label")


def q48_combine_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    every = rows.select("traj_id", *structure.PAIR, "label").distinct().withColumn("candidate", F.explode(F.array(*map(F.lit, b.METHODS))))
    full = every.join(rows.drop("label"), ["traj_id", *structure.PAIR, "candidate"], "left").fillna(0.0, ["score"])
    return _rounded(calibration.combine(full, {m: i + 1.0 for i, m in enumerate(b.METHODS)}))


def q49_top_k_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("traj_id").orderBy(*structure.PAIR)
    rows = _run_pairs(spark, sf_dir).withColumn("row_idx", F.row_number().over(order))
    return _rounded(calibration.top_k_by_f1(rows, range(1, 11)))


def q50_greedy_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    every = rows.select("traj_id", *structure.PAIR, "label").distinct().withColumn("candidate", F.explode(F.array(*map(F.lit, b.METHODS))))
    full = every.join(rows.drop("label"), ["traj_id", *structure.PAIR, "candidate"], "left").fillna(0.0, ["score"])
    return _rounded(calibration.cross_validated(full, 4).withColumn("fold", F.coalesce(F.col("fold").cast("string"), F.lit("all"))))


def q51_filter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(structure.filter_edges(_predicted(spark, sf_dir), 0.2, 2, source="1-URGENT").select(*EDGE, "edge_probability"))


def q52_graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(plotdata.circular(_predicted(spark, sf_dir), list(b.NODES)))


def q53_temporal_dag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(plotdata.temporal(_predicted(spark, sf_dir), list(b.NODES)))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "q" and name[1:3].isdigit()}


_D = "SELECT run_id, method, source, target, lag, avg(score) AS score, min(p_value) AS p FROM edges GROUP BY ALL"
_IN = "(" + ", ".join(f"'{m}'" for m in b.SIGNED) + ")"
_KEY = "source, target, lag"
_OUT = "source, target, lag::BIGINT AS lag"
_SIGNS = f"""coalesce(string_agg(method, ',' ORDER BY method) FILTER (method IN {_IN} AND score <> 0), '') AS signed_methods,
      count(*) FILTER (method IN {_IN} AND score > 0) AS positive_votes, count(*) FILTER (method IN {_IN} AND score < 0) AS negative_votes"""
_SIGN_OUT = """CASE WHEN positive_votes > 0 AND negative_votes > 0 THEN 'mixed' WHEN positive_votes > 0 THEN 'positive' WHEN negative_votes > 0 THEN 'negative' ELSE 'unknown' END AS sign_consensus,
      round(CASE WHEN positive_votes + negative_votes > 0 THEN greatest(positive_votes, negative_votes) / (positive_votes + negative_votes) END, 6) + 0.0 AS sign_agreement"""
_BF = "CASE WHEN {p} >= 1 / exp(1.0) THEN 1.0 ELSE 1 / (-exp(1.0) * least(greatest({p}, 1e-16), 1 - 1e-16) * ln(least(greatest({p}, 1e-16), 1 - 1e-16))) END"
_POST = "least(1 - 1e-12, greatest(1e-12, (0.1::DOUBLE / 0.9::DOUBLE) * {b} / (1 + (0.1::DOUBLE / 0.9::DOUBLE) * {b})))"
_Z975 = "1.959963984540054::DOUBLE"


def _wilson(v: str, n: str) -> tuple[str, str]:
    share, z = f"({v}::DOUBLE / {n})", _Z975
    mid, reach, bottom = f"({share} + {z} * {z} / (2.0 * {n}))", f"{z} * sqrt({share} * (1 - {share}) / {n} + {z} * {z} / (4.0 * {n} * {n}))", f"(1 + {z} * {z} / {n})"
    return f"greatest(0.0, ({mid} - {reach}) / {bottom})", f"least(1.0, ({mid} + {reach}) / {bottom})"


def _prob(keys: str = "", where: str = "TRUE", source: str = "d", weights: str = "", count: str = "5", total: str = "5.0") -> str:
    """A SELECT of the probabilistic summary from deduplicated edges; keys end with a comma. weights: a join that adds w, n_m and sum_w."""
    low, high = _wilson("votes", "n_m")
    w = "w" if weights else "1.0"
    group = f"{keys} {_KEY}" + (", n_m, sum_w" if weights else "")
    n_m, sum_w = ("", "") if weights else (f", {count} AS n_m", f", {total} AS sum_w")
    return f"""SELECT *, 1 - edge_probability AS uncertainty, least(1.0, greatest(0.0, 1 - (high - low))) AS confidence FROM (
      SELECT *, least(1.0, greatest(0.0, 0.7::DOUBLE * posterior_probability + 0.3::DOUBLE * weighted_support_ratio)) AS edge_probability FROM (
      SELECT *, {_POST.format(b='bf')} AS posterior_probability FROM (
      SELECT *, {_BF.format(p='combined_p_value')} AS bf, votes::DOUBLE / n_m AS support_ratio, weighted_votes / sum_w AS weighted_support_ratio, {low} AS low, {high} AS high FROM (
      SELECT *, {_FISHER} AS combined_p_value FROM (
      SELECT {group}{n_m}{sum_w}, string_agg(method, ',' ORDER BY method) AS method, count(*) AS votes, sum({w}) AS weighted_votes, avg(score) AS mean_score, count(p) AS k, sum(-ln(greatest(p, 1e-16))) AS l, {_SIGNS}
      FROM {source} {weights} WHERE {where} GROUP BY {group})))))"""


_RANK = "(rank() OVER (PARTITION BY run_id, method ORDER BY raw) + (count(*) OVER (PARTITION BY run_id, method, raw) - 1) / 2) / count(*) OVER (PARTITION BY run_id, method)"
_EVIDENCE = f"""ev AS (SELECT run_id, method, {_KEY}, CASE WHEN min(raw) OVER (PARTITION BY run_id, method) = max(raw) OVER (PARTITION BY run_id, method) THEN 1.0 ELSE {_RANK} END AS evidence FROM (SELECT *, coalesce(1 - p, abs(score)) AS raw FROM d))"""
_COUNTS = f"cnt AS (SELECT method, {_KEY}, count(DISTINCT run_id) AS n FROM edges WHERE run_id > 0 GROUP BY ALL)"


def _blend(summary: str, members: str, keys: str = "combo_id") -> str:
    """CTEs from a summary and members(combo_id, method, method_ord, weight) to `blended`."""
    return f"""{_EVIDENCE}, {_COUNTS}, boot AS (SELECT method, {_KEY}, sum(evidence) AS ev_sum FROM ev WHERE run_id > 0 GROUP BY ALL),
      mem AS (SELECT combo_id, method, method_ord, weight AS w, sum(weight) OVER (PARTITION BY combo_id) AS sum_w, max(weight) OVER (PARTITION BY combo_id) AS max_w FROM {members}),
      per AS (SELECT s.combo_id, s.source, s.target, s.lag, mem.method, method_ord, mem.w, mem.sum_w, mem.w / max_w AS rel, coalesce(ev.evidence, 0) AS ev0, coalesce(ev_sum, 0) AS evs, coalesce(n, 0) AS n FROM {summary} s JOIN mem ON mem.combo_id = s.combo_id
        LEFT JOIN ev ON ev.run_id = 0 AND ev.method = mem.method AND ev.source = s.source AND ev.target = s.target AND ev.lag = s.lag
        LEFT JOIN boot ON boot.method = mem.method AND boot.source = s.source AND boot.target = s.target AND boot.lag = s.lag
        LEFT JOIN cnt ON cnt.method = mem.method AND cnt.source = s.source AND cnt.target = s.target AND cnt.lag = s.lag),
      scored AS (SELECT *, (0.5 + 0.5 * rel) * (0.35::DOUBLE * ev0 + 0.65::DOUBLE * sqrt(evs / {BOOT} * n / {BOOT})) AS local FROM per),
      agg AS (SELECT combo_id, {_KEY}, sum(w * ev0) / first(sum_w) AS normalized_evidence_probability, sum(w * n / {BOOT}) / first(sum_w) AS bootstrap_probability, sum(w * evs / {BOOT}) / first(sum_w) AS bootstrap_evidence_score, max(local) AS local_expert_score, arg_max(method, (local, -method_ord)) AS dominant_method FROM scored GROUP BY combo_id, {_KEY}),
      blended AS (SELECT s.* EXCLUDE (edge_probability, uncertainty), agg.* EXCLUDE (combo_id, source, target, lag), s.edge_probability AS base_edge_probability, least(1.0, greatest(0.0, 0.65::DOUBLE * bootstrap_probability + 0.35::DOUBLE * s.edge_probability)) AS edge_probability,
        0.65::DOUBLE * bootstrap_evidence_score + 0.35::DOUBLE * normalized_evidence_probability AS consensus_score, 0.6::DOUBLE * local_expert_score + 0.4::DOUBLE * (0.65::DOUBLE * bootstrap_evidence_score + 0.35::DOUBLE * normalized_evidence_probability) AS ensemble_score
        FROM {summary} s JOIN agg ON agg.combo_id = s.combo_id AND agg.source = s.source AND agg.target = s.target AND agg.lag = s.lag)"""


_SETS = f"sets AS (SELECT DISTINCT run_id, method, {_KEY} FROM edges), grid AS (SELECT r.run_id, m.method FROM (SELECT unnest(range(0, {b.RUNS})) AS run_id) r CROSS JOIN methods m), size AS (SELECT g.run_id, g.method, count(s.source) AS n FROM grid g LEFT JOIN sets s ON s.run_id = g.run_id AND s.method = g.method GROUP BY ALL)"
_SIMILAR = f"""{_SETS},
      shared AS (SELECT x.run_id, x.method AS method_l, y.method AS method_r, count(*) AS shared FROM sets x JOIN sets y USING (run_id, {_KEY}) GROUP BY ALL),
      sim AS (SELECT x.run_id, x.method AS method_l, y.method AS method_r, CASE WHEN x.n + y.n - coalesce(shared, 0) > 0 THEN coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)) END AS jaccard FROM size x JOIN size y ON x.run_id = y.run_id LEFT JOIN shared s ON s.run_id = x.run_id AND s.method_l = x.method AND s.method_r = y.method),
      runs_shared AS (SELECT x.method, x.run_id AS a, y.run_id AS c, count(*) AS shared FROM sets x JOIN sets y USING (method, {_KEY}) WHERE x.run_id < y.run_id GROUP BY ALL),
      stable AS (SELECT x.method, coalesce(avg(CASE WHEN x.n + y.n - coalesce(shared, 0) > 0 THEN coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)) END), 0.0) AS bootstrap_stability FROM size x JOIN size y ON x.method = y.method AND x.run_id < y.run_id LEFT JOIN runs_shared s ON s.method = x.method AND s.a = x.run_id AND s.c = y.run_id GROUP BY x.method),
      counts AS (SELECT method, avg(n) AS mean_edge_count FROM size GROUP BY method)"""
_COMBOS = """combo AS (SELECT row_number() OVER (ORDER BY size, label_ord) - 1 AS combo_id, * FROM (
      SELECT 2 AS size, [a.method, b.method] AS ms, [a.method_ord, b.method_ord, -1] AS label_ord FROM methods a JOIN methods b ON a.method_ord < b.method_ord
      UNION ALL SELECT 3, [a.method, b.method, c.method], [a.method_ord, b.method_ord, c.method_ord] FROM methods a JOIN methods b ON a.method_ord < b.method_ord JOIN methods c ON b.method_ord < c.method_ord)),
      member AS (SELECT combo_id, size, array_to_string(ms, ' + ') AS combination, m.method, m.method_ord FROM (SELECT *, unnest(ms) AS u FROM combo) x JOIN methods m ON m.method = x.u)"""


def _weights(redundancy_penalty: str) -> str:
    return f"""pair_sim AS (SELECT method_l, method_r, avg(jaccard) AS s FROM sim WHERE method_l <> method_r GROUP BY ALL),
      crossed AS (SELECT x.combo_id, x.method, avg(s) AS redundancy FROM member x JOIN member y ON x.combo_id = y.combo_id AND x.method <> y.method LEFT JOIN pair_sim p ON p.method_l = x.method AND p.method_r = y.method GROUP BY ALL),
      parts AS (SELECT member.combo_id, member.method, method_ord, combination, bootstrap_stability, mean_edge_count, coalesce(redundancy, 0.0) AS redundancy, coalesce(1 - redundancy, 0.0) AS diversity, median(mean_edge_count) FILTER (mean_edge_count > 0) OVER (PARTITION BY member.combo_id) AS middle
        FROM member JOIN stable ON stable.method = member.method JOIN counts ON counts.method = member.method LEFT JOIN crossed ON crossed.combo_id = member.combo_id AND crossed.method = member.method),
      rel AS (SELECT *, CASE WHEN middle > 0 THEN mean_edge_count / middle ELSE 1.0 END AS relative_density, 1 / (1 + {redundancy_penalty} * redundancy) AS redundancy_factor FROM parts),
      den AS (SELECT *, 1 / (1 + 0.5 * greatest(relative_density - 1, 0.0)) AS density_factor FROM rel),
      raw AS (SELECT *, greatest(bootstrap_stability, 0.05) * (1 + 0.15::DOUBLE * diversity) * density_factor * redundancy_factor AS raw FROM den),
      weighed AS (SELECT *, raw / avg(raw) OVER (PARTITION BY combo_id) AS adaptive_weight FROM raw)"""


def _greedy(members: int) -> str:
    """CTEs of the greedy paths from cd(run_id, method, pair, score, label): the choice of step k is c{k}."""
    out = ["s0 AS (SELECT key, run_id, pair_lo, pair_hi, label, 0.0::DOUBLE AS total FROM (SELECT DISTINCT run_id::VARCHAR AS key FROM cd UNION SELECT 'all') CROSS JOIN (SELECT DISTINCT run_id, pair_lo, pair_hi, label FROM cd))"]
    for k in range(1, members + 1):
        out.append(f"""l{k} AS (SELECT key, s.run_id, method, round((total + score) / {k}, 12) AS m, count(*) AS n, sum(s.label) AS pos FROM s{k - 1} s JOIN cd ON cd.run_id = s.run_id AND cd.pair_lo = s.pair_lo AND cd.pair_hi = s.pair_hi GROUP BY ALL),
          a{k} AS (SELECT key, run_id, method, sum(pos * hits / seen) / sum(pos) AS ap FROM (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS hits FROM l{k} WINDOW w AS (PARTITION BY key, run_id, method ORDER BY m DESC)) GROUP BY ALL),
          c{k} AS (SELECT key, method, avg(ap) FILTER (run_id::VARCHAR <> key) AS v, max(ap) FILTER (run_id::VARCHAR = key) AS held FROM a{k} GROUP BY key, method QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(avg(ap) FILTER (run_id::VARCHAR <> key), 12) DESC, method) = 1),
          s{k} AS (SELECT s.key, s.run_id, s.pair_lo, s.pair_hi, s.label, total + score AS total FROM s{k - 1} s JOIN c{k} USING (key) JOIN cd ON cd.run_id = s.run_id AND cd.pair_lo = s.pair_lo AND cd.pair_hi = s.pair_hi AND cd.method = c{k}.method)""")
    return ", ".join(out)


def parts() -> dict:
    """Common table expressions and texts that several queries share."""
    c = b.ctes
    d = f"{c('edges')}, d AS MATERIALIZED ({_D})"
    summary = f"{d}, {c('methods')}, base AS (SELECT 0 AS combo_id, * FROM ({_prob(where='run_id = 0')})), one AS (SELECT 0 AS combo_id, method, method_ord, weight FROM methods), {_blend('base', 'one')}"
    predicted = f"{d}, base AS ({_prob(where='run_id = 0')})"
    nodes = "nodes AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in b.NODES) + "]) AS v), grid_p AS (SELECT a.v AS pair_lo, z.v AS pair_hi FROM nodes a JOIN nodes z ON a.v < z.v)"
    known = f"{c('truth')}, tp AS (SELECT DISTINCT least(source, target) AS pair_lo, greatest(source, target) AS pair_hi FROM truth)"
    pair = "least(source, target) AS pair_lo, greatest(source, target) AS pair_hi"
    wide = "round(mean_score, 11) + 0.0 AS mean_score, " + _r("support_ratio", "weighted_votes", "weighted_support_ratio", "combined_p_value", "posterior_probability", "edge_probability", "uncertainty", "confidence")
    steps, last = [], "b0"
    for i, (_, s, t, lag, relation, conf, kind, prior) in enumerate(b.RULES):
        match = f"source = '{s}' AND target = '{t}'" + ("" if lag is None else f" AND lag = {lag}")
        base = prior if prior is not None else expert.PRIORS[relation]
        blend = conf if kind == "soft" else min(1.0, 0.5 + 0.5 * conf)
        new = "0.0" if relation == "none" and kind == "hard" else f"p * {1 - 0.9 * conf}::DOUBLE" if relation == "none" else f"least(1.0, greatest(0.0, {1 - blend}::DOUBLE * p + {blend * base}::DOUBLE))"
        word = f"{kind}_" + ("forbidden" if relation == "none" else relation)
        steps.append(f"b{i + 1} AS (SELECT * EXCLUDE (p, adj, conf), CASE WHEN {match} THEN {new} ELSE p END AS p, CASE WHEN {match} THEN CASE WHEN adj = '' THEN '{word}' ELSE adj || '|{word}' END ELSE adj END AS adj, CASE WHEN {match} THEN greatest(coalesce(conf, 0.0), {conf}::DOUBLE) ELSE conf END AS conf FROM {last})")
        last = f"b{i + 1}"

    def ranked(n: int, extra: str = "", rescue: str = "FALSE") -> str:
        return f"""WITH {summary}, pr AS (SELECT {pair}, * FROM blended), best AS (SELECT pair_lo, pair_hi, max(CASE WHEN ensemble_score > 0 THEN ensemble_score END) AS ps, max(bootstrap_probability) AS r0, max(support_ratio) AS r2 FROM pr GROUP BY ALL),
          rk AS (SELECT *, CASE WHEN ps IS NOT NULL THEN row_number() OVER (ORDER BY ps DESC NULLS LAST, pair_lo, pair_hi) END AS rk FROM best)
          SELECT {_OUT}, round(ps, 6) + 0.0 AS ranked_selection_pair_score, coalesce(rk <= {n}, FALSE) OR ({rescue}) AS ensemble_selected FROM pr JOIN rk USING (pair_lo, pair_hi)"""

    counts = "count(*) FILTER (p IS NOT NULL AND t IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn"
    prf = "tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) + 0.0 AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) + 0.0 AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0.0 END, 6) + 0.0 AS f1"

    def run_pairs(value: str) -> str:
        return f"best AS (SELECT run_id, {pair}, max({value}) AS v FROM edges GROUP BY ALL), rp AS (SELECT r.run_id, g.pair_lo, g.pair_hi, coalesce(v, 0.0) AS score, CASE WHEN tp.pair_lo IS NULL THEN 0 ELSE 1 END AS label FROM (SELECT DISTINCT run_id FROM edges) r CROSS JOIN grid_p g LEFT JOIN best ON best.run_id = r.run_id AND best.pair_lo = g.pair_lo AND best.pair_hi = g.pair_hi LEFT JOIN tp ON tp.pair_lo = g.pair_lo AND tp.pair_hi = g.pair_hi)"

    auc = """lv AS (SELECT run_id, score, count(*) AS k, sum(label) AS pos FROM rp GROUP BY ALL), cum AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY run_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(k) OVER (PARTITION BY run_id ORDER BY score DESC) AS seen, sum(pos) OVER (PARTITION BY run_id ORDER BY score DESC) AS hits FROM lv),
      au AS (SELECT run_id, sum(k) AS n, sum(pos) AS p, sum(pos * (below + (k + 1) / 2)) AS r, sum(pos * hits / seen) AS g FROM cum GROUP BY ALL)"""
    candidates = f"cb AS (SELECT run_id, method, {pair}, max(abs(score)) AS v FROM edges GROUP BY ALL), cd AS (SELECT r.run_id, m.method, m.method_ord, g.pair_lo, g.pair_hi, coalesce(v, 0.0) AS score, CASE WHEN tp.pair_lo IS NULL THEN 0 ELSE 1 END AS label FROM (SELECT DISTINCT run_id FROM edges) r CROSS JOIN methods m CROSS JOIN grid_p g LEFT JOIN cb ON cb.run_id = r.run_id AND cb.method = m.method AND cb.pair_lo = g.pair_lo AND cb.pair_hi = g.pair_hi LEFT JOIN tp ON tp.pair_lo = g.pair_lo AND tp.pair_hi = g.pair_hi)"
    combined = f"""{d}, {c('methods')}, {_SIMILAR}, {_COMBOS}, {_weights('0.0')}, wt AS (SELECT combo_id, method, method_ord, adaptive_weight AS weight FROM weighed),
      tw AS (SELECT *, weight AS w, count(*) OVER (PARTITION BY combo_id) AS n_m, sum(weight) OVER (PARTITION BY combo_id) AS sum_w FROM wt),
      base AS ({_prob('combo_id,', 'run_id = 0', 'd', 'JOIN tw USING (method)')}), {_blend('base', 'wt')},
      sel AS (SELECT combo_id, count(*) AS num_edges, avg(edge_probability) AS mean_edge_probability, avg(confidence) AS mean_confidence, avg(1 - edge_probability) AS mean_uncertainty, avg(bootstrap_probability) AS mean_stability, avg((bootstrap_probability >= 0.6)::INT) AS stable_edge_ratio FROM blended WHERE edge_probability >= 0.5 GROUP BY combo_id),
      cand AS (SELECT combo_id, count(*) AS num_candidate_edges FROM blended GROUP BY combo_id), ml AS (SELECT greatest(coalesce(max(lag), 1), 1) AS ml FROM blended),
      agr AS (SELECT x.combo_id, avg(coalesce(jaccard, 1.0)) AS mean_method_agreement FROM member x JOIN member y ON x.combo_id = y.combo_id AND x.method_ord < y.method_ord JOIN sim ON sim.run_id = 0 AND sim.method_l = x.method AND sim.method_r = y.method GROUP BY ALL),
      ofm AS (SELECT combo_id, combination, count(*) AS num_methods, avg(bootstrap_stability) AS mean_method_stability, avg(diversity) AS mean_method_diversity FROM weighed GROUP BY ALL),
      met AS (SELECT ofm.combo_id, combination, num_methods, coalesce(num_edges, 0) AS num_edges, coalesce(mean_edge_probability, 0.0) AS mean_edge_probability, coalesce(mean_confidence, 0.0) AS mean_confidence, coalesce(mean_uncertainty, 1.0) AS mean_uncertainty, coalesce(mean_stability, 0.0) AS mean_stability, coalesce(stable_edge_ratio, 0.0) AS stable_edge_ratio,
        coalesce(num_candidate_edges, 0) AS num_candidate_edges, coalesce(mean_method_agreement, 1.0) AS mean_method_agreement, mean_method_stability, mean_method_diversity, least(coalesce(num_edges, 0) / (90.0 * ml), 1.0) AS edge_density FROM ofm LEFT JOIN sel USING (combo_id) LEFT JOIN cand USING (combo_id) LEFT JOIN agr USING (combo_id) CROSS JOIN ml),
      perf AS (SELECT *, CASE WHEN num_edges > 0 THEN 0.40::DOUBLE * mean_stability + 0.20::DOUBLE * mean_confidence + 0.15::DOUBLE * mean_edge_probability + 0.15::DOUBLE * stable_edge_ratio + 0.10::DOUBLE * (1 - sqrt(edge_density)) ELSE 0.0 END AS performance_score FROM met)"""
    return {k: v for k, v in locals().items() if k in ("d", "summary", "predicted", "nodes", "known", "pair", "wide", "steps", "last", "ranked", "counts", "prf", "run_pairs", "auc", "candidates", "combined")}


def _gated() -> str:
    """SQL of q33: ridge fits by sweeping the training rows' moments, errors row by row."""
    names = ["a0", "a1", "a2", "a3", "y"]
    edge = "source, target, lag, split"
    moments = ", ".join([*[f"avg({x}) AS m_{x}" for x in names], *[f"stddev_pop({x}) AS s_{x}" for x in names], *[f"count(*) * covar_pop({x}, {y}) AS c_{x}_{y}" for i, x in enumerate(names) for y in names[i:]]])
    by = lambda x: "" if x == "y" else f" / s_{x}"
    scaled = ", ".join(f"c_{x}_{y}{by(x)}{by(y)}{' + 1.0' if x == y != 'y' else ''} AS {x}_{y}" for i, x in enumerate(names) for y in names[i:])
    error = lambda w, k: "avg(pow(y - m_y - (" + " + ".join(f"{w}.a{i}_y * (a{i} - m_a{i}) / s_a{i}" for i in range(k)) + "), 2))"
    return f"""WITH {b.ctes('ord')}, z AS ({_Z.format(p='ord', eps='0')}), {_any_order('z', 2)},
      e AS (SELECT source, target, lag, 1 - p_value AS score FROM lag_tests),
      given AS (SELECT e.*, c.source AS parent, c.lag AS parent_lag FROM e JOIN e c ON c.target = e.target AND c.source <> e.source QUALIFY row_number() OVER (PARTITION BY e.source, e.target, e.lag ORDER BY c.score DESC, c.source, c.lag) = 1),
      st AS (SELECT variable, t, value, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, row_number() OVER w - 3 AS r, count(*) OVER (PARTITION BY variable) - 2 AS n FROM z WINDOW w AS (PARTITION BY variable ORDER BY t)),
      x AS (SELECT g.source, g.target, g.lag, y.r, y.n, y.value AS y, y.l1 AS a0, y.l2 AS a1, CASE parent_lag WHEN 1 THEN p.l1 ELSE p.l2 END AS a2, CASE g.lag WHEN 1 THEN s.l1 ELSE s.l2 END AS a3
        FROM given g JOIN st y ON y.variable = g.target JOIN st p ON p.variable = g.parent AND p.t = y.t JOIN st s ON s.variable = g.source AND s.t = y.t WHERE y.r >= 0),
      u AS (SELECT *, greatest(6, floor(n * (0.5::DOUBLE + 0.3::DOUBLE * split / 2))) AS train FROM x, (SELECT unnest([0, 1, 2]) AS split)),
      v AS (SELECT *, least(n, train + greatest(3, floor(n / 6))) AS stop FROM u), f AS (SELECT {edge}, {moments} FROM v WHERE r < train GROUP BY ALL),
      cell AS (SELECT {edge}, {scaled} FROM f), {sweep('cell', names, names[:3], edge, 'base_fit')}, {sweep('base_fit', names, names[3:4], edge, 'more_fit')},
      err AS (SELECT {edge}, {error('w0', 3)} AS e0, {error('w1', 4)} AS e1 FROM v JOIN f USING ({edge}) JOIN base_fit w0 USING ({edge}) JOIN more_fit w1 USING ({edge}) WHERE r >= train AND r < stop GROUP BY ALL),
      raw AS (SELECT source, target, lag, (e0 - e1) / greatest(e0, 1e-12) AS gain FROM err),
      g AS (SELECT source, target, lag, avg(gain) AS m, stddev_samp(gain) AS sd, count(*) AS k, avg((gain > 0)::INT) AS pos FROM raw GROUP BY ALL),
      s AS (SELECT *, sd / sqrt(k) AS se, greatest(0.0, m - 0.5 * sd / sqrt(k)) AS gain FROM g),
      k AS (SELECT *, CASE WHEN gain > 0 THEN (rank() OVER (PARTITION BY gain > 0 ORDER BY gain) + (count(*) OVER (PARTITION BY gain > 0, gain) - 1) / 2) / count(*) OVER (PARTITION BY gain > 0) ELSE 0.0 END AS rk FROM s),
      o AS (SELECT source, target, lag, 0::BIGINT AS combo_id, m AS predictive_gain_mean, sd AS predictive_gain_std, pos AS predictive_positive_split_ratio, se AS predictive_gain_standard_error, gain AS predictive_gain,
        rk AS predictive_rank, score AS pre_validation_ensemble_score, score * (0.25 + 0.75 * pow(rk, 0.35)) AS ensemble_score FROM k JOIN e USING (source, target, lag))
      SELECT source, target, lag, combo_id, {_r('predictive_gain_mean', 'predictive_gain_std', 'predictive_positive_split_ratio', 'predictive_gain_standard_error', 'predictive_gain', 'predictive_rank', 'pre_validation_ensemble_score', 'ensemble_score')} FROM o"""


def oracle_sql() -> dict[str, str]:
    c, s = b.ctes, parts()
    d, summary, predicted, nodes, known, pair, wide, steps, last = (s[k] for k in "d summary predicted nodes known pair wide steps last".split())
    ranked, counts, prf, run_pairs, auc, candidates, combined = (s[k] for k in "ranked counts prf run_pairs auc candidates combined".split())
    angle = lambda x: f"(2 * pi() * (list_position([{', '.join(repr(n) for n in b.NODES)}], {x}) - 1) / {len(b.NODES)})"
    place = lambda x: f"(list_position([{', '.join(repr(n) for n in b.NODES)}], {x}) - 1)::BIGINT"
    found = {
        "q17_dedup_edges": f"WITH {d} SELECT {_OUT}, method, round(score, 13) + 0.0 AS score, round(p, 6) + 0.0 AS p_value FROM d WHERE run_id = 0",
        "q18_vote_summary": f"WITH {d}, v AS (SELECT {_KEY}, string_agg(method, ',' ORDER BY method) AS method, count(*) AS votes, avg(score) AS mean_score, {_SIGNS} FROM d WHERE run_id = 0 GROUP BY ALL) SELECT {_OUT}, method, votes, round(mean_score, 11) + 0.0 AS mean_score, signed_methods, positive_votes, negative_votes, {_SIGN_OUT} FROM v WHERE votes >= 2",
        "q19_sign_summary": f"WITH {d}, v AS (SELECT run_id, {_KEY}, {_SIGNS} FROM d GROUP BY ALL) SELECT run_id::BIGINT AS run_id, {_OUT}, signed_methods, positive_votes, negative_votes, {_SIGN_OUT} FROM v",
        "q20_score_scale": f"WITH {d} SELECT run_id::BIGINT AS run_id, method, round(median(abs(score)), 6) + 0.0 AS scale FROM d GROUP BY ALL",
        "q21_fisher": f"WITH {d}, f AS (SELECT run_id, {_KEY}, count(p) AS k, sum(-ln(greatest(p, 1e-16))) AS l FROM d GROUP BY ALL) SELECT run_id::BIGINT AS run_id, {_OUT}, k, round({_FISHER}, 6) + 0.0 AS combined_p_value FROM f",
        "q22_bayes_posterior": f"WITH {d}, f AS (SELECT *, {_BF.format(p='p')} AS bf FROM d WHERE run_id = 0) SELECT method, {_OUT}, round(bf, 6) + 0.0 AS bayes_factor_10, round({_POST.format(b='bf')}, 6) + 0.0 AS posterior_probability FROM f",
        "q23_wilson": f"WITH {d}, v AS (SELECT run_id, {_KEY}, count(*) AS votes FROM d GROUP BY ALL) SELECT run_id::BIGINT AS run_id, {_OUT}, votes, round({_wilson('votes', '5')[0]}, 6) + 0.0 AS low, round({_wilson('votes', '5')[1]}, 6) + 0.0 AS high FROM v",
        "q24_score_probability": f"WITH {d}, s AS (SELECT run_id, method, median(abs(score)) AS scale FROM d GROUP BY ALL) SELECT run_id::BIGINT AS run_id, method, {_OUT}, round(1 / (1 + exp(-abs(score) / greatest(scale, 1e-12))), 6) + 0.0 AS probability FROM d JOIN s USING (run_id, method)",
        "q25_probabilistic_summary": f"WITH {predicted} SELECT {_OUT}, method, votes, signed_methods, positive_votes, negative_votes, {_SIGN_OUT}, {wide}, round(low, 6) + 0.0 AS support_ci_low, round(high, 6) + 0.0 AS support_ci_high, round(ln(bf), 6) + 0.0 AS log_bayes_factor FROM base",
        "q26_method_consistency": f"WITH {c('edges', 'methods')}, {_SIMILAR} SELECT method_l, method_r, round(coalesce(jaccard, 1.0), 6) + 0.0 AS jaccard FROM sim WHERE run_id = 0",
        "q27_bootstrap_stability_by_method": f"WITH {c('edges', 'methods')}, {_SIMILAR} SELECT method, {_r('bootstrap_stability', 'mean_edge_count')} FROM stable JOIN counts USING (method)",
        "q28_adaptive_weights": f"WITH {c('edges', 'methods')}, {_SIMILAR}, {_COMBOS}, {_weights('0.2::DOUBLE')} SELECT combo_id, method, 1.0::DOUBLE AS prior_weight, {_r('bootstrap_stability', 'diversity', 'mean_edge_count', 'relative_density', 'density_factor', 'redundancy', 'redundancy_factor', 'adaptive_weight')} FROM weighed",
        "q29_evidence_rank": f"WITH {d}, {_EVIDENCE} SELECT run_id::BIGINT AS run_id, method, {_OUT}, {_r('evidence')} FROM ev",
        "q30_bootstrap_counts": f"WITH {c('edges')}, {_COUNTS} SELECT method, {_OUT}, n FROM cnt",
        "q31_bootstrap_consensus": f"WITH {summary} SELECT {_OUT}, votes, {_r(*_BLEND)} FROM blended",
        "q33_predictive_gate": _gated(),
        "q34_expert_rules": f"WITH {summary}, b0 AS (SELECT {_KEY}, edge_probability, edge_probability AS p, '' AS adj, NULL::DOUBLE AS conf FROM blended), {', '.join(steps)} SELECT {_OUT}, round(edge_probability, 6) + 0.0 AS data_edge_probability, round(p, 6) + 0.0 AS edge_probability, CASE WHEN adj = '' THEN 'none' ELSE adj END AS expert_adjustment, round(conf, 6) + 0.0 AS expert_confidence, round(1 - p, 6) + 0.0 AS uncertainty FROM {last} WHERE adj NOT LIKE '%hard_forbidden%'",
        "q35_ranked_structure": ranked(9),
        "q36_rescue": ranked(3, rescue="r0 >= 0.4 AND r2 >= 0.25"),
        "q37_precision_consensus": f"WITH {summary} SELECT {_OUT}, {_r('ensemble_score')}, ensemble_score >= 0.5 AND support_ratio >= 0.4::DOUBLE AND bootstrap_probability >= 0.3::DOUBLE AS ensemble_selected FROM blended",
        "q38_stability_selection": f"WITH {d}, e AS ({_prob('run_id,', 'run_id > 0')}), s AS (SELECT {_KEY}, count(*) FILTER (edge_probability >= 0.5) AS selected_count, count(*) AS seen, avg(edge_probability) AS mean_edge_probability, avg(confidence) AS mean_confidence FROM e GROUP BY ALL) SELECT {_OUT}, selected_count, selected_count / {BOOT} + 0.0 AS selection_frequency, seen / {BOOT} + 0.0 AS appearance_frequency, {_r('mean_edge_probability', 'mean_confidence')}, selected_count / {BOOT} >= 0.6 AS stability_selected FROM s",
        "q39_combo_metrics": f"WITH {combined} SELECT combo_id, combination, num_methods, num_edges, num_candidate_edges, {_r('mean_edge_probability', 'mean_confidence', 'mean_uncertainty', 'mean_stability', 'stable_edge_ratio', 'mean_method_agreement', 'mean_method_stability', 'mean_method_diversity', 'edge_density', 'performance_score')} FROM perf",
        "q40_combo_ranking": f"WITH {combined} SELECT row_number() OVER (ORDER BY performance_score DESC, mean_stability DESC, mean_confidence DESC, combo_id) AS rank, combination, {_r('performance_score')} FROM perf",
        "q41_best_summary": f"WITH {combined}, top AS (SELECT combo_id FROM perf ORDER BY performance_score DESC, mean_stability DESC, mean_confidence DESC, combo_id LIMIT 1) SELECT combo_id, {_OUT}, {_r('edge_probability', 'ensemble_score', 'bootstrap_probability')}, dominant_method FROM blended SEMI JOIN top USING (combo_id)",
        "q42_structural_metrics": f"WITH {predicted}, {c('truth')}, p AS (SELECT {_KEY}, 1 AS p FROM base WHERE edge_probability >= 0.3), t AS (SELECT {_KEY}, 1 AS t FROM truth), j AS (SELECT * FROM p FULL JOIN t USING ({_KEY})), n AS (SELECT {counts} FROM j), w AS (SELECT count(*) AS reversed_edges FROM (SELECT * FROM j WHERE t IS NULL) x JOIN (SELECT * FROM j WHERE p IS NULL) y ON x.source = y.target AND x.target = y.source AND x.lag = y.lag) SELECT {prf}, reversed_edges, fp + fn - reversed_edges AS shd FROM n, w",
        "q43_skeleton_metrics": f"WITH {predicted}, {known}, p AS (SELECT DISTINCT {pair}, 1 AS p FROM base WHERE edge_probability >= 0.3), t AS (SELECT *, 1 AS t FROM tp), n AS (SELECT {counts} FROM p FULL JOIN t USING (pair_lo, pair_hi)) SELECT {prf}, round((tp + fn) / 45.0, 6) + 0.0 AS prevalence, round(2 * ((tp + fn) / 45.0) / (1 + (tp + fn) / 45.0), 6) + 0.0 AS all_pairs_f1 FROM n",
        "q44_pair_scores_complete": f"WITH {predicted}, {nodes}, m AS (SELECT {pair}, max(edge_probability) AS v FROM base GROUP BY ALL) SELECT pair_lo, pair_hi, round(coalesce(v, 0.0), 6) + 0.0 AS score FROM grid_p LEFT JOIN m USING (pair_lo, pair_hi)",
        "q45_ranked_auc_ap": f"WITH {c('edges')}, {nodes}, {known}, {run_pairs('abs(score)')}, {auc} SELECT run_id::BIGINT AS traj_id, round((r - p * (p + 1) / 2) / (p * (n - p)), 6) + 0.0 AS auroc, round(g / p, 6) + 0.0 AS average_precision, round(p / n, 6) + 0.0 AS prevalence FROM au",
        "q46_paired_differences": f"WITH {c('edges')}, {nodes}, {known}, a AS (WITH {run_pairs('abs(score)')}, {auc} SELECT run_id, g / p AS ap FROM au), z AS (WITH {run_pairs('1 - p_value')}, {auc} SELECT run_id, g / p AS ap FROM au) SELECT a.run_id::BIGINT AS trajectory_index, round(a.ap - z.ap, 6) + 0.0 AS difference FROM a JOIN z USING (run_id)",
        "q47_holm": f"WITH {d}, h AS (SELECT concat_ws('>', source, target, lag::VARCHAR) AS test, method, p FROM d WHERE run_id = 0), o AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY method) - row_number() OVER (PARTITION BY method ORDER BY p, test) + 1)) AS raw FROM h) SELECT test, method, round(p, 6) + 0.0 AS p_value, round(max(raw) OVER (PARTITION BY method ORDER BY p, test ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS holm_p FROM o",
        "q48_combine_candidates": f"WITH {c('edges', 'methods')}, {nodes}, {known}, {candidates} SELECT run_id::BIGINT AS traj_id, pair_lo, pair_hi, round(sum((method_ord + 1) / 15.0 * score), 6) + 0.0 AS score, max(label)::BIGINT AS label FROM cd GROUP BY ALL",
        "q49_top_k_f1": f"WITH {c('edges')}, {nodes}, {known}, {run_pairs('abs(score)')}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, pair_lo DESC, pair_hi DESC) AS rk FROM rp), k AS (SELECT unnest(range(1, 11)) AS k), s AS (SELECT k, run_id, sum(CASE WHEN rk <= k THEN label ELSE 0 END) AS tp, count(*) FILTER (rk <= k) AS n, sum(label) AS p FROM o CROSS JOIN k GROUP BY ALL) SELECT k, round(avg(tp / n), 6) + 0.0 AS precision, round(avg(tp / p), 6) + 0.0 AS recall, round(avg(2 * tp / (n + p)), 6) + 0.0 AS f1, round(avg(n + p - 2 * tp), 6) + 0.0 AS shd FROM s GROUP BY k",
        "q50_greedy_path": f"WITH {c('edges', 'methods')}, {nodes}, {known}, {candidates}, {_greedy(4)} " + " UNION ALL ".join(f"SELECT c{k}.key AS fold, {k}::BIGINT AS step, method AS candidate, round(v, 6) + 0.0 AS train_ap, round(held, 6) + 0.0 AS held_out_ap FROM c{k}" for k in range(1, 5)),
        "q51_filter_edges": f"WITH {predicted} SELECT {_OUT}, {_r('edge_probability')} FROM base WHERE edge_probability >= 0.2::DOUBLE AND lag <= 2 AND source = '1-URGENT'",
        "q53_temporal_dag_rows": f"WITH {predicted}, top AS (SELECT * FROM base ORDER BY edge_probability DESC, confidence DESC, lag DESC, source, target LIMIT 12) SELECT {_OUT}, CASE WHEN lag = 0 THEN 't' ELSE 't-' || lag END AS level, -lag::BIGINT AS x0, {place('source')} AS y0, 0::BIGINT AS x1, {place('target')} AS y1, round(1.5 + 5.5::DOUBLE * edge_probability, 6) + 0.0 AS width FROM top",
        "q52_graph_layout": f"WITH {predicted}, s AS (SELECT *, {_SIGN_OUT} FROM base) SELECT {_OUT}, round(cos({angle('source')}), 6) + 0.0 AS x0, round(sin({angle('source')}), 6) + 0.0 AS y0, round(cos({angle('target')}), 6) + 0.0 AS x1, round(sin({angle('target')}), 6) + 0.0 AS y1, round(1 + 5 * edge_probability, 6) + 0.0 AS width, round(0.2::DOUBLE + 0.8::DOUBLE * confidence, 6) + 0.0 AS opacity, sign_consensus AS sign, CASE sign_consensus WHEN 'positive' THEN '#1e88e5' WHEN 'negative' THEN '#d32f2f' WHEN 'mixed' THEN '#f57c00' ELSE '#607d8b' END AS colour, concat('sign=', sign_consensus, '<br>positive_votes=', positive_votes, '<br>negative_votes=', negative_votes, '<br>sign_agreement=', CASE WHEN positive_votes + negative_votes > 0 THEN printf('%.1f%%', 100.0 * greatest(positive_votes, negative_votes) / (positive_votes + negative_votes)) ELSE 'n/a' END) AS text, source = target AS self_loop FROM s",
    }
    return {k: as_one_run(v) if k[:3] in ONE_RUN else v for k, v in found.items()}
