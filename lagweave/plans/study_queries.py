"""Queries over loading, checks, orders, calibration, baselines and ablations of a study, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import local_bic
from ..operators import calibration, consensus, fusion, granger, metrics, panel, plotdata, predictive, registry, selection, structure, suite
from ..sources import checkpoints, datasets, tensors
from . import bindings as b
from . import fusion_queries as fq
from . import panel_queries as pq
from .panel_queries import _r, _rounded

EDGE, PAIR = fusion.EDGE, structure.PAIR
_position = structure.placed


def q68_loaded_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily panel written as CSV and as Parquet and loaded from both, two of its columns selected."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("t").cast("int"))
    wide = panel.wide(b.events_panel(spark, sf_dir), b.EVENTS).withColumn("date", day).drop("traj_id", "t")
    found = []
    for kind in ("csv", "parquet"):
        path = f"{checkpoints.shared_folder(spark)}.{kind}"
        getattr(wide.write.option("header", True), kind)(path)
        loaded = datasets.load(spark, path, selected_columns=["view", "click", "view"], date_column="date")
        found.append(loaded.selected().withColumn("format", F.lit(kind)))
    return _rounded(found[0].union(found[1]).select("format", "traj_id", "t", F.col("ts").cast("date").cast("string").alias("day"), "variable", "value"))


def q69_resumed_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories still to do after a first run that finished those of above-average value and failed on the lightest of them."""
    totals = b.trajectories(spark, sf_dir).groupBy(F.col("traj_id").alias("trajectory_index")).agg(F.sum("value").alias("total"), F.count_if(F.col("value") == 0).alias("zeros"))
    mean = totals.agg(F.avg("total").alias("mean"))
    done = totals.crossJoin(F.broadcast(mean)).where("total > mean").withColumn("failed", F.col("total") < 1.05 * F.col("mean"))  # one row
    path = checkpoints.shared_folder(spark)
    checkpoints.append(done.select("trajectory_index", "total", "failed"), path, {"run": 1})
    rest = [checkpoints.pending(totals, spark, path, again).withColumn("retry_failed", F.lit(again)) for again in (False, True)]
    return _rounded(rest[0].union(rest[1]).select("trajectory_index", "retry_failed", "total"))


def q70_cached_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated edges, made once, stored under their configuration and read back from there."""
    folder, config = checkpoints.shared_folder(spark), {"runs": b.RUNS, "by": "run_id"}
    checkpoints.cached_edges(spark, folder, config, lambda: fusion.dedup(b.edge_table(spark, sf_dir), ["run_id"]))
    return _rounded(checkpoints.cached_edges(spark, folder, config, lambda: spark.range(0)), "score")


def q71_complete_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of shipping in which every return flag occurs, renumbered."""
    week = F.floor(F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01")) / 7).cast("long")
    rows = b.read(spark, sf_dir, "lineitem").groupBy(F.lit(0).cast("long").alias("traj_id"), week.alias("t"), F.concat("l_returnflag", "l_linestatus").alias("variable")).agg(F.sum("l_quantity").alias("value"))
    return _rounded(panel.complete(rows, 1))


def q72_restricted_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the relations that are about one target."""
    edges = fusion.dedup(b.edge_table(spark, sf_dir), ["run_id"])
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    return _rounded(structure.restrict(edges, structure.relation_rows(nodes, "causes_of_target", target="BUILDING")), "score")


_OBJECTIVES = (("full_structure", None, None), ("causes_of_target", None, "BUILDING"), ("effects_of_source", "2-HIGH", None), ("compare_directions", "2-HIGH", "BUILDING"), ("specific_relations", None, None))


def q73_objective_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of each objective over the nodes of the edge table."""
    edges = b.edge_table(spark, sf_dir)
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    each = [structure.relation_rows(nodes, o, s, t, b.truth(spark)).select(F.lit(o).alias("objective"), "source", "target") for o, s, t in _OBJECTIVES]
    return suite.union(each).distinct()


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with graph marks that their p-values and scores stand for."""
    rows = fusion.dedup(b.edge_table(spark, sf_dir), ["run_id"])
    p, s = F.col("p_value"), F.col("score")
    return rows.withColumns({
        "mark": F.when(p < 0.02, " --> ").when(p < 0.05, "o->").otherwise("<->"), "tail": F.when(p < 0.02, "tail").when(p < 0.05, "circle").otherwise("arrow"),
        "head": F.when(s > 0, "arrow").otherwise("tail"),
    })


def q74_endpoint_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that the marks of each kind of graph let pass."""
    rows = _marked(spark, sf_dir)
    kept = {
        "arrow": structure.directed(rows), "ges": structure.temporal_endpoints(rows, "GES"), "fci": structure.temporal_endpoints(rows, "FCI"),
        "fci_partial": structure.temporal_endpoints(rows, "FCI", True),
    }
    return _rounded(suite.union([df.select(F.lit(k).alias("graph"), "run_id", *EDGE, "method") for k, df in kept.items()]))


def _lag_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficient and p-value of every lag of the order-2 tests of the user groups."""
    return granger.edges(granger.tests(panel.zscore(b.trajectories(spark, sf_dir))), 1.0)


def q75_pair_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest coefficient and least p-value of every pair over directions, lags and user groups."""
    return _rounded(suite.reduce_pairs(_lag_tests(spark, sf_dir)))


def q76_gain_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair's lag 1, its score damped by the rank of its predictive gain among those that gain."""
    gains = predictive.gains_order_one(panel.zscore(b.events_panel(spark, sf_dir))).withColumn("lag", F.lit(1))
    summary = gains.select("source", "target", "lag").distinct().withColumns({"combo_id": F.lit(0), "ensemble_score": F.lit(0.8)})
    return _rounded(predictive.gate(summary, gains, penalty=0.5).drop("combo_id"))


def q77_chronological_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.holdout(b.trajectories(spark, sf_dir), 0.2))


def q78_vote_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.votes(fq._base(spark, sf_dir), b.SIGNED, 1)
    return _rounded(_position(rows, structure.vote_order()).select("position", *EDGE, "votes"))


def q79_probability_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _coarse(fq._predicted(spark, sf_dir), "edge_probability")
    return _rounded(_position(rows, structure.probability_order()).select("position", *EDGE, "votes", "edge_probability"))


def _coarse(rows: DataFrame, *columns: str) -> DataFrame:
    """Doubles as whole millionths, so that ties don't hang on the last bit."""
    return rows.withColumns({c: F.round(F.col(c), 6) for c in columns})


def q80_consensus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _coarse(fq._summary(spark, sf_dir), "edge_probability", "bootstrap_probability")
    return _rounded(_position(rows, structure.best_order()).select("position", *EDGE, "edge_probability", "bootstrap_probability", "votes"))


def q81_stability_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fq.q38_stability_selection(spark, sf_dir)
    return _rounded(_position(rows, structure.stability_order()).select("position", *EDGE, "selection_frequency", "appearance_frequency"))


def q82_granger_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = granger.edges(granger.tests(panel.zscore(b.orders_panel(spark, sf_dir))), 0.5)
    return _rounded(_position(rows, structure.granger_order(), ["traj_id"]).select("traj_id", "position", *EDGE))


def q83_parent_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate parents of each target, strongest first."""
    rows = _coarse(fq._summary(spark, sf_dir), "ensemble_score")
    return _rounded(_position(rows, predictive.parent_order(), ["combo_id", "target"]).select("target", "position", "source", "lag", "ensemble_score"))


def q84_union_of_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Granger edges, which have a joint test, and correlations, which don't, in one table."""
    obs = panel.zscore(b.orders_panel(spark, sf_dir))
    tests = granger.edges(granger.tests(obs), 0.5)
    plain = panel.pearson_test(obs).select(F.lit(0).cast("long").alias("traj_id"), F.lit("Pearson").alias("method"), "source", "target", F.lit(0).alias("lag"), F.col("r").alias("score"), "p_value")
    return _rounded(suite.union([tests, plain]))


def q85_pair_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each run's directed edges, taken as labelled pairs: repeats among them."""
    rows = fusion.dedup(b.edge_table(spark, sf_dir), ["run_id"]).groupBy("run_id", *EDGE).agg(F.avg("score").alias("score"))
    pairs = structure.with_pair(rows).select("run_id", *PAIR, "score").withColumn("label", (F.col("score") > 0).cast("int"))
    return _rounded(metrics.pair_checks(pairs, ["run_id"]))


def q86_first_of_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run's edges of a pair, the first by lag, method and direction."""
    rows = structure.with_pair(fusion.dedup(b.edge_table(spark, sf_dir), ["run_id"]))
    return _rounded(calibration.keep_first(rows, [F.col(c) for c in ("lag", "method", "source", "target")], ["run_id", *PAIR]).select("run_id", *PAIR, "lag", "method", "source", "score"), "score")


def q87_sampled_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five user groups, drawn without those that an earlier draw of two took."""
    groups = b.trajectories(spark, sf_dir).select("traj_id").distinct()
    first = panel.sample_trajectories(groups, 2, 42)
    return panel.sample_trajectories(groups, 5, 2029, first)


def _full_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every run, pair and method, 0 where the method has none."""
    rows = fq._candidates(spark, sf_dir)
    every = rows.select("traj_id", *PAIR, "label").distinct().withColumn("candidate", F.explode(F.array(*map(F.lit, b.METHODS))))
    return every.join(rows.drop("label"), ["traj_id", *PAIR, "candidate"], "left").fillna(0.0, ["score"])


def q88_size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over runs of the average precision that the first k methods reach together."""
    full = _full_candidates(spark, sf_dir)
    size = F.array_position(F.array(*map(F.lit, b.METHODS)), F.col("candidate"))
    rows = full.withColumn("member_count", F.explode(F.sequence(size.cast("int"), F.lit(len(b.METHODS)))))
    mixed = rows.groupBy("member_count", "traj_id", *PAIR).agg((F.sum("score") / F.first("member_count")).alias("score"), F.max("label").alias("label"))
    ap = metrics.ranked(_coarse(mixed, "score"), ["member_count", "traj_id"]).select("member_count", F.col("average_precision").alias("ap"))
    return _rounded(calibration.cv_summary(_coarse(ap, "ap")))


def q89_described_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.described(fq._run_metrics(spark, sf_dir), ["ap"]))


def q90_combination_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each set of methods votes for an edge, over all runs."""
    rows = fusion.votes(b.edge_table(spark, sf_dir), b.SIGNED, 1, ["run_id"])
    return _rounded(metrics.value_counts(rows.withColumn("combination", F.array_join("method", " + ")), "combination"))


def q91_weight_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each combination's weights as JSON, read back into rows."""
    weights = consensus.adaptive_weights(b.edge_table(spark, sf_dir), b.run_table(spark), fq._combos(spark))
    packed = weights.groupBy("combo_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("method", "adaptive_weight")))).alias("weights"))
    return _rounded(packed.select("combo_id", F.explode(F.from_json("weights", "map<string,double>")).alias("method", "adaptive_weight")))


def q92_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeleton metrics per run of the edges found, of all pairs and of as many random pairs as are true."""
    known, edges = b.truth(spark), b.edge_table(spark, sf_dir)
    runs = edges.select(F.col("run_id").alias("key")).distinct()
    voted = fusion.votes(edges, b.SIGNED, 4, ["run_id"]).select(F.lit("VOTES").alias("strategy"), F.col("run_id").alias("key"), "source", "target")
    every = suite.union([voted, metrics.baselines(runs, b.NODES, known)])
    return _rounded(metrics.skeleton(every, known, nodes=len(b.NODES), by=["strategy", "key"]))


def q93_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that each ablation selects: both thresholds, the score's alone, and the ranked pairs without a gate."""
    rows = _coarse(fq._summary(spark, sf_dir), "ensemble_score", "support_ratio")
    found = {
        "hard_consensus": structure.precision_consensus(rows, 0.5, 0.5), "soft_vote": structure.precision_consensus(rows, 0.5, 0.0),
        "no_gate_top_k": structure.ranked_structure(rows, 0.40, len(b.NODES), ["combo_id"]),
    }
    return _rounded(suite.union([df.where("ensemble_selected").select(F.lit(k).alias("ablation"), *EDGE) for k, df in found.items()]))


def q94_score_table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the scores of methods that have some pairs only."""
    return _rounded(calibration.checks(fq._candidates(spark, sf_dir).where("score > 0")))


def q95_calibrated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the frozen ensemble's score of their pair beside the one they had."""
    weights = {m: i + 1.0 for i, m in enumerate(b.METHODS)}
    scores = _coarse(calibration.apply_calibrated(_full_candidates(spark, sf_dir), weights, 9), "score")
    edges = fusion.votes(b.edge_table(spark, sf_dir), b.SIGNED, 1, ["run_id"]).select(F.col("run_id").cast("long").alias("traj_id"), *EDGE, (F.col("votes") / len(b.METHODS)).alias("ensemble_score"))
    return _rounded(calibration.calibrated_summary(edges, scores).select("traj_id", *EDGE, "pre_calibration_ensemble_score", "ensemble_score", "calibrated_pair_rank", "ensemble_selected"))


def q96_feasible_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of kept pairs whose mean recall is at least 0.2, best F1 first; 10 if none is."""
    return _rounded(calibration.feasible_k(_coarse(fq.q49_top_k_f1(spark, sf_dir), "f1", "recall"), {"recall": 0.2}, 10).select("k", "position", "precision", "recall", "f1", "shd"))


def q97_consistency_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(plotdata.heatmap(consensus.consistency(b.edge_table(spark, sf_dir), b.run_table(spark))))


def q98_pearson_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.pearson_test(b.events_panel(spark, sf_dir)))


def q99_temporal_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panel.design(b.events_panel(spark, sf_dir), 1))


def q100_detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel's residuals under both models."""
    obs = b.orders_panel(spark, sf_dir)
    both = [panel.detrended(obs, 12, m).withColumn("model", F.lit(m)) for m in ("additive", "multiplicative")]
    return both[0].union(both[1]).withColumn("value", F.round("value", 3) + F.lit(0.0))  # totals run into millions


def q101_method_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The methods observed in the base run and all that have a weight."""
    return fusion.universe(spark, fq._base(spark, sf_dir), {"ASIA": 2.0, "PCMCI": 0.5, "EUROPE": -1.0})


def q102_vote_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability by votes alone, without the edges that hard rules forbid."""
    hard = b.rules(spark).where("relation = 'none' AND constraint = 'hard'").select(*EDGE)
    return _rounded(consensus.vote_stability(b.edge_table(spark, sf_dir), len(b.METHODS), fq.BOOT, 3, 0.6, hard))


def q103_canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with columns missing, extra and out of order, brought to the canonical form and checked."""
    rows = fusion.dedup(fq._base(spark, sf_dir)).select("target", F.concat("method", F.lit("!")).alias("extra"), "score", F.col("lag").cast("double").alias("lag"), "source")
    checked = registry.validate(registry.canonical(rows).withColumn("method", F.lit("Vote")), list(b.NODES), "Vote")
    return _rounded(checked.withColumn("no_p_value", F.col("p_value").isNull()).drop("p_value"), "score", places=13)


def q104_month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per month end, months without orders included."""
    orders = b.read(spark, sf_dir, "orders").select(F.last_day(F.to_date("o_orderdate")).alias("ts"))
    ends = orders.agg(F.min("ts").cast("string"), F.max("ts").cast("string")).first()
    counts = orders.groupBy("ts").agg(F.count("*").alias("orders"))
    rows = panel.month_ends(spark, *ends).join(counts, "ts", "left")
    return _rounded(rows.select("t", F.col("ts").cast("string").alias("ts"), F.coalesce("orders", F.lit(0)).alias("orders")))


def q105_local_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every target without parents and with each other variable as its only one."""
    z = panel.zscore(b.events_panel(spark, sf_dir))
    pairs = panel.lagged_covariance(z, 0).where("source <> target")
    own = panel.lagged_covariance(z, 0).where("source = target").select("target", F.col("covariance").alias("vt"))
    rows = pairs.join(own, "target").join(own.toDF("source", "vs"), "source")
    left = F.col("vt") - F.col("covariance") * F.col("covariance") / F.col("vs")
    return _rounded(rows.select("source", "target", local_bic(F.col("vt"), F.col("n"), 0).alias("alone"), local_bic(left, F.col("n"), 1).alias("with_source")))


def q106_temporal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a graph between event types that any mark joins, scored by correlation at their lag."""
    obs = b.events_panel(spark, sf_dir)
    graph = panel.lagged_covariance(panel.zscore(obs), 2).select("source", "target", "lag", F.when(F.col("covariance") > 0.1, "-->").when(F.col("covariance") < -0.1, "o-o").otherwise("").alias("mark"))
    return _rounded(panel.temporal_links(graph, obs))


def q107_evidence_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evidence ranks the edges of each run and method."""
    rows = b.edge_table(spark, sf_dir).withColumn("p_value", F.when(F.col("method") != "ASIA", F.col("p_value")))
    return _rounded(metrics.evidence_mode(rows, ["run_id", "method"]))


def q108_lagged_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lagged covariances of every user group that the methods of the grid fit on."""
    obs = panel.zscore(b.trajectories(spark, sf_dir)).withColumn("run_id", F.lit(0))
    parts = suite.lagged_moments(obs, 2).select("traj_id", "n", "m2", F.sqrt(F.size("m2").cast("double")).cast("int").alias("d"))
    cells = parts.select("traj_id", "n", "d", F.posexplode("m2").alias("at", "value"))
    name = lambda i: F.element_at(F.array(*map(F.lit, sorted(b.EVENTS))), (i % len(b.EVENTS) + 1).cast("int"))
    i, j = F.floor(F.col("at") / F.col("d")), F.col("at") % F.col("d")
    rows = cells.select("traj_id", "n", name(i).alias("one"), F.floor(i / len(b.EVENTS)).alias("lag_one"), name(j).alias("two"), F.floor(j / len(b.EVENTS)).alias("lag_two"), (F.col("value") / (F.col("n") - 1)).alias("covariance"))
    return _rounded(rows)


def q109_robust_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the daily panel to the ranked combinations of three methods, with predictive gates and four bootstrap samples."""
    specs = {k: v for k, v in registry.discover().items() if k in ("PCMCI", "ClassicalGranger", "DYNOTEARS")}
    signed = [k for k, v in specs.items() if v.signed_score]
    found = selection.select_robust(panel.zscore(b.events_panel(spark, sf_dir)), specs, 2, 4, 2, 3, signed, density=0.5, predictive_weight=0.5, parents=1)
    return _rounded(found["ranking"].select("position", "combination", "num_edges", "performance_score"))


def q110_extended_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal edges of the sample and four bootstrap samples, from a cache that held two runs, grew to six in waves of two and is read up to the fifth."""
    obs = panel.zscore(b.events_panel(spark, sf_dir))
    base = lambda last, first: suite.with_bootstraps(obs, last, pq.BLOCK, first=first)
    make = lambda first, last: granger.edges(granger.tests(base(last, first), ["traj_id", "run_id"]), 0.5, ["traj_id", "run_id"])
    runs = checkpoints.RunCache(spark, checkpoints.shared_folder(spark), {"data": checkpoints.fingerprint(obs), "block": pq.BLOCK})
    runs.extend(make, 2)
    runs.extend(make, pq.SAMPLES + 1, 2)
    return _rounded(runs.read(pq.SAMPLES).select("run_id", "source", "target", "lag", "score", "p_value", "joint_p_value", "joint_statistic"))


def q111_ranked_without_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked metrics of every run and method over all pairs of nodes, those without evidence counted as one level of a half."""
    rows = metrics.ranked_pairs(b.edge_table(spark, sf_dir).where("score > 0.3"), b.truth(spark), b.NODES, "one_minus_p_value", 0.5, ["run_id", "method"])
    return _rounded(rows)


def q112_superiority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether absolute scores beat p-values as evidence over the runs: interval of 500 resamples, signed ranks, rates and effect size."""
    pairs = metrics.paired(fq._run_metrics(spark, sf_dir), "ap", "absolute_score", "one_minus_p_value")
    rows = metrics.superiority_row(pairs.withColumn("difference", F.round("difference", 6)), 500)
    return _rounded(rows)


def q113_tensor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step sums and extremes of the user groups' panel, written as a tensor by tasks and read back by the data source."""
    obs, folder = b.trajectories(spark, sf_dir), checkpoints.shared_folder(spark)
    written = tensors.write_tensor(obs, folder, list(b.EVENTS)).agg(F.sum("steps")).first()[0]
    rows = tensors.read_tensor(spark, folder, block=2)
    found = rows.groupBy("traj_id", F.element_at(F.array(*map(F.lit, b.EVENTS)), F.col("node") + 1).alias("variable")).agg(
        F.count("*").alias("steps"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum(F.col("value") * F.col("t")).alias("moment"))
    return _rounded(found.withColumn("written", F.lit(written)))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "q" and name[1:3].isdigit()}


#: Queries over all edges as one run.
ONE_RUN = "q78 q79 q101 q103".split()
_PAIR = "least(source, target) AS pair_lo, greatest(source, target) AS pair_hi"
_RUN = "run_id::BIGINT AS run_id"


def oracle_sql() -> dict[str, str]:
    c = b.ctes
    s = fq.parts()
    d, out = s["d"], fq._OUT
    z = lambda p: pq._Z.format(p=p, eps="0")
    nodes = "node AS (SELECT DISTINCT source AS v FROM edges UNION SELECT DISTINCT target FROM edges)"
    days = "(SELECT *, dense_rank() OVER (ORDER BY t) - 1 AS i FROM ev)"
    full = f"x.v <> y.v"
    marked = f"{d}, mk AS (SELECT *, CASE WHEN p < 0.02 THEN 'tail' WHEN p < 0.05 THEN 'circle' ELSE 'arrow' END AS tail, CASE WHEN score > 0 THEN 'arrow' ELSE 'tail' END AS head FROM d)"
    row = f"{_RUN}, {out}, method"
    gain = pq.oracle_sql()["q32_predictive_gain_l1"]
    granger_ = f"{c('traj')}, z AS ({pq._Z.format(p='traj', eps='0')}), {pq._granger('z')}"
    sampled = "SELECT traj_id FROM (SELECT DISTINCT traj_id FROM traj) ORDER BY md5('42:' || traj_id) LIMIT 2"
    trend = """(sum(value) OVER (PARTITION BY traj_id, variable ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - (lag(value, 6) OVER s + lead(value, 6) OVER s) / 2) / 12"""
    decomposed = f"""w AS (SELECT *, row_number() OVER s - 1 AS pos, count(*) OVER (PARTITION BY traj_id, variable) AS size, min(value) OVER (PARTITION BY traj_id, variable) AS low, {trend} AS raw_trend, lag(value, 6) OVER s IS NOT NULL AND lead(value, 6) OVER s IS NOT NULL AS inside FROM ord WINDOW s AS (PARTITION BY traj_id, variable ORDER BY t)),
      i AS (SELECT * EXCLUDE (raw_trend), CASE WHEN inside THEN raw_trend END AS inn FROM w),
      lines AS (SELECT traj_id, variable, regr_slope(inn, pos) FILTER (pos < 18) AS s0, regr_intercept(inn, pos) FILTER (pos < 18) AS i0, regr_slope(inn, pos) FILTER (pos >= size - 18) AS s1, regr_intercept(inn, pos) FILTER (pos >= size - 18) AS i1 FROM i WHERE inn IS NOT NULL GROUP BY ALL),
      tr AS (SELECT i.*, pos % 12 AS phase, coalesce(inn, CASE WHEN pos < 6 THEN i0 + s0 * pos ELSE i1 + s1 * pos END) AS trend FROM i LEFT JOIN lines USING (traj_id, variable)),
      ph AS (SELECT traj_id, variable, phase, avg(value - trend) AS ra, avg(value / trend) AS rm FROM tr GROUP BY ALL),
      se AS (SELECT traj_id, variable, phase, ra - avg(ra) OVER (PARTITION BY traj_id, variable) AS sa, rm / avg(rm) OVER (PARTITION BY traj_id, variable) AS sm FROM ph)"""
    lagged = "l AS (SELECT traj_id, t, variable AS source, unnest([0, 1, 2]) AS lag, unnest([value, lag(value, 1) {w}, lag(value, 2) {w}]) AS x FROM {p})"
    picked = "round(ensemble_score, 6) AS ensemble_score, round(support_ratio, 6) AS support_ratio"
    forbidden = " OR ".join(f"(source = '{x}' AND target = '{y}'" + ("" if lag is None else f" AND lag = {lag}") + ")" for _, x, y, lag, relation, _, kind, _ in b.RULES if relation == "none" and kind == "hard")
    found = "found AS (SELECT run_id, source, target FROM d GROUP BY run_id, source, target, lag HAVING count(*) >= 4)"
    listed = ", ".join(f"'{x}'" for x in b.NODES)
    q110 = f"""WITH {c('ev')}, z AS ({pq._Z.format(p='ev', eps='0')}), i AS ({pq._index('z')}), s AS (SELECT 0::BIGINT AS run_id, t, variable, value FROM z UNION ALL SELECT run_id, new_t, variable, value FROM z JOIN i USING (t) WHERE run_id < {pq.SAMPLES}),
          {pq._granger('s', 'run_id')}, e AS ({pq._EDGE_ROWS.format(keys='run_id', alpha=0.5)}) SELECT run_id, source, target, lag::BIGINT AS lag, {_r('score', 'p_value', 'joint_p_value', 'joint_statistic')} FROM e"""
    q111 = f"""WITH {c('edges', 'truth')}, n AS (SELECT unnest([{listed}]) AS v), grid AS (SELECT x.v AS pair_lo, y.v AS pair_hi FROM n x JOIN n y ON x.v < y.v), g AS (SELECT DISTINCT run_id, method FROM edges WHERE score > 0.3),
          best AS (SELECT run_id, method, {_PAIR}, max(1 - p_value) AS s FROM edges WHERE score > 0.3 AND source <> target GROUP BY ALL), known AS (SELECT DISTINCT {_PAIR} FROM truth WHERE source <> target),
          every AS (SELECT run_id, method, coalesce(s, 0.5) AS s, (known.pair_lo IS NOT NULL)::INT AS label FROM g CROSS JOIN grid LEFT JOIN best USING (run_id, method, pair_lo, pair_hi) LEFT JOIN known USING (pair_lo, pair_hi)),
          m AS (SELECT *, rank() OVER (PARTITION BY run_id, method ORDER BY s) + (count(*) OVER (PARTITION BY run_id, method, s) - 1) / 2 AS r, sum(label) OVER (PARTITION BY run_id, method ORDER BY s DESC) AS hits, count(*) OVER (PARTITION BY run_id, method ORDER BY s DESC) AS seen FROM every),
          o AS (SELECT run_id::BIGINT AS run_id, method, count(*) AS n, sum(label) AS p, sum(label * r) AS r, sum(label * hits / seen) AS ap FROM m GROUP BY ALL)
          SELECT run_id, method, round((r - p * (p + 1) / 2) / (p * (n - p)), 6) + 0.0 AS auroc, round(ap / p, 6) + 0.0 AS average_precision, round(p / n, 6) + 0.0 AS prevalence FROM o"""
    found = {
        "q110_extended_runs": q110,
        "q113_tensor_round_trip": f"""WITH {c('traj')}, i AS (SELECT dense_rank() OVER (ORDER BY traj_id) - 1 AS traj_id, dense_rank() OVER (PARTITION BY traj_id ORDER BY t) - 1 AS t, variable, value FROM traj)
          SELECT traj_id, variable, steps, {_r('total', 'least', 'most', 'moment')}, written FROM (SELECT traj_id, variable, count(*) AS steps, sum(value) AS total, min(value) AS least, max(value) AS most, sum(value * t) AS moment FROM i GROUP BY ALL),
            (SELECT count(*)::BIGINT AS written FROM (SELECT DISTINCT traj_id, t FROM traj))""",
        "q112_superiority": f"""WITH x AS ({fq.oracle_sql()['q46_paired_differences']}), a AS (SELECT row_number() OVER (ORDER BY trajectory_index) - 1 AS spot, difference AS d FROM x), c AS (SELECT count(*) AS size FROM a),
          picks AS (SELECT draw, ('0x' || substr(md5('42:' || draw || ':' || pick), 1, 12))::BIGINT % size AS spot FROM c, (SELECT unnest(range(500)) AS draw), LATERAL (SELECT unnest(range(size)) AS pick)),
          means AS (SELECT draw, avg(d) AS m FROM picks JOIN a USING (spot) GROUP BY draw), nz AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM a WHERE abs(d) > 1e-8),
          t AS (SELECT count(*) AS n, count(DISTINCT abs(d)) AS levels, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM nz), g AS (SELECT count(*)::DOUBLE AS k FROM nz GROUP BY abs(d)),
          e AS (SELECT CASE WHEN n <= 25 AND levels = n THEN least(1.0, 2 * (SELECT count(*) FROM (SELECT unnest(range((1 << n)::BIGINT)) AS m) WHERE list_sum(list_transform(range(n), lambda i: ((m >> i) & 1) * (i + 1))) <= w) / pow(2, n)) END AS exact_p FROM t)
          SELECT round((SELECT avg(d) FROM a), 6) + 0.0 AS mean_difference, round((SELECT quantile_cont(m, 0.025) FROM means), 6) + 0.0 AS ci_low, round((SELECT quantile_cont(m, 0.975) FROM means), 6) + 0.0 AS ci_high,
            round((SELECT avg((d > 0)::INT) FROM a), 6) + 0.0 AS win_rate, round((SELECT avg((abs(d) <= 1e-8)::INT) FROM a), 6) + 0.0 AS tie_rate, round((SELECT avg(d) / stddev_samp(d) FROM a), 6) + 0.0 AS effect_size,
            n::BIGINT AS n, levels::BIGINT AS levels, round(w, 6) + 0.0 AS w, round((SELECT sum(k * k * k - k) FROM g), 6) + 0.0 AS ties, round(exact_p, 6) + 0.0 AS exact_p FROM t, e""",
        "q111_ranked_without_rows": q111,
        "q68_loaded_tables": f"WITH {c('ev')} SELECT format, 0::BIGINT AS traj_id, i AS t, (DATE '2024-01-01' + t::INT)::DATE::VARCHAR AS day, variable, {_r('value')} FROM {days} CROSS JOIN (SELECT unnest(['csv', 'parquet']) AS format) WHERE variable IN ('view', 'click')",
        "q69_resumed_study": f"WITH {c('traj')}, tot AS (SELECT traj_id, sum(value) AS total FROM traj GROUP BY ALL), m AS (SELECT *, avg(total) OVER () AS mean FROM tot), r AS (SELECT unnest([false, true]) AS retry_failed) SELECT traj_id::BIGINT AS trajectory_index, retry_failed, {_r('total')} FROM m CROSS JOIN r WHERE total <= mean OR (retry_failed AND total < 1.05::DOUBLE * mean)",
        "q70_cached_edges": f"WITH {d} SELECT {row}, round(score, 11) + 0.0 AS score, round(p, 6) + 0.0 AS p_value FROM d",
        "q71_complete_steps": f"WITH w AS (SELECT floor(date_diff('day', DATE '1992-01-01', l_shipdate::DATE) / 7)::BIGINT AS t, l_returnflag || l_linestatus AS variable, sum(l_quantity) AS value FROM lineitem GROUP BY ALL), k AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM w GROUP BY t HAVING count(*) = (SELECT count(DISTINCT variable) FROM w)) SELECT 0::BIGINT AS traj_id, i AS t, variable, {_r('value')} FROM w JOIN k USING (t)",
        "q72_restricted_relations": f"WITH {d} SELECT {row}, round(score, 11) + 0.0 AS score, round(p, 6) + 0.0 AS p_value FROM d WHERE target = 'BUILDING' AND source <> target",
        "q73_objective_relations": f"""WITH {c('edges', 'truth')}, {nodes}, e AS (SELECT x.v AS source, y.v AS target FROM node x JOIN node y ON {full}) SELECT 'full_structure' AS objective, * FROM e UNION ALL SELECT 'causes_of_target', * FROM e WHERE target = 'BUILDING' UNION ALL SELECT 'effects_of_source', * FROM e WHERE source = '2-HIGH'
          UNION ALL SELECT 'compare_directions', * FROM e WHERE (source, target) IN (('2-HIGH', 'BUILDING'), ('BUILDING', '2-HIGH')) UNION ALL SELECT 'specific_relations', e.* FROM e SEMI JOIN truth USING (source, target)""",
        "q74_endpoint_marks": f"""WITH {marked} SELECT 'arrow' AS graph, {row} FROM mk WHERE tail = 'tail' UNION ALL SELECT 'ges', {row} FROM mk WHERE tail = 'tail' UNION ALL SELECT 'fci', {row} FROM mk WHERE tail = 'tail' AND head = 'arrow' UNION ALL SELECT 'fci_partial', {row} FROM mk WHERE tail IN ('tail', 'circle') AND head = 'arrow'""",
        "q75_pair_maxima": f"WITH {granger_} SELECT least(source, target) AS source, greatest(source, target) AS target, round(max(greatest(abs(b1), abs(b2))), 6) + 0.0 AS score, round(min(least(p1, p2)), 6) + 0.0 AS p_value FROM tested GROUP BY ALL",
        "q76_gain_rank": f"""WITH raw AS ({gain.replace('round((e0 - e1) / greatest(e0, 1e-12), 6) + 0.0 AS gain', '(e0 - e1) / greatest(e0, 1e-12) AS gain')}), g AS (SELECT source, target, avg(gain) AS m, coalesce(stddev_samp(gain), 0) AS sd, count(*) AS k, avg((gain > 0)::INT) AS pos FROM raw GROUP BY ALL), e AS (SELECT *, sd / sqrt(k) AS se, greatest(0.0, m - 0.5 * sd / sqrt(k)) AS gain FROM g),
          r AS (SELECT *, CASE WHEN gain > 0 THEN (rank() OVER (PARTITION BY gain > 0 ORDER BY gain) + (count(*) OVER (PARTITION BY gain > 0, gain) - 1) / 2) / count(*) OVER (PARTITION BY gain > 0) ELSE 0.0 END AS rk FROM e)
          SELECT source, target, 1::BIGINT AS lag, round(m, 6) + 0.0 AS predictive_gain_mean, round(sd, 6) + 0.0 AS predictive_gain_std, round(pos, 6) + 0.0 AS predictive_positive_split_ratio, round(se, 6) + 0.0 AS predictive_gain_standard_error, round(gain, 6) + 0.0 AS predictive_gain, round(rk, 6) + 0.0 AS predictive_rank, 0.8::DOUBLE AS pre_validation_ensemble_score, round(0.8::DOUBLE * (0.25 + 0.75 * sqrt(rk)), 6) + 0.0 AS ensemble_score FROM r""",
        "q77_chronological_holdout": f"WITH {c('traj')} SELECT traj_id, t, variable, {_r('value')}, CASE WHEN row_number() OVER (PARTITION BY traj_id, variable ORDER BY t) - 1 < floor(count(*) OVER (PARTITION BY traj_id, variable) * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS part FROM traj",
        "q78_vote_order": f"WITH {d}, v AS (SELECT {fq._KEY}, count(*) AS votes, avg(score) AS mean_score FROM d WHERE run_id = 0 GROUP BY ALL) SELECT row_number() OVER (ORDER BY votes DESC, mean_score DESC NULLS LAST, {fq._KEY}) AS position, {out}, votes FROM v",
        "q79_probability_order": f"WITH {s['predicted']}, v AS (SELECT {fq._KEY}, votes, mean_score, round(edge_probability, 6) + 0.0 AS edge_probability FROM base) SELECT row_number() OVER (ORDER BY edge_probability DESC, votes DESC, mean_score DESC NULLS LAST, {fq._KEY}) AS position, {out}, votes, edge_probability FROM v",
        "q80_consensus_order": f"WITH {s['summary']}, v AS (SELECT {fq._KEY}, votes, {_r('edge_probability', 'bootstrap_probability')} FROM blended) SELECT row_number() OVER (ORDER BY edge_probability DESC, bootstrap_probability DESC, votes DESC, {fq._KEY}) AS position, {out}, edge_probability, bootstrap_probability, votes FROM v",
        "q81_stability_order": f"WITH st AS ({fq.oracle_sql()['q38_stability_selection']}) SELECT row_number() OVER (ORDER BY selection_frequency DESC, appearance_frequency DESC, {fq._KEY}) AS position, {fq._KEY}, selection_frequency, appearance_frequency FROM st",
        "q82_granger_order": f"WITH gr AS ({pq.oracle_sql()['q13_granger_edges']}) SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY target, source, lag) AS position, {fq._KEY} FROM gr",
        "q83_parent_order": f"WITH {s['summary']}, v AS (SELECT {fq._KEY}, {_r('ensemble_score')} FROM blended) SELECT target, row_number() OVER (PARTITION BY target ORDER BY ensemble_score DESC, source, lag) AS position, source, lag::BIGINT AS lag, ensemble_score FROM v",
        "q84_union_of_methods": f"""WITH gr AS ({pq.oracle_sql()['q13_granger_edges']}), {c('ord')}, z AS ({z('ord')}), r AS (SELECT x.variable AS source, y.variable AS target, count(*) AS n, corr(x.value, y.value) AS r FROM z x JOIN z y ON x.t = y.t AND x.variable < y.variable GROUP BY ALL), tt AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS nu FROM r)
          SELECT traj_id, 'ClassicalGranger' AS method, source, target, lag, score, p_value, joint_p_value, joint_statistic FROM gr UNION ALL SELECT 0, 'Pearson', source, target, 0, round(r, 6) + 0.0, round({pq._student('t', 'nu')}, 6) + 0.0, NULL, NULL FROM tt""",
        "q85_pair_checks": f"WITH {d}, g AS (SELECT run_id, {fq._KEY}, avg(score) AS score FROM d GROUP BY ALL), p AS (SELECT run_id, {_PAIR}, (score > 0)::INT AS label FROM g) SELECT {_RUN}, count(*) - count(DISTINCT (pair_lo, pair_hi)) AS repeated_pairs, count(*) FILTER (pair_lo = pair_hi) AS self_pairs, 0::BIGINT AS invalid_scores, count(DISTINCT label) AS classes FROM p GROUP BY run_id",
        "q86_first_of_pair": f"WITH {d}, p AS (SELECT *, {_PAIR} FROM d) SELECT {_RUN}, pair_lo, pair_hi, lag::BIGINT AS lag, method, source, round(score, 11) + 0.0 AS score FROM p QUALIFY row_number() OVER (PARTITION BY run_id, pair_lo, pair_hi ORDER BY lag, method, source, target) = 1",
        "q87_sampled_trajectories": f"WITH {c('traj')} SELECT DISTINCT traj_id FROM (SELECT traj_id FROM (SELECT DISTINCT traj_id FROM traj) WHERE traj_id NOT IN ({sampled}) ORDER BY md5('2029:' || traj_id) LIMIT 5)",
        "q88_size_summary": f"""WITH {c('edges', 'methods')}, {s['nodes']}, {s['known']}, {s['candidates']}, mx AS (SELECT k.k, cd.run_id, cd.pair_lo, cd.pair_hi, round(sum(score) / any_value(k.k), 6) + 0.0 AS score, max(label) AS label FROM cd JOIN (SELECT unnest(range(1, {len(b.METHODS) + 1})) AS k) k ON cd.method_ord < k.k GROUP BY k.k, cd.run_id, cd.pair_lo, cd.pair_hi),
          lv AS (SELECT k, run_id, score, count(*) AS n, sum(label) AS pos FROM mx GROUP BY ALL), cu AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS hits FROM lv WINDOW w AS (PARTITION BY k, run_id ORDER BY score DESC)), ap AS (SELECT k, run_id, round(sum(pos * hits / seen) / sum(pos), 6) AS ap FROM cu GROUP BY ALL), sm AS (SELECT k AS member_count, avg(ap) AS mean_ap, stddev_samp(ap) AS std_ap FROM ap GROUP BY k)
          SELECT member_count, {_r('mean_ap', 'std_ap')}, row_number() OVER (ORDER BY mean_ap DESC, member_count) AS position FROM sm""",
        "q89_described_strategies": f"WITH {c('edges')}, {s['nodes']}, {s['known']}, a AS (WITH {s['run_pairs']('abs(score)')}, {s['auc']} SELECT 'absolute_score' AS strategy, g / p AS ap FROM au UNION ALL SELECT * FROM (WITH {s['run_pairs']('1 - p_value')}, {s['auc']} SELECT 'one_minus_p_value', g / p FROM au)) SELECT strategy, round(avg(ap), 6) + 0.0 AS ap_mean, round(stddev_samp(ap), 6) + 0.0 AS ap_std, round(median(ap), 6) + 0.0 AS ap_median FROM a GROUP BY strategy",
        "q90_combination_counts": f"WITH {d}, v AS (SELECT run_id, {fq._KEY}, string_agg(method, ' + ' ORDER BY method) AS combination FROM d GROUP BY ALL) SELECT combination, count(*) AS count FROM v GROUP BY combination",
        "q91_weight_maps": f"WITH {c('edges', 'methods')}, {fq._SIMILAR}, {fq._COMBOS}, {fq._weights('0.0')} SELECT combo_id, method, {_r('adaptive_weight')} FROM weighed",
        "q92_baselines": f"""WITH {d}, {s['nodes']}, {s['known']}, {found}, rk AS (SELECT run_id, pair_lo, pair_hi, row_number() OVER (PARTITION BY run_id ORDER BY md5('42:' || run_id || ':' || pair_lo || ':' || pair_hi)) AS r FROM (SELECT DISTINCT run_id FROM d) CROSS JOIN grid_p),
          p AS (SELECT DISTINCT 'VOTES' AS strategy, run_id AS key, {_PAIR} FROM found UNION ALL SELECT 'ALL_PAIRS', run_id, pair_lo, pair_hi FROM rk UNION ALL SELECT 'RANDOM_DENSITY', run_id, pair_lo, pair_hi FROM rk WHERE r <= (SELECT count(*) FROM tp)),
          k AS (SELECT DISTINCT strategy, key FROM p), j AS (SELECT strategy, key, x.pair_lo AS a, tp.pair_lo AS t FROM p x LEFT JOIN tp USING (pair_lo, pair_hi)), m AS (SELECT strategy, key, NULL AS a, tp.pair_lo AS t FROM k CROSS JOIN tp WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.strategy = k.strategy AND p.key = k.key AND p.pair_lo = tp.pair_lo AND p.pair_hi = tp.pair_hi)),
          n AS (SELECT strategy, key, count(*) FILTER (a IS NOT NULL AND t IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (a IS NULL) AS fn FROM (SELECT * FROM j UNION ALL SELECT * FROM m) GROUP BY ALL)
          SELECT strategy, key::BIGINT AS key, {s['prf']}, round((tp + fn) / 45.0, 6) + 0.0 AS prevalence, round(2 * ((tp + fn) / 45.0) / (1 + (tp + fn) / 45.0), 6) + 0.0 AS all_pairs_f1 FROM n""",
        "q93_ablations": f"""WITH {s['summary']}, v AS (SELECT {fq._KEY}, {picked} FROM blended), pr AS (SELECT *, {_PAIR} FROM v), best AS (SELECT pair_lo, pair_hi, max(CASE WHEN ensemble_score > 0 THEN ensemble_score END) AS ps FROM pr GROUP BY ALL), rk AS (SELECT *, row_number() OVER (ORDER BY ps DESC NULLS LAST, pair_lo, pair_hi) AS rk FROM best)
          SELECT 'hard_consensus' AS ablation, {out} FROM v WHERE ensemble_score >= 0.5 AND support_ratio >= 0.5 UNION ALL SELECT 'soft_vote', {out} FROM v WHERE ensemble_score >= 0.5 UNION ALL SELECT 'no_gate_top_k', {out} FROM pr JOIN rk USING (pair_lo, pair_hi) WHERE ps IS NOT NULL AND rk <= 18""",
        "q94_score_table_checks": f"""WITH {c('edges', 'methods')}, {s['nodes']}, {s['known']}, {s['candidates']}, ok AS (SELECT * FROM cd WHERE score > 0), pr AS (SELECT run_id, pair_lo, pair_hi, count(DISTINCT method) AS k, max(label) AS label FROM ok GROUP BY ALL), per AS (SELECT run_id, count(*) FILTER (k < (SELECT count(DISTINCT method) FROM ok)) AS n, (max(label) = min(label))::INT AS single FROM pr GROUP BY ALL)
          SELECT coalesce(sum(n), 0)::BIGINT AS incomplete_pairs, 0::BIGINT AS doubled_scores, 0::BIGINT AS invalid_scores, 0::BIGINT AS invalid_labels, coalesce(sum(single), 0)::BIGINT AS single_class_trajectories FROM per""",
        "q95_calibrated_edges": f"""WITH {d}, {c('methods')}, {s['nodes']}, {s['known']}, {s['candidates']}, ps AS (SELECT run_id, pair_lo, pair_hi, sum((method_ord + 1) / 15.0 * score) AS score FROM cd GROUP BY ALL), pk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, pair_lo, pair_hi) AS rk FROM ps), e AS (SELECT run_id, {fq._KEY}, count(*) / 5 AS pre, {_PAIR} FROM d GROUP BY run_id, source, target, lag)
          SELECT e.run_id::BIGINT AS traj_id, {out}, round(pre, 6) + 0.0 AS pre_calibration_ensemble_score, round(score, 6) + 0.0 AS ensemble_score, rk AS calibrated_pair_rank, rk <= 9 AS ensemble_selected FROM e JOIN pk USING (run_id, pair_lo, pair_hi)""",
        "q96_feasible_k": f"WITH by_k AS ({fq.oracle_sql()['q49_top_k_f1']}), ok AS (SELECT * FROM by_k WHERE recall >= 0.2::DOUBLE - 1e-12 OR (k = 10 AND NOT EXISTS (SELECT 1 FROM by_k WHERE recall >= 0.2::DOUBLE - 1e-12))) SELECT k, row_number() OVER (ORDER BY f1 DESC, k) AS position, precision, recall, f1, shd FROM ok",
        "q97_consistency_heatmap": f"WITH sim AS ({fq.oracle_sql()['q26_method_consistency']}) SELECT method_l, " + ", ".join(f"max(CASE WHEN method_r = '{m}' THEN jaccard END) AS \"{m}\"" for m in b.METHODS) + " FROM sim GROUP BY method_l",
        "q98_pearson_test": f"WITH {c('ev')}, r AS (SELECT x.variable AS source, y.variable AS target, count(*) AS n, corr(x.value, y.value) AS r FROM ev x JOIN ev y ON x.t = y.t AND x.variable < y.variable GROUP BY ALL), tt AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS nu FROM r) SELECT source, target, n, {_r('r')}, round({pq._student('t', 'nu')}, 6) + 0.0 AS p_value FROM tt",
        "q99_temporal_design": f"WITH {c('ev')}, l AS (SELECT *, lag(value, 1) {pq._W} AS l1 FROM ev) SELECT traj_id, t, " + ", ".join(f"round(max(CASE WHEN variable = '{v}' THEN value END), 6) + 0.0 AS {v}__t, round(max(CASE WHEN variable = '{v}' THEN l1 END), 6) + 0.0 AS {v}__lag_1" for v in b.EVENTS) + " FROM l WHERE l1 IS NOT NULL GROUP BY traj_id, t HAVING count(*) = 5",
        "q100_detrended": f"""WITH {c('ord')}, {decomposed} SELECT traj_id, t, variable, round(CASE WHEN size >= 24 THEN value - trend - sa ELSE value END, 3) + 0.0 AS value, 'additive' AS model FROM tr JOIN se USING (traj_id, variable, phase)
          UNION ALL SELECT traj_id, t, variable, round(CASE WHEN size >= 24 AND low > 0 THEN value / trend / sm ELSE value END, 3) + 0.0, 'multiplicative' FROM tr JOIN se USING (traj_id, variable, phase)""",
        "q101_method_universe": f"WITH {c('edges')}, m AS (SELECT DISTINCT method FROM edges WHERE run_id = 0 UNION SELECT unnest(['ASIA', 'PCMCI', 'EUROPE'])) SELECT method, CASE method WHEN 'ASIA' THEN 2.0 WHEN 'PCMCI' THEN 0.5 WHEN 'EUROPE' THEN 0.0 ELSE 1.0 END::DOUBLE AS weight FROM m",
        "q102_vote_stability": f"""WITH {c('edges')}, v AS (SELECT run_id, {fq._KEY}, count(DISTINCT method) AS votes FROM edges WHERE run_id > 0 GROUP BY ALL HAVING count(DISTINCT method) >= 3), k AS (SELECT {fq._KEY}, count(*) AS n, avg(votes / 5) AS m FROM v WHERE NOT ({forbidden}) GROUP BY ALL)
          SELECT {out}, n AS selected_count, round(m, 6) + 0.0 AS mean_support, round(n / {fq.BOOT}, 6) + 0.0 AS selection_frequency, round(n / {fq.BOOT}, 6) + 0.0 AS appearance_frequency, n / {fq.BOOT} >= 0.6::DOUBLE AS stability_selected FROM k""",
        "q103_canonical_edges": f"WITH {d} SELECT {out}, round(score, 13) + 0.0 AS score, 'Vote' AS method, method || '!' AS extra, TRUE AS no_p_value FROM d WHERE run_id = 0",
        "q104_month_ends": "WITH o AS (SELECT last_day(o_orderdate::DATE) AS ts FROM orders), m AS (SELECT last_day(unnest(generate_series(date_trunc('month', (SELECT min(ts) FROM o)), date_trunc('month', (SELECT max(ts) FROM o)), INTERVAL 1 MONTH))::DATE) AS ts) SELECT row_number() OVER (ORDER BY ts) - 1 AS t, ts::VARCHAR AS ts, (SELECT count(*) FROM o WHERE o.ts = m.ts) AS orders FROM m",
        "q105_local_bic": f"WITH {c('ev')}, z AS ({z('ev')}), p AS (SELECT x.variable AS source, y.variable AS target, count(*) AS n, covar_pop(x.value, y.value) AS cov, var_pop(x.value) AS vs, var_pop(y.value) AS vt FROM z x JOIN z y ON x.t = y.t AND x.variable <> y.variable GROUP BY ALL) SELECT source, target, round(-0.5 * n * (1 + ln(vt)) - 0.5 * ln(n), 6) + 0.0 AS alone, round(-0.5 * n * (1 + ln(greatest(vt - cov * cov / vs, 2.220446049250313e-16))) - ln(n), 6) + 0.0 AS with_source FROM p",
        "q106_temporal_links": f"""WITH {c('ev')}, z AS ({z('ev')}), {lagged.format(w=pq._W, p='z')}, cv AS (SELECT source, variable AS target, lag, covar_pop(x, value) AS cv FROM l JOIN z USING (traj_id, t) WHERE x IS NOT NULL GROUP BY ALL), raw AS (SELECT traj_id, t, variable AS source, unnest([0, 1, 2]) AS lag, unnest([value, lag(value, 1) {pq._W}, lag(value, 2) {pq._W}]) AS x FROM ev)
          SELECT source, variable AS target, lag::BIGINT AS lag, count(*) AS n, round(corr(x, value), 6) + 0.0 AS score FROM raw JOIN ev USING (traj_id, t) SEMI JOIN (SELECT source AS s, target AS g, lag AS k FROM cv WHERE abs(cv) > 0.1) ok ON raw.source = ok.s AND ev.variable = ok.g AND raw.lag = ok.k WHERE x IS NOT NULL GROUP BY ALL""",
        "q108_lagged_moments": f"""WITH {c('traj')}, z AS ({z('traj')}), l AS (SELECT traj_id, t, variable, unnest([0, 1, 2]) AS lag, unnest([value, lag(value, 1) {pq._W}, lag(value, 2) {pq._W}]) AS x FROM z), k AS (SELECT * FROM l SEMI JOIN (SELECT traj_id AS g, t AS u FROM l WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) = 15) ok ON l.traj_id = ok.g AND l.t = ok.u)
          SELECT p.traj_id, count(*) AS n, p.variable AS one, p.lag::BIGINT AS lag_one, q.variable AS two, q.lag::BIGINT AS lag_two, round(covar_samp(p.x, q.x), 6) + 0.0 AS covariance FROM k p JOIN k q ON p.traj_id = q.traj_id AND p.t = q.t GROUP BY ALL""",
        "q107_evidence_modes": f"WITH {c('edges')} SELECT DISTINCT {_RUN}, method, CASE WHEN method = 'ASIA' THEN 'absolute_score' ELSE 'one_minus_p_value' END AS evidence FROM edges",
    }
    return {k: fq.as_one_run(v) if k.split("_")[0] in ONE_RUN else v for k, v in found.items()}
