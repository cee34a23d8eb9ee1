"""Method combinations: enumeration, metrics, ranking. All combinations are rows of one plan."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.checkpoints import RunCache, fingerprint, shared_folder, stored
from . import suite
from .consensus import adaptive_weights, blended, consistency, stability_selection
from .expert import apply_rules
from .fusion import EDGE, compact, probabilities
from .predictive import gate
from .ranks import placed
from .structure import ranked_structure, selected


def combos(spark: SparkSession, methods: Sequence[tuple[str, float]], least: int = 2, most: int | None = None) -> DataFrame:
    """(combo_id, size, combination, method, weight, method_ord) of all subsets by size; ids keep the order of enumeration."""
    most = len(methods) if most is None else most
    if not 1 <= least <= most <= len(methods):
        raise ValueError("sizes lie between 1 and the number of methods")
    rows, number = [], 0
    for size in range(least, most + 1):
        for chosen in combinations(range(len(methods)), size):
            label = " + ".join(methods[i][0] for i in chosen)
            rows += [(number, size, label, methods[i][0], float(methods[i][1]), i) for i in chosen]
            number += 1
    return spark.createDataFrame(rows, "combo_id int, size int, combination string, method string, weight double, method_ord int")


def per_combo(edges: DataFrame, combo: DataFrame) -> DataFrame:
    """The edges of each combination's methods."""
    return edges.join(combo.select("combo_id", "method"), "method")


def evaluate(
    edges: DataFrame, runs: DataFrame, combo: DataFrame, signed: Sequence[str], bootstraps: int, min_votes: int = 1, adaptive: bool = True, rules: DataFrame | None = None,
    density: float | None = None, nodes: int | None = None, gain_rows: DataFrame | None = None, predictive: tuple[float, float, float] = (0.75, 0.0, 0.5), **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, stability, weights) of all combinations over the base run and all bootstrap runs.

    gain_rows: predictive gains of edges, by which scores are damped before rules and structure; predictive: weight, penalty and
    exponent of that gate.
    """
    weights = stored(adaptive_weights(edges, runs, combo))
    used = weights.select("combo_id", "method", F.col("adaptive_weight").alias("weight")) if adaptive else combo.select("combo_id", "method", "weight")
    rows = per_combo(edges, combo)
    base = probabilities(rows.where("run_id = 0"), used, signed, min_votes, by=["combo_id"], universe_by=["combo_id"])
    summary = blended(base, edges, used.join(combo.select("combo_id", "method", "method_ord"), ["combo_id", "method"]), bootstraps, **options)
    if gain_rows is not None and predictive[0] > 0:
        summary = gate(summary, gain_rows, *predictive)
    if rules is not None:
        summary = apply_rules(summary, rules)
    if density is not None:
        summary = ranked_structure(summary, density, nodes, ["combo_id"])
    summary = stored(summary)
    each = probabilities(rows.where("run_id > 0"), used, signed, min_votes, by=["combo_id", "run_id"], universe_by=["combo_id"])
    return summary, stability_selection(each, bootstraps), weights


def metrics(summary: DataFrame, weights: DataFrame, edges: DataFrame, runs: DataFrame, combo: DataFrame, variables: int, threshold: float = 0.5, stable: float = 0.6) -> DataFrame:
    """Scalar metrics and the performance score of each combination, also of those without edges."""
    chosen = selected(summary, threshold).groupBy("combo_id").agg(
        F.count("*").alias("num_edges"), F.avg("edge_probability").alias("mean_edge_probability"), F.avg("confidence").alias("mean_confidence"), F.avg("uncertainty").alias("mean_uncertainty"),
        F.avg("bootstrap_probability").alias("mean_stability"), F.avg((F.col("bootstrap_probability") >= stable).cast("double")).alias("stable_edge_ratio"),
    )
    candidates = summary.groupBy("combo_id").agg(F.count("*").alias("num_candidate_edges"))
    agree = consistency(edges, runs)
    left, right = (combo.select("combo_id", F.col("method").alias(f"method_{s}"), F.col("method_ord").alias(f"ord_{s}")) for s in "lr")
    agreement = left.join(right, "combo_id").where("ord_l < ord_r").join(agree, ["method_l", "method_r"]).groupBy("combo_id").agg(F.avg("jaccard").alias("mean_method_agreement"))
    of_methods = weights.groupBy("combo_id").agg(F.avg("bootstrap_stability").alias("mean_method_stability"), F.avg("diversity").alias("mean_method_diversity"))
    lag = summary.agg(F.max("lag").alias("max_lag"))
    head = combo.groupBy("combo_id", "combination").agg(F.count("*").alias("num_methods")).crossJoin(F.broadcast(lag))  # one row
    rows = head.join(chosen, "combo_id", "left").join(candidates, "combo_id", "left").join(agreement, "combo_id", "left").join(of_methods, "combo_id", "left")
    rows = rows.fillna(0, ["num_edges", "num_candidate_edges", "mean_edge_probability", "mean_confidence", "mean_stability", "stable_edge_ratio"]).fillna(1.0, ["mean_uncertainty", "mean_method_agreement"])
    possible = float(variables * (variables - 1)) * F.greatest(F.coalesce("max_lag", F.lit(1)), F.lit(1))
    rows = rows.withColumn("edge_density", F.least(F.col("num_edges") / possible, F.lit(1.0)))
    score = 0.40 * F.col("mean_stability") + 0.20 * F.col("mean_confidence") + 0.15 * F.col("mean_edge_probability") + 0.15 * F.col("stable_edge_ratio") + 0.10 * (1 - F.sqrt("edge_density"))
    return rows.withColumn("performance_score", F.when(F.col("num_edges") > 0, score).otherwise(0.0)).drop("max_lag")


def ranking_order() -> list:
    return [F.desc("performance_score"), F.desc("mean_stability"), F.desc("mean_confidence"), F.col("combo_id")]


def best(ranking: DataFrame, summary: DataFrame) -> DataFrame:
    """The summary rows of the best combination."""
    return summary.join(ranking.orderBy(*ranking_order()).limit(1).select("combo_id"), "combo_id", "left_semi").select("combo_id", *EDGE, "edge_probability", "ensemble_score", "bootstrap_probability", "dominant_method")


def _runs(obs: DataFrame, specs: dict, max_lag: int, bootstraps: int, block: int | None, seed: int, known: tuple[DataFrame, int] | None, cache: str | None, wave: int, seconds: float | None) -> tuple[DataFrame, int]:
    """(edges of run 0 and the bootstrap runs that there are, number of bootstrap runs): those known or cached, cut or extended."""
    make = lambda first, last: compact(suite.fit_grid(suite.with_bootstraps(obs, last, block, seed, first), specs, max_lag))
    if known is not None:
        edges, have = known
        if have > bootstraps:
            return stored(edges.where(F.col("run_id") <= bootstraps)), bootstraps
        if have == bootstraps:
            return edges, have
        return stored(edges.unionByName(make(have + 1, bootstraps), allowMissingColumns=True)), bootstraps
    if cache is None:
        cache = shared_folder(obs.sparkSession)
    config = {"data": fingerprint(obs.select("traj_id", "t", "variable", "value")), "max_lag": max_lag, "block": block, "seed": seed, "methods": {k: s.default_kwargs for k, s in specs.items()}}
    runs = RunCache(obs.sparkSession, cache, config)
    have = runs.extend(make, bootstraps + 1, wave, seconds)
    return runs.read(have), have - 1


def select_robust(
    obs: DataFrame, specs: dict, max_lag: int, bootstraps: int = 8, least: int = 2, most: int = 3, signed: Sequence[str] = (), min_votes: int = 1, rules: DataFrame | None = None,
    density: float | None = None, predictive_weight: float = 0.0, parents: int = 0, block: int | None = None, seed: int = 42, known: tuple[DataFrame, int] | None = None,
    cache: str | None = None, wave: int = 0, seconds: float | None = None,
) -> dict:
    """From one panel to its best method combination: every method on the sample and its bootstrap samples, all combinations
    of least to most methods evaluated in one plan, ranked, and the best one's edges.

    known: edges (run_id, method, ...) of run 0 and so many bootstrap runs, which are used as they are: if they are more than
    bootstraps, the first; if fewer, the others are fitted, as a whole fit would have drawn them. cache: a folder of runs of
    this data and these settings, used and extended likewise, in waves of so many runs; after so many seconds no wave begins
    any more, and the runs that there are count.

    Returns edges, bootstraps (the number of runs used), weights, summary, stability, ranking (best first by position) and best.
    """
    from .predictive import gains

    if obs.select("traj_id").distinct().count() != 1:
        raise ValueError("a combination is chosen for one trajectory")
    names = suite.variables(obs)
    edges, bootstraps = _runs(obs, specs, max_lag, bootstraps, block, seed, known, cache, wave, seconds)
    runs = obs.sparkSession.range(bootstraps + 1).select(F.col("id").cast("int").alias("run_id")).withColumn("method", F.explode(F.array(*map(F.lit, specs))))
    combo = combos(obs.sparkSession, [(k, s.weight) for k, s in specs.items()], least, most)
    found = gains(obs, edges.where("run_id = 0").withColumn("ensemble_score", F.abs("score")), max_lag, parents=parents) if predictive_weight > 0 else None
    summary, stable, weights = evaluate(edges, runs, combo, signed, bootstraps, min_votes, rules=rules, density=density, nodes=len(names), gain_rows=found, predictive=(predictive_weight, 0.0, 0.5))
    scored = stored(metrics(summary, weights, edges, runs, combo, len(names)))
    ranking = placed(scored, ranking_order())
    return {"edges": edges, "bootstraps": bootstraps, "weights": weights, "summary": summary, "stability": stable, "ranking": ranking, "best": best(scored, summary)}
