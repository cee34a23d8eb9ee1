"""Agreement of methods over bootstrap runs: consistency, stability, adaptive weights, evidence and blended scores.

What doesn't depend on the method combination (evidence, run similarity) is computed once and joined to combinations.
runs: (run_id, method) lists every fit, so that a fit without edges differs from a missing one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import clip, finite, valid_p
from .fusion import EDGE, dedup


def edge_sets(edges: DataFrame) -> DataFrame:
    """Distinct edges of each run and method; edges with missing parts go, self-links stay."""
    return edges.select("run_id", "method", *EDGE).dropna(subset=EDGE).distinct()


def _similar(left: DataFrame, right: DataFrame, on: Sequence[str], pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jaccard of edge sets for pairs(keys, n_left, n_right): shared edges by an equi-join on the edge."""
    shared = left.join(right, [*on, *EDGE]).groupBy(*keys).agg(F.count("*").alias("shared"))
    union = F.col("n_left") + F.col("n_right") - F.coalesce("shared", F.lit(0))
    joined = pairs.join(shared, list(keys), "left")
    return joined.withColumn("jaccard", F.when(union > 0, F.coalesce("shared", F.lit(0)) / union)).select(*keys, "jaccard")


def sizes(edges: DataFrame, runs: DataFrame) -> DataFrame:
    count = edge_sets(edges).groupBy("run_id", "method").agg(F.count("*").alias("n"))
    return runs.join(count, ["run_id", "method"], "left").select("run_id", "method", F.coalesce("n", F.lit(0)).alias("n"))


def consistency(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """(method_l, method_r, jaccard) of the base run, both ways and with the diagonal; two empty sets agree fully."""
    base, n = edge_sets(edges).where("run_id = 0"), sizes(edges, runs).where("run_id = 0")
    pairs = n.select("run_id", F.col("method").alias("method_l"), F.col("n").alias("n_left")).join(n.select("run_id", F.col("method").alias("method_r"), F.col("n").alias("n_right")), "run_id")
    found = _similar(base.withColumnRenamed("method", "method_l"), base.withColumnRenamed("method", "method_r"), ["run_id"], pairs, ["method_l", "method_r"])
    return found.withColumn("jaccard", F.coalesce("jaccard", F.lit(1.0)))


def run_similarity(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """(method_l, method_r, similarity): mean over runs of the Jaccard of two methods; runs where both are empty don't count."""
    sets, n = edge_sets(edges), sizes(edges, runs)
    pairs = n.select("run_id", F.col("method").alias("method_l"), F.col("n").alias("n_left")).join(n.select("run_id", F.col("method").alias("method_r"), F.col("n").alias("n_right")), "run_id").where("method_l <> method_r")
    found = _similar(sets.withColumnRenamed("method", "method_l"), sets.withColumnRenamed("method", "method_r"), ["run_id"], pairs, ["run_id", "method_l", "method_r"])
    return found.groupBy("method_l", "method_r").agg(F.avg("jaccard").alias("similarity"))


def stability(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """(method, bootstrap_stability, mean_edge_count): mean Jaccard over all pairs of runs of a method; none gives 0."""
    sets, n = edge_sets(edges), sizes(edges, runs)
    pairs = n.select("method", F.col("run_id").alias("run_l"), F.col("n").alias("n_left")).join(n.select("method", F.col("run_id").alias("run_r"), F.col("n").alias("n_right")), "method").where("run_l < run_r")
    found = _similar(sets.withColumnRenamed("run_id", "run_l"), sets.withColumnRenamed("run_id", "run_r"), ["method"], pairs, ["method", "run_l", "run_r"])
    mean = found.groupBy("method").agg(F.avg("jaccard").alias("s"))
    counts = n.groupBy("method").agg(F.avg("n").alias("mean_edge_count"))
    return counts.join(mean, "method", "left").select("method", F.coalesce("s", F.lit(0.0)).alias("bootstrap_stability"), "mean_edge_count")


def adaptive_weights(
    edges: DataFrame, runs: DataFrame, combos: DataFrame, power: float = 1.0, diversity_bonus: float = 0.15, density_penalty: float = 0.5,
    least: float = 0.05, redundancy_penalty: float = 0.0,
) -> DataFrame:
    """Weight diagnostics per combination and method, from combos(combo_id, method, weight)."""
    similar = run_similarity(edges, runs)
    others = combos.select("combo_id", F.col("method").alias("method_l")).join(combos.select("combo_id", F.col("method").alias("method_r")), "combo_id").where("method_l <> method_r")
    cross = others.join(similar, ["method_l", "method_r"], "left").groupBy("combo_id", F.col("method_l").alias("method")).agg(F.avg("similarity").alias("redundancy"))
    rows = combos.join(stability(edges, runs), "method").join(cross, ["combo_id", "method"], "left")
    middle = rows.groupBy("combo_id").agg(F.median(F.when(F.col("mean_edge_count") > 0, F.col("mean_edge_count"))).alias("middle"))
    rows = rows.join(middle, "combo_id").withColumns({
        "prior_weight": F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)),
        "diversity": F.coalesce(1 - F.col("redundancy"), F.lit(0.0)), "redundancy": F.coalesce("redundancy", F.lit(0.0)),
        "relative_density": F.when(F.col("middle") > 0, F.col("mean_edge_count") / F.col("middle")).otherwise(1.0),
    })
    rows = rows.withColumns({"density_factor": 1 / (1 + density_penalty * F.greatest(F.col("relative_density") - 1, F.lit(0.0))), "redundancy_factor": 1 / (1 + redundancy_penalty * F.col("redundancy"))})
    raw = F.col("prior_weight") * F.pow(F.greatest("bootstrap_stability", F.lit(least)), F.lit(power)) * (1 + diversity_bonus * F.col("diversity")) * F.col("density_factor") * F.col("redundancy_factor")
    rows = rows.withColumn("raw", raw)
    mean = rows.groupBy("combo_id").agg(F.avg(F.when(F.col("raw") > 0, F.col("raw"))).alias("mean_raw"))
    return rows.join(mean, "combo_id").select(
        "combo_id", "method", "prior_weight", "bootstrap_stability", "diversity", "mean_edge_count", "relative_density", "density_factor", "redundancy", "redundancy_factor",
        F.when(F.col("mean_raw") > 0, F.col("raw") / F.col("mean_raw")).otherwise(F.col("raw")).alias("adaptive_weight"),
    )


def evidence(edges: DataFrame) -> DataFrame:
    """(run_id, method, edge, evidence): percent rank, ties averaged, of 1 - p or else of the score's size; 1 if all are equal."""
    rows = dedup(edges, ["run_id"]).where("lag IS NOT NULL").withColumn("raw", F.coalesce(1 - valid_p(F.col("p_value")), F.abs(finite(F.col("score"))))).where("raw IS NOT NULL")
    group = Window.partitionBy("run_id", "method")
    ties = F.count("*").over(Window.partitionBy("run_id", "method", "raw"))
    rank = (F.rank().over(group.orderBy("raw")) + (ties - 1) / 2) / F.count("*").over(group)
    same = F.min("raw").over(group) == F.max("raw").over(group)
    return rows.select("run_id", "method", *EDGE, F.when(same, F.lit(1.0)).otherwise(rank).alias("evidence"))


def counts(edges: DataFrame) -> DataFrame:
    """(method, edge, n): bootstrap runs that hold the edge."""
    return edge_sets(edges).where("run_id > 0 AND source <> target").groupBy("method", *EDGE).agg(F.count_distinct("run_id").alias("n"))


def blended(summary: DataFrame, edges: DataFrame, combos: DataFrame, bootstraps: int, stability_weight: float = 0.65, local_weight: float = 0.60) -> DataFrame:
    """Summary rows (combo_id, edge, ...) with base and bootstrap evidence, the dominant method and the ensemble score.

    combos: (combo_id, method, weight, method_ord).
    """
    per = evidence(edges)
    base = per.where("run_id = 0").select("method", *EDGE, F.col("evidence").alias("ev0"))
    boot = per.where("run_id > 0").groupBy("method", *EDGE).agg(F.sum("evidence").alias("ev_sum"))
    total = combos.groupBy("combo_id").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("sum_w"), F.max("weight").alias("max_w"), F.count("*").alias("k"))
    members = combos.join(total, "combo_id").withColumns({
        "w": F.when(F.col("sum_w") > 0, F.greatest("weight", F.lit(0.0))).otherwise(1.0), "sum_w": F.when(F.col("sum_w") > 0, F.col("sum_w")).otherwise(F.col("k").cast("double")),
        "max_w": F.when(F.col("sum_w") > 0, F.col("max_w")).otherwise(1.0),
    }).select("combo_id", "method", "method_ord", "w", "sum_w", "max_w")
    rows = summary.select("combo_id", *EDGE, "weighted_support_ratio").join(members, "combo_id")
    rows = rows.join(base, ["method", *EDGE], "left").join(boot, ["method", *EDGE], "left").join(counts(edges), ["method", *EDGE], "left").fillna(0, ["ev0", "ev_sum", "n"])
    b = float(bootstraps)
    stable = F.sqrt(F.col("ev_sum") / b * F.col("n") / b) if bootstraps else F.col("ev0")
    share = F.col("n") / b if bootstraps else F.when(F.col("ev0") > 0, 1.0).otherwise(0.0)
    local = (0.5 + 0.5 * F.col("w") / F.col("max_w")) * ((1 - stability_weight) * F.col("ev0") + stability_weight * stable)
    rows = rows.withColumns({"local": local, "share": share, "reliability": F.col("w") / F.col("max_w")})
    best = F.max_by(F.struct("method", "reliability", "share"), F.struct("local", -F.col("method_ord")))
    mean = lambda x: F.sum(F.col("w") * x) / F.first("sum_w")
    found = rows.groupBy("combo_id", *EDGE).agg(
        mean(F.col("ev0")).alias("normalized_evidence_probability"), (mean(F.col("n") / b) if bootstraps else F.first("weighted_support_ratio")).alias("bootstrap_probability"),
        (mean(F.col("ev_sum") / b) if bootstraps else mean(F.col("ev0"))).alias("bootstrap_evidence_score"), F.max("local").alias("local_expert_score"), best.alias("best"),
    )
    out = summary.join(found, ["combo_id", *EDGE]).withColumn("base_edge_probability", F.col("edge_probability"))
    out = out.withColumns({
        "edge_probability": clip(stability_weight * F.col("bootstrap_probability") + (1 - stability_weight) * F.col("base_edge_probability"), 0, 1),
        "consensus_score": clip(stability_weight * F.col("bootstrap_evidence_score") + (1 - stability_weight) * F.col("normalized_evidence_probability"), 0, 1),
        "dominant_method": F.col("best.method"), "dominant_method_reliability": F.col("best.reliability"), "dominant_edge_stability": F.col("best.share"),
    })
    return out.withColumns({"ensemble_score": clip(local_weight * F.col("local_expert_score") + (1 - local_weight) * F.col("consensus_score"), 0, 1), "uncertainty": 1 - F.col("edge_probability")}).drop("best")


def vote_stability(edges: DataFrame, methods: int, iterations: int, min_votes: int = 1, threshold: float = 0.6, forbidden: DataFrame | None = None) -> DataFrame:
    """Stability of edges by votes alone: every edge of a run with min_votes methods counts as selected there.

    forbidden(source, target, lag): edges that no run may hold; a null lag forbids all.
    """
    if iterations <= 0:
        raise ValueError("at least one iteration is needed")
    rows = edges.where("run_id > 0 AND source <> target").groupBy("run_id", *EDGE).agg(F.count_distinct("method").alias("votes")).where(F.col("votes") >= min_votes)
    if forbidden is not None:
        f = F.broadcast(forbidden.select(*[F.col(c).alias(f"f_{c}") for c in EDGE]))
        rows = rows.join(f, (F.col("source") == F.col("f_source")) & (F.col("target") == F.col("f_target")) & (F.col("f_lag").isNull() | (F.col("f_lag") == F.col("lag"))), "left_anti")
    found = rows.groupBy(*EDGE).agg(F.count("*").alias("selected_count"), F.avg(F.col("votes") / methods).alias("mean_support"))
    return found.withColumns({"selection_frequency": F.col("selected_count") / iterations, "appearance_frequency": F.col("selected_count") / iterations, "stability_selected": F.col("selected_count") / iterations >= threshold})


def stability_selection(summary: DataFrame, iterations: int, probability: float = 0.5, threshold: float = 0.6) -> DataFrame:
    """How often each edge of summary(combo_id, run_id, edge, edge_probability, confidence) appears and is selected."""
    found = summary.groupBy("combo_id", *EDGE).agg(
        F.count_if(F.col("edge_probability") >= probability).alias("selected_count"), F.count("*").alias("seen"),
        F.sum("edge_probability").alias("sp"), F.sum("confidence").alias("sc"),
    )
    rows = found.withColumns({"selection_frequency": F.col("selected_count") / iterations, "appearance_frequency": F.col("seen") / iterations, "mean_edge_probability": F.col("sp") / F.col("seen"), "mean_confidence": F.col("sc") / F.col("seen")})
    return rows.withColumn("stability_selected", F.col("selection_frequency") >= threshold).drop("seen", "sp", "sc")
