"""Fusing the edges of several methods into votes, signs and probabilities.

edges: (run_id, method, source, target, lag, score, p_value); run 0 is the base sample. methods: (method, weight) is the
universe of a fusion: methods without edges still count. Groups may be split further by extra key columns, `by`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import bayes_factor, clip, finite, fisher, posterior, score_probability, valid_p, wilson

EDGE = ["source", "target", "lag"]


def compact(edges: DataFrame) -> DataFrame:
    """One row per run, method and edge, self-links and all: what every fusion makes of the table first, so it can be kept."""
    return edges.groupBy("run_id", "method", *EDGE).agg(F.avg(finite(F.col("score"))).alias("score"), F.min(valid_p(F.col("p_value"))).alias("p_value"))


def dedup(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per edge and method: mean score, least p-value. Self-links go; a missing method is unknown."""
    named = edges.withColumn("method", F.coalesce("method", F.lit("unknown"))).where("source <> target")
    return named.groupBy(*by, *EDGE, "method").agg(F.avg(finite(F.col("score"))).alias("score"), F.min(valid_p(F.col("p_value"))).alias("p_value"))


def sign_columns(signed: Sequence[str]) -> list[Column]:
    """Aggregates over deduplicated edges: signs of the methods whose scores have one."""
    ok = F.col("method").isin(*signed) & F.col("score").isNotNull() & (F.col("score") != 0)
    pos, neg = F.count_if(ok & (F.col("score") > 0)), F.count_if(ok & (F.col("score") < 0))
    consensus = F.when((pos > 0) & (neg > 0), "mixed").when(pos > 0, "positive").when(neg > 0, "negative").otherwise("unknown")
    return [
        F.array_sort(F.collect_set(F.when(ok, F.col("method")))).alias("signed_methods"), pos.alias("positive_votes"), neg.alias("negative_votes"),
        consensus.alias("sign_consensus"), F.when(pos + neg > 0, F.greatest(pos, neg) / (pos + neg)).alias("sign_agreement"),
    ]


def universe(spark: SparkSession, observed: DataFrame, weights: dict[str, float] | None = None, named: Sequence[str] = ()) -> DataFrame:
    """(method, weight): the methods named, or else those that observed(method) holds, and all that have a weight; 1 without one."""
    given = spark.createDataFrame([(k, float(v)) for k, v in (weights or {}).items()], "method string, weight double")
    first = spark.createDataFrame([(m,) for m in dict.fromkeys(named)], "method string") if named else observed.select(F.coalesce("method", F.lit("unknown")).alias("method"))
    every = first.union(given.select("method")).distinct()
    return every.join(F.broadcast(given), "method", "left").select("method", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)).alias("weight"))


def votes(edges: DataFrame, signed: Sequence[str], min_votes: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Vote summary: methods, count, mean score and signs of each edge with at least min_votes."""
    found = dedup(edges, by).where("lag IS NOT NULL").groupBy(*by, *EDGE).agg(
        F.array_sort(F.collect_set("method")).alias("method"), F.count_distinct("method").alias("votes"), F.avg("score").alias("mean_score"), *sign_columns(signed)
    )
    return found.where(F.col("votes") >= min_votes)


def scales(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median size of each method's deduplicated scores."""
    return dedup(edges, by).groupBy(*by, "method").agg(F.median(F.abs("score")).alias("scale"))


def probabilities(
    edges: DataFrame, methods: DataFrame, signed: Sequence[str], min_votes: int = 2, prior: float = 0.1, posterior_weight: float = 0.7,
    confidence: float = 0.95, by: Sequence[str] = (), universe_by: Sequence[str] = (),
) -> DataFrame:
    """Probabilistic summary of each edge: votes, supports, intervals, combined evidence, edge probability.

    universe_by: the key columns that methods has, among by; weights may differ between them.
    """
    weighed = methods.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)))
    totals = weighed.groupBy(*universe_by).agg(F.count("*").alias("n_methods"), F.sum("weight").alias("sum_weight"))
    totals = totals.withColumn("sum_weight", F.when(F.col("sum_weight") > 0, F.col("sum_weight")).otherwise(F.col("n_methods").cast("double")))
    unique = dedup(edges, by).where("lag IS NOT NULL")
    unique = unique.join(weighed, [*universe_by, "method"], "left").join(scales(edges, by), [*by, "method"], "left")
    unique = unique.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "as_probability": F.when(F.col("score").isNotNull(), score_probability(F.col("score"), F.coalesce("scale", F.lit(1.0))))})
    found = unique.groupBy(*by, *EDGE).agg(
        F.array_sort(F.collect_set("method")).alias("method"), F.count("*").alias("votes"), F.sum("weight").alias("weighted_votes"), F.avg("score").alias("mean_score"),
        fisher(F.col("p_value")).alias("combined_p_value"), F.avg("as_probability").alias("score_probability"), *sign_columns(signed),
    ).where(F.col("votes") >= min_votes)
    found = found.join(totals, list(universe_by)) if universe_by else found.crossJoin(F.broadcast(totals))  # one row
    low, high = wilson(F.col("votes"), F.col("n_methods"), confidence)
    found = found.withColumns({
        "support_ratio": F.col("votes") / F.col("n_methods"), "weighted_support_ratio": F.col("weighted_votes") / F.col("sum_weight"),
        "support_ci_low": low, "support_ci_high": high, "bayes_factor_10": bayes_factor(F.col("combined_p_value")),
    })
    found = found.withColumn("posterior_probability", F.when(F.col("combined_p_value").isNotNull(), posterior(F.col("bayes_factor_10"), prior)).otherwise(F.coalesce("score_probability", F.lit(0.5))))
    edge = clip(posterior_weight * F.col("posterior_probability") + (1 - posterior_weight) * F.col("weighted_support_ratio"), 0, 1)
    found = found.withColumn("edge_probability", edge)
    found = found.withColumns({"uncertainty": 1 - F.col("edge_probability"), "confidence": clip(1 - (F.col("support_ci_high") - F.col("support_ci_low")), 0, 1)})
    return found.select(
        *by, *EDGE, "method", "votes", "weighted_votes", "support_ratio", "weighted_support_ratio", "support_ci_low", "support_ci_high", "mean_score", "signed_methods",
        "positive_votes", "negative_votes", "sign_consensus", "sign_agreement", "combined_p_value", "bayes_factor_10", "posterior_probability", "edge_probability", "uncertainty", "confidence",
    )
