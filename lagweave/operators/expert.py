"""Expert rules over edges: strong, weak, inverse or no relation, as soft or hard constraints, applied in rule order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import clip
from .fusion import EDGE

#: Probability that a relation pulls an edge towards.
PRIORS = {"strong": 0.90, "inverse": 0.75, "weak": 0.35, "none": 0.0}
#: Rules of one application at most; they are kept in every task.
MOST_RULES = 10_000


def normalise(rules: DataFrame) -> DataFrame:
    """Rules (rule_ord, source, target, lag, relation, confidence, constraint, prior_probability) with defaults; invalid ones go."""
    out = rules.select(
        "rule_ord", F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.col("lag").cast("int").alias("lag"),
        F.lower(F.trim(F.coalesce("relation", F.lit("weak")))).alias("relation"), clip(F.coalesce(F.col("confidence").cast("double"), F.lit(0.5)), 0, 1).alias("confidence"),
        F.lower(F.trim(F.coalesce("constraint", F.lit("soft")))).alias("constraint"), clip(F.col("prior_probability").cast("double"), 0, 1).alias("prior_probability"),
    )
    return out.where(F.col("relation").isin(*PRIORS) & F.col("constraint").isin("soft", "hard"))


def apply_rules(summary: DataFrame, rules: DataFrame, keep_forbidden: bool = False) -> DataFrame:
    """summary with edge probabilities folded through all matching rules; hard-forbidden edges go at the end.

    A rule without a lag matches every lag. The rules are few by contract, which is checked before they are broadcast.
    """
    valid = normalise(rules)
    if valid.count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    r = F.broadcast(valid.select(*[F.col(c).alias(f"r_{c}") for c in valid.columns]))
    keys = [c for c in ("combo_id", *EDGE) if c in summary.columns]
    match = (F.col("source") == F.col("r_source")) & (F.col("target") == F.col("r_target")) & (F.col("r_lag").isNull() | (F.col("r_lag") == F.col("lag")))
    found = summary.select(*keys).join(r, match).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(f"r_{c}").alias(c) for c in ("rule_ord", "relation", "constraint", "confidence", "prior_probability")]))).alias("rules")
    )
    rows = summary.join(found, keys, "left").withColumn("data_edge_probability", F.col("edge_probability"))

    def step(p, rule):
        prior = F.coalesce(rule["prior_probability"], *[F.when(rule["relation"] == k, F.lit(v)) for k, v in PRIORS.items()])
        blend = F.when(rule["constraint"] == "hard", F.least(F.lit(1.0), 0.5 + 0.5 * rule["confidence"])).otherwise(rule["confidence"])
        none = rule["relation"] == "none"
        return (
            F.when(none & (rule["constraint"] == "hard"), F.lit(0.0))
            .when(none, p * (1 - 0.9 * rule["confidence"]))
            .otherwise(F.least(F.greatest((1 - blend) * p + blend * prior, F.lit(0.0)), F.lit(1.0)))
        )

    def label(rule):
        return F.when(rule["relation"] == "none", F.concat(rule["constraint"], F.lit("_forbidden"))).otherwise(F.concat(rule["constraint"], F.lit("_"), rule["relation"]))

    out = rows.withColumns({
        "edge_probability": F.when(F.col("rules").isNull(), F.col("edge_probability")).otherwise(F.aggregate("rules", F.col("edge_probability"), step)),
        "expert_adjustment": F.when(F.col("rules").isNull(), "none").otherwise(F.array_join(F.transform("rules", label), "|")),
        "expert_confidence": F.aggregate("rules", F.lit(0.0), lambda a, r: F.greatest(a, r["confidence"])),
    })
    out = out.withColumn("uncertainty", 1 - F.col("edge_probability")).drop("rules")
    return out if keep_forbidden else out.where(~F.col("expert_adjustment").contains("hard_forbidden"))
