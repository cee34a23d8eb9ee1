"""Choosing edges: filters, undirected pairs, ranked budgets, rescue and precision consensus."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fusion import EDGE
from .ranks import placed

PAIR = ["pair_lo", "pair_hi"]


def with_pair(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"pair_lo": F.least("source", "target"), "pair_hi": F.greatest("source", "target")})


def filter_edges(summary: DataFrame, min_probability: float = 0.5, max_lag: int | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    """Edges at or above a probability, up to a lag, from or to a variable."""
    out = summary.where(F.col("edge_probability") >= min_probability) if "edge_probability" in summary.columns else summary
    out = out.where(F.col("lag") <= max_lag) if max_lag is not None else out
    for name, value in (("source", source), ("target", target)):
        out = out.where(F.col(name) == value) if value else out
    return out


def restrict(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Only relations listed in allowed(source, target)."""
    return edges.join(allowed, ["source", "target"], "left_semi")


def relation_rows(nodes: DataFrame, objective: str, source: str | None = None, target: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """The ordered pairs (source, target) of distinct nodes(node) that an objective is about, each node joined with those that it asks for."""
    a, b = nodes.select(F.col("node").alias("source")).distinct(), nodes.select(F.col("node").alias("target")).distinct()
    if objective == "causes_of_target":
        a, b = a, b.where(F.col("target") == target)
    elif objective == "effects_of_source":
        a, b = a.where(F.col("source") == source), b
    elif objective == "compare_directions":
        a, b = a.where(F.col("source").isin(source, target)), b.where(F.col("target").isin(source, target))
    elif objective == "specific_relations":
        a = a.join(pairs.select("source").distinct(), "source", "left_semi")
    elif objective != "full_structure":
        raise ValueError(f"unknown objective {objective}")
    every = a.join(b, F.col("source") != F.col("target"))
    return every.join(pairs.select("source", "target"), ["source", "target"], "left_semi") if objective == "specific_relations" else every


def directed(links: DataFrame) -> DataFrame:
    """Links of a graph over time whose mark is an arrow from the lagged to the later variable."""
    return links.where(F.trim("mark") == "-->")


def temporal_endpoints(links: DataFrame, method: str, include_partial: bool = False) -> DataFrame:
    """Links (tail, head) that a method's graph lets count as edges from the tail: for GES arrows and undirected lines,
    for FCI arrows, and circles with an arrow if partial ones are asked for."""
    tail, head = F.upper(F.trim("tail")), F.upper(F.trim("head"))
    if method == "GES":
        return links.where((tail == "TAIL") & head.isin("ARROW", "TAIL"))
    if method == "FCI":
        return links.where((head == "ARROW") & tail.isin("TAIL", *(["CIRCLE"] if include_partial else [])))
    raise ValueError(f"{method} has no endpoint marks")


def _at_least(column: str, threshold: float) -> Column:
    if not 0 <= threshold <= 1:
        raise ValueError("thresholds lie between 0 and 1")
    return F.coalesce(F.col(column), F.lit(0.0)) >= threshold


def precision_consensus(summary: DataFrame, score: float = 0.5, support: float = 0.5, bootstrap: float | None = None) -> DataFrame:
    """Flags edges whose ensemble score, support and, if asked, bootstrap probability all reach their thresholds."""
    needed = {"ensemble_score", "support_ratio"} | ({"bootstrap_probability"} if bootstrap is not None else set())
    if missing := needed - set(summary.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    flag = _at_least("ensemble_score", score) & _at_least("support_ratio", support)
    return summary.withColumn("ensemble_selected", flag & _at_least("bootstrap_probability", bootstrap) if bootstrap is not None else flag)


def ranked_structure(summary: DataFrame, density: float, nodes: int, by: Sequence[str] = (), rescue: tuple[float, float, float] | None = None) -> DataFrame:
    """Selects the best ceil(density * n(n-1)/2) undirected pairs by their best positive score.

    rescue: thresholds of bootstrap probability, predictive rank and support that the maxima of a pair must all reach.
    """
    if not 0 < density <= 1:
        raise ValueError("density lies above 0 and at most at 1")
    budget = math.ceil(density * nodes * (nodes - 1) / 2)
    rows = with_pair(summary).withColumn("score", F.coalesce("ensemble_score", F.lit(0.0)))
    pairs = rows.groupBy(*by, *PAIR).agg(
        F.max(F.when(F.col("score") > 0, F.col("score"))).alias("ranked_selection_pair_score"),
        *([F.coalesce(F.max(c), F.lit(0.0)).alias(f"r{i}") for i, c in enumerate(("bootstrap_probability", "predictive_rank", "support_ratio"))] if rescue else []),
    )
    scored = pairs.where("ranked_selection_pair_score IS NOT NULL")
    ranked = placed(scored, [F.desc("ranked_selection_pair_score"), *PAIR], by, "ranked_selection_pair_rank").select(*by, *PAIR, "ranked_selection_pair_rank")
    pairs = pairs.join(ranked, [*by, *PAIR], "left")
    chosen = F.coalesce(F.col("ranked_selection_pair_rank") <= budget, F.lit(False))
    if rescue:
        chosen |= (F.col("r0") >= rescue[0]) & (F.col("r1") >= rescue[1]) & (F.col("r2") >= rescue[2])
    pairs = pairs.select(*by, *PAIR, "ranked_selection_pair_score", "ranked_selection_pair_rank", chosen.alias("ensemble_selected"))
    return with_pair(summary).join(pairs, [*by, *PAIR]).drop(*PAIR)


def selected(summary: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The flagged edges, or those at the probability threshold where nothing is flagged."""
    return summary.where("ensemble_selected") if "ensemble_selected" in summary.columns else summary.where(F.col("edge_probability") >= threshold)


def vote_order() -> list[Column]:
    return [F.desc("votes"), F.desc_nulls_last("mean_score"), *map(F.col, EDGE)]


def probability_order() -> list[Column]:
    return [F.desc("edge_probability"), *vote_order()]


def best_order() -> list[Column]:
    return [F.desc("edge_probability"), F.desc("bootstrap_probability"), F.desc("votes"), *map(F.col, EDGE)]


def stability_order() -> list[Column]:
    return [F.desc("selection_frequency"), F.desc("appearance_frequency"), *map(F.col, EDGE)]


def granger_order() -> list[Column]:
    return [F.col(c) for c in ("target", "source", "lag")]
