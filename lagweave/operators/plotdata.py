"""Positions, widths and colours of causal graphs as DataFrames; drawing is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import sign_label
from .fusion import EDGE

#: A colour per sign consensus.
COLOURS = {"positive": "#1e88e5", "negative": "#d32f2f", "mixed": "#f57c00", "unknown": "#607d8b"}


def _placed(edges: DataFrame, nodes: list[str]) -> DataFrame:
    angle = {v: 2 * math.pi * i / max(len(nodes), 1) for i, v in enumerate(nodes)}
    at = lambda c: F.coalesce(*[F.when(F.col(c) == v, F.lit(a)) for v, a in angle.items()])
    return edges.withColumns({"source_angle": at("source"), "target_angle": at("target")})


def sign_text(columns: list[str]) -> Column:
    """What a graph says of an edge's sign: consensus, votes and agreement; votes that are absent count 0."""
    known = lambda c, kind: F.col(c) if c in columns else F.lit(None).cast(kind)
    votes = [F.coalesce(known(f"{s}_votes", "long"), F.lit(0)).cast("string") for s in ("positive", "negative")]
    share = known("sign_agreement", "double")
    agreement = F.when(share.isNotNull(), F.format_string("%.1f%%", share * 100)).otherwise("n/a")
    return F.concat(F.lit("sign="), sign_label(F.col("sign_consensus")), F.lit("<br>positive_votes="), votes[0], F.lit("<br>negative_votes="), votes[1], F.lit("<br>sign_agreement="), agreement)


def circular(summary: DataFrame, nodes: list[str]) -> DataFrame:
    """Edges of a circular graph: ends on the unit circle, width by probability, colour by sign, opacity by confidence."""
    rows = _placed(summary, nodes).withColumn("sign", sign_label(F.col("sign_consensus")))
    colour = F.coalesce(*[F.when(F.col("sign") == k, F.lit(v)) for k, v in COLOURS.items()])
    return rows.select(
        *EDGE, F.cos("source_angle").alias("x0"), F.sin("source_angle").alias("y0"), F.cos("target_angle").alias("x1"), F.sin("target_angle").alias("y1"),
        (1 + 5 * F.col("edge_probability")).alias("width"), (0.2 + 0.8 * F.col("confidence")).alias("opacity"), "sign", colour.alias("colour"), sign_text(rows.columns).alias("text"),
        (F.col("source") == F.col("target")).alias("self_loop"),
    )


def temporal(summary: DataFrame, nodes: list[str], most: int = 12) -> DataFrame:
    """The most probable edges of a layered graph: the source's column is its lag, rows are variables."""
    row = {v: i for i, v in enumerate(nodes)}
    at = lambda c: F.coalesce(*[F.when(F.col(c) == v, F.lit(i)) for v, i in row.items()])
    top = summary.orderBy(F.desc("edge_probability"), F.desc("confidence"), F.desc("lag"), "source", "target").limit(most)
    name = F.when(F.col("lag") == 0, "t").otherwise(F.concat(F.lit("t-"), F.col("lag").cast("string")))
    return top.select(*EDGE, name.alias("level"), (-F.col("lag")).alias("x0"), at("source").alias("y0"), F.lit(0).alias("x1"), at("target").alias("y1"), (1.5 + 5.5 * F.col("edge_probability")).alias("width"))


def heatmap(consistency: DataFrame) -> DataFrame:
    """The consistency matrix with a column per method."""
    return consistency.groupBy("method_l").pivot("method_r").agg(F.first("jaccard")).orderBy("method_l")


def self_loops(placed: DataFrame, radius: float = 0.12, points: int = 24) -> DataFrame:
    """Points of an arc outside the circle for each edge of a variable to itself, from circular()."""
    turn = 2 * math.pi * F.col("point") / (points - 1)
    rows = placed.where("self_loop").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    centre = {c: F.col(f"{c}0") * (1 + radius) for c in "xy"}
    return rows.select(*EDGE, "point", (centre["x"] + radius * F.cos(turn)).alias("x"), (centre["y"] + radius * F.sin(turn)).alias("y"), "width", "opacity", "colour")
