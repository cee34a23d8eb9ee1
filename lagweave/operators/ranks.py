"""Positions and running totals of rows in a total order without one task that holds them all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.checkpoints import stored


def accumulated(rows: DataFrame, order: Sequence[Column | str], sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """rows with running sums and maxima, up to and with each row, in an order; with by, in each group.

    Without by, rows are dealt by ranges of the order and added up within; what the ranges before hold is one row per range,
    and only that reaches the driver. Equal rows come in no order among them.
    """
    order, sums, maxima = [F.col(c) if isinstance(c, str) else c for c in order], dict(sums or {}), dict(maxima or {})
    window = lambda *key: Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if by:
        w = window(*by)
        return rows.withColumns({**{k: F.sum(c).over(w) for k, c in sums.items()}, **{k: F.max(c).over(w) for k, c in maxima.items()}})
    parted = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = parted.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()], *[F.max(c).alias(f"_{k}") for k, c in maxima.items()])
    before: list = [None] * (len(sums) + len(maxima))
    shifts = []
    for r in parts.orderBy("_part").collect():
        shifts.append((r[0], *before))
        for i, now in enumerate(r[1:]):
            if now is not None:
                before[i] = now if before[i] is None else before[i] + now if i < len(sums) else max(before[i], now)
    kinds = StructType([StructField("_part", IntegerType()), *[StructField(f.name, f.dataType) for f in parts.schema.fields[1:]]])
    shift = F.broadcast(rows.sparkSession.createDataFrame(shifts, kinds))  # a row per range
    w = window("_part")
    found = {**{k: F.coalesce(F.sum(c).over(w) + F.col(f"_{k}"), F.sum(c).over(w)) for k, c in sums.items()}, **{k: F.greatest(F.max(c).over(w), F.col(f"_{k}")) for k, c in maxima.items()}}
    return parted.join(shift, "_part").withColumns(found).drop("_part", *[f"_{k}" for k in (*sums, *maxima)])


def placed(rows: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """rows with their position, from 1, in an order; with by, in each group."""
    return accumulated(rows, order, {name: F.lit(1)}, by=by)


def steps(obs: DataFrame) -> DataFrame:
    """(traj_id, t, step, steps): each time's position, from 0, in its trajectory, and how many it has."""
    times = placed(obs.select("traj_id", "t").distinct(), ["traj_id", "t"], name="_at")
    size = times.groupBy("traj_id").agg(F.min("_at").alias("_first"), F.count("*").alias("steps"))
    return times.join(size, "traj_id").select("traj_id", "t", (F.col("_at") - F.col("_first")).alias("step"), "steps")
