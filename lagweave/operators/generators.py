"""Synthetic series with known causes, and disturbances of given ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: The edges of the synthetic system.
TRUTH = [("X", "X", 1), ("Y", "Y", 1), ("X", "Y", 2), ("Z", "Z", 1), ("Y", "Z", 1), ("X", "Z", 1)]


def system(steps: int, noise: float, seed: int) -> np.ndarray:
    """Columns X, Y and Z: X follows itself; Y itself and X two steps back; Z itself, Y and X. The first two steps are 0; noise is
    drawn x, y, z per step."""
    draw = np.random.default_rng(seed).normal(0, noise, (max(steps - 2, 0), 3))
    out = np.zeros((steps, 3))
    for t in range(2, steps):
        one, two, e = out[t - 1], out[t - 2], draw[t - 2]
        out[t] = (0.7 * one[0] + e[0], 0.5 * one[1] + 0.8 * two[0] + e[1], 0.6 * one[2] + 0.9 * one[1] - 0.5 * one[0] + e[2])
    return out


def panels(spark: SparkSession, trajectories: int, steps: int = 500, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """Observations of so many independent systems; trajectory i has seed + i. Tasks generate them."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["id"]:
                x = system(steps, noise, seed + int(i))
                yield pd.DataFrame({"traj_id": i, "t": np.repeat(np.arange(steps), 3), "variable": np.tile(list("XYZ"), steps), "value": x.ravel()})

    return spark.range(trajectories).mapInPandas(make, "traj_id long, t long, variable string, value double")


def truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRUTH, "source string, target string, lag int")


def noise_from(obs: DataFrame, index: int, multiplier: float, seed: int = 42) -> DataFrame:
    """Adds normal noise of multiplier times each series' population deviation from step index on, seeded per series."""
    if multiplier < 0 or index < 0:
        raise ValueError("index and multiplier aren't negative")

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t").reset_index(drop=True)
        key = f"{seed}:{frame['traj_id'].iloc[0]}:{frame['variable'].iloc[0]}".encode()
        late = frame["t"] >= index
        frame.loc[late, "value"] += np.random.default_rng(list(key)).normal(0, frame["value"].std(ddof=0) * multiplier, int(late.sum()))
        return frame

    return obs.groupBy("traj_id", "variable").applyInPandas(add, obs.schema)
