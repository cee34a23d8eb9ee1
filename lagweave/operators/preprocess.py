"""Preparing panels: unit-root tests, differencing to stationarity, detrending and scaling."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources.checkpoints import stored
from .panel import detrended, differences_by, zscore


def adf_p(x: np.ndarray) -> float:
    """Augmented Dickey-Fuller p-value with a constant: lags by AIC, MacKinnon's approximate response surface.

    1 for fewer than five values or a constant series.
    """
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if len(x) < 5 or len(np.unique(x)) <= 1:
        return 1.0
    d = np.diff(x)
    most = max(0, min(int(math.ceil(12 * (len(x) / 100) ** 0.25)), len(x) // 2 - 2))

    def fit(lags: int, skip: int) -> tuple[float, float]:
        y = d[skip:]
        columns = [x[skip:-1], *[d[skip - k : -k] for k in range(1, lags + 1)], np.ones(len(y))]
        a = np.column_stack(columns)
        inverse = np.linalg.pinv(a.T @ a)
        beta = inverse @ a.T @ y
        rss = max(float(((y - a @ beta) ** 2).sum()), 1e-300)
        error = math.sqrt(max(inverse[0, 0], 0) * rss / max(len(y) - a.shape[1], 1))
        return len(y) * math.log(rss / len(y)) + 2 * a.shape[1], beta[0] / error if error else 0.0

    lags = min(range(most + 1), key=lambda k: fit(k, most)[0])
    tau = fit(lags, lags)[1]
    # fixed values: the published coefficients for a constant and one variable
    if tau > 2.74:
        return 1.0
    if tau < -18.83:
        return 0.0
    if tau <= -1.61:
        return NormalDist().cdf(2.1659 + 1.4412 * tau + 0.038269 * tau**2)
    return NormalDist().cdf(1.7339 + 0.93202 * tau - 0.12745 * tau**2 - 0.010368 * tau**3)


def differencing_orders(obs: DataFrame, alpha: float = 0.05, most: int = 2) -> DataFrame:
    """(traj_id, variable, differencing_order, p_value): the first order whose test passes, or the last tried."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, order = frame.sort_values("t")["value"].to_numpy(), 0
        p = adf_p(x)
        while p > alpha and order < most and len(x) > 1:
            x, order = np.diff(x), order + 1
            p = adf_p(x)
        return pd.DataFrame({"traj_id": [frame["traj_id"].iloc[0]], "variable": [frame["variable"].iloc[0]], "differencing_order": [order], "p_value": [p]})

    kind = obs.schema["traj_id"].dataType.simpleString()
    return obs.groupBy("traj_id", "variable").applyInPandas(run, f"traj_id {kind}, variable string, differencing_order int, p_value double")


class Preprocessor:
    """Detrends, differences to stationarity and scales, in this order; keeps the orders it chose, one for each series."""

    def __init__(self, alpha: float = 0.05, max_diffs: int = 2, decomposition_period: int | None = None, model: str = "additive"):
        self.alpha, self.max_diffs, self.period, self.model = alpha, max_diffs, decomposition_period, model
        self.orders: dict[str, int] = {}
        self.chosen: DataFrame | None = None

    def fit_transform(self, obs: DataFrame, make_stationary: bool = True, normalize: bool = True, remove_trend: bool = False) -> DataFrame:
        if remove_trend and self.period:
            obs = detrended(obs, self.period, self.model)
        if make_stationary:
            self.chosen = stored(differencing_orders(obs, self.alpha, self.max_diffs))
            # one number per variable of the panel's schema: the highest over its trajectories
            self.orders = {r["variable"]: r["o"] for r in self.chosen.groupBy("variable").agg({"differencing_order": "max"}).toDF("variable", "o").collect()}
            obs = differences_by(obs, self.chosen)
        return zscore(obs) if normalize else obs

    def summary(self) -> DataFrame:
        """(traj_id, variable, differencing_order, p_value) of the last fit."""
        if self.chosen is None:
            raise ValueError("nothing was made stationary yet")
        return self.chosen
