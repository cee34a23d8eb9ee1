"""Running methods over trajectories and bootstrap runs: every (trajectory, run, method) is a group of one Spark job."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import block_index, bootstrap, variables
from .registry import CANONICAL, MethodSpec, check_records

#: Steps times variables of one fit at most: a fit's panel is one group.
MOST_CELLS = 20_000_000


def fit_grid(obs: DataFrame, specs: Mapping[str, MethodSpec], max_lag: int, options: Mapping[str, dict] | None = None) -> DataFrame:
    """Canonical edges (traj_id, run_id, method, ..., extras) of every method on every sample of obs(run_id, traj_id, t, variable, value).

    extras holds, as JSON, what a method alone reports of an edge.

    Methods that need no more than moments of the lagged columns get them from Spark's sums and never see a series; the
    others get a sample's panel as one group, of MOST_CELLS cells at most.
    """
    used = {k: {**s.default_kwargs, **(options or {}).get(k, {})} for k, s in specs.items()}
    whole = {k: s for k, s in specs.items() if s.moments is None}
    found = []
    for reach, scaled in sorted({(s.moments.reach, s.moments.standardised) for s in specs.values() if s.moments}):
        mine = {k: (s.moments.function, used[k]) for k, s in specs.items() if s.moments and (s.moments.reach, s.moments.standardised) == (reach, scaled)}
        found.append(_fit_moments(_scaled(complete_steps(obs)) if scaled else obs, mine, max_lag, reach * max_lag))
    if whole:
        found.append(_fit_panels(obs, {k: (s.function, used[k]) for k, s in whole.items()}, max_lag))
    return union(found).withColumn("p_value", F.when(~F.isnan("p_value"), F.col("p_value")))


_NAMED = ["source", "target", "lag", "score", "p_value"]


def _edges_of(records: list[dict], names: list[str], method: str, traj_id, run_id) -> list[tuple]:
    """Checked rows of _edge_schema()."""
    check_records(records, names, method)
    extras = [json.dumps(more, sort_keys=True) if (more := {k: v for k, v in r.items() if k not in _NAMED}) else None for r in records]
    return [(traj_id, run_id, method, *[r[c] for c in _NAMED], more) for r, more in zip(records, extras, strict=True)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["traj_id", "run_id", "method", *_NAMED, "extras"]).astype({"p_value": float, "score": float})


def _edge_schema(obs: DataFrame) -> str:
    return f"traj_id {obs.schema['traj_id'].dataType.simpleString()}, run_id int, method string, {CANONICAL}, extras string"


def _fit_panels(obs: DataFrame, functions: dict, max_lag: int) -> DataFrame:
    names = variables(obs)
    widest = obs.groupBy("run_id", "traj_id").count().agg(F.max("count")).first()[0] or 0
    if widest > MOST_CELLS:
        raise ValueError(f"a panel has {widest} cells; fits take {MOST_CELLS}")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0]
        data = frame.pivot_table(index="t", columns="variable", values="value")[[n for n in names if n in set(frame["variable"])]].dropna()
        function, kwargs = functions[head["method"]]
        found = function(data.to_numpy(), max_lag, names=list(data.columns), **kwargs) if len(data) > 2 else []
        return _frame(_edges_of(found, list(data.columns), head["method"], head["traj_id"], head["run_id"]))

    each = obs.withColumn("method", F.explode(F.array(*map(F.lit, functions))))
    return each.groupBy("traj_id", "run_id", "method").applyInPandas(fit, _edge_schema(obs))


def complete_steps(obs: DataFrame) -> DataFrame:
    """Steps of a sample that have a number for each of its variables; repeated cells are averaged."""
    key = ["traj_id", "run_id"]
    cells = obs.where("value IS NOT NULL AND NOT isnan(value)").groupBy(*key, "t", "variable").agg(F.avg("value").alias("value"))
    names = obs.groupBy(*key).agg(F.count_distinct("variable").alias("_names"))
    whole = cells.groupBy(*key, "t").agg(F.count("*").alias("_cells")).join(names, key).where("_cells = _names").select(*key, "t")
    return cells.join(whole, [*key, "t"], "left_semi")


def _scaled(obs: DataFrame) -> DataFrame:
    """Population z-scores per sample and variable."""
    key = ["traj_id", "run_id", "variable"]
    own = obs.groupBy(*key).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    value = (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return obs.join(own, key).withColumn("value", value).drop("_m", "_s")


def lagged_moments(obs: DataFrame, reach: int) -> DataFrame:
    """(traj_id, run_id, names, n, mean, m2) of all variables at lags 0 to reach, lag by lag: rows, means and sums of centred products.

    Each task adds its steps up; a sample has one row per task that held steps of it. Steps that lack a variable of their sample
    go before lags are taken.
    """
    key = ["traj_id", "run_id"]
    cells = obs.where("value IS NOT NULL AND NOT isnan(value)").groupBy(*key, "t", "variable").agg(F.avg("value").alias("value"))
    steps = cells.groupBy(*key, "t").agg(F.array_sort(F.collect_list(F.struct("variable", "value"))).alias("cells"))
    names = obs.groupBy(*key).agg(F.array_sort(F.collect_set("variable")).alias("names"))
    steps = steps.join(names, key).where(F.size("cells") == F.size("names")).select(*key, "names", "t", F.transform("cells", lambda c: c["value"]).alias("x0"))
    w = Window.partitionBy(*key).orderBy("t")
    steps = steps.select(*key, "names", "x0", *[F.lag("x0", k).over(w).alias(f"x{k}") for k in range(1, reach + 1)])
    rows = (steps.where(F.col(f"x{reach}").isNotNull()) if reach else steps).select(*key, "names", F.flatten(F.array(*[f"x{k}" for k in range(reach + 1)])).alias("x"))

    def add(frames):
        sums: dict = {}
        for frame in frames:
            for k, part in frame.groupby(key, dropna=False):
                x = np.stack(part["x"].to_numpy())
                mean = x.mean(0)
                new = (len(x), mean, (x - mean).T @ (x - mean))
                sums[k] = (*_together(sums[k][:3], new), sums[k][3]) if k in sums else (*new, list(part["names"].iloc[0]))
        yield pd.DataFrame([(*k, names, n, mean.tolist(), m2.ravel().tolist()) for k, (n, mean, m2, names) in sums.items()], columns=[*key, "names", "n", "mean", "m2"])

    return rows.mapInPandas(add, f"traj_id {obs.schema['traj_id'].dataType.simpleString()}, run_id int, names array<string>, n long, mean array<double>, m2 array<double>")


def _together(a: tuple, b: tuple) -> tuple:
    """Rows, means and centred products of two sets of rows as one."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + np.outer(gap, gap) * a[0] * b[0] / n


def _fit_moments(obs: DataFrame, functions: dict, max_lag: int, reach: int) -> DataFrame:
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for r in frame.itertuples(index=False):
            mine = (r.n, np.asarray(r.mean, float), np.asarray(r.m2, float).reshape(len(r.mean), -1))
            total = _together(total, mine) if total else mine
        n, mean, m2 = total
        names, head = list(frame["names"].iloc[0]), frame.iloc[0]
        found = {k: f(m2 / max(n - 1, 1), mean, n, names, max_lag, **kwargs) for k, (f, kwargs) in functions.items()}
        return _frame([row for k, records in found.items() for row in _edges_of(records, names, k, head["traj_id"], head["run_id"])])

    return lagged_moments(obs, reach).groupBy("traj_id", "run_id").applyInPandas(fit, _edge_schema(obs))


def with_bootstraps(obs: DataFrame, runs: int, block: int | None = None, seed: int = 42, first: int = 0) -> DataFrame:
    """The sample itself as run 0 and so many moving-block samples, from run first on; all trajectories share the index."""
    base = obs.select(F.lit(0).alias("run_id"), "traj_id", "t", "variable", "value")
    if not runs:
        return base
    steps = int(obs.agg(F.max("t")).first()[0]) + 1
    index = block_index(obs.sparkSession, steps, runs, block or max(2, steps // 10), seed, max(first, 1))
    more = bootstrap(obs, index)
    return more if first else base.unionByName(more)


def run_table(obs: DataFrame, methods: Sequence[str]) -> DataFrame:
    """(run_id, method) of every fit, so that empty results are known."""
    return obs.select("run_id").distinct().withColumn("method", F.explode(F.array(*map(F.lit, methods))))


def fit_in_waves(obs: DataFrame, specs: Mapping[str, MethodSpec], max_lag: int, seconds: float, wave: int, path: str) -> DataFrame:
    """Fits runs in waves of so many and stops between waves when the time is up; at least one wave is fitted."""
    began = time.monotonic()
    runs = sorted(r[0] for r in obs.select("run_id").distinct().collect())
    for at in range(0, len(runs), wave):
        if at and time.monotonic() - began >= seconds:
            break
        fit_grid(obs.where(F.col("run_id").isin(runs[at : at + wave])), specs, max_lag).write.mode("append").parquet(path)
    return obs.sparkSession.read.parquet(path)


def segment_votes(edges: DataFrame, segments: int, least: int = 2) -> DataFrame:
    """Edges that recur in at least so many segments: mean score, combined p-value, segments and their share."""
    from ..functions.special import fisher

    found = edges.groupBy("traj_id", "source", "target", "lag").agg(
        F.avg("score").alias("score"), fisher(F.col("p_value")).alias("p_value"), F.count_distinct("segment").alias("segment_votes"), F.array_sort(F.collect_set("segment")).alias("segments")
    )
    return found.where(F.col("segment_votes") >= least).withColumn("support_ratio", F.col("segment_votes") / segments)


def pooled_covariance(obs: DataFrame, max_lag: int) -> tuple[np.ndarray, int, list[str]]:
    """Covariance of all variables at lags 0 to max_lag, pooled over trajectories: tasks add steps up, small matrices return.

    Trajectories that lack a variable don't count.
    """
    names = variables(obs)
    size = len(names) * (max_lag + 1)
    parts = lagged_moments(obs.withColumn("run_id", F.lit(0)), max_lag).where(F.size("names") == len(names))

    def pool(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for r in frame.itertuples(index=False):
            mine = (r.n, np.asarray(r.mean, float), np.asarray(r.m2, float).reshape(size, size))
            total = _together(total, mine) if total else mine
        return pd.DataFrame({"part": [0], "n": [total[0]], "mean": [total[1].tolist()], "m2": [total[2].ravel().tolist()]})

    # first per group of trajectories, then the few sums of those
    kind = "part int, n long, mean array<double>, m2 array<double>"
    some = parts.select(F.pmod(F.xxhash64("traj_id"), F.lit(256)).cast("int").alias("part"), "n", "mean", "m2").groupBy("part").applyInPandas(pool, kind)
    found = some.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(pool, kind).first()
    if found is None:
        return np.zeros((size, size)), 0, names
    return np.asarray(found["m2"]).reshape(size, size) / max(found["n"] - 1, 1), found["n"], names


def reduce_pairs(links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The strongest effect and the least p-value of every unordered pair, over both directions and all lags."""
    from .structure import PAIR, with_pair

    best = with_pair(links.where("source <> target")).groupBy(*by, *PAIR).agg(F.max(F.abs("score")).alias("score"), F.min("p_value").alias("p_value"))
    return best.select(*by, F.col("pair_lo").alias("source"), F.col("pair_hi").alias("target"), "score", "p_value")


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """The edges of several methods in one table; columns that a method lacks are null."""
    if not frames:
        raise ValueError("no method has edges")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def panel_pcmci(obs: DataFrame, max_lag: int = 1, alpha: float = 1.0) -> DataFrame:
    """The strongest momentary correlation and least p-value of every unordered pair over all trajectories."""
    from ..methods.pcmci import mci
    from .panel import zscore

    cov, n, names = pooled_covariance(zscore(obs, 1e-12), 2 * max_lag)
    links = obs.sparkSession.createDataFrame(pd.DataFrame(mci(cov, n, names, max_lag, alpha, 0.2), columns=["source", "target", "lag", "score", "p_value"]), CANONICAL)
    return reduce_pairs(links)
