"""Panels of observations (traj_id, t, variable, value): shaping, scaling, differencing, lags and segments.

Lags count rows of a trajectory, never calendar time; trajectories never mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Variables of one panel at most; their names are schema and known to the driver.
MOST_VARIABLES = 10_000
SERIES = ["traj_id", "variable"]


def series() -> Window:
    return Window.partitionBy(*SERIES).orderBy("t")


def variables(obs: DataFrame) -> list[str]:
    names = sorted(r[0] for r in obs.select("variable").distinct().limit(MOST_VARIABLES + 1).collect())
    if len(names) > MOST_VARIABLES:
        raise ValueError(f"a panel has {MOST_VARIABLES} variables at most")
    return names


def densify(obs: DataFrame) -> DataFrame:
    """Every variable at every step of its trajectory; what was absent is 0."""
    names = variables(obs)
    grid = obs.select("traj_id", "t").distinct().withColumn("variable", F.explode(F.array(*map(F.lit, names))))
    return grid.join(obs, ["traj_id", "t", "variable"], "left").select("traj_id", "t", "variable", F.coalesce("value", F.lit(0.0)).alias("value"))


def wide(obs: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per step, one column per variable."""
    return obs.groupBy("traj_id", "t").pivot("variable", list(names or variables(obs))).agg(F.first("value"))


def complete(obs: DataFrame, least: int = 3) -> DataFrame:
    """Steps at which every variable has a number, renumbered without gaps; fewer than least is an error."""
    names = len(variables(obs))
    ok = obs.where("value IS NOT NULL AND NOT isnan(value)").groupBy("traj_id", "t").agg(F.count("*").alias("n")).where(F.col("n") == names)
    ok = ok.withColumn("to", F.row_number().over(Window.partitionBy("traj_id").orderBy("t")) - 1)
    if ok.groupBy("traj_id").count().where(F.col("count") < least).head(1) or not ok.head(1):
        raise ValueError(f"at least {least} complete steps are needed")
    return obs.join(ok, ["traj_id", "t"]).select("traj_id", F.col("to").cast("long").alias("t"), "variable", "value")


def zscore(obs: DataFrame, eps: float = 0.0) -> DataFrame:
    """Population z-scores per series; a series that doesn't vary is only centred."""
    moments = obs.groupBy(*SERIES).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    scale = F.when(F.col("s") > eps, F.col("s")).otherwise(1.0)
    return obs.join(moments, SERIES).select("traj_id", "t", "variable", ((F.col("value") - F.col("m")) / scale).alias("value"))


def differences(obs: DataFrame, orders: dict[str, int] | int) -> DataFrame:
    """Iterated first differences, order by variable; steps that lose a value for any variable go."""
    order = (lambda v: orders) if isinstance(orders, int) else (lambda v: orders.get(v, 0))
    most = orders if isinstance(orders, int) else max(orders.values(), default=0)
    d = obs.withColumn("d0", F.col("value"))
    for k in range(1, most + 1):
        d = d.withColumn(f"d{k}", F.col(f"d{k - 1}") - F.lag(f"d{k - 1}").over(series()))
    if isinstance(orders, int):
        return d.select("traj_id", "t", "variable", F.col(f"d{orders}").alias("value")).where("value IS NOT NULL")
    pick = F.col("d0")
    for v in orders:
        pick = F.when(F.col("variable") == v, F.col(f"d{order(v)}")).otherwise(pick)
    rank = F.row_number().over(series()) - 1
    return d.withColumn("rank", rank).where(F.col("rank") >= most).select("traj_id", "t", "variable", pick.alias("value"))


def differences_by(obs: DataFrame, orders: DataFrame) -> DataFrame:
    """Iterated first differences by orders(traj_id, variable, differencing_order), 0 where absent.

    The steps that the highest order of a trajectory takes from one variable go for all of them. If nothing would be left,
    the series stay as they are.
    """
    per = orders.select(*SERIES, F.col("differencing_order").alias("_order"))
    most = per.agg(F.max("_order")).first()[0] or 0
    d = obs.join(per, SERIES, "left").fillna(0, ["_order"]).withColumn("d0", F.col("value"))
    for k in range(1, most + 1):
        d = d.withColumn(f"d{k}", F.col(f"d{k - 1}") - F.lag(f"d{k - 1}").over(series()))
    pick = F.element_at(F.array(*[F.col(f"d{k}") for k in range(most + 1)]), F.col("_order") + 1)
    whole = Window.partitionBy("traj_id")
    d = d.withColumns({"_rank": F.row_number().over(series()) - 1, "_lost": F.max("_order").over(whole), "_size": F.count("*").over(Window.partitionBy(*SERIES))})
    short = F.min("_size").over(whole) <= F.col("_lost")
    d = d.withColumn("_short", short).where(F.col("_short") | (F.col("_rank") >= F.col("_lost")))
    return d.select("traj_id", "t", "variable", F.when(F.col("_short"), F.col("value")).otherwise(pick).alias("value"))


def lags(obs: DataFrame, most: int, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """Each value beside its own lag_1 to lag_most; steps without all lags go. A series is a variable of a group by."""
    out, own = obs, Window.partitionBy(*by, "variable").orderBy("t")
    for k in range(1, most + 1):
        out = out.withColumn(f"lag_{k}", F.lag("value", k).over(own))
    return out.where(" AND ".join(f"lag_{k} IS NOT NULL" for k in range(1, most + 1)))


def lag_rows(obs: DataFrame, most: int, least: int = 1) -> DataFrame:
    """Long form of the lags: (traj_id, t, variable, lag, value)."""
    each = [F.struct(F.lit(k).alias("lag"), (F.lag("value", k).over(series()) if k else F.col("value")).alias("value")) for k in range(least, most + 1)]
    rows = obs.withColumn("all", F.array(*each)).select("traj_id", "t", "variable", F.inline("all"))
    return rows.where("value IS NOT NULL")


def target_dataset(obs: DataFrame, target: str, most: int) -> DataFrame:
    """Wide rows: the target's value and all variables at lags 1 to most."""
    if most < 1:
        raise ValueError("at least one lag is needed")
    names = variables(obs)
    columns = [f"{v}__lag_{k}" for k in range(1, most + 1) for v in names]
    rows = lag_rows(obs, most).withColumn("column", F.concat("variable", F.lit("__lag_"), F.col("lag").cast("string")))
    wide_ = rows.groupBy("traj_id", "t").pivot("column", columns).agg(F.first("value")).dropna()
    y = obs.where(F.col("variable") == target).select("traj_id", "t", F.col("value").alias("y"))
    return y.join(wide_, ["traj_id", "t"])


def segments(obs: DataFrame, count: int, least: int) -> DataFrame:
    """Contiguous segments of each series whose sizes differ by one at most; fewer if they'd be shorter than least."""
    size = F.count("*").over(Window.partitionBy(*SERIES))
    rank = F.row_number().over(series()) - 1
    k = F.greatest(F.least(F.lit(count), F.floor(size / least)), F.lit(1)).cast("int")
    base, rest = F.floor(size / k), size % k
    edge = rest * (base + 1)
    segment = F.when(rank < edge, F.floor(rank / (base + 1))).otherwise(rest + F.floor((rank - edge) / base))
    return obs.withColumn("segment", segment.cast("int"))


def seasonal_residual(obs: DataFrame, period: int) -> DataFrame:
    """Additive decomposition: trend by a centred moving average (half weights at even periods' ends), seasonal means
    of the detrended series less their mean, and the residual. Rows within period // 2 of an end are left out."""
    half = period // 2
    w = series()
    inner = F.sum("value").over(w.rowsBetween(-half, half))
    trend = (inner - (F.lag("value", half).over(w) + F.lead("value", half).over(w)) / 2) / period if period % 2 == 0 else inner / period
    enough = F.lag("value", half).over(w).isNotNull() & F.lead("value", half).over(w).isNotNull()
    d = obs.withColumns({"pos": F.row_number().over(w) - 1, "trend": F.when(enough, trend)}).where("trend IS NOT NULL")
    d = d.withColumn("phase", F.col("pos") % period)
    by_phase = d.groupBy(*SERIES, "phase").agg(F.avg(F.col("value") - F.col("trend")).alias("raw"))
    centre = by_phase.groupBy(*SERIES).agg(F.avg("raw").alias("centre"))
    seasonal = by_phase.join(centre, SERIES).select(*SERIES, "phase", (F.col("raw") - F.col("centre")).alias("seasonal"))
    out = d.join(seasonal, [*SERIES, "phase"])
    return out.select("traj_id", "t", "variable", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))


def detrended(obs: DataFrame, period: int, model: str = "additive") -> DataFrame:
    """Residual of a decomposition over whole series: the centred moving average as the trend, carried on at both ends along the
    line through the nearest period of it, and seasonal means of what is left, centred.

    Series of under two periods, and of values not above 0 in a multiplicative model, stay as they are.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model {model}")
    part = (lambda x, y: x - y) if model == "additive" else (lambda x, y: x / y)
    half, w, whole = period // 2, series(), Window.partitionBy(*SERIES)
    inner = F.sum("value").over(w.rowsBetween(-half, half))
    mean = (inner - (F.lag("value", half).over(w) + F.lead("value", half).over(w)) / 2) / period if period % 2 == 0 else inner / period
    enough = F.lag("value", half).over(w).isNotNull() & F.lead("value", half).over(w).isNotNull()
    d = obs.withColumns({"pos": F.row_number().over(w) - 1, "size": F.count("*").over(whole), "least": F.min("value").over(whole)})
    d = d.withColumns({"inner": F.when(enough, mean)})
    first, last = F.col("pos") < half + period, F.col("pos") >= F.col("size") - half - period
    lines = [f(F.when(c, F.col("inner")), F.col("pos")).alias(n + end) for end, c in (("0", first), ("1", last)) for n, f in (("slope", F.regr_slope), ("at", F.regr_intercept))]
    d = d.join(d.where("inner IS NOT NULL").groupBy(*SERIES).agg(*lines), SERIES, "left")
    trend = F.coalesce("inner", F.when(F.col("pos") < half, F.col("at0") + F.col("slope0") * F.col("pos")).otherwise(F.col("at1") + F.col("slope1") * F.col("pos")))
    d = d.withColumns({"trend": trend, "phase": F.col("pos") % period})
    by_phase = d.groupBy(*SERIES, "phase").agg(F.avg(part(F.col("value"), F.col("trend"))).alias("raw"))
    seasonal = by_phase.withColumn("seasonal", part(F.col("raw"), F.avg("raw").over(Window.partitionBy(*SERIES))))
    out = d.join(seasonal.select(*SERIES, "phase", "seasonal"), [*SERIES, "phase"], "left")
    whole_enough = (F.col("size") >= 2 * period) & ((F.col("least") > 0) | F.lit(model == "additive")) & F.col("seasonal").isNotNull()
    return out.select("traj_id", "t", "variable", F.when(whole_enough, part(part(F.col("value"), F.col("trend")), F.col("seasonal"))).otherwise(F.col("value")).alias("value"))


def design(obs: DataFrame, most: int) -> DataFrame:
    """Wide rows: all variables at t as x__t and at lags 1 to most as x__lag_k; steps without all of them go."""
    names = variables(obs)
    columns = [f"{v}__t" for v in names] + [f"{v}__lag_{k}" for k in range(1, most + 1) for v in names]
    name = F.when(F.col("lag") == 0, F.concat("variable", F.lit("__t"))).otherwise(F.concat("variable", F.lit("__lag_"), F.col("lag").cast("string")))
    return lag_rows(obs, most, 0).withColumn("column", name).groupBy("traj_id", "t").pivot("column", columns).agg(F.first("value")).dropna()


def holdout(obs: DataFrame, fraction: float = 0.2) -> DataFrame:
    """obs with part, train or validation: the last fraction of each series' steps is validation."""
    size = F.count("*").over(Window.partitionBy(*SERIES))
    rank = F.row_number().over(series()) - 1
    return obs.withColumn("part", F.when(rank < F.floor(size * F.lit(1 - fraction)), "train").otherwise("validation"))


def sample_trajectories(trajectories: DataFrame, count: int, seed: int, without: DataFrame | None = None) -> DataFrame:
    """So many of trajectories(traj_id), not among those of without(traj_id), in the order of a seeded hash."""
    rows = trajectories.select("traj_id").distinct()
    rows = rows.join(without.select("traj_id").distinct(), "traj_id", "left_anti") if without is not None else rows
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("traj_id").cast("string")))).limit(count)


def month_ends(spark, first: str, last: str) -> DataFrame:
    """(t, ts): the last day of every month between two dates, numbered from 0."""
    months = F.posexplode(F.sequence(F.trunc(F.lit(first), "month"), F.trunc(F.lit(last), "month"), F.expr("interval 1 month"))).alias("t", "month")
    return spark.range(1).select(months).select(F.col("t").cast("long").alias("t"), F.last_day("month").alias("ts"))


def lagged_covariance(obs: DataFrame, most: int) -> DataFrame:
    """Population covariance of each target at t with each source at t - lag, lags 0 to most."""
    sources = lag_rows(obs, most, 0).select("traj_id", "t", F.col("variable").alias("source"), "lag", F.col("value").alias("x"))
    targets = obs.select("traj_id", "t", F.col("variable").alias("target"), F.col("value").alias("y"))
    return sources.join(targets, ["traj_id", "t"]).groupBy("source", "target", "lag").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("covariance"))


def pearson(obs: DataFrame) -> DataFrame:
    """Correlation of each pair of variables at equal steps; null under three steps."""
    a = obs.select("traj_id", "t", F.col("variable").alias("source"), F.col("value").alias("x"))
    b = obs.select("traj_id", "t", F.col("variable").alias("target"), F.col("value").alias("y"))
    both = a.join(b, ["traj_id", "t"]).where("source < target").groupBy("source", "target").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    return both.withColumn("r", F.when(F.col("n") >= 3, F.col("r")))


def pearson_test(obs: DataFrame) -> DataFrame:
    """pearson() with the two-sided p-value of r."""
    from ..functions.special import student_p

    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return pearson(obs).withColumn("p_value", F.when(F.abs("r") < 1, student_p(t, F.col("n") - 2)).when(F.col("r").isNotNull(), 0.0))


def temporal_links(graph: DataFrame, obs: DataFrame) -> DataFrame:
    """Links of graph(source, target, lag, mark) with any mark, from lagged to current variables, scored by the correlation at that lag."""
    most = graph.agg(F.max("lag")).first()[0] or 0
    past = lag_rows(obs, most, 0).select("traj_id", "t", F.col("variable").alias("source"), "lag", F.col("value").alias("x"))
    now = obs.select("traj_id", "t", F.col("variable").alias("target"), F.col("value").alias("y"))
    some = graph.where("mark IS NOT NULL AND trim(mark) <> ''").select("source", "target", "lag").distinct()
    both = past.join(some, ["source", "lag"]).join(now, ["traj_id", "t", "target"])
    return both.groupBy("source", "target", "lag").agg(F.count("*").alias("n"), F.corr("x", "y").alias("score"))


def block_index(spark, steps: int, runs: int, block: int, seed: int = 42, first: int = 1) -> DataFrame:
    """(run_id, new_t, t) of the moving-block bootstrap samples first to runs: blocks of steps joined and cut.

    Where a block starts is a hash of seed, run and block, so that a run is the same whichever others are drawn.
    """
    block = min(max(block, 1), steps)
    blocks = -(-steps // block)
    rows = spark.range(first * blocks, (runs + 1) * blocks) if runs >= first else spark.range(0)
    rows = rows.select((F.col("id") / blocks).cast("int").alias("run_id"), (F.col("id") % blocks).alias("block"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "run_id", "block")), 1, 12), 16, 10).cast("long")
    rows = rows.withColumn("start", drawn % (steps - block + 1))
    step = F.posexplode(F.sequence(F.col("start"), F.col("start") + block - 1)).alias("i", "t")
    return rows.select("run_id", "block", step).select("run_id", (F.col("block") * block + F.col("i")).alias("new_t"), "t").where(F.col("new_t") < steps)


def bootstrap(obs: DataFrame, index: DataFrame) -> DataFrame:
    """The samples of a panel that an index of block_index() names, as (run_id, traj_id, t, variable, value)."""
    picked = obs.join(index, "t")
    return picked.select("run_id", "traj_id", F.col("new_t").alias("t"), "variable", "value")

