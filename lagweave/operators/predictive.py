"""Out-of-sample gates: how much an edge's source lowers the target's forecast error over expanding splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import backward, cell, cholesky, forward, packed
from ..functions.special import clip
from .fusion import EDGE
from .panel import lags
from .ranks import steps

#: Tasks at least that the steps of one variable are dealt to, where they meet the edges that need them.
PIECES = 16


def splits(rows: int, count: int) -> list[tuple[int, int, int]]:
    """(split, train_end, validation_end) of expanding splits over so many rows; empty ones are left out."""
    out = []
    for i in range(count):
        fraction = 0.5 if count == 1 else 0.5 + 0.3 * i / (count - 1)
        train = max(6, int(rows * fraction))
        end = min(rows, train + max(3, rows // 6))
        if train < end:
            out.append((i, train, end))
    return out


def _other_parents(edges: DataFrame, by: Sequence[str], count: int) -> DataFrame:
    """(by, edge, parents): for each edge the strongest other candidate parents of its target, as (place, source, lag).

    edges: (by, source, target, lag, ensemble_score). A parent is another variable at some lag; the candidates of a target meet its edges only.
    """
    candidates = edges.where("source <> target").groupBy(*by, "target", F.col("source").alias("parent"), F.col("lag").alias("parent_lag")).agg(F.max("ensemble_score").alias("strength"))
    rows = edges.select(*by, *EDGE).distinct().join(candidates, [*by, "target"]).where("parent <> source")
    rank = F.row_number().over(Window.partitionBy(*by, *EDGE).orderBy(F.desc("strength"), "parent", "parent_lag"))
    return rows.withColumn("place", rank).where(F.col("place") <= count).select(*by, *EDGE, "place", "parent", "parent_lag")


def _moments(obs: DataFrame, edges: DataFrame, max_lag: int, count: int, parents: int, by: Sequence[str]) -> DataFrame:
    """(by, edge, traj_id, split, train, test): sums and products of each edge's regression before and after its split.

    The variables are the target's own lags, other parents (none: a constant 0), the source, and the target last. Every
    row of every series is added once, to the stretch between two neighbouring boundaries; splits add up stretches.
    """
    key, size = [*by, *EDGE], max_lag + parents + 1
    place = lambda slot, variable, lag: F.struct(F.lit(slot).alias("slot"), variable.alias("variable"), lag.alias("shift"))
    own = [place(k - 1, F.col("target"), F.lit(k)) for k in range(1, max_lag + 1)]
    used = edges.where((F.col("lag") <= max_lag) & (F.col("source") != F.col("target")))
    columns = F.array(*own, place(size - 1, F.col("source"), F.col("lag").cast("int")), place(size, F.col("target"), F.lit(0)))
    design = used.select(*key).distinct().select(*key, F.inline(columns))
    if parents:
        others = _other_parents(used.where("ensemble_score IS NOT NULL"), by, parents)
        design = design.union(others.select(*key, (F.col("place") + max_lag - 1).alias("slot"), F.col("parent").alias("variable"), F.col("parent_lag").cast("int").alias("shift")))
    parts = F.sequence(F.lit(0), F.lit(PIECES - 1))
    value = F.when(F.isnan("value") | (F.abs("value") == float("inf")) | F.col("value").isNull(), F.lit(float("nan"))).otherwise(F.col("value").cast("double"))
    series = obs.join(steps(obs), ["traj_id", "t"]).withColumn("n", F.col("steps") - max_lag).where("n >= 12")
    series = series.select("traj_id", "variable", "step", "n", value.alias("value"), (F.col("step") % PIECES).cast("int").alias("piece"))
    cells = design.withColumn("piece", F.explode(parts)).join(series, ["variable", "piece"]).withColumn("row", F.col("step") + F.col("shift") - max_lag)
    cells = cells.where("row >= 0 AND row < n")
    absent = [0.0 if max_lag <= i < size - 1 else None for i in range(size + 1)]
    grid = cells.groupBy(*key, "traj_id", "n", "row").agg(*[F.max(F.when(F.col("slot") == i, F.col("value"))).alias(f"v{i}") for i in range(size + 1)])
    if parents:
        known = others.groupBy(*key).agg(F.max("place").alias("known"))
        grid = grid.join(known, key, "left")
        grid = grid.withColumns({f"v{i}": F.when(F.coalesce("known", F.lit(0)) <= i - max_lag, F.lit(0.0)).otherwise(F.col(f"v{i}")) for i in range(size + 1) if absent[i] is not None})
    cuts = [(F.greatest(F.lit(6), F.floor(F.col("n") * (0.5 if count == 1 else 0.5 + 0.3 * i / (count - 1))))).cast("long") for i in range(count)]
    ends = [F.least("n", c + F.greatest(F.lit(3), F.floor(F.col("n") / 6))).cast("long") for c in cuts]
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.array_sort(F.array_distinct(F.array(*cuts, *ends, F.col("n")))))
    grid = grid.where(" AND ".join(f"v{i} IS NOT NULL" for i in range(size + 1))).withColumn("bounds", bounds)
    grid = grid.withColumn("low", F.array_max(F.filter("bounds", lambda b: b <= F.col("row")))).withColumn("high", F.array_min(F.filter("bounds", lambda b: b > F.col("row"))))
    sums = grid.groupBy(*key, "traj_id", "n", "low", "high").agg(
        F.count("*").alias("m"), F.array(*[F.sum(f"v{i}") for i in range(size + 1)]).alias("s"), packed(lambda i, j: F.sum(F.col(f"v{i}") * F.col(f"v{j}")), size + 1).alias("p")
    )
    whole = sums.groupBy(*key, "traj_id", "n").agg(F.collect_list(F.struct("low", "high", "m", "s", "p")).alias("parts"), F.sum("m").alias("rows"))
    whole = whole.where("rows >= 12").where(~F.exists("parts", lambda x: F.exists(x["p"], F.isnan)))
    pairs = F.array(*[F.struct(F.lit(i).alias("split"), c.alias("cut"), e.alias("end")) for i, (c, e) in enumerate(zip(cuts, ends, strict=True))])
    whole = whole.select(*key, "traj_id", "parts", F.inline(pairs)).where("cut < end")
    zero = F.struct(F.lit(0).cast("long").alias("m"), F.array(*[F.lit(0.0)] * (size + 1)).alias("s"), F.array(*[F.lit(0.0)] * cell(size + 1, 0)).alias("p"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = lambda keep: F.aggregate(F.filter("parts", keep), zero, lambda t, x: F.struct((t["m"] + x["m"]).alias("m"), add(t["s"], x["s"]).alias("s"), add(t["p"], x["p"]).alias("p")))
    train, test = total(lambda x: x["high"] <= F.col("cut")), total(lambda x: (x["low"] >= F.col("cut")) & (x["high"] <= F.col("end")))
    return whole.select(*key, "traj_id", "split", train.alias("train"), test.alias("test")).where("train.m > 0 AND test.m > 0")


def gains(obs: DataFrame, edges: DataFrame, max_lag: int = 2, count: int = 3, alpha: float = 1.0, parents: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """(by, traj_id, source, target, lag, split, gain) of each edge, from moments that Spark adds up; no task holds a series.

    The baseline knows the target's own lags and so many of the strongest other candidate parents of the target in the same
    group by; parents need ensemble_score in edges. Lags count the steps of the trajectory; rows in which a series has no
    step are left out, a value that is no number leaves its edges without a gain, as do lags above max_lag and fewer than 12
    rows. Inputs are standardised by the training rows, and a ridge of alpha is solved by a Cholesky factor, of which the
    baseline's is the leading part.
    """
    size = max_lag + parents + 1
    m = _moments(obs, edges, max_lag, count, parents, by).withColumns({"m": F.col("train.m").cast("double"), "s": F.col("train.s"), "p": F.col("train.p")})
    m = m.withColumn("mean", F.transform("s", lambda x: x / F.col("m")))
    get = lambda c, i: F.get(F.col(c), F.lit(i))
    spread = lambda i: get("p", cell(i, i)) / F.col("m") - get("mean", i) * get("mean", i)
    m = m.withColumn("scale", F.array(*[F.when((spread(i) > 1e-16) & (spread(i) > get("p", cell(i, i)) / F.col("m") * 1e-13), F.sqrt(spread(i))).otherwise(1.0) for i in range(size)]))
    centred = lambda i, j: get("p", cell(i, j)) - F.col("m") * get("mean", i) * get("mean", j)
    m = m.withColumn("a", packed(lambda i, j: centred(i, j) / (get("scale", i) * get("scale", j)) + (alpha if i == j else 0.0), size))
    m = m.withColumn("b", F.array(*[centred(i, size) / get("scale", i) for i in range(size)])).withColumn("l", cholesky(F.col("a"), size))
    m = m.withColumn("f", forward(F.col("l"), F.col("b"), size))
    m = m.withColumns({"w0": backward(F.col("l"), F.col("f"), size - 1), "w1": backward(F.col("l"), F.col("f"), size)})
    seen = lambda i, j: F.get("test.p", F.lit(cell(i, j))) - get("mean", i) * F.get("test.s", F.lit(j)) - get("mean", j) * F.get("test.s", F.lit(i)) + F.col("test.m") * get("mean", i) * get("mean", j)
    m = m.withColumn("v", packed(seen, size + 1)).withColumns({f"g{k}": F.zip_with(f"w{k}", "scale", lambda w, c: F.coalesce(w, F.lit(0.0)) / c) for k in (0, 1)})

    def error(k: int) -> Column:
        w = [get(f"g{k}", i) for i in range(size)] + [F.lit(-1.0)]
        return sum(w[i] * w[j] * get("v", cell(i, j)) * (1 if i == j else 2) for i in range(size + 1) for j in range(i + 1)) / F.col("test.m")

    m = m.withColumns({"e0": error(0), "e1": error(1)})
    return m.select(*by, "traj_id", "source", "target", "lag", "split", ((F.col("e0") - F.col("e1")) / F.greatest("e0", F.lit(1e-12))).alias("gain"))


def parent_order() -> list[Column]:
    """Candidate parents of a target: the strongest first."""
    return [F.desc("ensemble_score"), F.col("source"), F.col("lag")]


def gate(summary: DataFrame, gain_rows: DataFrame, weight: float = 0.75, penalty: float = 0.0, exponent: float = 0.5, by: Sequence[str] = ("combo_id",)) -> DataFrame:
    """Damps ensemble scores by the rank of the edges' predictive gain among those that gain anything.

    Gains may be those of all groups, or of each group by if they have its columns.
    """
    own = [c for c in by if c in gain_rows.columns]
    per = gain_rows.groupBy(*own, *EDGE).agg(
        F.avg("gain").alias("predictive_gain_mean"), F.coalesce(F.stddev_samp("gain"), F.lit(0.0)).alias("predictive_gain_std"), F.count("*").alias("k"),
        F.avg((F.col("gain") > 0).cast("double")).alias("predictive_positive_split_ratio"),
    )
    per = per.withColumn("predictive_gain_standard_error", F.col("predictive_gain_std") / F.sqrt(F.col("k").cast("double"))).drop("k")
    per = per.withColumn("predictive_gain", F.greatest(F.lit(0.0), F.col("predictive_gain_mean") - penalty * F.col("predictive_gain_standard_error")))
    rows = summary.join(per, [*own, *EDGE], "left").fillna(0.0, [c for c in per.columns if c.startswith("predictive")])
    up = F.col("predictive_gain") > 0
    group = Window.partitionBy(*by, up)
    ties = F.count("*").over(Window.partitionBy(*by, up, "predictive_gain"))
    rank = (F.rank().over(group.orderBy("predictive_gain")) + (ties - 1) / 2) / F.count("*").over(group)
    rows = rows.withColumns({"predictive_rank": F.when(up, rank).otherwise(0.0), "pre_validation_ensemble_score": F.col("ensemble_score")})
    return rows.withColumn("ensemble_score", clip(F.col("ensemble_score") * ((1 - weight) + weight * F.pow("predictive_rank", F.lit(exponent))), 0, 1))


def gains_order_one(obs: DataFrame, count: int = 3, alpha: float = 1.0) -> DataFrame:
    """The gain of every ordered pair's lag 1 from split-wise moments alone: closed forms of one and two inputs."""
    w = lags(obs, 1)
    rank = F.row_number().over(Window.partitionBy("traj_id", "variable").orderBy("t")) - 1
    total = F.count("*").over(Window.partitionBy("traj_id", "variable"))
    y = w.select("traj_id", "t", F.col("variable").alias("target"), F.col("value").alias("y"), F.col("lag_1").alias("a"), rank.alias("i"), total.alias("rows"))
    x = w.select("traj_id", "t", F.col("variable").alias("source"), F.col("lag_1").alias("b"))
    pairs = y.join(x, ["traj_id", "t"]).where("source <> target")
    fraction = F.lit(0.5) if count == 1 else F.lit(0.5) + F.lit(0.3) * F.col("split") / (count - 1)
    rows = pairs.withColumn("split", F.explode(F.array(*map(F.lit, range(count)))))
    rows = rows.withColumn("train", F.greatest(F.lit(6), F.floor(F.col("rows") * fraction)))
    rows = rows.withColumn("end", F.least("rows", F.col("train") + F.greatest(F.lit(3), F.floor(F.col("rows") / 6)))).where("i < end")
    key = ["traj_id", "source", "target", "split"]
    fit = rows.where("i < train").groupBy(*key).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "yab"], F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"),
        F.covar_pop("a", "y").alias("cay"), F.covar_pop("b", "y").alias("cby"), F.covar_pop("a", "b").alias("cab"),
    )
    fit = fit.withColumns({s: F.when(F.col(s) < 1e-8, 1.0).otherwise(F.col(s)) for s in ("sa", "sb")})
    fit = fit.withColumns({"va": F.expr("n * cay / sa"), "vb": F.expr("n * cby / sb"), "o": F.expr("n * cab / (sa * sb)"), "h": F.col("n") + F.lit(float(alpha))})
    fit = fit.withColumns({"w0": F.expr("va / h"), "w1": F.expr("(va * h - vb * o) / (h * h - o * o)"), "w2": F.expr("(vb * h - va * o) / (h * h - o * o)")})
    test = rows.where("i >= train").join(fit, key).withColumns({"za": F.expr("(a - ma) / sa"), "zb": F.expr("(b - mb) / sb"), "zy": F.expr("y - my")})
    errors = test.groupBy(*key).agg(F.avg(F.expr("pow(zy - w0 * za, 2)")).alias("e0"), F.avg(F.expr("pow(zy - w1 * za - w2 * zb, 2)")).alias("e1"))
    return errors.select(*key, ((F.col("e0") - F.col("e1")) / F.greatest("e0", F.lit(1e-12))).alias("gain"))
