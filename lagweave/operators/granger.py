"""Pairwise Granger causality from moments: Spark aggregates them, closed forms give tests and coefficients.

Everything is an expression: for lags 1 and 2 in closed form, for any order by a Cholesky factor. The target's own lags are partialled out of the moments, which leaves a
two-by-two system per pair. The joint test compares with the target's own past; each lag has a t-test of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linear import backward, cholesky, explained, forward, inverse_diagonal, packed
from ..functions.special import f_sf_two, student_p
from .panel import lags

ALPHA = 0.05
_NAMES = ("y", "y1", "y2", "x1", "x2")


def _pairs(obs: DataFrame, most: int, by: Sequence[str]) -> DataFrame:
    """Rows per step and ordered pair: the target, its lags and the source's lags."""
    with_lags = lags(obs, most, by)
    y = with_lags.select(*by, "t", F.col("variable").alias("target"), F.col("value").alias("y"), *[F.col(f"lag_{k}").alias(f"y{k}") for k in range(1, most + 1)])
    x = with_lags.select(*by, "t", F.col("variable").alias("source"), *[F.col(f"lag_{k}").alias(f"x{k}") for k in range(1, most + 1)])
    return y.join(x, [*by, "t"]).where("source <> target")


def tests(obs: DataFrame, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """Order-2 tests of every ordered pair, per group: n, b1, b2, joint F and p, and per-lag t and p."""
    rows = _pairs(obs, 2, by)
    moment = {(a, b): F.covar_pop(a, b).alias(f"{a}_{b}") for i, a in enumerate(_NAMES) for b in _NAMES[i:]}
    m = rows.groupBy(*by, "source", "target").agg(F.count("*").alias("n"), *moment.values())
    c = lambda a, b: F.col(f"{a}_{b}" if (a, b) in moment else f"{b}_{a}")
    det = c("y1", "y1") * c("y2", "y2") - c("y1", "y2") * c("y1", "y2")

    def rest(a: str, b: str):
        """Moment of a and b without what the target's own lags explain."""
        a1, a2, b1, b2 = c(a, "y1"), c(a, "y2"), c(b, "y1"), c(b, "y2")
        return c(a, b) - (a1 * b1 * c("y2", "y2") - (a1 * b2 + a2 * b1) * c("y1", "y2") + a2 * b2 * c("y1", "y1")) / det

    m = m.where("n > 5").where(det != 0).withColumns({"ryy": rest("y", "y"), "r1": rest("y", "x1"), "r2": rest("y", "x2"), "r11": rest("x1", "x1"), "r12": rest("x1", "x2"), "r22": rest("x2", "x2")})
    m = m.withColumn("d", F.expr("r11 * r22 - r12 * r12")).where("d > 0")
    m = m.withColumns({"b1": F.expr("(r1 * r22 - r2 * r12) / d"), "b2": F.expr("(r2 * r11 - r1 * r12) / d"), "dof": F.col("n") - 5})
    m = m.withColumn("u", F.expr("ryy - (r1 * b1 + r2 * b2)")).where("u > 0")
    m = m.withColumns({
        "f": F.expr("((ryy - u) / 2) / (u / dof)"),
        "t1": F.expr("b1 / sqrt(u / dof * r22 / d)"), "t2": F.expr("b2 / sqrt(u / dof * r11 / d)"),
    })
    m = m.withColumns({"p": f_sf_two(F.col("f"), F.col("dof").cast("double")), "p1": student_p(F.col("t1"), F.col("dof")), "p2": student_p(F.col("t2"), F.col("dof"))})
    return m.select(*by, "source", "target", "n", "b1", "b2", "f", "p", "t1", "p1", "t2", "p2")


def edges(tested: DataFrame, alpha: float = ALPHA, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """Canonical edges: lags whose own p and whose pair's joint p are at most alpha."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"b{k}").alias("score"), F.col(f"p{k}").alias("p_value")) for k in (1, 2)])).alias("e")
    out = tested.where(F.col("p") <= alpha).select(*by, "source", "target", each, F.col("p").alias("joint_p_value"), F.col("f").alias("joint_statistic"))
    return out.where(F.col("e.p_value") <= alpha).select(*by, F.lit("ClassicalGranger").alias("method"), "source", "target", "e.lag", "e.score", "e.p_value", "joint_p_value", "joint_statistic")


def gram(obs: DataFrame, most: int, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """Sufficient statistics of every ordered pair for any order: n and the covariances of target, own lags, source lags."""
    names = ["y", *[f"y{k}" for k in range(1, most + 1)], *[f"x{k}" for k in range(1, most + 1)]]
    cells = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]]
    return _pairs(obs, most, by).groupBy(*by, "source", "target").agg(F.count("*").alias("n"), F.array(*cells).alias("cells"))


def tests_any_order(obs: DataFrame, most: int, by: Sequence[str] = ("traj_id",)) -> DataFrame:
    """Coefficients and t statistics of each lag for any order, and the joint F, from a Cholesky factor of each pair's moments.

    The target's own lags come first: what they leave, and what the source's lags leave then, are sums of squares of one
    solve. Columns that depend on others have coefficient and t of zero.
    """
    size, cells = 2 * most, F.col("cells")
    upper = [(i, j) for i in range(size + 1) for j in range(i, size + 1)]
    moment = lambda i, j: F.get(cells, F.lit(upper.index((min(i, j), max(i, j)))))
    rows = gram(obs, most, by).withColumn("dof", F.col("n") - size - 1).where("dof >= 1")
    rows = rows.withColumns({"l": cholesky(packed(lambda i, j: moment(i + 1, j + 1), size), size), "yy": moment(0, 0)})
    rows = rows.withColumn("f", forward(F.col("l"), F.array(*[moment(0, i + 1) for i in range(size)]), size))
    rows = rows.withColumns({"w": backward(F.col("l"), F.col("f"), size), "r0": F.col("yy") - explained(F.col("f"), most), "r1": F.greatest(F.col("yy") - explained(F.col("f")), F.lit(1e-300))})
    inverse = inverse_diagonal(F.col("l"), size, range(most, size))
    each = F.array(*[F.struct(F.lit(k).alias("lag"), F.get("w", F.lit(most + k - 1)).alias("score"), F.sqrt(d * F.col("r1") / F.col("dof")).alias("error")) for k, d in enumerate(inverse, 1)])
    rows = rows.withColumn("joint_statistic", (F.col("r0") - F.col("r1")) / most / (F.col("r1") / F.col("dof"))).select(*by, "source", "target", "n", "dof", "joint_statistic", F.inline(each))
    rows = rows.withColumn("t", F.when(F.col("error") > 0, F.col("score") / F.col("error")).otherwise(0.0))
    return rows.select(*by, "source", "target", "lag", "n", "score", "t", "joint_statistic", "dof", student_p(F.col("t"), F.col("dof")).alias("p_value"))


def segmented(obs_with_segment: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Tests within segments: each segment is a trajectory of its own."""
    as_trajectory = obs_with_segment.withColumn("traj_id", F.struct("traj_id", "segment"))
    found = edges(tests(as_trajectory), alpha)
    return found.select(F.col("traj_id.traj_id").alias("traj_id"), F.col("traj_id.segment").alias("segment"), "source", "target", "lag", "score", "p_value")
