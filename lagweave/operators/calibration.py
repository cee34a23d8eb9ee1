"""Calibrated ensembles over candidate pair scores: greedy selection, combination and the number of edges to keep.

scores: (traj_id, pair_lo, pair_hi, candidate, score, label).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import stored
from .structure import PAIR, with_pair

#: Tasks that the folds of one path are dealt to.
SALTS = 16


def combine(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Convex mean of the candidates' scores per trajectory and pair."""
    total = sum(max(w, 0.0) for w in weights.values())
    if total <= 0:
        raise ValueError("weights need a positive sum")
    w = F.coalesce(*[F.when(F.col("candidate") == k, F.lit(max(v, 0.0) / total)) for k, v in weights.items()])
    used = scores.where(F.col("candidate").isin(*weights)).groupBy("traj_id", *PAIR).agg(F.sum(w * F.col("score")).alias("score"), F.max("label").alias("label"), F.count("*").alias("n"))
    if used.where(F.col("n") != len(weights)).head(1):
        raise ValueError("a candidate has no score for some pair")
    return used.drop("n")


def checks(scores: DataFrame) -> DataFrame:
    """One row that counts what breaks the rules of a score table: pairs without some candidate, doubled rows, scores that are
    no numbers, labels other than 0 and 1 or that differ within a pair, trajectories of a single class."""
    names = scores.select("candidate").distinct()
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    pairs = scores.groupBy("traj_id", *PAIR).agg(
        F.count_distinct("candidate").alias("k"), F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.max("label").alias("label"), F.min("label").alias("low"),
        F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("odd"),
    )
    rows = pairs.join(F.broadcast(names.agg(F.count("*").alias("all"))))  # one row
    per = rows.groupBy("traj_id").agg(
        F.count_if(F.col("k") < F.col("all")).alias("incomplete_pairs"), F.sum(F.col("n") - F.col("k")).alias("doubled_scores"), F.sum("bad").alias("invalid_scores"),
        F.sum(F.col("odd") + (F.col("label") != F.col("low")).cast("int")).alias("invalid_labels"), (F.max("label") == F.min("label")).cast("int").alias("single"),
    )
    return per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("incomplete_pairs", "doubled_scores", "invalid_scores", "invalid_labels")], F.coalesce(F.sum("single"), F.lit(0)).alias("single_class_trajectories"))


def validate(scores: DataFrame) -> DataFrame:
    """scores, if checks() finds nothing and there is a row."""
    found = {k: v for k, v in checks(scores).first().asDict().items() if v}
    if found or not scores.head(1):
        raise ValueError(f"the score table is invalid: {found or 'empty'}")
    return scores


def keep_first(rows: DataFrame, order: Sequence[Column], by: Sequence[str] = ("traj_id", *PAIR)) -> DataFrame:
    """The first row of each group in an order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def cv_summary(folds: DataFrame) -> DataFrame:
    """(member_count, mean_ap, std_ap) from (member_count, ap) of held-out trajectories, with the position of each size: best mean, then fewest members."""
    rows = folds.groupBy("member_count").agg(F.avg("ap").alias("mean_ap"), F.stddev_samp("ap").alias("std_ap"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_ap"), "member_count")  # as many rows as there are sizes
    return rows.withColumn("position", F.row_number().over(order))


def fit_cross_validated(scores: DataFrame, members: int) -> dict:
    """The size that held-out trajectories favour and the weights of a path of that size over all of them."""
    if scores.select("traj_id").distinct().count() < 2:
        raise ValueError("at least two trajectories are needed")
    path = cross_validated(validate(scores), members)
    summary = cv_summary(path.where("fold IS NOT NULL").select(F.col("step").alias("member_count"), F.col("held_out_ap").alias("ap")))
    size = summary.where("position = 1").first()["member_count"]
    chosen = [r["candidate"] for r in path.where(F.col("fold").isNull() & (F.col("step") <= size)).orderBy("step").collect()]
    return {"member_count": size, "path": chosen, "weights": {c: chosen.count(c) / size for c in dict.fromkeys(chosen)}, "summary": summary}


def cross_validated(scores: DataFrame, members: int) -> DataFrame:
    """(fold, step, candidate, train_ap, held_out_ap): a greedy path per left-out trajectory; fold null uses all.

    Folds that have chosen alike share one state: each step tries every candidate once per trajectory and distinct path so
    far, and a fold's mean is that of all trajectories less its own. Work grows with scores times distinct paths, of which
    there are few, not with folds times trajectories. Every step uses the scores, so they are stored: what they are made
    from is read once.
    """
    from .metrics import ranked

    scores = stored(scores.select("traj_id", *PAIR, "candidate", "score", "label"))
    spark, kind = scores.sparkSession, scores.schema["traj_id"].dataType
    trajectories = scores.select("traj_id").distinct()
    folds = trajectories.select(F.col("traj_id").alias("fold")).union(spark.range(1).select(F.lit(None).cast(kind)))
    folds = stored(folds.withColumn("path", F.lit("")))
    tries = scores.select("traj_id", *PAIR, "candidate", "score")
    pairs = scores.groupBy("traj_id", *PAIR).agg(F.max("label").alias("label"))
    state = stored(pairs.withColumns({"path": F.lit(""), "total": F.lit(0.0)}))
    steps = []
    for step in range(1, members + 1):
        trial = state.join(tries, ["traj_id", *PAIR]).withColumn("score", F.round((F.col("total") + F.col("score")) / step, 12))
        ap = ranked(trial, ["path", "traj_id", "candidate"]).select("path", "traj_id", "candidate", F.coalesce("average_precision", "prevalence").alias("ap"))
        ap = stored(ap)
        whole = ap.groupBy("path", "candidate").agg(F.sum("ap").alias("sum"), F.count("*").alias("n"))
        # many folds share a path: they are dealt to SALTS tasks, which each get the path's few sums
        dealt = folds.withColumn("salt", F.pmod(F.xxhash64("fold"), F.lit(SALTS)).cast("int"))
        value = dealt.join(whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["path", "salt"])
        own = ap.select("path", "candidate", F.col("traj_id").alias("fold"), F.col("ap").alias("held_out_ap"))
        value = value.join(own, ["path", "candidate", "fold"], "left")
        out = F.col("fold").isNotNull().cast("int")
        value = value.withColumn("train_ap", (F.col("sum") - F.coalesce("held_out_ap", F.lit(0.0))) / F.when(F.col("n") > out, F.col("n") - out))
        rank = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc(F.round("train_ap", 12)), "candidate"))
        best = stored(value.withColumn("_rank", rank).where("_rank = 1").select("fold", "path", "candidate", "train_ap", "held_out_ap"))
        steps.append(best.select("fold", F.lit(step).alias("step"), "candidate", "train_ap", "held_out_ap"))
        if step < members:
            chosen = best.select("path", "candidate").distinct()
            longer = F.concat("path", F.length("candidate").cast("string"), F.lit(":"), "candidate").alias("path")
            taken = state.join(chosen, "path").join(tries, ["traj_id", *PAIR, "candidate"])
            state = stored(taken.select("traj_id", *PAIR, "label", longer, (F.col("total") + F.col("score")).alias("total")))
            folds = stored(best.select("fold", longer))
    out = steps[0]
    for more in steps[1:]:
        out = out.union(more)
    return out


def apply_calibrated(pairs: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Frozen weights on pairs(traj_id, pair, candidate, score, label): score, rank and the best k of each trajectory.

    k is cut to the number of pairs there are. Of several rows of a pair and candidate the one with the highest score counts.
    """
    rows = combine(keep_first(pairs, [F.desc("score")], ["traj_id", *PAIR, "candidate"]), weights)
    rank = F.row_number().over(Window.partitionBy("traj_id").orderBy(F.desc("score"), *PAIR))
    return rows.withColumns({"calibrated_pair_rank": rank, "ensemble_selected": rank <= max(k, 0)})


def calibrated_summary(summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of summary(traj_id, edge, ensemble_score) with the score, rank and flag of their pair from apply_calibrated()."""
    own = pairs.select("traj_id", *PAIR, F.col("score").alias("calibrated"), "calibrated_pair_rank", F.col("ensemble_selected").alias("chosen"))
    rows = with_pair(summary).withColumnRenamed("ensemble_score", "pre_calibration_ensemble_score").join(own, ["traj_id", *PAIR], "left")
    return rows.withColumns({"ensemble_score": F.coalesce("calibrated", F.lit(0.0)), "ensemble_selected": F.coalesce("chosen", F.lit(False))}).drop("calibrated", "chosen", *PAIR)


def top_k_by_f1(pairs: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Mean precision, recall, F1 and distance of keeping the best k pairs of each trajectory; best first by F1, then k.

    pairs: (traj_id, row_idx, score, label). Among equal scores the later row ranks first.
    """
    order = Window.partitionBy("traj_id").orderBy(F.desc("score"), F.desc("row_idx"))
    rows = pairs.withColumn("rank", F.row_number().over(order)).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    kept = F.col("rank") <= F.col("k")
    per = rows.groupBy("k", "traj_id").agg(F.sum(F.when(kept, F.col("label")).otherwise(0)).alias("tp"), F.count_if(kept).alias("n"), F.sum("label").alias("p"))
    per = per.withColumns({"precision": F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0), "recall": F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0)})
    per = per.withColumns({"f1": F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0), "shd": F.col("n") + F.col("p") - 2 * F.col("tp")})
    return per.groupBy("k").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "shd")]).orderBy(F.desc("f1"), "k")


def feasible_k(by_k: DataFrame, least: dict[str, float], fallback_k: int | None = None) -> DataFrame:
    """Rows of top_k_by_f1() that reach the least values asked for, to 1e-12, with their position: best F1, then smallest k.

    If none does, the row of fallback_k; without one that is an error.
    """
    ok = F.lit(True)
    for name, value in least.items():
        ok &= F.col(name) >= value - 1e-12
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("f1"), "k")  # one row per k
    rows = by_k.where(ok)
    if not rows.head(1):
        if fallback_k is None:
            raise ValueError(f"no k reaches {least}")
        rows = by_k.where(F.col("k") == fallback_k)
    return rows.withColumn("position", F.row_number().over(order))
