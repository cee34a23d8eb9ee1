"""Judging predicted edges and pairs against known ones."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import finite, valid_p
from .fusion import EDGE
from .ranks import accumulated, placed
from .structure import PAIR, with_pair


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def _scores(rows: DataFrame) -> DataFrame:
    """precision, recall and f1 from columns tp, fp, fn."""
    rows = rows.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rows.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def structural(predicted: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Directed edges with lags: counts, reversed edges, precision, recall, F1 and structural Hamming distance."""
    p = predicted.where(F.col("edge_probability") >= threshold) if "edge_probability" in predicted.columns else predicted
    p, t = p.select(*EDGE).distinct(), truth.select(*EDGE).distinct()
    both = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), EDGE, "full")
    counts = both.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    wrong = p.join(t, EDGE, "left_anti").where("source <> target")
    turned = t.join(p, EDGE, "left_anti").select(F.col("target").alias("source"), F.col("source").alias("target"), "lag")
    reversed_ = wrong.join(turned, EDGE).agg(F.count("*").alias("reversed_edges"))
    rows = _scores(counts.crossJoin(reversed_))  # one row each
    return rows.withColumn("shd", F.col("fp") + F.col("fn") - F.col("reversed_edges"))


def skeleton(predicted: DataFrame, truth: DataFrame, threshold: float = 0.5, evaluated: DataFrame | None = None, nodes: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Undirected pairs: counts and scores, prevalence and the F1 of predicting every pair; by: groups of predictions, judged by the same truth."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    p = predicted.where(F.coalesce("edge_probability", F.lit(0.0)) >= threshold) if "edge_probability" in predicted.columns else predicted
    p, t = (with_pair(x.where("source <> target")).select(*k, *PAIR).distinct() for x, k in ((p, by), (truth, ())))
    if evaluated is not None:
        mask = with_pair(evaluated.where("source <> target")).select(*PAIR).distinct()
        p, t = p.join(mask, PAIR, "left_semi"), t.join(mask, PAIR, "left_semi")
    if by:
        t = predicted.select(*by).distinct().join(F.broadcast(t))  # the known pairs, once a group
    both = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), [*by, *PAIR], "full")
    rows = _scores(both.groupBy(*by).agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")))
    if nodes is None:
        return rows
    rows = rows.withColumn("prevalence", (F.col("tp") + F.col("fn")) / (nodes * (nodes - 1) / 2))
    return rows.withColumn("all_pairs_f1", 2 * F.col("prevalence") / (1 + F.col("prevalence")))


def _node_pairs(groups: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """groups with every unordered pair of nodes, which tasks count out."""
    names = F.array(*map(F.lit, sorted(nodes)))
    firsts = groups.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(nodes) - 2)))).repartition(*groups.columns, "_i")
    pairs = firsts.withColumn("_j", F.explode(F.sequence(F.col("_i") + 1, F.lit(len(nodes) - 1))))
    return pairs.select(*groups.columns, F.get(names, F.col("_i")).alias("pair_lo"), F.get(names, F.col("_j")).alias("pair_hi"))


def _scored_pairs(edges: DataFrame, nodes: Sequence[str], evidence: str, by: Sequence[str]) -> DataFrame:
    """(by, pair, score): the best evidence of each pair of nodes that has any."""
    if len(set(nodes)) < 2 or len(set(nodes)) != len(nodes):
        raise ValueError("at least two different nodes are needed")
    value = {"one_minus_p_value": lambda: 1 - valid_p(F.col("p_value")), "absolute_score": lambda: F.abs(finite(F.col("score")))}.get(evidence, lambda: finite(F.col(evidence)))()
    rows = with_pair(edges.where("source <> target")).withColumn("v", value).where("v IS NOT NULL")
    return rows.where(F.col("pair_lo").isin(*nodes) & F.col("pair_hi").isin(*nodes)).groupBy(*by, *PAIR).agg(F.max("v").alias("score"))


def _groups(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    return edges.select(*by).distinct() if by else edges.sparkSession.range(1).select()


def complete_pairs(edges: DataFrame, nodes: Sequence[str], evidence: str = "edge_probability", default: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """One score per unordered pair of nodes: the best evidence of its edges, or the default.

    evidence: edge_probability, ensemble_score, one_minus_p_value or absolute_score. For a ranking, ranked_pairs() needs no
    row for pairs without evidence.
    """
    best = _scored_pairs(edges, nodes, evidence, by).withColumnRenamed("score", "v")
    grid = _node_pairs(_groups(edges, by), nodes)
    return grid.join(best, [*by, *PAIR], "left").select(*by, *PAIR, F.coalesce("v", F.lit(float(default))).alias("score"))


def ranked_pairs(edges: DataFrame, truth: DataFrame, nodes: Sequence[str], evidence: str = "edge_probability", default: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """ranked() of all pairs of nodes from those alone that have evidence: the others are one level, whose pairs are counted."""
    scored = label(_scored_pairs(edges, nodes, evidence, by), truth)
    known = with_pair(truth.where("source <> target")).where(F.col("pair_lo").isin(*nodes) & F.col("pair_hi").isin(*nodes)).select(*PAIR).distinct().count()
    levels = scored.groupBy(*by, "score").agg(F.count("*").alias("k"), F.sum("label").alias("pos"))
    seen = levels.groupBy(*by).agg(F.sum("k").alias("k"), F.sum("pos").alias("pos"))
    every = len(nodes) * (len(nodes) - 1) // 2
    groups = _groups(edges, by).withColumns({"score": F.lit(float(default)), "_n": F.lit(every), "_p": F.lit(known)})
    rest = groups.join(seen, list(by), "left") if by else groups.join(F.broadcast(seen))  # one row each
    rest = rest.select(*by, "score", (F.col("_n") - F.coalesce("k", F.lit(0))).alias("k"), (F.col("_p") - F.coalesce("pos", F.lit(0))).alias("pos")).where("k > 0")
    return _ranked_levels(levels.unionByName(rest).groupBy(*by, "score").agg(F.sum("k").alias("k"), F.sum("pos").alias("pos")), by)


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label 1 to pairs that the truth holds."""
    t = with_pair(truth.where("source <> target")).select(*PAIR).distinct().withColumn("t", F.lit(1))
    return pairs.join(t, PAIR, "left").withColumn("label", F.coalesce("t", F.lit(0))).drop("t")


def pair_checks(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group of labelled pairs: how many repeat, join a variable to itself, lack a finite score, and the classes seen."""
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    return with_pair(labelled.withColumnsRenamed({"pair_lo": "source", "pair_hi": "target"})).groupBy(*by).agg(
        (F.count("*") - F.count_distinct(*PAIR)).alias("repeated_pairs"), F.count_if(F.col("pair_lo") == F.col("pair_hi")).alias("self_pairs"),
        F.count_if(bad).alias("invalid_scores"), F.count_distinct("label").alias("classes"),
    )


def ranked_checked(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ranked(), after an error for repeated or self pairs, scores that are no numbers, or a group of a single class."""
    wrong = pair_checks(labelled, by).where("repeated_pairs > 0 OR self_pairs > 0 OR invalid_scores > 0 OR classes < 2").head(1)
    if wrong or not labelled.head(1):
        raise ValueError(f"pairs can't be ranked: {wrong[0].asDict() if wrong else 'none'}")
    return ranked(labelled, by)


def described(results: DataFrame, metrics: Sequence[str], by: str = "strategy") -> DataFrame:
    """Mean, sample deviation and median of each metric per group."""
    return results.groupBy(by).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("median", F.median))])


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("count"))


def evidence_mode(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, evidence): 1 - p where a group has any p-value, else the size of its scores."""
    return edges.groupBy(*by).agg(F.when(F.count(valid_p(F.col("p_value"))) > 0, "one_minus_p_value").otherwise("absolute_score").alias("evidence"))


def baselines(keys: DataFrame, nodes: Sequence[str], truth: DataFrame, seed: int = 42) -> DataFrame:
    """(strategy, key, source, target) of two predictions per row of keys(key): every pair, and as many pairs, by a seeded hash, as are true."""
    every = _node_pairs(keys.select("key"), nodes).withColumnsRenamed({"pair_lo": "source", "pair_hi": "target"})
    count = with_pair(truth.where("source <> target")).select(*PAIR).distinct().count()
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key").cast("string"), "source", "target"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(draw))
    some = every.withColumn("_rank", rank).where(F.col("_rank") <= count).drop("_rank")
    return every.select(F.lit("ALL_PAIRS").alias("strategy"), "*").union(some.select(F.lit("RANDOM_DENSITY").alias("strategy"), "*"))


def _ranked_levels(levels: DataFrame, by: Sequence[str]) -> DataFrame:
    """ranked() from (by, score, k, pos): the pairs and true pairs of each distinct score."""
    rows = accumulated(levels, [*by, "score"], {"_upto": F.col("k"), "_found": F.col("pos")}, by=by)
    whole = levels.groupBy(*by).agg(F.sum("k").alias("_n"), F.sum("pos").alias("_p"))
    rows = rows.join(whole, list(by)) if by else rows.join(F.broadcast(whole))  # one row
    seen, hits = F.col("_n") - F.col("_upto") + F.col("k"), F.col("_p") - F.col("_found") + F.col("pos")
    rows = rows.withColumns({"_rank_sum": F.col("pos") * (F.col("_upto") - F.col("k") + (F.col("k") + 1) / 2), "_gain": F.col("pos") * hits / seen})
    total = rows.groupBy(*by).agg(F.max("_n").alias("_n"), F.max("_p").alias("_p"), F.sum("_rank_sum").alias("_r"), F.sum("_gain").alias("_g"))
    n, p = F.col("_n"), F.col("_p")
    ok = (p > 0) & (p < n)
    return total.select(*by, F.when(ok, (F.col("_r") - p * (p + 1) / 2) / (p * (n - p))).alias("auroc"), F.when(ok, F.col("_g") / p).alias("average_precision"), (p / n).alias("prevalence"))


def ranked(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUROC by mid-ranks and average precision over distinct thresholds of (by, score, label); null for a single class."""
    return _ranked_levels(labelled.groupBy(*by, "score").agg(F.count("*").alias("k"), F.sum("label").alias("pos")), by)


def paired(results: DataFrame, metric: str, candidate: str, baseline: str, higher: bool = True) -> DataFrame:
    """(trajectory_index, difference) of two strategies on the trajectories that have both; positive is better."""
    both = results.where(F.col("strategy").isin(candidate, baseline)).groupBy("trajectory_index").pivot("strategy", [candidate, baseline]).agg(F.first(metric)).dropna()
    d = F.col(f"`{candidate}`") - F.col(f"`{baseline}`")
    return both.select("trajectory_index", (d if higher else -d).alias("difference"))


def bootstrap_means(differences: DataFrame, bootstraps: int, seed: int = 42) -> DataFrame:
    """(draw, mean) of so many resamples: each takes as many differences as there are, with the counts that hashes give them.

    differences: (trajectory_index, difference). Tasks count the hashes of each draw by position, so a difference enters
    a draw once, with its weight.
    """
    rows = placed(differences.where("difference IS NOT NULL"), ["trajectory_index"], name="_at").select((F.col("_at") - 1).alias("at"), F.col("difference").cast("double").alias("d"))
    size = rows.count()
    if not size:
        raise ValueError("there is no difference")
    picks = differences.sparkSession.range(size * bootstraps).select(F.floor(F.col("id") / size).cast("long").alias("draw"), (F.col("id") % size).alias("pick"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "pick")), 1, 12), 16, 10).cast("long") % size
    weights = picks.groupBy("draw", drawn.alias("at")).agg(F.count("*").alias("w"))
    return weights.join(rows, "at").groupBy("draw").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("mean"))


def signed_ranks(differences: DataFrame) -> DataFrame:
    """One row (n, levels, w, ties, exact_p): of the differences that aren't close to 0, how many there are, how many sizes, the smaller rank
    sum, the sum of k^3 - k over sizes of k, and the exact two-sided p-value for up to 25 of different sizes, else null."""
    d = F.col("difference").cast("double")
    sizes = differences.where(d.isNotNull() & (F.abs(d) > 1e-8)).groupBy(F.abs(d).alias("size")).agg(F.count("*").alias("k"), F.count_if(d > 0).alias("up"))
    rows = accumulated(sizes, ["size"], {"upto": F.col("k")}).withColumn("rank", F.col("upto") - F.col("k") + (F.col("k") + 1) / 2)
    k = F.col("k").cast("double")
    found = rows.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count("*").alias("levels"), F.coalesce(F.sum(F.col("up") * F.col("rank")), F.lit(0.0)).alias("plus"),
        F.coalesce(F.sum((F.col("k") - F.col("up")) * F.col("rank")), F.lit(0.0)).alias("minus"), F.coalesce(F.sum(k * k * k - k), F.lit(0.0)).alias("ties"),
    )
    found = found.withColumn("w", F.least("plus", "minus"))
    # how many sign patterns have each rank sum, rank by rank
    ways = F.aggregate(
        F.sequence(F.lit(1), F.col("n").cast("int")), F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), 325)),
        lambda a, r: F.zip_with(a, F.concat(F.array_repeat(F.lit(0.0), r), F.slice(a, F.lit(1), F.lit(326) - r)), lambda x, y: x + y),
    )
    low = F.aggregate(F.slice(ways, F.lit(1), F.floor("w").cast("int") + 1), F.lit(0.0), lambda s, x: s + x)
    exact = F.when(F.col("n") == 0, F.lit(1.0)).when((F.col("n") <= 25) & (F.col("levels") == F.col("n")), F.least(F.lit(1.0), 2 * low / F.pow(F.lit(2.0), F.col("n"))))
    return found.select("n", "levels", "w", "ties", exact.alias("exact_p"))


def superiority_row(differences: DataFrame, bootstraps: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: mean difference with a bootstrap interval, signed ranks, win and tie rates and effect size of (trajectory_index, difference)."""
    d = F.col("difference").cast("double")
    base = differences.where(d.isNotNull()).agg(
        F.avg(d).alias("mean_difference"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"), F.avg((d > 0).cast("double")).alias("win_rate"), F.avg((F.abs(d) <= 1e-8).cast("double")).alias("tie_rate"),
    )
    means = bootstrap_means(differences, bootstraps, seed).agg(*[F.percentile("mean", q).alias(n) for n, q in (("ci_low", 0.025), ("ci_high", 0.975))])
    rows = base.join(F.broadcast(means)).join(F.broadcast(signed_ranks(differences)))  # one row each
    size = F.when(F.abs("mean_difference") <= 1e-8, F.lit(0.0)).otherwise(F.signum("mean_difference") * F.lit(float("inf")))
    return rows.withColumn("effect_size", F.when(F.col("sd") > 0, F.col("mean_difference") / F.col("sd")).otherwise(size)).drop("sd")


def superiority(differences: DataFrame, bootstraps: int = 10_000, seed: int = 42) -> dict[str, float]:
    """superiority_row() as numbers, with the p-value of the signed ranks: exact, else by the normal approximation."""
    r = superiority_row(differences, bootstraps, seed).first().asDict()
    n, levels, w, ties, exact = (r.pop(k) for k in ("n", "levels", "w", "ties", "exact_p"))
    return r | {"p_value": exact if exact is not None else normal_p(n, w, ties)}


def normal_p(n: int, w: float, ties: float) -> float:
    """Two-sided p-value of a rank sum w of n differences by the normal approximation, corrected for ties."""
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(min(1.0, 2 * NormalDist().cdf((w - n * (n + 1) / 4) / variance**0.5)))


def holm(p_values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(…, p_value) with holm_p: running maximum of p times the tests that remain, 1 at most."""
    order = ["p_value", "test"]
    size = p_values.groupBy(*by).agg(F.count("*").alias("_tests"))
    rows = placed(p_values, order, by, "_place")
    rows = rows.join(size, list(by)) if by else rows.join(F.broadcast(size))  # one row
    raw = F.least((F.col("_tests") - F.col("_place") + 1) * F.col("p_value"), F.lit(1.0))
    return accumulated(rows.withColumn("_raw", raw), order, maxima={"holm_p": F.col("_raw")}, by=by).drop("_raw", "_tests", "_place")


def superior(row: dict, holm_p: float, trajectories: int) -> bool:
    """The study's criterion of superiority."""
    return row["ci_low"] > 0.05 and holm_p < 0.05 and row["win_rate"] >= 0.70 and trajectories >= 10
