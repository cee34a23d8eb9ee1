"""Scalar statistics as Column expressions: tests, posteriors, intervals and encodings."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12
#: Smallest p-value that logarithms see.
LEAST_P = 1e-16


def number(value: float) -> Column:
    return F.lit(float(value))


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, number(low)), number(high)))


def clip_probability(x: Column, eps: float = TINY) -> Column:
    return clip(x, eps, 1 - eps)


def finite(x: Column) -> Column:
    """x, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def valid_p(p: Column) -> Column:
    """p within 0 and 1, else null."""
    return F.when(finite(p).between(0, 1), p)


def chi2_even_sf(half: Column, k: Column) -> Column:
    """Upper tail of chi-square with 2k degrees of freedom at 2 * half: a Poisson sum of k terms."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k.cast("int") - 1, F.lit(1))),
        F.struct(number(1).alias("term"), number(1).alias("sum")),
        lambda a, i: F.struct((a["term"] * half / i).alias("term"), (a["sum"] + a["term"] * half / i).alias("sum")),
    )
    return F.when(k == 1, F.exp(-half)).when(k > 1, F.exp(-half) * terms["sum"])


def fisher(p: Column) -> Column:
    """Combined p-value of a group; invalid values don't count, none gives null."""
    logs = F.sum(-F.log(clip(valid_p(p), LEAST_P, 1)))
    return clip(chi2_even_sf(logs, F.count(valid_p(p))), 0, 1)


def bayes_factor(p: Column) -> Column:
    """Upper bound of the evidence against the null hypothesis; 1 from p = 1/e on."""
    q = clip(p, LEAST_P, 1 - LEAST_P)
    return F.when(finite(p).isNull(), None).when(p >= 1 / math.e, number(1)).otherwise(1 / (-number(math.e) * q * F.log(q)))


def posterior(factor: Column, prior: float) -> Column:
    """Probability from prior odds times the factor; the prior where there is no factor."""
    start = min(max(prior, TINY), 1 - TINY)
    odds = number(start / (1 - start)) * F.greatest(factor, number(LEAST_P))
    return F.when(factor.isNull(), number(start)).otherwise(clip_probability(odds / (1 + odds)))


def score_probability(score: Column, scale: Column) -> Column:
    """Logistic of the score's size against a scale: 0.5 or more, 0.5 where there is no score."""
    usable = F.greatest(F.coalesce(finite(scale), number(1)), number(TINY))
    return F.coalesce(clip_probability(1 / (1 + F.exp(-F.abs(finite(score)) / usable))), number(0.5))


def wilson(votes: Column, total: Column, confidence: float) -> tuple[Column, Column]:
    """Interval of a share of votes."""
    z = NormalDist().inv_cdf(0.5 + min(max(confidence, 1e-6), 1 - 1e-6) / 2)
    n = total.cast("double")
    share = F.least(F.greatest(votes, F.lit(0)), total) / n
    bottom = 1 + z * z / n
    middle, reach = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return clip((middle - reach) / bottom, 0, 1), clip((middle + reach) / bottom, 0, 1)


def local_bic(variance: Column, rows: Column, parents: int, penalty: float = 0.5) -> Column:
    """Score of a variable given its parents, from the variance that they leave: half the log-likelihood's size less penalty times parameters times ln n."""
    floor = F.greatest(variance, F.lit(2.220446049250313e-16))
    return -0.5 * rows * (1 + F.log(floor)) - penalty * (parents + 1) * F.log(rows)


def f_sf_two(f: Column, m: Column) -> Column:
    """Upper tail of the F distribution with 2 and m degrees of freedom."""
    return F.pow(1 + 2 * f / m, -m / 2)


def student_p(t: Column, nu: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom, by the finite trigonometric sums."""
    angle = F.atan(F.abs(t) / F.sqrt(nu.cast("double")))
    cos, sin = F.cos(angle), F.sin(angle)

    def total(first: Column, count: Column, odd: int) -> Column:
        steps = F.aggregate(
            F.sequence(F.lit(1), F.greatest(count.cast("int"), F.lit(1))),
            F.struct(first.alias("term"), first.alias("sum")),
            lambda a, j: F.struct(
                (a["term"] * cos * cos * (2 * j - 1 + odd) / (2 * j + odd)).alias("term"),
                (a["sum"] + a["term"] * cos * cos * (2 * j - 1 + odd) / (2 * j + odd)).alias("sum"),
            ),
        )
        return F.when(count >= 1, steps["sum"]).otherwise(first)

    even = sin * total(number(1), nu / 2 - 1, 0)
    inner = total(cos, (nu - 3) / 2, 1)
    odd = number(2 / math.pi) * F.when(nu == 1, angle).otherwise(angle + sin * inner)
    return clip(1 - F.when(nu % 2 == 0, even).otherwise(odd), 0, 1)


def lag_name(variable: Column, lag: Column) -> Column:
    """Name of a lagged column in a wide design."""
    return F.when(lag == 0, F.concat(variable, F.lit("__t"))).otherwise(F.concat(variable, F.lit("__lag_"), lag.cast("string")))


def sign_label(consensus: Column) -> Column:
    """Text of a sign consensus; unknown values are unknown."""
    return F.when(consensus.isin("positive", "negative", "mixed"), consensus).otherwise("unknown")
