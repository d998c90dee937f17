"""Statistics over aggregated rows, as Column expressions; the few numbers that need a normal quantile take it as a literal."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = NormalDist()
Z95 = NORMAL.inv_cdf(0.975)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval, clipped to [0, 1]; (0, 0) without trials."""
    trials = n.cast("double")
    p = successes / trials
    middle = p + z * z / (2 * trials)
    half = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    scale = 1 + z * z / trials
    low = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (middle - half) / scale))
    high = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (middle + half) / scale))
    return low, high


def wilson_sql(successes: str, n: str, bound: str, z: float = Z95) -> str:
    """The bound ("low" or "high") of ``wilson`` as SQL over doubles."""
    sign, clip, edge = ("-", "greatest", "0e0") if bound == "low" else ("+", "least", "1e0")
    s, t, zz = f"cast({successes} AS double)", f"cast({n} AS double)", repr(z)
    p = f"({s} / {t})"
    return (
        f"CASE WHEN {n} = 0 THEN 0e0 ELSE {clip}({edge}, ({p} + {zz}::double * {zz}::double / (2 * {t}) {sign} {zz}::double * "
        f"sqrt({p} * (1 - {p}) / {t} + {zz}::double * {zz}::double / (4 * {t} * {t}))) / (1 + {zz}::double * {zz}::double / {t})) END"
    )


def cohens_h(a: Column, b: Column) -> Column:
    return 2 * F.asin(F.sqrt(a)) - 2 * F.asin(F.sqrt(b))


def two_proportion_z(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Pooled z of two proportions a/n and b/m; null where there are no trials or no variance."""
    pooled = (a + b) / (n + m)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    return F.when((n > 0) & (m > 0) & (error > 0), (a / n - b / m) / error)


def two_sided_p(z: float) -> float:
    return 2 * (1 - NORMAL.cdf(abs(z)))


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, to some 14 digits: the series of positive terms up to 3, above that the continued fraction, as folds over fixed ranges."""
    square = x * x
    start = F.struct(x.alias("t"), x.alias("s"))

    def more(a: Column, k: Column) -> Column:
        t = a["t"] * 2 * square / (2 * k + 1)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    steps = lambda n: F.sequence(F.lit(1), F.lit(n))
    series = 1 - 2 / math.sqrt(math.pi) * F.exp(-square) * F.aggregate(steps(90), start, more, lambda a: a["s"])
    fraction = F.exp(-square) / (x * math.sqrt(math.pi)) / F.aggregate(F.reverse(steps(80)), F.lit(1.0), lambda a, k: 1 + k / (2 * square) / a)
    return F.when(x <= 3, series).otherwise(fraction)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution's function."""
    tail = erfc(F.abs(z) / math.sqrt(2)) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


def two_sided(z: Column) -> Column:
    """Two-sided p of a z."""
    return erfc(F.abs(z) / math.sqrt(2))


def sequential_bounds(share: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """(boundary of |z|, alpha spent so far) of O'Brien and Fleming at a share of the information; null where there is none."""
    z = NORMAL.inv_cdf(1 - alpha / 2)
    at = F.when((share > 0) & (share <= 1), z / F.sqrt(share))
    return at, two_sided(at)


def required_trials(p: Column, effect: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """``required_per_arm`` as a Column; null at rates without variance."""
    z, b = NORMAL.inv_cdf(1 - alpha / 2), NORMAL.inv_cdf(power)
    q = p + effect
    mean = (p + q) / 2
    top = z * F.sqrt(2 * mean * (1 - mean)) + b * F.sqrt(p * (1 - p) + q * (1 - q))
    fit = (p > 0) & (p < 1) & (q > 0) & (q < 1) & (effect != 0)
    return F.when(fit, F.ceil(top * top / (effect * effect)))


def detectable_effect(p: Column, n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """``minimum_effect`` as a Column."""
    z = NORMAL.inv_cdf(1 - alpha / 2) + NORMAL.inv_cdf(power)
    return F.when((p > 0) & (p < 1) & (n > 0), z * F.sqrt(2 * p * (1 - p) / n))


def required_days(trials: Column, per_day: Column) -> Column:
    """Whole days until each arm has its trials; null without traffic."""
    return F.when(per_day > 0, F.ceil(trials / per_day))


def corpus_floor(margin: float, p: float = 0.5, confidence: float = 0.95) -> int:
    """Labelled cases needed for a proportion p within a margin."""
    z = NORMAL.inv_cdf(0.5 + confidence / 2)
    return math.ceil(z * z * p * (1 - p) / (margin * margin))


def required_per_arm(p: float, effect: float, alpha: float = 0.05, power: float = 0.8) -> int | None:
    """Trials of each arm that show a difference of ``effect`` from rate p; None at rates without variance."""
    q = p + effect
    if not 0 < p < 1 or not 0 < q < 1 or not effect:
        return None
    z, b = NORMAL.inv_cdf(1 - alpha / 2), NORMAL.inv_cdf(power)
    mean = (p + q) / 2
    top = z * math.sqrt(2 * mean * (1 - mean)) + b * math.sqrt(p * (1 - p) + q * (1 - q))
    return math.ceil(top * top / (effect * effect))


def minimum_effect(p: float, n: int, alpha: float = 0.05, power: float = 0.8) -> float | None:
    """Smallest absolute difference that n trials of each arm show at rate p."""
    if not 0 < p < 1 or n <= 0:
        return None
    return (NORMAL.inv_cdf(1 - alpha / 2) + NORMAL.inv_cdf(power)) * math.sqrt(2 * p * (1 - p) / n)


def sequential_bound(share: float, alpha: float = 0.05) -> float:
    """O'Brien-Fleming boundary at a share of the information: z / sqrt(share)."""
    return NORMAL.inv_cdf(1 - alpha / 2) / math.sqrt(share)


def expected_regret(mean: float, deviation: float) -> float:
    """Expected loss of taking an arm whose advantage is normal: s*phi(m/s) + m*Phi(m/s)."""
    if deviation <= 0:
        return max(mean, 0.0)
    z = mean / deviation
    return deviation * NORMAL.pdf(z) + mean * NORMAL.cdf(z)


def split_score(session: Column) -> Column:
    """First 8 bytes of the session's SHA-256 as a fraction of 2^64."""
    head = F.conv(F.substring(F.sha2(session, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return head.cast("double") / F.lit(2.0**64)


def split_of(session: Column, fraction: float) -> Column:
    return F.when(split_score(session) < fraction, F.lit("eval")).otherwise(F.lit("train"))
