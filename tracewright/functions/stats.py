"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % quantile of the normal distribution as the reports use it.
Z95 = 1.96


def ratio(top: Column, bottom: Column, digits: int = 4) -> Column:
    """``top / bottom`` rounded, 0.0 where ``bottom`` is zero."""
    return F.round(F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0)), digits)


def rounded(value: Column, digits: int) -> Column:
    """A double rounded half away from zero as SQL engines do it, scaled up in binary first; ``F.round`` goes by the decimal text, so 0.285 is 0.29 there and 0.28 here."""
    scale = float(10**digits)
    return F.round(value * scale, 0) / scale


def mean_reaches(value: Column, least: int) -> Column:
    """Whether the mean of a column of doubles is ``least`` or more.

    Values of up to twelve decimals are added exactly, so a mean of just
    ``least`` doesn't depend on the order of the rows, as a sum of doubles does;
    a group with any other value (NaN, infinite, finer, over 10^16) goes by its
    double mean.
    """
    exact = value.try_cast("decimal(28,12)")
    exact = F.when(exact.cast("double") == value, exact)
    return F.when(F.count(exact) == F.count(value), F.sum(exact) >= F.count(value) * F.lit(least)).otherwise(F.avg(value) >= least)


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def wilson(passes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson score interval, rounded to four places; (0, 0) without trials."""
    trials = n.cast("double")
    p = passes.cast("double") / trials
    z2 = F.lit(z * z)
    scale = 1 + z2 / trials
    middle = (p + z2 / (2 * trials)) / scale
    reach = F.lit(z) * F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials)) / scale
    ends = (F.greatest(middle - reach, F.lit(0.0)), F.least(middle + reach, F.lit(1.0)))
    low, high = (F.when(n > 0, F.round(end, 4)).otherwise(F.lit(0.0)) for end in ends)
    return low, high


def pass_hat_k(wins: Column, trials: Column, k: Column) -> Column:
    """Chance that ``k`` of ``trials`` drawn without replacement are all among the ``wins``."""
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(k, F.lit(1)).cast("long") - 1)
    product = F.aggregate(steps, F.lit(1.0), lambda p, i: p * (wins - i).cast("double") / (trials - i).cast("double"))
    edge = F.when(wins < k, F.lit(0.0)).when((k <= 0) | (k > trials), F.lit(1.0))
    return F.when((k <= 0) | (k > trials) | (wins < k), edge).otherwise(product)
