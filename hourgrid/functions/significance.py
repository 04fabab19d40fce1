"""Two-sided p value of a correlation coefficient as a column expression.

Spark has no t distribution. The regularised incomplete beta function is a continued fraction over a sequence
of steps, which runs inside the executors like any other expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS, TINY = 200, 1e-300
#: The ratio of gamma functions is raised by so many steps to where its series holds to the last digits.
RAISED = 24


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation) in a fixed number of steps."""
    def away(v: Column) -> Column:
        return F.when(F.abs(v) > TINY, v).otherwise(F.lit(TINY))

    def state(c: Column, d: Column, value: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), value.alias("value"))

    def turn(now: Column, term: Column) -> Column:
        d = 1.0 / away(1.0 + term * now["d"])
        c = away(1.0 + term / now["c"])
        return state(c, d, now["value"] * c * d)

    # Steps 2 to 2 * STEPS - 1 are the odd and even terms in turn.
    def step(now: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        return turn(now, F.when(k % 2 == 0, even).otherwise(odd))

    first = 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    start = state(F.lit(1.0), first, first)
    return F.aggregate(F.sequence(F.lit(2), F.lit(2 * STEPS - 1)), start, step, lambda now: now["value"])


def _gamma_half_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a) for a > 0: a series in 1 / a far out, brought down by the recurrence."""
    far = a + float(RAISED)
    series = 1.0 - 1.0 / (8.0 * far) + 1.0 / (128.0 * far**2) + 5.0 / (1024.0 * far**3) - 21.0 / (32768.0 * far**4) - 399.0 / (262144.0 * far**5)
    down = F.aggregate(F.sequence(F.lit(0), F.lit(RAISED - 1)), F.lit(1.0), lambda v, j: v * (a + j) / (a + j + 0.5))
    return F.sqrt(far) * series * down


def correlation_p_value(rho: Column, n: Column) -> Column:
    """Two-sided p value of a correlation of n pairs; null without a coefficient or below three pairs."""
    a = (n.cast("double") - 2.0) / 2.0
    y = rho * rho  # I_x(a, 1/2) with x = 1 - rho^2
    x = 1.0 - y
    front = _gamma_half_ratio(a) / math.sqrt(math.pi) * F.pow(x, a) * F.sqrt(y)
    low = x < (a + 1.0) / (a + 2.5)
    value = F.when(low, front * _beta_fraction(a, F.lit(0.5), x) / a).otherwise(
        1.0 - front * _beta_fraction(F.lit(0.5), a, y) / 0.5)
    inside = F.when(y >= 1.0, F.lit(0.0)).when(y == 0.0, F.lit(1.0)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    return F.when(rho.isNotNull() & ~F.isnan(rho) & (n >= 3), inside)
