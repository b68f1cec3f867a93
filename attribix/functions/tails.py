"""Tail probabilities as column expressions, for statistics that are already aggregated to a few rows.

Series and continued fractions run as ``aggregate`` over a sequence whose length follows from the arguments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from attribix.functions.numeric import col

#: Arguments of the log gamma series are moved up by so much first.
SHIFT = 8
TINY = 1e-300
#: Standard deviations beyond which a normal tail is below any printed digit.
FAR = 12.0


def log_gamma(x: Column) -> Column:
    """ln Gamma for positive x: Stirling's series beyond ``SHIFT``."""
    y = x + SHIFT
    low = x
    for i in range(1, SHIFT):
        low = low * (x + i)
    y2 = y * y
    series = (1 / F.lit(12.0) - (1 / F.lit(360.0) - (1 / F.lit(1260.0) - 1 / (1680 * y2)) / y2) / y2) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(low)


def _away(v: Column) -> Column:
    """v, kept away from zero."""
    return F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function; its terms grow in number like the root of the larger parameter."""
    terms = F.sequence(F.lit(1), (F.lit(60) + F.ceil(4 * F.sqrt(F.greatest(a, b)))).cast("int"))
    first = 1 / _away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def step(acc, top):
        d = 1 / _away(1 + top * acc["d"])
        c = _away(1 + top / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    def both(acc, m):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # A transform gives the inner step its own value, so that it is worked out once.
        inner = F.transform(F.array(step(acc, even)), lambda half: step(half, odd))
        return inner[0]

    return F.aggregate(terms, start, both)["h"]


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta function at x; ``rest`` is 1 - x, given apart as it may be tiny."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(rest))
    near = x < (a + 1) / (a + b + 2)
    inside = F.when(near, front * _beta_fraction(a, b, x) / a).otherwise(1 - front * _beta_fraction(b, a, rest) / b)
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0)))


def t_two_sided(t: str | Column, df: str | Column) -> Column:
    t, df = col(t).cast("double"), col(df).cast("double")
    total = df + t * t
    return F.when(df > 0, incomplete_beta(df / 2, F.lit(0.5), df / total, t * t / total))


def p_correlation(r: str | Column, n: str | Column) -> Column:
    """Two-sided p of a correlation, from the t distribution with n - 2 degrees of freedom."""
    r, n = col(r).cast("double"), col(n).cast("double")
    inside = incomplete_beta((n - 2) / 2, F.lit(0.5), 1 - r * r, r * r)
    return F.when(r.isNotNull() & (n > 2), F.when(F.abs(r) >= 1, 0.0).otherwise(inside))


def p_f(f: str | Column, df1: str | Column, df2: str | Column) -> Column:
    """Upper tail of the F distribution."""
    f, d1, d2 = (col(c).cast("double") for c in (f, df1, df2))
    total = d2 + d1 * f
    return F.when(f.isNotNull() & (d1 > 0) & (d2 > 0), incomplete_beta(d2 / 2, d1 / 2, d2 / total, d1 * f / total))


def p_normal(z: str | Column) -> Column:
    """Two-sided tail of the standard normal distribution: the error function's series without cancelling terms."""
    x = F.abs(col(z).cast("double")) / math.sqrt(2)
    start = F.struct(x.alias("term"), x.alias("sum"))

    def step(acc, n):
        term = acc["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, step)["sum"]
    inside = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series
    return F.when(x > FAR / 2, 0.0).when(x.isNotNull(), F.greatest(inside, F.lit(0.0)))
