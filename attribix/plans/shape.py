"""Output shaping shared by the queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 4


def nudge(digits: int) -> float:
    """Far above summation noise and far below the last digit, so that exact ties round one way."""
    return float(f"1e-{digits + 3}")


def rnd(c: Column | str, digits: int = DIGITS) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(nudge(digits)), digits)


def rounded(df: DataFrame, digits: int = DIGITS, **per_column: int) -> DataFrame:
    """Round every double column, so that summation order does not show."""
    return df.select(
        *[
            rnd(f.name, per_column.get(f.name, digits)).alias(f.name)
            if f.dataType.simpleString() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL rounding; adding zero turns -0.0 into 0.0."""
    return f"(round(({expr}) + {nudge(digits):.{digits + 3}f}, {digits}) + 0.0)"


def simpson_sql(integrand: str, low: str, high: str, steps: int = 2000) -> str:
    """Integral in SQL; ``integrand`` is over the variable t."""
    h = f"(({high}) - ({low})) / {steps}"
    at = f"({low}) + i * ({h})"
    return f"(({h}) / 3 * list_sum([(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {integrand.replace('$t', f'({at})')} for i in range({steps + 1})]))"


def beta_sql(a: str, b: str, angle: str) -> str:
    """Incomplete beta function by its trigonometric integral up to ``angle``, whose sine squared is the argument."""
    low = f"greatest(0, {angle} - 60 / sqrt(({a}) + ({b})))"
    log_beta = f"lgamma({a}) + lgamma({b}) - lgamma(({a}) + ({b}))"
    inside = f"exp((2 * ({a}) - 1) * ln(greatest(sin($t), 1e-300)) + (2 * ({b}) - 1) * ln(greatest(cos($t), 1e-300)) - ({log_beta}))"
    return f"2 * {simpson_sql(inside, low, angle)}"


def correlation_p_sql(rho: str, n: str) -> str:
    return f"CASE WHEN {rho} IS NOT NULL AND {n} > 2 THEN CASE WHEN abs({rho}) >= 1 THEN 0 ELSE {beta_sql(f'({n} - 2) / 2.0', '0.5', f'acos(abs({rho}))')} END END"


def f_p_sql(f: str, d1: str, d2: str) -> str:
    return beta_sql(f"{d2} / 2.0", f"{d1} / 2.0", f"atan(sqrt({d2} / ({d1} * {f})))")


def normal_p_sql(z: str) -> str:
    return f"2 * {simpson_sql('exp(-$t * $t / 2) / sqrt(2 * pi())', f'{z}', f'{z} + 12')}"
