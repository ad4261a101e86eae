"""Normal and Student-t tails as column arithmetic (Spark has no ``erf``).

Formulas: Abramowitz & Stegun 7.1.26 (error function, absolute error below 1.5e-7)
and 26.7.5 (t quantile); Hill 1970 (t tail via an equivalent normal deviate).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Abramowitz & Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Fixed value: 97.5 % point of the standard normal distribution.
Z_975 = 1.959963984540054


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z."""
    x = F.abs(z) / math.sqrt(2.0)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    half_tail = F.lit(0.5) * poly * F.exp(-x * x)
    return F.when(z >= 0, half_tail).otherwise(F.lit(1.0) - half_tail)


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for Student's t, through Hill's normal deviate."""
    a = df - F.lit(0.5)
    b = F.lit(48.0) * a * a
    y = a * F.log1p(t * t / df)
    series = ((F.lit(-0.4) * y - 3.3) * y - 24.0) * y - 85.5
    deviate = ((series / (F.lit(0.8) * y * y + 100.0 + b) + y + 3.0) / b + 1.0) * F.sqrt(y)
    return F.lit(2.0) * normal_upper_tail(deviate)


def student_quantile_975(df: Column) -> Column:
    """97.5 % point of Student's t: closed forms for 1 and 2 degrees, A&S 26.7.5 above."""
    z = Z_975
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    v = df.cast("double")
    expansion = F.lit(z) + F.lit(g1) / v + F.lit(g2) / (v * v) + F.lit(g3) / (v * v * v) + F.lit(g4) / (v * v * v * v)
    return (
        F.when(v == 1, F.lit(math.tan(math.pi * 0.475)))
        .when(v == 2, F.lit(0.95 / math.sqrt(2 * 0.975 * 0.025)))
        .when(v > 2, expansion)
    )
