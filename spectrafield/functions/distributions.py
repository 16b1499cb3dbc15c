"""Tail probabilities of Student's t and of the normal distribution as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of freedom from which the normal distribution of a corrected statistic stands for t: there both agree to 1e-9.
MANY = 20_000


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|): a power series up to 3, a continued fraction beyond."""
    x = F.abs(z)
    steps = F.sequence(F.lit(1), F.lit(60))
    # sum of x^(2k+1) / (1 * 3 * .. * (2k+1)), term by term
    start = F.struct(x.alias("term"), x.alias("sum"))
    grown = F.aggregate(steps, start, lambda s, k: F.struct((s["term"] * x * x / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * x * x / (2 * k + 1)).alias("sum")))
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    below = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x.cast("double"), lambda s, k: x + k / s)
    return F.when(x < 3, F.greatest(F.lit(0.0), 1 - 2 * density * grown["sum"])).otherwise(2 * density / below)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for whole degrees of freedom, by the finite series in the angle atan(t / sqrt(df)); NULL below 1."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    sine, square = F.sin(angle), F.cos(angle) * F.cos(angle)
    odd = df % 2 == 1
    # terms: product of (2k-1)/(2k) or of (2k)/(2k+1), times cos^2k
    last = F.least(F.greatest(F.floor((df - 2) / 2), F.lit(0)), F.lit(MANY)).cast("int")
    steps = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    ratio = lambda k: F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    series = F.aggregate(steps, start, lambda s, k: F.struct((s["term"] * ratio(k) * square).alias("term"), (s["sum"] + s["term"] * ratio(k) * square).alias("sum")))["sum"]
    inside = F.when(df == 1, 2 * angle / math.pi).when(odd, 2 / math.pi * (angle + sine * F.cos(angle) * series)).otherwise(sine * series)
    z = t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    return F.when(df >= MANY, normal_two_sided(z)).when(df >= 1, F.greatest(F.lit(0.0), 1 - inside))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs: t with n - 2 degrees of freedom; 0 where |r| is 1."""
    left = 1 - r * r
    return F.when(n < 3, None).when(left <= 0, F.lit(0.0)).otherwise(t_two_sided(r * F.sqrt((n - 2) / left), (n - 2).cast("long")))


def normal_below(z: Column) -> Column:
    """P(Z <= z)."""
    return F.when(z < 0, normal_two_sided(z) / 2).otherwise(1 - normal_two_sided(z) / 2)


def normal_quantile(p: Column) -> Column:
    """z of P(Z <= z) = p, by Newton's steps from 0, which never pass the root; p is kept within 1e-10 of 0 and 1."""
    near = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), p))
    step = lambda z, _: z + (near - normal_below(z)) * F.exp(z * z / 2) * math.sqrt(2 * math.pi)
    return F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.lit(0.0), step)
