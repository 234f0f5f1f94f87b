"""Tests on counts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """Sum of logarithms; counts here are days or cells, not rows of a corpus."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a 2 x 2 table: the sum over all tables with these margins that are no likelier than it."""
    r1, r2, c1 = a + b, c + d, a + c
    n = r1 + r2
    fixed = log_factorial(r1) + log_factorial(r2) + log_factorial(c1) + log_factorial(n - c1) - log_factorial(n)
    of = lambda x: fixed - log_factorial(x) - log_factorial(r1 - x) - log_factorial(c1 - x) - log_factorial(r2 - c1 + x)
    lo, hi = F.greatest(F.lit(0), c1 - r2).cast("int"), F.least(r1, c1).cast("int")
    observed = of(a)
    total = F.aggregate(F.sequence(lo, hi), F.lit(0.0), lambda s, x: s + F.when(of(x) <= observed + 1e-7, F.exp(of(x))).otherwise(0.0))
    return F.least(total, F.lit(1.0))


def against_uniform(p_values: DataFrame, p: str, order: list[str]) -> DataFrame:
    """p-values in order, with the quantile that a uniform sample would have. One row per test."""
    w = Window.orderBy(p, *order)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return p_values.withColumn("nth", F.row_number().over(w)).withColumn("expected", F.col("nth") / (n + 1))
