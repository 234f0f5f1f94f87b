"""Exact quantiles of a whole column, without a task that holds all its values.

Each quantile lies between two order statistics. A pass brackets each wanted rank by an approximate percentile of
the values still in question (a mergeable summary of bounded size) and counts exactly how many lie below, on and
between the brackets; the rank then is one of the brackets or lies strictly between two of them, where the next pass
goes on. A pass leaves about one value in ``ACCURACY`` / 4 of those it saw, so that a trillion values take three;
at most ``HELD`` values in all come to the driver at the end. Ties end a search at once, however many they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.operators.components import checkpointed

ACCURACY, HELD = 10_000, 20_000


@dataclass
class Search:
    """The value of a rank (from 0): among the ``left`` values above ``lo`` and below ``hi``, with ``before`` values below them."""

    rank: int
    before: int
    left: int
    lo: float | None = None
    hi: float | None = None
    value: float | None = None

    def inside(self, v: Column) -> Column:
        above = F.lit(True) if self.lo is None else v > F.lit(self.lo)
        return above & (F.lit(True) if self.hi is None else v < F.lit(self.hi))


def order_statistics(values: DataFrame, v: str, n: int, ranks: list[int], held: int = HELD, accuracy: int = ACCURACY) -> dict[int, float]:
    """The values of some ranks (from 0) among the n known values of a column."""
    x, searches = F.col(v), [Search(r, 0, n) for r in sorted(set(ranks))]
    while True:
        open_ = [s for s in searches if s.value is None and s.left > held // len(searches)]
        if not open_:
            break
        near = [sorted({min(max((s.rank - s.before + d) / s.left, 0.0), 1.0) for d in (-2 * s.left / accuracy, 2 * s.left / accuracy)}) for s in open_]
        row = values.agg(*(F.percentile_approx(F.when(s.inside(x), x), q, accuracy).alias(f"q{k}") for k, (s, q) in enumerate(zip(open_, near, strict=True)))).first()
        cuts = [(min(row[f"q{k}"]), max(row[f"q{k}"])) for k in range(len(open_))]
        counts = []
        for k, (s, (a, b)) in enumerate(zip(open_, cuts, strict=True)):
            here = s.inside(x)
            counts += [F.count_if(here & c).alias(f"{name}{k}") for name, c in (("below", x < F.lit(a)), ("on_a", x == F.lit(a)), ("between", (x > F.lit(a)) & (x < F.lit(b))), ("on_b", (x == F.lit(b)) & F.lit(a != b)))]
        row = values.agg(*counts).first()
        for k, (s, (a, b)) in enumerate(zip(open_, cuts, strict=True)):
            parts = [("below", s.lo, a, None), ("on_a", None, None, a), ("between", a, b, None), ("on_b", None, None, b)]
            at = s.before
            for name, lo, hi, value in parts:
                if s.rank < at + row[f"{name}{k}"]:
                    s.before, s.left, s.lo, s.hi, s.value = at, row[f"{name}{k}"], lo, hi, value
                    break
                at += row[f"{name}{k}"]
            else:
                s.left, s.before, s.lo = s.before + s.left - at, at, b
    last = [s for s in searches if s.value is None]
    if last:
        wanted = last[0].inside(x)
        for s in last[1:]:
            wanted = wanted | s.inside(x)
        got = sorted(r[0] for r in values.filter(x.isNotNull() & wanted).select(x).collect())  # ``held`` rows at most
        for s in last:
            own = [g for g in got if (s.lo is None or g > s.lo) and (s.hi is None or g < s.hi)]
            s.value = own[s.rank - s.before]
    return {s.rank: s.value for s in searches}


def quantiles(df: DataFrame, v: str | Column, shares: list[float], held: int = HELD, accuracy: int = ACCURACY) -> list[float | None]:
    """Quantiles with linear interpolation, as ``percentile`` gives them; None without values."""
    values = df.select((F.col(v) if isinstance(v, str) else v).cast("double").alias("v")).filter("v IS NOT NULL")
    n = values.count()
    if not n:
        return [None] * len(shares)
    if n > held:
        values = checkpointed(values)  # one column; each pass reads it again, not what it was made from
    at = [s * (n - 1) for s in shares]
    found = order_statistics(values, "v", n, [r for p in at for r in (math.floor(p), math.ceil(p))], held, accuracy)
    out = []
    for p in at:
        lo, hi = math.floor(p), math.ceil(p)
        out.append(found[lo] if lo == hi else (hi - p) * found[lo] + (p - lo) * found[hi])
    return out
