"""Small numeric column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    """A column from a name, a column, or (for numbers) a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def temp_key(temp) -> Column:
    """Whole-degree model key, rounding halves to even."""
    return F.rint(c(temp)).cast("int")


def clamp(x, lo, hi) -> Column:
    # least/greatest skip NULLs, so a missing value must be passed through explicitly
    return F.when(c(x).isNotNull(), F.least(F.greatest(c(x), c(lo)), c(hi)))


def nz(x, default=0.0) -> Column:
    return F.coalesce(c(x), F.lit(default))


def safe_div(a, b, guard: float = 0.0) -> Column:
    """``a / b``; NULL where ``|b|`` does not exceed the guard."""
    return F.when(F.abs(c(b)) > guard, c(a) / c(b))


def sum_if(cond: Column, x) -> Column:
    """Conditional sum that is 0, not NULL, when nothing qualifies."""
    return F.sum(F.when(cond, c(x)).otherwise(F.lit(0.0)))


def nearest_rank(sorted_arr: Column, n: Column, p: float) -> Column:
    """Nearest-rank percentile ``ceil(p*n)`` (1-based) of a sorted array."""
    idx = F.greatest(F.ceil(F.lit(p) * n).cast("int"), F.lit(1))
    return F.element_at(sorted_arr, idx)


def solve3(ss, ee, ww, se, sw, ew, bs, be, bw):
    """Cramer solution of a symmetric 3x3 system as (det, x1, x2, x3) columns."""
    det = (
        ss * (ee * ww - ew * ew) - se * (se * ww - ew * sw) + sw * (se * ew - ee * sw)
    )
    d1 = bs * (ee * ww - ew * ew) - se * (be * ww - ew * bw) + sw * (be * ew - ee * bw)
    d2 = ss * (be * ww - ew * bw) - bs * (se * ww - ew * sw) + sw * (se * bw - be * sw)
    d3 = ss * (ee * bw - be * ew) - se * (se * bw - be * sw) + bs * (se * ew - ee * sw)
    return det, d1, d2, d3


def rnd(x, n: int) -> Column:
    """Round half up with a 1e-9 guard, so summation noise cannot flip a tie."""
    return F.round(c(x) + F.lit(1e-9), n)


def regime_of(mode) -> Column:
    """heating, cooling or NULL for modes that carry no solar regime."""
    m = c(mode)
    return (
        F.when(m.isin("heating", "guest_heating"), F.lit("heating"))
        .when(m.isin("cooling", "guest_cooling"), F.lit("cooling"))
    )


def safe_corr(x, y) -> Column:
    """Pearson correlation; NULL where either side has no spread (ANSI mode would raise)."""
    sx, sy = F.stddev_pop(c(x)), F.stddev_pop(c(y))
    return F.when((sx > 1e-9) & (sy > 1e-9), F.covar_pop(c(x), c(y)) / (sx * sy))


def safe_slope(y, x) -> Column:
    """Least-squares slope of y on x; NULL where x has no spread."""
    return F.when(F.var_pop(c(x)) > 1e-12, F.covar_pop(c(x), c(y)) / F.var_pop(c(x)))
