"""Null-safe numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96  # two-sided 95 % normal quantile as used throughout


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """TRUE for a real number; FALSE for NULL, NaN and infinities."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def coerce_double(c: Column | str) -> Column:
    """Text to DOUBLE; unparsable text and NaN become NULL."""
    return F.nullif(col(c).try_cast("double"), F.lit(float("nan")))


def blank_to_null(c: Column | str) -> Column:
    """The three missing conventions (NULL, empty text, 'nan') as NULL DOUBLE."""
    text = F.trim(col(c).cast("string"))
    return F.when((text == "") | (F.lower(text) == "nan"), None).otherwise(text.try_cast("double"))


def valid_value(c: Column | str, nodata: Column | float | None) -> Column:
    """Finite and not the nodata marker."""
    ok = finite(c)
    if nodata is None:
        return ok
    nd = nodata if isinstance(nodata, Column) else F.lit(float(nodata))
    return ok & (nd.isNull() | F.isnan(nd) | (col(c) != nd))


def valid_exposure(c: Column | str, nodata: Column | float | None = None,
                   cover: Column | str | None = None) -> Column:
    """Finite, non-negative, not nodata, and (if a cover is given) covered."""
    ok = valid_value(c, nodata) & (col(c) >= 0)
    return ok if cover is None else ok & (col(cover) > 0)


def within_sentinel(c: Column | str, nodata: float | None = None, bound: float = 1e20) -> Column:
    """Finite and strictly between -bound and bound."""
    return valid_value(c, nodata) & (col(c) > -bound) & (col(c) < bound)


def ratio0(num: Column | str, den: Column | str) -> Column:
    """num/den, 0 where den is 0 or missing."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))


def ratio_null(num: Column | str, den: Column | str) -> Column:
    """num/den, NULL where den is 0 or missing."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def clamp01(c: Column | str, scale: float = 1.0) -> Column:
    """c/scale held inside [0, 1]; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / F.lit(float(scale)))))


def log1p_pos(c: Column | str) -> Column:
    return F.log1p(F.greatest(col(c), F.lit(0.0)))


def haldane_or(a, b, c, d) -> Column:
    """Odds ratio of a 2x2 table with one half added to every count."""
    a, b, c, d = (col(x) + F.lit(0.5) for x in (a, b, c, d))
    return (a * d) / (b * c)


def woolf_variance(a, b, c, d) -> Column:
    """Variance of the log odds ratio on half-corrected counts."""
    return sum((F.lit(1.0) / (col(x) + F.lit(0.5)) for x in (b, c, d)), F.lit(1.0) / (col(a) + F.lit(0.5)))


def se_from_ci(lo: Column | str, hi: Column | str) -> Column:
    """Standard error of a log ratio from its 95 % limits."""
    return (F.log(col(hi)) - F.log(col(lo))) / F.lit(2.0 * Z95)


def wsum(weight: Column | str, mask: Column) -> Column:
    """Masked sum of the finite weights; 0, not NULL, when nothing matches."""
    return F.coalesce(F.sum(F.when(mask & finite(weight), col(weight))), F.lit(0.0))


def exposure_sum(weight: Column | str, mask: Column | None = None, nodata: float | None = None) -> Column:
    """Masked sum of the valid exposures (finite, not negative, not nodata); 0 when nothing matches.

    Missing exposure of any kind counts as 0 and never spoils the rest of the sum.
    """
    ok = valid_exposure(weight, nodata)
    return F.coalesce(F.sum(F.when(ok if mask is None else mask & ok, col(weight))), F.lit(0.0))


def wmean(value: Column | str, weight: Column | str) -> Column:
    """Weighted mean over rows with finite value and positive finite weight; NULL if none."""
    ok = finite(value) & finite(weight) & (col(weight) > 0)
    return F.try_divide(F.sum(F.when(ok, col(value) * col(weight))), F.sum(F.when(ok, col(weight))))


def expit(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
