"""Survey statistics as Column expressions; Student's t quantile as a vectorised function of distinct degrees of freedom."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

MIN_SAMPLE = 3


def z_value(level: float) -> float:
    return NormalDist().inv_cdf(1 - (1 - level) / 2)


#: A number as text: sign, digits with single underscores between them, a fraction, an exponent.
_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def _is(col: Column, *kinds: str) -> Column:
    """Whether the column's type is one of kinds; known when a query is planned."""
    return F.typeof(col).isin(*kinds)


def to_double(col: Column) -> Column:
    """Numbers of a text, number or boolean column. Text counts only if all of it, blanks at its ends aside, is a number or an
    infinity; a typed boolean is 1 or 0; all else, not-a-number included, is null."""
    text = strip(col.cast("string"))
    infinite = F.regexp_extract(text, r"^(?i)([+-]?)inf(?:inity)?$", 1)
    x = F.when(_is(col, "boolean"), F.when(text == "true", 1.0).when(text == "false", 0.0))
    x = x.when(text.rlike(NUMBER), F.replace(text, F.lit("_")).try_cast("double"))
    return x.when(text.rlike(r"^(?i)[+-]?inf(?:inity)?$"), F.when(infinite == "-", F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))


def to_bool(col: Column) -> Column:
    """Typed booleans as they are; numbers are true unless 0; text is true for yes, true, 1 and false for no, false, 0 in any case,
    with nothing around it; else null."""
    text = F.lower(col.cast("string"))
    word = F.when(text.isin("yes", "true", "1"), True).when(text.isin("no", "false", "0"), False)
    return F.when(_is(col, "string", "boolean"), word).otherwise(col.cast("string").try_cast("double") != 0)


def wilson(count: Column, n: Column, level: float) -> Column:
    """struct(lo, hi): Wilson's score interval, kept within 0 and 1; 0 and 0 for n = 0."""
    z2 = z_value(level) ** 2
    p = count / n
    denom = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / denom
    margin = math.sqrt(z2) / denom * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    some = n > 0
    return F.struct(F.when(some, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0).alias("lo"), F.when(some, F.least(F.lit(1.0), centre + margin)).otherwise(0.0).alias("hi"))


def sample_warning(n: Column) -> Column:
    s = n.cast("string")
    return F.when(n < MIN_SAMPLE, F.concat(F.lit("Insufficient data: "), s, F.lit(f" responses (minimum {MIN_SAMPLE} required)."))).when(n < 10, F.concat(F.lit("Small sample size ("), s, F.lit("): confidence interval may be very wide.")))


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_quantile(df: float, level: float) -> float:
    """The two-sided critical value of Student's t, by bisection on the incomplete beta function."""
    if df > 1e6:
        return z_value(level)
    low, high = 0.0, 1e7
    for _ in range(200):
        t = (low + high) / 2
        if 1 - _beta_share(df / 2, 0.5, df / (df + t * t)) < level:
            low = t
        else:
            high = t
        if high - low < 1e-12 * max(1.0, high):
            break
    return (low + high) / 2


def t_critical(level: float):
    """Pandas UDF df -> critical value; equal values of a batch are computed once."""

    @F.pandas_udf("double")
    def critical(df: pd.Series) -> pd.Series:
        known = {v: t_quantile(v, level) if v > 0 else np.nan for v in df.dropna().unique()}
        return df.map(known).astype(float)

    return critical
