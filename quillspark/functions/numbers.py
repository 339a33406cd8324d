"""Scalar number functions. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """Half away from zero of the double c * 10**digits, as SQL engines in C do; Spark's round works on the decimal text of c.

    What has no digits left to cut (2**52 and more after scaling, infinite, NaN) stays.
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    scale = 10.0**digits
    p = F.abs(x) * scale
    whole = F.floor(p)
    up = whole + F.when(p - whole >= 0.5, 1).otherwise(0)
    return F.when(p < 2.0**52, F.signum(x) * up / scale).otherwise(x)
