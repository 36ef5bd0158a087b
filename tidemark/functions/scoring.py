"""Score and label expressions. Plain Catalyst expressions, so they stay in codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NULL for NaN and infinities, else the value."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def is_finite(x: Column) -> Column:
    return finite(x).isNotNull()


def positive(x: Column) -> Column:
    return F.coalesce(finite(x) > 0, F.lit(False))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero or unknown (ANSI mode raises on plain division)."""
    return a / F.when(b != 0, b)


def piecewise_score(x: Column, anchors: list[tuple[float, float]]) -> Column:
    """Linear between anchors, clamped outside, NULL for unknown input."""
    pts = sorted(anchors)
    x = finite(x)
    out = F.when(x.isNull(), None).when(x <= pts[0][0], pts[0][1]).when(x >= pts[-1][0], pts[-1][1])
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        out = out.when(x <= x1, F.lit(y0) + (x - x0) / (x1 - x0) * (y1 - y0))
    return out


def band_label(x: Column, labels: list[tuple[float, str]]) -> Column:
    """Label of the highest threshold not above x; below every threshold, the last label."""
    ordered = sorted(labels, key=lambda p: -p[0])
    out = F.when(x.isNull(), None)
    for cut, name in ordered:
        out = out.when(x >= cut, name)
    return out.otherwise(ordered[-1][1])


def weighted_score(factors: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum; unknown as soon as one factor is unknown."""
    return reduce(lambda a, b: a + b, [factors[k] * F.lit(w) for k, w in weights.items()])


def vix_level(close: Column, ready: Column) -> Column:
    """Caution band of a volatility index close, only for a current, fetched value."""
    return (
        F.when(~F.coalesce(ready & positive(close), F.lit(False)), "unconfirmed")
        .when(close < 15, "low")
        .when(close < 20, "moderate")
        .when(close < 30, "elevated")
        .otherwise("high")
    )


def publish(x: Column, digits: int = 6) -> Column:
    """Rounded for output; adding zero turns -0.0 into 0.0."""
    return F.round(x, digits) + F.lit(0.0)
