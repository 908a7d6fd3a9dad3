"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


def ratio(a, b, default: float = 0.0) -> Column:
    """a / b as doubles; default where b is not above 0 or anything is null."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    return F.coalesce(F.when(b > 0, a / b), F.lit(default))


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one timestamp to another, with fractions."""
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def dense_entropy(share: Column, buckets: Column) -> Column:
    """Entropy in nats over a fixed number of buckets, of which only the used ones have rows.

    Every share is raised by EPSILON and the shares are scaled to one; the
    empty buckets are added in closed form. buckets is a column or literal,
    the same in all rows of a group.
    """
    used = F.sum(-(share + EPSILON) / (1 + buckets * EPSILON) * F.log((share + EPSILON) / (1 + buckets * EPSILON)))
    one = F.lit(EPSILON) / (1 + F.max(buckets) * EPSILON)
    return used - (F.max(buckets) - F.count(F.lit(1))) * one * F.log(one)


def gini(sorted_values: Column) -> Column:
    """Gini coefficient of an ascending array; 0.5 for fewer than two values or a sum of 0."""
    n, total = F.size(sorted_values), F.aggregate(sorted_values, F.lit(0.0), lambda s, x: s + x)
    ranked = F.aggregate(
        F.transform(sorted_values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x
    )
    return F.when((n > 1) & (total > 0), 2 * ranked / (n * total) - (n + 1) / n).otherwise(0.5)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in kilometres."""
    a, b, c, d = (F.radians(x.cast("double")) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def latitude(location: Column) -> Column:
    return F.trim(F.get(F.split(location, ","), F.lit(0))).try_cast("double")


def longitude(location: Column) -> Column:
    return F.trim(F.get(F.split(location, ","), F.lit(1))).try_cast("double")


def short_number(n: float) -> str:
    """1234567 as 1.2M, 45600 as 45.6K."""
    for size, letter in ((1_000_000, "M"), (1_000, "K")):
        if abs(n) >= size:
            return f"{n / size:.1f}{letter}"
    return str(int(n))
