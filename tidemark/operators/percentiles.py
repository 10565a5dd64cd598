"""Exact percentiles of whole columns without a sort and without one group of all values.

A sketch gives two values near a wanted place; a pass counts what lies below, at, between and above them, and the part that has the
place is sketched again, until the place holds one of the two or the part is few values. Every pass is one aggregate that is combined before
the shuffle, for all columns and places at once. The driver holds a few numbers a place, and at last at most FEW values of each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many values of a part are listed.
FEW = 4096
#: A sketch's places are off by one in so many.
ACCURACY = 10_000


@dataclass
class _Place:
    """Place ``k`` of a column's sorted values, which is one of the ``inside`` values from ``low`` to ``high``, above ``below`` others."""

    column: str
    k: int
    low: float
    high: float
    below: int
    inside: int
    value: float | None = None

    def part(self) -> Column:
        x = _number(self.column)
        return F.when(x.between(self.low, self.high), x)


def _number(column: str) -> Column:
    return F.col(f"`{column}`").cast("double")


def exact_percentiles(df: DataFrame, wanted: dict[str, tuple[float, ...]], few: int = FEW, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """By column the values at the given shares (0 to 1), in proportion between neighbours; None for a column without values.

    ``df`` is read in a first pass, in a last one, and in two for each factor of some thousands of values between; give it settled where it is dear to
    compute. Nulls don't count, NaN is greater than all other values. Values that are repeated, however often, are only counted.
    """
    if bad := [p for shares in wanted.values() for p in shares if not 0 <= p <= 1]:
        raise ValueError(f"shares must be from 0 to 1, got {bad[0]}")
    if not wanted:
        return {}
    ends = df.agg(*[f(_number(c)).alias(f"{n}{k}") for k, c in enumerate(wanted) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
    places: dict[tuple[str, int], _Place] = {}
    sizes = {c: ends[f"n{k}"] for k, c in enumerate(wanted)}
    for k, (c, shares) in enumerate(wanted.items()):
        for p in shares if sizes[c] else ():
            at = p * (sizes[c] - 1)
            for place in {math.floor(at), math.ceil(at)}:
                places[c, place] = _Place(c, place, ends[f"low{k}"], ends[f"high{k}"], 0, sizes[c])
    while open_ := [r for r in places.values() if r.value is None]:
        for r in open_:
            if r.low == r.high or math.isnan(r.low):
                r.value = r.low
        open_ = [r for r in open_ if r.value is None]
        listed, wide = [r for r in open_ if r.inside <= few], [r for r in open_ if r.inside > few]
        if listed:
            found = df.agg(*[F.sort_array(F.collect_list(r.part())).alias(f"v{k}") for k, r in enumerate(listed)]).first()
            for k, r in enumerate(listed):
                r.value = found[k][r.k - r.below]
        if wide:
            _narrow(df, wide, accuracy)

    def value(c: str, p: float) -> float | None:
        if not sizes[c]:
            return None
        at = p * (sizes[c] - 1)
        low, high = places[c, math.floor(at)].value, places[c, math.ceil(at)].value
        return low if low == high else low + (at - math.floor(at)) * (high - low)

    return {c: [value(c, p) for p in shares] for c, shares in wanted.items()}


def _narrow(df: DataFrame, places: list[_Place], accuracy: int) -> None:
    """Two values of each part near the place, and the part of the five they make that has it; it lacks one value at least."""
    sketches = []
    for k, r in enumerate(places):
        slack, at = 2 * r.inside / accuracy + 2, r.k - r.below
        sketches.append(F.percentile_approx(r.part(), [max(0.0, (at - slack) / r.inside), min(1.0, (at + slack) / r.inside)], accuracy).alias(f"s{k}"))
    near = [tuple(x) for x in df.agg(*sketches).first()]
    sums = []
    for k, (r, (a, b)) in enumerate(zip(places, near, strict=True)):
        x = r.part()
        between = F.when((x > a) & (x < b), x)
        sums += [F.count_if(x < a), F.max(F.when(x < a, x)), F.count_if(x == a), F.count(between), F.min(between), F.max(between), F.count_if(x == b), F.min(F.when(x > b, x))]
    found = df.agg(*[c.alias(f"c{k}") for k, c in enumerate(sums)]).first()
    for k, (r, (a, b)) in enumerate(zip(places, near, strict=True)):
        less, most, at_a, inner, low, high, at_b, above = found[8 * k : 8 * k + 8]
        at_b = 0 if a == b or (math.isnan(a) and math.isnan(b)) else at_b
        at = r.k - r.below
        if at < less:
            r.high, r.inside = most, less
        elif at < less + at_a:
            r.value = a
        elif at < less + at_a + inner:
            r.low, r.high, r.below, r.inside = low, high, r.below + less + at_a, inner
        elif at < less + at_a + inner + at_b:
            r.value = b
        else:
            gone = less + at_a + inner + at_b
            r.low, r.below, r.inside = above, r.below + gone, r.inside - gone


def described(df: DataFrame, names: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, n, mean, std, least, p25 ..., most): a row a column, percentiles exact; nulls don't count."""
    found = exact_percentiles(df, {n: shares for n in names})
    sums = df.agg(*[F.struct(F.lit(n).alias("column"), F.count(_number(n)).alias("n"), F.avg(_number(n)).alias("mean"), F.stddev_samp(_number(n)).alias("std"), F.min(_number(n)).alias("least"), *[F.lit(v).cast("double").alias(f"p{round(100 * p)}") for p, v in zip(shares, found[n], strict=True)], F.max(_number(n)).alias("most")).alias(f"c{k}") for k, n in enumerate(names)])
    return sums.select(F.inline(F.array(*[f"c{k}" for k in range(len(names))])))
