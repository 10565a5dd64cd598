"""Least squares by tree-reduced QR: no sums of products, so nothing is squared and nothing cancels.

Each task reduces its rows, a block at a time, to one small triangle a group; triangles are stacked and reduced again on the way
to the group's last one, from which the coefficients, their errors and the fit are read. A triangle of [1, x, y] has all of it: its first
row holds the means, its last column the projections of y and what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crosssection import TRADING_DAYS

#: Rows of a block, and triangles that one task reduces on the way.
BLOCK, FAN = 4096, 16
TRIANGLE = "grp string, n long, seen binary, r binary"
_NAMES = ["grp", "n", "seen", "r"]


def reduced(stack: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(stack), mode="r")


class _Held:
    """The triangle of the rows so far, and which columns had a value."""

    def __init__(self):
        self.n, self.seen, self.r = 0, None, None

    def add(self, n: int, seen: np.ndarray, rows: np.ndarray) -> None:
        self.n += n
        self.seen = seen if self.seen is None else self.seen | seen
        self.r = reduced([rows] if self.r is None else [self.r, rows])


def _packed(held: dict) -> pa.RecordBatch:
    columns = zip(*((k, h.n, h.seen.tobytes(), h.r.tobytes()) for k, h in held.items()), strict=True)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], _NAMES)


def triangles(rows: DataFrame, y: str, xs: list[str], by: str | None = None) -> DataFrame:
    """(grp, n, seen, r): one row a group; rows without y are dropped, a missing x counts 0."""
    width = len(xs) + 2

    def first(batches):
        held: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns[1:]])
                groups = part.column(0).dictionary_encode()
                code = groups.indices.to_numpy()
                for k, name in enumerate(groups.dictionary.to_pylist()):
                    own = values[code == k]
                    known = ~np.isnan(own)
                    held.setdefault(name, _Held()).add(len(own), known.any(0), np.where(known, own, 0.0))
            if len(held) > 4096:
                yield _packed(held)
                held = {}
        if held:
            yield _packed(held)

    def merge(batches):
        held: dict = {}
        for batch in batches:
            for name, n, seen, r in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                held.setdefault(name, _Held()).add(n, np.frombuffer(seen, bool), np.frombuffer(r).reshape(-1, width))
        if held:
            yield _packed(held)

    group = F.col(by).cast("string") if by else F.lit("")
    table = rows.select(F.coalesce(group, F.lit("")).alias("grp"), F.lit(1.0).alias("__one"), *[F.col(f"`{x}`").cast("double").alias(f"__x{k}") for k, x in enumerate(xs)], F.col(f"`{y}`").cast("double").alias("__y"))
    found = table.where(F.col("__y").isNotNull()).mapInArrow(first, TRIANGLE).withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    found = found.repartition("grp", "slot").select(*_NAMES).mapInArrow(merge, TRIANGLE)
    return found.repartition("grp").mapInArrow(merge, TRIANGLE)


def solved(r: np.ndarray, seen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float | None, np.ndarray, np.ndarray] | None:
    """(terms, their beta, r2, t, means) of a triangle of [1, x, y]; terms that had no value are left out; None for too few rows."""
    terms = np.flatnonzero(seen[:-1])
    k = len(terms)
    if n <= k:
        return None
    r = reduced([r[:, [*terms, r.shape[1] - 1]], np.zeros((k + 1, k + 1))])
    x, y = r[:k, :k], r[:, k]
    beta = np.linalg.lstsq(x, y[:k], rcond=None)[0]
    left = y[k] ** 2 + float(((y[:k] - x @ beta) ** 2).sum())
    error = np.sqrt((np.linalg.pinv(x) ** 2).sum(1) * left / (n - k))
    t = np.divide(beta, error, out=np.zeros(k), where=error > 0)
    total = float((y[1:] ** 2).sum())
    return terms, beta, 1 - left / total if total > 0 else None, t, x[0] / x[0, 0]


def regression(rows: DataFrame, y: str, xs: list[str], by: str | None = None) -> DataFrame:
    """(term, beta, t, r2, contribution) by least squares with an intercept, of each group on the variables that it has.

    A term's contribution is its beta times the mean of its variable, times the trading days of a year; that of the intercept is alpha a year.
    No rows for a group of no more observations than terms. ``by``: a string key of several regressions.
    """
    names = ["alpha", *xs]

    def run(batches):
        out = []
        for batch in batches:
            for group, n, seen, r in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                found = solved(np.frombuffer(r).reshape(-1, len(names) + 1), np.frombuffer(seen, bool), n)
                if found is not None:
                    terms, beta, r2, t, means = found
                    out += [(group, names[j], float(beta[k]), float(t[k]), r2, float(beta[k] * means[k] * TRADING_DAYS)) for k, j in enumerate(terms.tolist())]
        if out:
            kinds = [pa.string(), pa.string(), *[pa.float64()] * 4]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["grp", "term", "beta", "t", "r2", "contribution"])

    found = triangles(rows, y, xs, by).mapInArrow(run, "grp string, term string, beta double, t double, r2 double, contribution double")
    return found.withColumnRenamed("grp", by) if by else found.drop("grp")
