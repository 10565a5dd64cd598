"""Eigen-decompositions of small symmetric matrices in the plan, and Monte Carlo draws that any engine can repeat.

A matrix is an array of doubles, row by row. Cyclic Jacobi rotations run as higher-order functions: no Python worker, for a handful of
factors on every row. Draws are no stream of random numbers but a hash of (seed, simulation, row, factor), so they depend on neither tasks
nor partitions nor order; the moments of a simulation are plain sums. A simulated covariance of factors of other variances is
that of unit draws, scaled, so the draws are summed up once and serve every bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matrices import EIGEN_FLOOR, EIGEN_LEAST

SWEEPS = 8
#: Digits of a hash that make one uniform number.
DIGITS = 12


def _at(m: Column, place: Column) -> Column:
    return F.element_at(m, (place + 1).cast("int"))


def _turned(m: Column, k: int, r: Column, by_row: bool) -> Column:
    """The columns (rows) r.p and r.q of ``m`` turned into one another by cosine r.c and sine r.s."""
    step = k if by_row else 1
    apart = (r["q"] - r["p"]) * step

    def turn(x: Column, i: Column) -> Column:
        own = F.floor(i / k) if by_row else i % k
        return F.when(own == r["p"], r["c"] * x - r["s"] * _at(m, i + apart)).when(own == r["q"], r["s"] * _at(m, i - apart) + r["c"] * x).otherwise(x)

    return F.transform(m, turn)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def jacobi(matrix: Column, k: int, sweeps: int = SWEEPS) -> Column:
    """array<struct<value, vector>>, ascending, of a symmetric k x k matrix; null for null."""
    pairs = [F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(k) for q in range(p + 1, k)]
    kind = "struct<a:array<double>,v:array<double>>"
    unit = F.array(*[F.lit(float(i == j)) for i in range(k) for j in range(k)])
    start = F.struct(matrix.alias("a"), unit.alias("v")).cast(kind)

    def rotate(held: Column, r: Column) -> Column:
        a = held["a"]
        pq = _at(a, r["p"] * k + r["q"])
        theta = (_at(a, r["q"] * (k + 1)) - _at(a, r["p"] * (k + 1))) / (2 * pq)
        t = F.when(pq == 0, 0.0).otherwise(F.when(theta < 0, -1.0).otherwise(1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1)))

        def turn(x: Column) -> Column:
            c = 1 / F.sqrt(x["t"] * x["t"] + 1)
            full = F.struct(x["p"].alias("p"), x["q"].alias("q"), c.alias("c"), (c * x["t"]).alias("s"))
            both = lambda y: F.struct(_bound(_turned(a, k, y, False), lambda b: _turned(b, k, y, True)).alias("a"), _turned(held["v"], k, y, False).alias("v"))
            return _bound(full, both)

        return _bound(F.struct(r["p"].alias("p"), r["q"].alias("q"), t.alias("t")), turn).cast(kind)

    def told(held: Column) -> Column:
        axis = F.sequence(F.lit(0), F.lit(k - 1))
        return F.array_sort(F.transform(axis, lambda j: F.struct(_at(held["a"], j * (k + 1)).alias("value"), F.transform(axis, lambda i: _at(held["v"], i * k + j)).alias("vector"))))

    if not pairs:
        return F.when(matrix.isNotNull(), _bound(start, told))
    return F.when(matrix.isNotNull(), F.aggregate(F.flatten(F.array_repeat(F.array(*pairs), sweeps)), start, rotate, told))


def composed(parts: Column, value, k: int) -> Column:
    """The matrix of the eigenvectors of jacobi() with the values ``value(part, place)``."""
    scaled = F.transform(parts, lambda x, m: F.struct(value(x, m).alias("value"), x["vector"].alias("vector")))
    cell = lambda xs, i: F.aggregate(xs, F.lit(0.0), lambda total, x: total + x["value"] * _at(x["vector"], F.floor(i / k)) * _at(x["vector"], i % k))
    return _bound(scaled, lambda xs: F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda i: cell(xs, i)))


def clipped(matrix: Column, k: int) -> Column:
    """The matrix with its eigenvalues no less than a small share of the largest."""
    def floored(parts: Column) -> Column:
        least = F.greatest(EIGEN_FLOOR * _at(parts, F.lit(k - 1))["value"], F.lit(EIGEN_LEAST))
        return composed(parts, lambda x, _: F.greatest(x["value"], least), k)

    return _bound(jacobi(matrix, k), floored)


def adjusted(matrix: Column, bias: Column, scale: float, k: int) -> Column:
    """The matrix with each eigenvalue, ascending, times (1 + scale (bias - 1))^2."""
    return composed(jacobi(matrix, k), lambda x, m: F.pow(1 + scale * (_at(bias, m) - 1), F.lit(2.0)) * x["value"], k)


def normal(seed: int, *counters: Column) -> Column:
    """A standard normal number for each value of the counters: two uniform ones from their hash, by Box and Muller."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in counters]).cast("binary"))
    whole = 16.0**DIGITS
    number = lambda start: F.conv(F.substring(digest, start, DIGITS), 16, 10).cast("double")
    return F.sqrt(-2 * F.log((number(1) + 1) / whole)) * F.cos(2 * F.lit(3.141592653589793) * number(1 + DIGITS) / whole)


def draw_moments(spark: SparkSession, k: int, *, seed: int, simulations: int, window: int, decay: float) -> DataFrame:
    """(simulation, s): demeaned, weighted and bias-corrected covariances of unit draws, k x k, one row a simulation.

    Rows of draws become sums at once; what is shuffled is a row of sums a simulation and task.
    """
    if window <= k:
        raise ValueError("the window must be longer than the number of factors")
    total = (1 - decay**window) / (1 - decay)
    squares = (1 - decay ** (2 * window)) / (1 - decay * decay) / total**2
    rows = spark.range(simulations * window).select(F.floor(F.col("id") / window).alias("simulation"), (F.col("id") % window).alias("row"))
    rows = rows.withColumns({f"z{j}": normal(seed, F.col("simulation"), F.col("row"), F.lit(j)) for j in range(k)})
    rows = rows.withColumn("w", F.pow(F.lit(decay), window - 1 - F.col("row")) / total)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    means = [F.sum(F.col("w") * F.col(f"z{j}")).alias(f"m{j}") for j in range(k)]
    sums = rows.groupBy("simulation").agg(*means, *[F.sum(F.col("w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}_{j}") for i, j in upper])
    cell = lambda i, j: (F.col(f"s{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")) / (1 - squares)
    return sums.select("simulation", F.array(*[cell(min(i, j), max(i, j)) for i in range(k) for j in range(k)]).alias("s"))


def simulated_bias(spectra: DataFrame, moments: DataFrame, k: int) -> DataFrame:
    """(key, bias): root mean ratio of true to estimated variance of each estimated eigenvector, ascending, of (key, spectrum).

    Every spectrum meets every simulation, of which there is a fixed number; each such row is one small matrix, decomposed in the plan.
    """
    root = lambda i: F.sqrt(_at(F.col("spectrum"), i))
    estimate = F.transform("s", lambda x, i: x * root(F.floor(i / k)) * root(i % k))
    rows = spectra.crossJoin(F.broadcast(moments)).withColumn("parts", jacobi(estimate, k))
    true = lambda x: F.aggregate(F.zip_with(x["vector"], F.col("spectrum"), lambda e, v: e * e * v), F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumn("ratio", F.transform("parts", lambda x: true(x) / x["value"]))
    means = [F.avg(F.get("ratio", F.lit(j))).alias(f"r{j}") for j in range(k)]
    return rows.groupBy("key").agg(*means).select("key", F.array(*[F.sqrt(f"r{j}") for j in range(k)]).alias("bias"))


def quadratic_forms(cov: DataFrame, weights: DataFrame, names: list[str]) -> DataFrame:
    """(bar, f, n): the covariance of each two of the named portfolios, k x k, and the pairs known, of (bar, i, j, cov) for i <= j and (name, ticker, weight)."""
    whole = cov.select("bar", "i", "j", "cov").union(cov.where("i != j").select("bar", "j", "i", "cov")).where("cov is not null")
    held = weights.groupBy("ticker").agg(*[F.sum(F.when(F.col("name") == n, F.col("weight")).otherwise(0.0)).alias(f"w{k}") for k, n in enumerate(names)])
    side = lambda t, p: held.select(F.col("ticker").alias(t), *[F.col(f"w{k}").alias(f"{p}{k}") for k in range(len(names))])
    rows = whole.join(side("i", "a"), "i").join(side("j", "b"), "j")
    forms = [F.sum(F.col("cov") * F.col(f"a{p}") * F.col(f"b{q}")) for p in range(len(names)) for q in range(len(names))]
    return rows.groupBy("bar").agg(F.array(*forms).alias("f"), F.count("*").alias("n"))
