"""Centroid clustering of integer vectors, exact at every magnitude.

Vectors are packed into blocks of a table in the shared folder. In each round every block is held against the centroids, which
are few and go with the task, and ``treeAggregate`` adds up what belongs to each: integer sums and counts, so neither the order
of the tasks nor a lost executor changes a result. Squared distances are |x|^2 - 2 x.c + |c|^2 in float64 by matrix products where
no partial sum can reach 2^53; blocks of larger values use 64-bit integers below 2^63 and Python's integers beyond.

Kept are vectors of exactly DIMENSIONS components without null, NaN or infinity. An empty table, or one with nothing kept, gives no
rows; with fewer vectors than centroids each vector starts one. Rows that share an id, repeated rows included, are vectors of their own;
a null id counts as the empty text where centroids are drawn. Of equally near centroids the smaller number wins. Distances and
inertias beyond 64 bits are null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .common import begin, embeddings, pieces, written

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: The centroids that the rounds start from are those of the smallest hashes of this text and the id.
SALT = "3:"
#: Vectors of a block.
BLOCK = 4096
_FLOAT, _LONG = 2**53, 2**63

Centroids = list[list[int]]


def finite(column: str, dimensions: int) -> Column:
    return (F.size(column) == dimensions) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _kept(vectors: DataFrame, dimensions: int) -> DataFrame:
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    values = F.col("embedding") if single else F.col("embedding").cast(ArrayType(DoubleType()))
    return vectors.select(F.col("vec_id").cast("long"), values.alias("embedding")).where(finite("embedding", dimensions))


def packed(kept: DataFrame) -> DataFrame:
    """(n, ids, known, x): blocks of vectors as they are stored, in the shared folder; no exchange."""
    dtype = np.dtype("f4" if isinstance(kept.schema["embedding"].dataType.elementType, FloatType) else "f8")

    def run(batches):
        begin("centroids")
        for part in pieces(batches, BLOCK):
            if part.num_rows:
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
                known = ~part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy().astype("i8")
                yield pa.record_batch([pa.array([part.num_rows], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, known, x))], ["n", "ids", "known", "x"])

    return written(kept.select("vec_id", "embedding").mapInArrow(run, "n int, ids binary, known binary, x binary"))


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite values, as float64 where that is exact below 2^53, as 64-bit or as Python integers otherwise."""
    x = x.astype(float)
    top = float(np.abs(x).max(initial=0.0)) * scale
    if top < _FLOAT:
        return np.floor(x * scale)
    if top < _LONG / 2:
        return np.floor(x * scale).astype("i8")
    return np.array([int(Fraction(v) * scale // 1) for v in x.ravel().tolist()], object).reshape(x.shape)


def _most(x: np.ndarray) -> int:
    return int(max(abs(x.max(initial=0)), abs(x.min(initial=0))))


def distances(x: np.ndarray, centroids: Centroids) -> np.ndarray:
    """(vectors, centroids): exact squared distances, by the cheapest arithmetic that holds them."""
    reach = x.shape[1] * (_most(x) + max((abs(v) for c in centroids for v in c), default=0)) ** 2
    if reach < _FLOAT:  # every partial sum of the expansion is a whole number below 2^53
        x, c = x.astype(float, copy=False), np.array(centroids, float)
        return (np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ c.T) + np.einsum("ij,ij->i", c, c)[None]).astype("i8")
    kind = "i8" if reach < _LONG else object
    x, c = _whole(x, kind), np.array(centroids, kind)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def _whole(x: np.ndarray, kind) -> np.ndarray:
    return x.astype("i8").astype(object) if kind is object and x.dtype.kind == "f" else x.astype(kind)


def sums(x: np.ndarray, own: np.ndarray, k: int) -> list[list[int]]:
    """Exact sums of the vectors of each cluster, as Python's integers."""
    reach = len(x) * _most(x)
    if reach < _FLOAT:
        hot = np.zeros((k, len(x)))
        hot[own, np.arange(len(x))] = 1.0
        return [[int(v) for v in row] for row in (hot @ x.astype(float, copy=False)).tolist()]
    x = _whole(x, "i8" if reach < _LONG else object)
    return [[int(v) for v in x[own == j].sum(0)] if (own == j).any() else [0] * x.shape[1] for j in range(k)]


class Folded:
    """Per cluster: how many vectors, their sums, the sum of their squared distances."""

    def __init__(self, k: int, dimensions: int):
        self.count, self.sums, self.inertia = [0] * k, np.zeros((k, dimensions), object), [0] * k

    def add(self, x: np.ndarray, centroids: Centroids) -> Folded:
        d = distances(x, centroids)
        own = d.argmin(1)
        k = len(centroids)
        self.sums = self.sums + np.array(sums(x, own, k), object)
        near = d[np.arange(len(x)), own]
        for j in np.unique(own).tolist():
            mine = near[own == j]
            self.count[j] += len(mine)
            self.inertia[j] += sum(mine.tolist())
        return self

    def merge(self, other: Folded) -> Folded:
        self.count = [a + b for a, b in zip(self.count, other.count, strict=True)]
        self.inertia = [a + b for a, b in zip(self.inertia, other.inertia, strict=True)]
        self.sums = self.sums + other.sums
        return self


def _block(x: bytes, n: int, dtype: str, scale: int) -> np.ndarray:
    return integers(np.frombuffer(x, dtype).reshape(n, -1), scale)


def fold(blocks: DataFrame, centroids: Centroids, dtype: str, scale: int = SCALE) -> Folded:
    """One pass over the blocks; the driver gets one small Folded, merged in a tree of tasks."""
    zero = Folded(len(centroids), len(centroids[0]))
    rows = blocks.select("n", "x").rdd
    return rows.treeAggregate(zero, lambda held, r: held.add(_block(r.x, r.n, dtype, scale), centroids), lambda a, b: a.merge(b))


def first_centroids(kept: DataFrame, k: int = CENTROIDS, salt: str = SALT, scale: int = SCALE) -> Centroids:
    """Those of the smallest hashes, ascending; rows of equal hashes by their components."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(k).collect()
    return [[int(v) for v in integers(np.array([r.embedding]), scale)[0].tolist()] for r in rows]


def moved(folded: Folded, centroids: Centroids) -> Centroids:
    """Each non-empty cluster's floor of the mean; empty ones stay."""
    return [[int(s) // n for s in row] if n else old for n, row, old in zip(folded.count, folded.sums.tolist(), centroids, strict=True)]


def digest(centroid: Iterable[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _long(value: int) -> int | None:
    return value if -_LONG <= value < _LONG else None


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, Centroids]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row a kept vector of (vec_id, embedding), and the centroids."""
    kept = _kept(vectors, dimensions)
    dtype = "f4" if isinstance(kept.schema["embedding"].dataType.elementType, FloatType) else "f8"
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(kept, k, salt, scale)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema), []
    blocks = packed(kept)
    for _ in range(rounds):
        centroids = moved(fold(blocks, centroids, dtype, scale), centroids)
    last = fold(blocks, centroids, dtype, scale)
    names, inertia, whole = [digest(c) for c in centroids], [_long(v) for v in last.inertia], _long(sum(last.inertia))

    def run(batches):
        begin("centroids")
        for part in batches:
            for n, ids, known, x in zip(*(c.to_pylist() for c in part.columns), strict=True):
                d = distances(_block(x, n, dtype, scale), centroids)
                own = d.argmin(1)
                near = [_long(int(v)) for v in d[np.arange(n), own].tolist()]
                ids = pa.array(np.frombuffer(ids, "i8"), mask=~np.frombuffer(known, bool))
                per = [pa.array([v[j] for j in own.tolist()], t) for v, t in ((inertia, pa.int64()), (names, pa.string()))]
                yield pa.record_batch([ids, pa.array(own, pa.int32()), pa.array(near, pa.int64()), per[0], pa.array([whole] * n, pa.int64()), per[1]], [f.split()[0] for f in schema.split(", ")])

    return blocks.select("n", "ids", "known", "x").mapInArrow(run, schema), centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(embeddings(spark, sf_dir))[0]


def _oracle() -> str:
    steps = ["""e as materialized (
  select r, vec_id, generate_subscripts(embedding, 1) as j, unnest(embedding) as x
  from (select row_number() over () as r, vec_id, embedding from embeddings where len(embedding) = 64)),
v as materialized (
  select r, j, cast(floor(1024 * cast(x as double)) as bigint) as x from e
  where r in (select r from e group by r having count(x) = 64 and bool_and(isfinite(x)))),
ids as (select distinct r, vec_id from e where r in (select r from v)),
c0 as materialized (
  select k, j, x as c from v join
  (select r, row_number() over (order by sha256('3:' || vec_id)) - 1 as k from ids qualify k < 8) using (r))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""d{i} as (select r, k, sum((x - c) * (x - c)) as d from v join c{i} using (j) group by r, k),
a{i} as materialized (select r, arg_min(k, d * 8 + k) as k, min(d) as d from d{i} group by r)""")
        if i < ROUNDS:
            steps.append(f"""s{i} as (select k, j, sum(x) as s, count(*) as n from v join a{i} using (r) group by k, j),
c{i + 1} as materialized (
  select k, j, cast((s - ((s % n) + n) % n) // n as bigint) as c from s{i}
  union all select k, j, c from c{i} where k not in (select k from a{i}))""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, cast(k as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by k) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, h as centroid_sha256
from a{ROUNDS} join ids using (r) join (select k, sha256(string_agg(cast(c as varchar), ',' order by j)) as h from c{ROUNDS} group by k) using (k)"""


ORACLE = _oracle()
