"""Near-duplicate vectors: p-stable hashing in several tables, exact cosines, connected components, links counted per component.

A vector of null, of no component or with null, NaN or infinite ones, and one of zeros only, is linked with nothing. Equal vectors form a
class, compared once. Normalised vectors are projected on normal draws, shifted and cut into steps; the steps of several projections are
a table's bucket. Step, projections and tables follow from the threshold and the number of classes: about one false
member in ten buckets, and a pair at the threshold is missed with probability MISS. Each member of a bucket is held against its
least one; only buckets whose other members still belong to several components are compared further, in blocks, and never
inside the component that has most of its members. What is then connected is counted: links run inside components only, so every two
vectors of a component are compared once, in blocks, whatever their buckets. In a component of many vectors those within half the
threshold's angle of its mean direction are linked with one another without a comparison. So a group of near copies costs a few rows a
member in every step, and no rows are pairs but those of a bucket's members with its least one.

Vectors of different lengths are not compared. Rows are vectors of their own: repeated rows, and rows that share an id, count as links of one another
where their vectors say so. A row of null id takes part; its component is the least id that it reaches, null if there is none, and it is kept. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import begin, checkpoint, embeddings, pieces, runs_of, shuffle_partitions, written
from .components import components, spanning

THRESHOLD = 0.95
#: Chance that a pair at the threshold shares no bucket.
MISS = 1e-4
#: Steps are this often the distance at the threshold.
STEP = 8.0
#: Expected false members of a bucket beside a vector, when vectors point anywhere.
FALSE = 0.1
SEED = 20_240_613
#: Vectors of a block, and of a tile of the products inside a task.
BLOCK, TILE = 4096, 512


def _collides(ratio: float) -> float:
    """Probability that a shifted projection of step ``ratio`` times the distance falls into the same cell for both ends."""
    return 1 - math.erfc(ratio / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def plan(classes: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[float, int, int]:
    """(step, projections a table, tables) for so many distinct vectors; right angles stand for what is not linked."""
    near = math.sqrt(2 * (1 - threshold))
    step = STEP * near
    hit, other = _collides(STEP), _collides(step / math.sqrt(2))
    projections = max(1, math.ceil(math.log(max(classes, 2) / FALSE) / -math.log(other)))
    return step, projections, math.ceil(math.log(miss) / math.log1p(-(hit**projections)))


def _dtype(kind) -> np.dtype:
    return np.dtype("f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "f8")


def unit(rows: list[bytes], dtype: np.dtype) -> np.ndarray:
    """The vectors, all of one length, at length one in double precision."""
    x = np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, x): the vectors' bytes and a digest of them, both null for vectors that are linked with nothing; no exchange."""
    dtype = _dtype(vectors.schema["embedding"].dataType)

    def run(batches):
        begin("vectors")
        for part in pieces(batches, 2048):
            found = []
            for x in part.column(1):
                v = x.values
                v = None if v is None or v.null_count or not len(v) else v.to_numpy()
                found.append(v.tobytes() if v is not None and np.isfinite(v).all() and v.any() else None)
            keys = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in found]
            yield pa.record_batch([part.column(0), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["vec_id", "key", "x"])

    values = F.col("embedding").cast("array<float>" if dtype.itemsize == 4 else "array<double>")
    return vectors.select(F.col("vec_id").cast("long"), values.alias("embedding")).mapInArrow(run, "vec_id long, key binary, x binary")


class Hasher:
    """Buckets of unit vectors: ``tables`` keys of ``projections`` shifted and cut projections each, the same in every task."""

    def __init__(self, step: float, projections: int, tables: int, seed: int = SEED):
        self.step, self.shape, self.seed, self._drawn = step, (tables, projections), seed, {}

    def _draws(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in self._drawn:
            draw = np.random.default_rng([self.seed, width])
            n = self.shape[0] * self.shape[1]
            self._drawn = {width: (draw.standard_normal((width, n)), draw.uniform(0, self.step, n))}
        return self._drawn[width]

    def buckets(self, x: np.ndarray) -> np.ndarray:
        lines, shift = self._draws(x.shape[1])
        cells = np.floor((x @ lines + shift) / self.step).astype(np.int64).view(np.uint64).reshape(len(x), *self.shape)
        out = np.arange(1, self.shape[0] + 1, dtype=np.uint64)[None] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(x.shape[1])
        for k in range(self.shape[1]):
            out = (out ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def _by_width(rows: list[bytes]) -> list[np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    return [np.flatnonzero(sizes == s) for s in np.unique(sizes)]


def _in_buckets(classes: DataFrame, hasher: Hasher, dtype: np.dtype) -> DataFrame:
    def run(batches):
        begin("vectors")
        for part in pieces(batches, 1024):
            rows = part.column(1).to_pylist()
            for own in _by_width(rows):
                keys = hasher.buckets(unit([rows[k] for k in own], dtype))
                node = np.repeat(part.column(0).to_numpy()[own], keys.shape[1])
                yield pa.record_batch([pa.array(node), pa.array(keys.ravel())], ["node", "bucket"])

    return classes.select("node", "x").mapInArrow(run, "node long, bucket long")


def _confirmed(pairs: DataFrame, classes: DataFrame, threshold: float, dtype: np.dtype) -> DataFrame:
    """The pairs (u, v) whose cosine reaches the threshold."""

    def run(batches):
        begin("vectors")
        for part in pieces(batches, 2048):
            a, b = part.column(2).to_pylist(), part.column(3).to_pylist()
            keep = np.zeros(len(a), bool)
            for own in _by_width(a):
                own = np.array([k for k in own.tolist() if len(b[k]) == len(a[k])], int)
                if len(own):
                    keep[own] = np.einsum("ij,ij->i", unit([a[k] for k in own], dtype), unit([b[k] for k in own], dtype)) >= threshold
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).filter(pa.array(keep))

    x = lambda node, name: classes.select(F.col("node").alias(node), F.col("x").alias(name))
    return pairs.join(x("u", "a"), "u").join(x("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def in_blocks(members: DataFrame, group: str) -> DataFrame:
    """``members`` with (lo, hi, mine), one row for each pair of blocks that a member is in.

    A group's members are dealt into blocks of about BLOCK: those that aren't ``major`` meet one another and the major ones, major
    ones never meet. So a member has as many rows as its group has blocks that it must meet. ``mine``: 1 on the side of the block ``hi``.
    """
    count = lambda c: F.ceil(F.count(F.when(c, 1)) / BLOCK).cast("int")
    sizes = members.groupBy(group).agg(count(~F.col("major")).alias("__few"), count(F.col("major")).alias("__many")).where("__few > 0")
    own = lambda n, shift: F.pmod(F.xxhash64("node"), F.col(n)).cast("int") + shift
    dealt = members.join(sizes, group).withColumn("__own", F.when(F.col("major"), own("__many", F.col("__few"))).otherwise(own("__few", F.lit(0))))
    other = F.sequence(F.lit(0), F.when(F.col("major"), F.col("__few") - 1).otherwise(F.col("__few") + F.col("__many") - 1))
    dealt = dealt.withColumn("__other", F.explode(other))
    sides = F.least("__own", "__other").alias("lo"), F.greatest("__own", "__other").alias("hi"), (F.col("__own") > F.col("__other")).cast("int").alias("mine")
    return dealt.select(*[c for c in members.columns], *sides)


def _block_pairs(batches, group: str):
    """Of rows sorted by (group, lo, hi): the two sides of each pair of blocks, twice the same table for a block with itself."""
    for rows in runs_of(batches, (group, "lo", "hi")):
        mine = rows.column("mine").to_numpy()
        if rows.column("lo")[0] == rows.column("hi")[0]:
            yield rows, rows, True
        elif 0 < mine.sum() < len(mine):
            yield rows.filter(pa.array(mine == 0)), rows.filter(pa.array(mine == 1)), False


def _dealt(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    key = [group, "lo", "hi"]
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), *key).sortWithinPartitions(*key)
    return rows.select(*key, "mine", *columns)


def _tiles(a: pa.Table, b: pa.Table, dtype: np.dtype, threshold: float):
    """(places in a, places in b, linked) of tiles of the product of two sides; vectors of other lengths are never linked."""
    rows = a.column("x").to_pylist(), b.column("x").to_pylist()
    for left in _by_width(rows[0]):
        width = len(rows[0][left[0]])
        right = np.array([k for k, r in enumerate(rows[1]) if len(r) == width], int)
        if len(right):
            y = unit([rows[1][k] for k in right], dtype).T
            for at in range(0, len(left), TILE):
                own = left[at : at + TILE]
                yield own, right, unit([rows[0][k] for k in own], dtype) @ y >= threshold


def _across(placed: DataFrame, links: DataFrame, classes: DataFrame, threshold: float, dtype: np.dtype) -> DataFrame:
    """(u, v): links that join components which meet in a bucket beside its least member; a forest a pair of blocks."""

    def run(batches):
        begin("vectors")
        for a, b, _ in _block_pairs(batches, "bucket"):
            (u, v), (cu, cv) = ([t.column(c).to_numpy() for t in (a, b)] for c in ("node", "component"))
            found = []
            for own, right, linked in _tiles(a, b, dtype, threshold):
                i, j = spanning(linked, cu[own], cv[right])
                found += zip(u[own][i].tolist(), v[right][j].tolist(), strict=True)
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    found = components(links)
    others = placed.where("node != least").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = others.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    members = checkpoint(others.join(mixed, "bucket"))
    most = members.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max_by("component", "count").alias("most"))
    members = members.join(most, "bucket").withColumn("major", F.col("component") == F.col("most")).drop("most")
    rows = in_blocks(members, "bucket").join(classes.select("node", "x"), "node")
    return _dealt(rows, "bucket", "node", "component", "x").mapInArrow(run, "u long, v long")


def _centres(rows: DataFrame, dtype: np.dtype) -> DataFrame:
    """(root, centre): the sum of the unit vectors of each root; a row a root and task is shuffled."""

    def part_sums(batches):
        begin("vectors")
        held: dict[tuple[int, int], np.ndarray] = {}
        for part in pieces(batches, 2048):
            roots, x = part.column(0).to_numpy(), part.column(1).to_pylist()
            for own in _by_width(x):
                values = unit([x[k] for k in own], dtype)
                names, at = np.unique(roots[own], return_inverse=True)
                for k, root in enumerate(names.tolist()):
                    held[root, 0] = held.get((root, 0), 0.0) + values[at == k].sum(0)
            if len(held) > 4096:
                yield _binary(held)
                held = {}
        if held:
            yield _binary(held)

    def _binary(held):
        return pa.record_batch([pa.array([k[0] for k in held], pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["root", "centre"])

    def merge(batches):
        begin("vectors")
        for group in runs_of(batches, ("root",)):
            whole = sum(np.frombuffer(c, float) for c in group.column(1).to_pylist())
            yield pa.record_batch([group.column(0).combine_chunks()[:1], pa.array([whole.tobytes()], pa.binary())], ["root", "centre"])

    schema = "root long, centre binary"
    sums = rows.select("root", "x").mapInArrow(part_sums, schema).repartition(shuffle_partitions(rows.sparkSession), "root")
    return sums.sortWithinPartitions("root").mapInArrow(merge, schema)


def _cored(tied: DataFrame, sizes: DataFrame, threshold: float, dtype: np.dtype) -> DataFrame:
    """``tied`` (node, root, copies, x) with ``major``: whether a member of a large component is within half the threshold's angle of its mean."""
    half = math.cos(math.acos(threshold) / 2 - 1e-9)

    def run(batches):
        begin("vectors")
        for part in pieces(batches, 2048):
            x, centre = part.column(3).to_pylist(), part.column(4).to_pylist()
            major = np.zeros(len(x), bool)
            for own in _by_width(x):
                a, b = unit([x[k] for k in own], dtype), np.stack([np.frombuffer(centre[k], float) for k in own])
                length = np.sqrt(np.einsum("ij,ij->i", b, b))
                major[own] = np.einsum("ij,ij->i", a, b) >= half * np.maximum(length, 1e-300)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(major)], names=["node", "root", "copies", "x", "major"])

    large = sizes.where(F.col("size") > BLOCK).withColumn("salts", F.ceil(F.col("size") / BLOCK).cast("int")).select("root", "salts")
    rows = tied.join(large, "root").withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    centres = _centres(rows, dtype).join(large, "root").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    many = rows.join(centres, ["root", "salt"]).select("node", "root", "copies", "x", "centre").mapInArrow(run, "node long, root long, copies long, x binary, major boolean")
    few = tied.join(large, "root", "left_anti").select("node", "root", "copies", "x", F.lit(False).alias("major"))
    return few.unionByName(many)


def _degrees(tied: DataFrame, threshold: float, dtype: np.dtype) -> DataFrame:
    """(node, links): how many vectors of other classes each class is linked with, of (node, root, copies, x)."""

    def run(batches):
        begin("vectors")
        for a, b, same in _block_pairs(batches, "root"):
            weight = [t.column("copies").to_numpy() for t in (a, b)]
            left, right = (np.zeros(len(w), np.int64) for w in weight)
            for own, other, linked in _tiles(a, b, dtype, threshold):
                if same:
                    at = np.full(len(weight[1]), -1)
                    at[other] = np.arange(len(other))
                    linked[np.arange(len(own)), at[own]] = False
                left[own] += linked @ weight[1][other]
                right[other] += weight[0][own] @ linked
            sides = [(a, left)] if same else [(a, left), (b, right)]
            for t, links in sides:
                yield pa.record_batch([t.column("node").combine_chunks(), pa.array(links)], ["node", "links"])

    sizes = checkpoint(tied.groupBy("root").agg(F.count("*").alias("size")))
    cored = written(_cored(tied, sizes, threshold, dtype))
    pairs = _dealt(in_blocks(cored, "root"), "root", "node", "copies", "x").mapInArrow(run, "node long, links long")
    # the members of a core are linked with one another
    whole = cored.where("major").groupBy("root").agg(F.sum("copies").alias("whole"))
    inside = cored.where("major").select("node", "root", "copies").join(F.broadcast(whole) if sizes.count() < BLOCK else whole, "root").select("node", (F.col("whole") - F.col("copies")).alias("links"))
    return pairs.unionByName(inside).groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row a row of (vec_id, embedding)."""
    dtype = _dtype(vectors.schema["embedding"].dataType)
    base = written(keyed(vectors))
    grouped = base.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("x").alias("x"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()))
    hasher = Hasher(*plan(classes.count(), threshold, miss))
    in_buckets = _in_buckets(classes, hasher, dtype)
    shared = in_buckets.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("bucket", "least")
    placed = written(in_buckets.join(shared, "bucket").select("bucket", "node", "least"))
    to_least = placed.where("node != least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    links = checkpoint(_confirmed(to_least, classes, threshold, dtype))
    whole = checkpoint(components(links.unionByName(_across(placed, links, classes, threshold, dtype))).withColumnRenamed("component", "root"))
    tied = written(classes.select("node", "least", "copies", "x").join(whole, "node"))
    roots = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = tied.select("node", "root").join(roots, "root").join(_degrees(tied.drop("least"), threshold, dtype), "node", "left").select("node", "component_id", "links")
    found = classes.select("key", "node", "least", "copies").join(linked, "node", "left")
    found = found.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    rows = base.select("vec_id", "key").join(found, "key", "left")
    out = rows.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(embeddings(spark, sf_dir))
