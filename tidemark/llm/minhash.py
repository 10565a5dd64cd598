"""Near-duplicate documents: MinHash signatures, banding, verification, connected components.

A document's set holds its distinct runs of five words (ASCII white space, A-Z lower-cased); one
with fewer words has the whole sequence, one without words or with null text the empty set, and it is
linked with nothing. Documents of equal sets form a class, which its least doc_id stands for.
Representatives whose signatures agree in a band are candidates. Each is first held against the
least one of its bucket: such a pair must be near in size, its signatures, one bit a hash function, must agree
to within DEVIATIONS of what the threshold gives (a link fails this once in 10^9), and it is confirmed on the full sets. The members of buckets that
then still hold several components are looked at once more, all together: linked sets share one of their rarest values, by an order
that all tasks share, so they meet by these, in blocks, and only where sizes and signatures allow links that can join components.
So a bucket of many copies costs one link a copy, near misses cost their rarest values but hardly a copy of their sets, and no link that
could join two components is left out.

Rows of null doc_id are linked with nothing: their component is null and they are kept. Rows that
share a doc_id are one node of the graph: what one of their texts is linked with, all are; so ids should be unique. Extra columns, whatever their names, are ignored by near_duplicates() and kept by keep_first().
An empty table gives no rows. Very long texts are whole sets, of which a task holds a few at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, begin, checkpoint, documents, pieces, runs_of, shuffle_partitions
from .components import components

SHINGLE = 5
BANDS, ROWS = 40, 6
SEED = 20_240_501
#: A candidate whose signatures differ in more bits than expected at the threshold, by so many deviations, is dropped.
DEVIATIONS = 6.0
#: Most bits of the filter of document ids that tasks hold (16 MB).
FILTER_BITS = 1 << 27
#: Members of a bucket, and values of their sets, that are held against as many others at once.
BLOCK, BLOCK_VALUES = 512, 1 << 20
#: Slots of the table by whose counts values are called rare (4 MB), and of a part of it; fuller slots make the order coarser, never wrong.
SLOT_BITS, SLOT_RANGE = 20, 4096
#: Distinct values that are compared at once.
COLUMNS = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(32))) * _PRIME
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``width`` words."""
    words = ascii_lower(text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    if len(codes) < width:
        # whole sequences of different lengths differ, and so does a sequence from a run
        return _mixed(np.array([xxhash.xxh3_64_intdigest(codes.tobytes(), len(codes))], np.uint64))
    n = len(codes) - width + 1
    out = codes[:n].copy()
    for k in range(1, width):
        out *= _STEP
        out += codes[k : k + n]
    return np.unique(_mixed(out))


class Signer:
    """``bands * rows`` universal hash functions x -> a x + b on 64-bit values, a odd."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)[:, None]

    def sign(self, values: np.ndarray) -> np.ndarray:
        """The least value of each function, its upper 32 bits."""
        least = np.full(len(self.a), ~np.uint64(0))
        for at in range(0, len(values), 1024):
            np.minimum(least, (self.a * values[None, at : at + 1024] + self.b).min(axis=1), out=least)
        return (least >> np.uint64(32)).astype("<u4")

    def bits(self, signature: np.ndarray) -> np.ndarray:
        """One bit of each least value, as four longs; equal with probability (1 + J) / 2."""
        out = np.zeros(256, np.uint8)
        out[: len(signature)] = (_mixed(signature.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
        return np.packbits(out).view(np.int64)

    def buckets(self, signature: np.ndarray) -> np.ndarray:
        """A 64-bit key a band, different for equal values of different bands."""
        parts = signature.reshape(self.bands, self.rows).astype(np.uint64)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            out = _mixed(out * _STEP + parts[:, k])
        return out.view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, body, n_shingles, set_key, s0 ... s3, buckets: one row a document, no exchange; ``body`` is xxhash64 of the text."""
    names = ["doc_id", "body", "n_shingles", "set_key", "s0", "s1", "s2", "s3", "buckets"]
    kinds = [*[pa.int64()] * 3, pa.binary(), *[pa.int64()] * 4, pa.list_(pa.int64())]

    def run(batches):
        begin("minhash")
        signer = Signer(bands, rows)
        for part in pieces(batches):
            out = []
            for text in part.column(2).to_pylist():
                own = shingles(text)
                if len(own):
                    signature = signer.sign(own)
                    out.append((len(own), set_key(own), *signer.bits(signature).tolist(), signer.buckets(signature)))
                else:
                    out.append((0, *[None] * 6))
            columns = [part.column(0), part.column(1), *zip(*out, strict=True)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("body"), "text").mapInArrow(run, "doc_id long, body long, n_shingles long, set_key binary, s0 long, s1 long, s2 long, s3 long, buckets array<long>")


def set_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def most_bits(percent: int, bits: int) -> int:
    """In how many bits of their signatures links may differ."""
    p = (100 - percent) / 200
    return int(bits * p + DEVIATIONS * (bits * p * (1 - p)) ** 0.5)


def _plausible(a: str, b: str, percent: int, bits: int) -> Column:
    """Whether structs a, b (rep, n_shingles, s0 ... s3) can be links, by their sizes and signatures."""
    most = most_bits(percent, bits)
    differ = sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(4)), F.lit(0))
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ <= most)


def _id_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each hash of ``rep`` that occurs; of a size fixed by the count, FILTER_BITS at most."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * ids.count()).bit_length()))
    hashed = ids.select(_id_hash("rep", bits).alias("h"))
    words = hashed.groupBy(F.floor(F.col("h") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("v")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy()] = words["v"].to_numpy().astype(np.int64).view(np.uint64)
    return out, bits


def _id_hash(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def _sets(ids: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, members): the full sets of the representatives in ``ids``.

    Sets are made again from the texts; the documents that are not asked for are passed over in the scan
    by a filter of ids, so that no text is shuffled.
    """
    ids = checkpoint(ids)
    words, bits = _id_filter(ids)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        begin("minhash")
        known = shared.value
        for part in pieces(batches):
            h = part.column(2).to_numpy()
            part = part.filter(pa.array((known[h // 64] >> (h % 64).astype(np.uint64)) & np.uint64(1) != 0))
            own = [shingles(t) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(map(set_key, own), pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["rep", "set_key", "members"])

    wanted = reps.join(ids, "rep", "left_semi").select("rep", "set_key")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), "text").withColumn("h", _id_hash("rep", bits))
    found = texts.mapInArrow(run, "rep long, set_key binary, members binary").dropDuplicates(["rep", "set_key"])
    return checkpoint(found.join(wanted, ["rep", "set_key"], "left_semi").select("rep", "members"))


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 |A and B| >= percent |A or B|, on full sets (rep, members)."""

    def run(batches):
        begin("minhash")
        for part in pieces(batches, 64):
            keep = []
            for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                both = np.concatenate((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("rep").alias("u"), F.col("members").alias("a"))
    b = sets.select(F.col("rep").alias("v"), F.col("members").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs of representatives that are links, on full sets made from their texts."""
    found = _sets(pairs.select(F.col("u").alias("rep")).union(pairs.select("v")).distinct(), docs, reps)
    return _compared(pairs, found, percent)


def _mixed_buckets(placed: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, rep, n_shingles, component): the members of the buckets that hold several components."""
    now = placed.join(found, placed["m.rep"] == found["node"], "left").select("bucket", "m.rep", "m.n_shingles", F.coalesce("component", "m.rep").alias("component"))
    mixed = now.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("bucket")
    return checkpoint(now.join(mixed, "bucket"))


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(len(a), len(b)): how many values each two sets have in common; a product of 0/1 matrices, some columns at a time."""
    flat, row = [], []
    for sets in (a, b):
        flat.append(np.concatenate(sets))
        row.append(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
    shared = np.intersect1d(flat[0] if len(a) == 1 else np.unique(flat[0]), flat[1] if len(b) == 1 else np.unique(flat[1]), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(shared):
        return out
    at = [np.minimum(np.searchsorted(shared, x), len(shared) - 1) for x in flat]
    hit = [shared[k] == x for k, x in zip(at, flat, strict=True)]
    at, row = ([x[h] for x, h in zip(both, hit, strict=True)] for both in (at, row))
    for low in range(0, len(shared), COLUMNS):
        width, sides = min(COLUMNS, len(shared) - low), []
        for k, sets in enumerate((a, b)):
            mine = (at[k] >= low) & (at[k] < low + width)
            dense = np.zeros((len(sets), width), np.float32)
            dense[row[k][mine], at[k][mine] - low] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out


def forest(a: list, b: list, percent: int) -> list[tuple[int, int]]:
    """Links (u > v) between members (rep, component, set) of ``a`` and of ``b`` that join components; no more than a forest."""
    sizes = [np.array([len(x[2]) for x in side]) for side in (a, b)]
    both = common_counts([x[2] for x in a], [x[2] for x in b])
    linked = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None] - both)
    names, local = np.unique([x[1] for x in a] + [x[1] for x in b], return_inverse=True)
    mine, other = local[: len(a)], local[len(a) :]
    linked &= mine[:, None] != other[None]
    i, j = np.nonzero(linked)
    _, first = np.unique(mine[i] * len(names) + other[j], return_index=True)
    root, out = list(range(len(names))), []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k in first.tolist():
        x, y = find(mine[i[k]]), find(other[j[k]])
        if x != y:
            root[x] = y
            u, v = a[i[k]][0], b[j[k]][0]
            out.append((max(u, v), min(u, v)))
    return out


def prefixes(size: int, percent: int) -> tuple[int, int]:
    """How many of a set's rarest values must hold a common one if it is linked with a set that is no smaller, and with any."""
    return size - -(-2 * percent * size // (100 + percent)) + 1, size - -(-percent * size // 100) + 1


def _slots(values: np.ndarray) -> np.ndarray:
    return (_mixed(values) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many values of the sets fall into each slot of a table of fixed size: an order of values, rare ones first, that all tasks share."""

    def count(batches):
        begin("minhash")
        held = np.zeros(1 << SLOT_BITS, np.int64)
        for part in pieces(batches):
            flat = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64)
            held += np.bincount(_slots(flat), minlength=len(held))
        yield from _ranges({k: c for k, c in enumerate(held.reshape(-1, SLOT_RANGE)) if c.any()})

    def add(batches):
        begin("minhash")
        held: dict[int, np.ndarray] = {}
        for part in batches:
            for k, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(c, np.int64)
        yield from _ranges(held)

    kind = "range int, counts binary"
    found = sets.select("members").mapInArrow(count, kind).repartition("range").mapInArrow(add, kind)
    out = np.zeros((1 << SLOT_BITS) // SLOT_RANGE * SLOT_RANGE, np.int32).reshape(-1, SLOT_RANGE)
    for r in found.collect():  # one row a range, of which there is a fixed number
        out[r.range] = np.minimum(np.frombuffer(r.counts, np.int64), np.iinfo(np.int32).max)
    return out.ravel()


def _ranges(held: dict[int, np.ndarray]):
    if held:
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([c.tobytes() for c in held.values()], pa.binary())], ["range", "counts"])


def _tokens(sets: DataFrame, percent: int) -> DataFrame:
    """(token, rep, component, n, index): the rare values of each set by which a linked set can be found; no exchange.

    ``index``: whether the value is among the fewer ones that a set needs for partners of its own size or more.
    """
    shared = sets.sparkSession.sparkContext.broadcast(_slot_counts(sets))

    def run(batches):
        begin("minhash")
        counts = shared.value
        for part in pieces(batches, 64):
            rep, component, members = (c.to_pylist() for c in part.columns)
            out = []
            for r, c, x in zip(rep, component, members, strict=True):
                own = np.frombuffer(x, np.uint64)
                index, probe = prefixes(len(own), percent)
                rare = own[np.lexsort((own, counts[_slots(own)]))[:probe]].view(np.int64)
                out.append((rare, np.full(len(rare), r), np.full(len(rare), c), np.full(len(rare), len(own)), np.arange(len(rare)) < index))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(v)) for v in zip(*out, strict=True)], ["token", "rep", "component", "n", "index"])

    return sets.select("rep", "component", "members").mapInArrow(run, "token long, rep long, component long, n long, index boolean")


def meetings(tokens: DataFrame) -> DataFrame:
    """(token, lo, hi, mine, rep, component): the pairs of blocks of each token's sets that can hold a link between components.

    Of two linked sets one, at least, has the token among its index values, and they are of different components. So sets meet unless both
    are only probes or both are of the token's commonest component; a token without such a pair has no rows. Blocks hold
    BLOCK sets and BLOCK_VALUES values on average.
    """
    per = tokens.groupBy("token", "component").agg(F.count("*").alias("c"), F.max("index").alias("any"))
    mixed = per.groupBy("token").agg(F.max_by("component", "c").alias("top"), F.count("*").alias("components"), F.max("any").alias("any")).where("components > 1 and any")
    rows = checkpoint(tokens.join(mixed.select("token", "top"), "token"))
    # 0: index of the commonest component, 1: other index, 2: other probe, 3: probe of the commonest component
    same = F.col("component") == F.col("top")
    rows = rows.withColumn("kind", F.when(F.col("index"), F.when(same, 0).otherwise(1)).otherwise(F.when(same, 3).otherwise(2)))
    need = lambda k: F.ceil(F.greatest(F.count(F.when(F.col("kind") == k, 1)) / BLOCK, F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) / BLOCK_VALUES)).cast("int").alias(f"b{k}")
    sizes = rows.groupBy("token").agg(*map(need, range(4)))
    # an index set meets something: other index sets, or those that are only probes of other components
    sizes = sizes.where("b1 > 0 or (b0 > 0 and b2 > 0)")
    start = [sum((F.col(f"b{j}") for j in range(k)), F.lit(0)) for k in range(4)]
    spans = F.array(*[F.when(F.col(f"b{k}") > 0, F.sequence(start[k], start[k] + F.col(f"b{k}") - 1)).otherwise(F.array().cast("array<int>")) for k in range(4)])
    meets = ((1, 2), (0, 1, 2, 3), (0, 1), (1,))
    dealt = rows.join(sizes, "token").withColumn("spans", spans)
    at = F.get("spans", F.col("kind"))
    dealt = dealt.withColumn("own", F.get(at, F.pmod(F.xxhash64("rep"), F.size(at)).cast("int")))
    others = F.lit(None).cast("array<int>")
    for kind, with_ in enumerate(meets):
        others = F.when(F.col("kind") == kind, F.concat(*[F.get("spans", F.lit(k)) for k in with_])).otherwise(others)
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("mine"), "rep", "component")


def plausible_meetings(dealt: DataFrame, percent: int, bits: int) -> DataFrame:
    """What is left of meeting blocks by sizes and signatures: pairs (u, v) where they are no more than the sets, or else the sets.

    ``dealt``: (token, lo, hi, mine, rep, component, n_shingles, s0 ... s3). So no more rows come out than go in, and sets are only
    fetched for what can be a link.
    """
    most, key = most_bits(percent, bits), ["token", "lo", "hi"]
    names = [*key, "mine", "rep", "component", "u", "v"]

    def run(batches):
        begin("minhash")
        held: list[list[np.ndarray]] = []
        for group in runs_of(batches, key):
            mine, rep, component, n = (group.column(c).to_numpy() for c in ("mine", "rep", "component", "n_shingles"))
            signature = np.stack([group.column(f"s{k}").to_numpy().view(np.uint64) for k in range(4)], 1)
            same = group.column("lo")[0] == group.column("hi")[0]
            a = np.flatnonzero(mine == 0)
            b = a if same else np.flatnonzero(mine == 1)
            if not len(a) or not len(b):
                continue
            seen, pairs, count = np.zeros(len(rep), bool), [], 0
            for at in range(0, len(a), 512):
                own = a[at : at + 512]
                fine = 100 * np.minimum(n[own][:, None], n[b][None]) >= percent * np.maximum(n[own][:, None], n[b][None])
                fine &= component[own][:, None] != component[b][None]
                differ = sum(np.bitwise_count(signature[own, k][:, None] ^ signature[b, k][None]).astype(np.int16) for k in range(4))
                i, j = np.nonzero(fine & (differ <= most))
                i, j = own[i], b[j]
                seen[i] = seen[j] = True
                if same:
                    i, j = i[i < j], j[i < j]
                count += len(i)
                if count <= len(rep):
                    pairs.append((i, j))
            if 0 < count <= len(rep):
                u, v = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
                empty = np.full(len(u), -1)
                held.append([empty, empty, empty, empty, empty, empty, np.maximum(rep[u], rep[v]), np.minimum(rep[u], rep[v])])
            elif count:
                left, empty = np.flatnonzero(seen), np.full(int(seen.sum()), -1)
                held.append([*(group.column(c).to_numpy()[left] for c in key), mine[left], rep[left], component[left], empty, empty])
            if len(held) > 500:
                yield _columns(held, names)
                held = []
        if held:
            yield _columns(held, names)

    rows = dealt.repartition(shuffle_partitions(dealt.sparkSession), *key).sortWithinPartitions(*key)
    return rows.mapInArrow(run, "token long, lo int, hi int, mine int, rep long, component long, u long, v long")


def _columns(held: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 4]
    return pa.record_batch([pa.array(np.concatenate(c)).cast(t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _across(members: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, bits: int) -> DataFrame:
    """(u, v): links that join what is left of the components of the buckets, decided on the full sets.

    ``members``: (bucket, rep, n_shingles, component). Sets that can be linked share one of their rarest values,
    so only these are exchanged; where sets of several components share one, their sizes and signatures are compared in blocks, and only what
    they leave is compared in full: few pairs as pairs, many in blocks. The rows
    that come out are linear in the members: a forest a pair of blocks.
    """

    def run(batches):
        begin("minhash")
        found = []
        for group in runs_of(batches, ("token", "lo", "hi")):
            mine, rep, component, members = (group.column(c).to_pylist() for c in ("mine", "rep", "component", "members"))
            sides = [], []
            for m, r, c, x in zip(mine, rep, component, members, strict=True):
                sides[m].append((r, c, np.frombuffer(x, np.uint64)))
            a, b = sides if group.column("lo")[0] != group.column("hi")[0] else (sides[0], sides[0])
            if a and b:
                found += forest(a, b, percent)
            if len(found) > 10_000:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])
                found = []
        if found:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    nodes = checkpoint(members.select("rep", "component").distinct())
    sets = checkpoint(_sets(nodes.select("rep"), docs, reps).join(nodes, "rep"))
    signed = meetings(_tokens(sets, percent)).join(reps.select("rep", "n_shingles", "s0", "s1", "s2", "s3"), "rep")
    left = checkpoint(plausible_meetings(signed.select("token", "lo", "hi", "mine", "rep", "component", "n_shingles", "s0", "s1", "s2", "s3"), percent, bits))
    pairs = checkpoint(left.where("u >= 0").select("u", "v").distinct())
    key = ["token", "lo", "hi"]
    rows = left.where("u < 0").join(sets.select("rep", "members"), "rep").repartition(shuffle_partitions(docs.sparkSession), *key)
    blocks = rows.sortWithinPartitions(*key).select(*key, "mine", "rep", "component", "members").mapInArrow(run, "u long, v long")
    return blocks.unionByName(_compared(pairs, sets.select("rep", "members"), percent))


def linked(docs: DataFrame, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, body, n_shingles, component_id: one row a document."""
    base = checkpoint(signatures(docs, bands, rows))
    full = base.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    first_rows = full.join(classes.withColumnRenamed("set_key", "__key"), (F.col("doc_id") == F.col("rep")) & (F.col("set_key") == F.col("__key")))
    reps = checkpoint(first_rows.select("rep", "set_key", "n_shingles", "s0", "s1", "s2", "s3", "buckets").dropDuplicates(["rep", "set_key"]))
    member = F.struct("rep", "n_shingles", "s0", "s1", "s2", "s3")
    in_buckets = reps.select("rep", F.explode("buckets").alias("bucket"))
    shared = in_buckets.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("bucket", "least")
    signed = reps.select("rep", member.alias("m"))
    placed = checkpoint(in_buckets.join(shared, "bucket").join(signed, "rep").drop("rep"))
    near = lambda a, b: _plausible(a, b, percent, bands * rows)

    centres = placed.where("m.rep = least").select("bucket", F.col("m").alias("c")).dropDuplicates(["bucket"])
    to_least = placed.where("m.rep != least").join(centres, "bucket").where(near("m", "c"))
    to_least = checkpoint(to_least.select(F.col("m.rep").alias("u"), F.col("c.rep").alias("v")).distinct())
    links = checkpoint(_confirmed(to_least, docs, reps, percent))
    # what is left: all against all in a bucket that still holds several components
    more = _across(_mixed_buckets(placed, components(links)), docs, reps, percent, bands * rows)
    whole = components(links.union(more))
    of_class = classes.join(whole, classes["rep"] == whole["node"], "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = base.select("doc_id", "body", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "body", "n_shingles", component.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document; kept is true for rows of null doc_id."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return linked(docs, percent, bands, rows).drop("body").withColumn("kept", kept)


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, that of the least doc_id, and all rows of null doc_id.

    Of rows that share this least doc_id the text of the least hash stays, and of equal rows one.
    """
    found = checkpoint(linked(docs, percent).where("doc_id is not null").select("doc_id", "body", "component_id"))
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("body").alias("body"), F.count("*").alias("rows"))
    stay = first.select("doc_id", "body")
    gone = found.select("doc_id", "body").distinct().join(stay, ["doc_id", "body"], "left_anti")
    repeated = first.where("rows > 1").select("doc_id", "body")

    def matched(other: DataFrame, how: str) -> DataFrame:
        on = (docs["doc_id"].cast("long") == other["doc_id"]) & (F.xxhash64(docs["text"]) == other["body"])
        return docs.join(other, on, how)

    if repeated.isEmpty():
        return matched(gone, "left_anti")
    # of a doc_id with several rows one row of the staying text is taken, whichever comes
    one = matched(repeated, "left_semi")
    one = one.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).groupBy(F.col("row.doc_id").alias("k")).agg(F.first("row").alias("row"))
    return matched(gone.union(repeated), "left_anti").unionByName(one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)
