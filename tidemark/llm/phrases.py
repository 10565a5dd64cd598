"""Phrase collocations: what stands together more often than its parts would say, per language.

Texts are split into pieces at PIECE_ENDS and pieces into words at spaces and tabs, A-Z lower-cased. Equal pieces become one with a multiplicity.
Runs of one word, then two, three and four are counted level by level: a task counts the runs of a few million words with numpy and deals
them by hash into buckets, and each bucket is added up by duckdb, which spills beyond its memory and gives the frequent ones. A run of several words
is only counted where both shorter runs in it pass a bit table of the frequent ones of the level before, so no frequent run is ever missed
and the table needs not be exact. Scores need the counts of both parts of every cut of a phrase: these are asked for by rows that are
shuffled to where the part's count is, so no count table goes to every task.

A phrase is a candidate from LEAST occurrences on. Its score is floor(2000000 a / (l + r)) of its worst cut (a: its count, l and r: those of
the parts); ties go to the first cut. Candidates inside a longer candidate that has at least 80 % of their occurrences are dropped. Products are
decimals of 38 digits. Null texts are empty, null languages count as ``und``. Repeated rows count each time. A text of any length is one row until
its pieces are dealt. Extra columns, whatever their names, are ignored; an empty table gives no rows; of equal score and count the
phrase that is less in UTF-8 bytes comes first.
"""

from __future__ import annotations

import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import begin, documents, shuffle_partitions, written

PIECE_ENDS = r"[.,;:!?\x0A-\x0D]"
LONGEST, LEAST, TOP = 4, 30, 2000
COVERED = 80
#: Bytes of pieces that a task counts at once.
CHUNK = 8 << 20
#: Memory of a bucket's sums before duckdb spills.
BUCKET_MEMORY = "256MB"
#: Bits of the table of frequent runs for each of them, and at most (16 MB).
BITS_A_RUN, FILTER_BITS = 16, 1 << 27
RUNS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
_STEP, _PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def pieces_of(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): distinct pieces, words apart by one space, and how often each occurs."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate(F.coalesce("text", F.lit("")), upper, upper.lower())
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(lower, PIECE_ENDS)).alias("piece"))
    rows = rows.select("lang", F.trim(F.regexp_replace("piece", "[ \t]+", " ")).alias("piece")).where("piece != ''")
    return rows.groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _PRIME
    return x ^ (x >> np.uint64(29))


def _hashes(texts: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts.cast(pa.binary()).to_pylist()], np.uint64)


def _joined(start: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of runs from those of their language and words."""
    for h in words:
        start = _mixed(start * _STEP + h)
    return start


def run_hashes(lang: pa.Array, gram: pa.Array, words: int) -> np.ndarray:
    """The same hashes of runs in full, words apart by a space."""
    flat = pc.split_pattern(gram, " ").flatten() if words > 1 else gram
    per = _hashes(flat).reshape(-1, words)
    return _joined(_hashes(lang), list(per.T))


class Known:
    """A bit for the hash of each frequent run: never says no to one of them."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, np.uint64(bits)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes % self.bits
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def runs(lang: pa.Array, piece: pa.Array, m: np.ndarray, words: int, known: Known | None) -> tuple[pa.RecordBatch, np.ndarray]:
    """The distinct runs of ``words`` words of the pieces, with their weighted counts, and the runs' hashes."""
    langs, split = lang.dictionary_encode(), pc.split_pattern(piece, " ")
    flat = split.flatten().dictionary_encode()
    ends = split.offsets.to_numpy()
    ends = ends - ends[0]
    of = np.repeat(np.arange(len(piece)), np.diff(ends))
    names, spoken = flat.dictionary, langs.indices.to_numpy().astype(np.int64)
    # a word of a language is one number
    kinds, code = np.unique(spoken[of] * len(names) + flat.indices.to_numpy(), return_inverse=True)
    language, word = kinds // max(len(names), 1), kinds % max(len(names), 1)
    h_lang, h_word = _hashes(langs.dictionary), _hashes(names)
    if words == 1:
        n = np.zeros(len(kinds), np.int64)
        np.add.at(n, code, m[of])
        own = [word]
    else:
        at = np.flatnonzero(ends[1:][of] - np.arange(len(of)) >= words)
        hashed = h_word[word][code]
        starts = np.flatnonzero(ends[1:][of] - np.arange(len(of)) >= words - 1)
        fine = np.zeros(len(of) + 1, bool)
        fine[starts] = known(_joined(h_lang[language][code[starts]], [hashed[starts + k] for k in range(words - 1)]))
        at = at[fine[at] & fine[at + 1]]
        run = code[at]
        for k in range(1, words):
            _, run = np.unique(run * len(kinds) + code[at + k], return_inverse=True)
        _, first = np.unique(run, return_index=True)
        n = np.zeros(len(first), np.int64)
        np.add.at(n, run, m[of[at]])
        own = [word[code[at[first] + k]] for k in range(words)]
        language = language[code[at[first]]]
    gram = [names.take(pa.array(w)) for w in own]
    batch = pa.record_batch([langs.dictionary.take(pa.array(language)), gram[0] if words == 1 else pc.binary_join_element_wise(*gram, " "), pa.array(n)], schema=RUNS)
    return batch, _joined(h_lang[language], [h_word[w] for w in own])


def _chunks(batches):
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            held.append(part)
            size += part.column(1).nbytes
            if size >= CHUNK:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def summed(batches, least: int) -> pa.RecordBatchReader:
    """(lang, gram, n): sums of the runs of a bucket, from ``least`` on; beyond BUCKET_MEMORY in a folder of the task's own, gone when it ends."""
    with tempfile.TemporaryDirectory(prefix="runs-") as spill, duckdb.connect() as base:
        base.execute(f"set threads = 1; set memory_limit = '{BUCKET_MEMORY}'; set temp_directory = '{spill}'; set preserve_insertion_order = false")
        rows = pa.RecordBatchReader.from_batches(RUNS, batches)  # read by name in the query
        yield from base.sql("select lang, gram, cast(sum(n) as bigint) as n from rows group by lang, gram having sum(n) >= $1", params=[least]).to_arrow_reader(65_536)
        del rows


def frequent(pieces: DataFrame, words: int, known: tuple[np.ndarray, int] | None, least: int) -> DataFrame:
    """(lang, words, gram, n, h): the runs of ``words`` words with at least ``least`` occurrences; a payload a chunk and bucket is shuffled."""
    spark = pieces.sparkSession
    buckets = shuffle_partitions(spark)
    shared = spark.sparkContext.broadcast(known)

    def deal(batches):
        begin("phrases")
        table = None if shared.value is None else Known(*shared.value)
        for chunk in _chunks(batches):
            found, hashes = runs(chunk.column(0), chunk.column(1), chunk.column(2).to_numpy(), words, table)
            bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            found, bucket = found.take(pa.array(order)), bucket[order].astype(np.int32)
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
            for low in range(0, len(edges) - 1, 64):
                sides = edges[low : low + 65]
                packed = [pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(a, b))) for c in found.columns], schema=RUNS).serialize().to_pybytes() for a, b in zip(sides[:-1], sides[1:], strict=True)]
                yield pa.record_batch([pa.array(bucket[sides[:-1]]), pa.array(packed, pa.binary())], ["bucket", "packed"])

    def add(batches):
        begin("phrases")
        payloads = (pa.ipc.read_record_batch(pa.py_buffer(p), RUNS) for batch in batches for p in batch.column(1).to_pylist())
        for part in summed(payloads, least):
            if part.num_rows:
                lang, gram, n = (c.cast(t) for c, t in zip(part.columns, RUNS.types, strict=True))
                yield pa.record_batch([lang, pa.array(np.full(len(n), words, np.int32)), gram, n, pa.array(run_hashes(lang, gram, words).view(np.int64))], ["lang", "words", "gram", "n", "h"])

    dealt = pieces.select("lang", "piece", "m").mapInArrow(deal, "bucket int, packed binary").repartitionById(buckets, F.col("bucket"))
    return written(dealt.mapInArrow(add, "lang string, words int, gram string, n long, h long"))


def bit_table(found: DataFrame) -> tuple[np.ndarray, int]:
    """The bits of the hashes ``h``; their number follows that of the runs, up to FILTER_BITS."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (BITS_A_RUN * found.count()).bit_length()))
    low = F.col("h").bitwiseAND(F.lit(bits - 1))  # the hash, without its sign, modulo a power of two
    rows = found.select(F.shiftright(low, 6).alias("w"), low.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    words = rows.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy()] = words["v"].to_numpy().astype(np.int64).view(np.uint64)
    return out, bits


def _decimal(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all runs of several words in ``counts`` (lang, words, gram, n), by their worst cut."""
    word = F.split("gram", " ")
    cut = lambda k: F.struct(k.cast("int").alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("l"), F.array_join(F.slice("w", k + 1, F.col("words")), " ").alias("r"))
    asked = counts.where("words > 1").withColumn("w", word).select("lang", "gram", "words", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), cut)).alias("cut"))
    asked = asked.select("lang", "gram", "words", "n", "cut.k", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("cut.l").alias("part")), F.struct(F.lit("r").alias("side"), F.col("cut.r").alias("part")))).alias("at"))
    asked = asked.select("lang", "gram", "words", "n", "k", "at.side", "at.part")
    parts = counts.where(F.col("words") < LONGEST).select("lang", F.col("gram").alias("part"), F.col("n").alias("f"))
    told = asked.join(parts, ["lang", "part"])
    held = {f"{side}{k}": F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))) for k in range(1, LONGEST) for side in "lr"}
    wide = told.groupBy("lang", "gram", "words", "n").agg(*[c.alias(name) for name, c in held.items()])
    of = lambda k: F.expr(f"(cast(n as decimal(20,0)) * 2000000BD) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    cuts = [F.when(F.col("words") > k, F.struct(of(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]
    return wide.withColumn("worst", F.array_min(F.array_compact(F.array(*cuts)))).select("lang", F.col("gram").alias("phrase"), "words", F.col("n").alias("a"), "worst.l", "worst.r", "worst.score")


def uncovered(found: DataFrame) -> DataFrame:
    """The candidates that lie in no longer candidate with COVERED % of their occurrences."""
    inner = [(n, k) for n in range(2, LONGEST) for k in range(1, LONGEST - n + 2)]
    w = F.split("phrase", " ")
    parts = [F.when((F.col("words") >= k + n - 1) & (F.col("words") > n), F.array_join(F.slice(w, k, n), " ")) for n, k in inner]
    own = found.where("words > 2").withColumn("part", F.explode(F.array_distinct(F.array_compact(F.array(*parts)))))
    longest = own.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = found.join(longest, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (100 * _decimal("longer") < COVERED * _decimal("a"))).drop("longer")


def first_of_each(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their ``rank``.

    A coarse histogram of bounded size (thousands of the score; at the highest score, which many phrases share, the counts' powers of two)
    tells which rows can be among them, so that no task sorts a whole language.
    """
    level = F.struct(F.floor(F.col("score") / 1000).alias("s"), F.when(F.col("score") == 1_000_000, F.floor(F.log2("a"))).otherwise(F.lit(0)).alias("p"))
    rows = found.withColumn("level", level)
    table = rows.groupBy("lang", "level").agg(F.count("*").alias("n"))
    above = Window.partitionBy("lang").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = table.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).where(F.col("above") < top)
    wanted = wanted.groupBy("lang").agg(F.min("level").alias("lowest"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.join(wanted, "lang").where("level >= lowest").drop("level", "lowest")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases."""
    pieces = written(pieces_of(docs))
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    totals = pieces.groupBy("lang").agg(F.sum(F.col("m") * words).cast("long").alias("n"))
    levels = [frequent(pieces, 1, None, least)]
    for k in range(2, LONGEST + 1):
        levels.append(frequent(pieces, k, bit_table(levels[-1]), least))
    counts = levels[0]
    for more in levels[1:]:
        counts = counts.unionByName(more)
    best = first_of_each(written(uncovered(written(scored(counts)))), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
  from documents),
w as materialized (
  select lang, m, string_split(trim(regexp_replace(p, '[ \t]+', ' ', 'g'), ' '), ' ') as ws
  from (select lang, p, count(*) as m from pieces where regexp_matches(p, '[^ \t]') group by lang, p)),
g as materialized (
  select lang, k as words, gram, sum(m) as f from (
    select lang, m, k, array_to_string(ws[i:i + k - 1], ' ') as gram
    from (select lang, m, k, ws, unnest(range(1, len(ws) - k + 2)) as i from w, (values (1), (2), (3), (4)) as sizes(k) where len(ws) >= k))
  group by lang, k, gram having sum(m) >= 30),
cuts as (select lang, words, gram, f, string_split(gram, ' ') as ws, unnest(range(1, words)) as k from g where words > 1),
parts as (
  select c.lang, c.words, c.gram, c.f as a, c.k, l.f as l, r.f as r, (2000000 * c.f) // (l.f + r.f) as score
  from cuts c join g l on l.lang = c.lang and l.gram = array_to_string(c.ws[1:c.k], ' ') join g r on r.lang = c.lang and r.gram = array_to_string(c.ws[c.k + 1:], ' ')),
worst as materialized (select * from parts qualify row_number() over (partition by lang, gram order by score, k) = 1),
inner_runs as (
  select lang, a, array_to_string(ws[i:i + k - 1], ' ') as gram from (
    select lang, a, ws, k, unnest(range(1, words - k + 2)) as i from (select lang, a, words, string_split(gram, ' ') as ws from worst), (values (2), (3)) as sizes(k) where k < words)),
covered as (select lang, gram, max(a) as longer from inner_runs group by lang, gram),
kept as (select worst.* from worst left join covered using (lang, gram) where longer is null or 100 * longer < 80 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, gram) as rank from kept)
select lang, rank, gram as phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join (select lang, sum(m * len(ws)) as n from w group by lang) using (lang) where rank <= 2000"""
