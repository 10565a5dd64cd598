"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are runs of at most ``TOKEN`` letters or digits of the lower-cased text. A longer run is cut where its own
letters say so, after a vowel, a digit below 5 or any letter beyond ASCII, or after each letter where none of these is near, so a
text without separators has the same tokens at whatever letter it starts. A cyclic polynomial over the tokens' hashes gives each run of ``GRAM``
tokens its rolling hash; it and the minima of windows of ``WINDOW`` such hashes are built by
doubling, in passes whose number doesn't depend on the text. Hashes are ordered by their lower 38 bits, in which two of a window agree
by chance once in 10^9 windows. Of equal minima the rightmost
is taken, and each chosen hash, all of its 64 bits, keeps its token position: any passage of GRAM + WINDOW - 1 tokens
that two texts share gives both at least one common hash.

Null text is empty text, whose fingerprint is empty. A text with fewer than GRAM tokens has one hash
of all of them, and a non-empty text without any token has the hash of the whole text. The likeness
of two fingerprints is the Jaccard index of their hash sets, 1 if both are empty. Repeated rows are
kept; rows of equal doc_id are ordered by their text, null ids come last. Extra columns, whatever their names, are
ignored by compare_neighbours(). An empty table gives no rows. A text of up to 2^26 tokens, more than a row of Spark holds, is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, shuffle_partitions

GRAM = 5
WINDOW = 16
TOKEN = 12
#: Low bits of a packed minimum that hold the reversed position: 2^26 tokens need an array beyond Spark's row size.
POSITION_BITS = 26
_LETTER = r"[\p{L}\p{N}]"
#: A whole run of a few letters, else up to a letter at which runs are cut, else one letter.
_TOKENS = rf"{_LETTER}{{1,{TOKEN}}}+(?!{_LETTER})|{_LETTER}{{0,{TOKEN - 1}}}?[aeiouy0-4[\p{{L}}\p{{N}}&&[^\x00-\x7F]]]|{_LETTER}"
_MASK = (1 << POSITION_BITS) - 1


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _from(array: Column, start: int) -> Column:
    """The array without its first ``start`` elements."""
    return F.slice(array, start + 1, F.greatest(F.size(array) - start, F.lit(0)))


def _joined(left: Column, right: Column, by: int) -> Column:
    """Cyclic polynomial of the runs that start in ``left`` and go on, ``by`` tokens long, in ``right``."""
    n = F.size(right)
    return F.zip_with(F.slice(left, 1, n), right, lambda a, b: _rotated(a, by).bitwiseXOR(b))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array<struct<hash: long, position: int>>, in the order of positions.

    The other columns are kept, whatever their names; one named ``out`` is replaced.
    """
    kept = [c for c in df.columns if c != out]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))
    return _fingerprinted(rows, "text", "made").select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("made").alias(out))


def _fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """with_fingerprint() for columns without names of two underscores; the plan still sees how the rows are dealt.

    Every step is a column of its own, so that no step is evaluated twice.
    """
    step = lambda name: F.col(f"__{name}")
    kept = df.columns
    df = df.withColumn("__tokens", F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKENS), F.lit(0)), lambda w: F.xxhash64(w)))
    df = df.withColumn("__two", _joined(step("tokens"), _from(step("tokens"), 1), 1))
    df = df.withColumn("__four", _joined(step("two"), _from(step("two"), 2), 2))
    df = df.withColumn("__grams", F.when(F.size("__tokens") >= GRAM, _joined(step("four"), _from(step("tokens"), 4), 1)).when(F.size("__tokens") > 0, F.array(F.xxhash64("__tokens"))).when(F.length(text) > 0, F.array(F.xxhash64(text))).otherwise(F.expr("cast(array() as array<bigint>)")))
    # a packed entry compares by hash, then by position, the later the less
    df = df.withColumn("__least1", F.transform("__grams", lambda h, i: F.shiftleft(h, POSITION_BITS).bitwiseOR((F.lit(_MASK) - i).cast("long"))))
    span = 1
    while span < WINDOW:
        df = df.withColumn(f"__least{2 * span}", F.zip_with(step(f"least{span}"), _from(step(f"least{span}"), span), lambda a, b: F.least(a, b)))
        span *= 2
    # beyond the last full window the minima are of cut windows; a short text has one cut window
    df = df.withColumn("__chosen", F.array_distinct(F.slice(step(f"least{WINDOW}"), 1, F.greatest(F.size("__grams") - WINDOW + 1, F.least(F.size("__grams"), F.lit(1))))))
    df = df.withColumn("__at", F.transform("__chosen", lambda p: (F.lit(_MASK) - p.bitwiseAND(F.lit(_MASK))).cast("int")))
    df = df.withColumn(out, F.transform("__at", lambda p: F.struct(F.get(F.col("__grams"), p).alias("hash"), p.alias("position"))))
    return df.select(*kept, out)


def hashes(fingerprint: str) -> Column:
    return F.array_distinct(F.col(fingerprint)["hash"])


def as_text(fingerprint: str) -> Column:
    """``hash:position`` joined by commas, the hash in hexadecimal."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.hex(x["hash"]), F.lit(":"), x["position"].cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard index of two arrays of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Deal (doc_id, text) into ranges of doc_id, each with the row that comes after it in descending order.

    ``part``: the range. ``guest``: true for the copy of a row of the range below. The ranges end at
    ids that are in the table, so a range's first row in descending order is that of its upper end,
    and it is copied to the range above, that of the topmost range to the lowest.
    The driver holds one id a range.
    """
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    shares = [k / parts for k in range(1, parts)]
    ends = docs.agg(F.percentile_approx("key", [*shares, 1.0], 100 * parts).alias("ends"), F.max("key").alias("top")).first()
    ends = sorted({*(ends["ends"] or ()), *([ends["top"]] if ends["top"] is not None else ())})
    ends = ends or [0]
    # two levels, so that finding a row's range costs the root of their number
    step = max(1, int(len(ends) ** 0.5))
    groups = [ends[k : k + step] for k in range(0, len(ends), step)]
    above = F.size(F.filter(F.array(*[F.lit(g[-1]) for g in groups]).cast("array<bigint>"), lambda e: e < F.col("key")))
    table = F.array(*[F.array(*map(F.lit, g)).cast("array<bigint>") for g in groups]).cast("array<array<bigint>>")
    docs = docs.withColumn("part", above * step + F.size(F.filter(F.coalesce(F.get(table, above), F.array().cast("array<bigint>")), lambda e: e < F.col("key"))))
    following = (F.col("part") + 1) % len(ends)
    ended = F.array_contains(F.coalesce(F.get(table, F.floor(F.col("part") / step).cast("int")), F.array().cast("array<bigint>")), F.col("key"))
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    guest = F.struct(following.cast("int").alias("part"), F.lit(True).alias("guest"))
    docs = docs.withColumn("place", F.explode(F.when(ended, F.array(own, guest)).otherwise(F.array(own))))
    return docs.select("doc_id", "text", "key", "place.part", "place.guest")


def compare_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The fingerprints of every whole text and its edited text, and their likeness.

    The next document is that of the next lower doc_id. The edited text has the last half of a
    text's code points replaced by as many of the next text's first ones.
    """
    parts = parts or shuffle_partitions(docs.sparkSession)
    df = with_next(docs, parts).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    df = df.repartitionByRange(parts, "part")
    order = Window.partitionBy("part").orderBy("guest", F.desc("key"), "tie")
    df = df.withColumn("follower", F.lead("text").over(order)).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 2) as int)), substring(coalesce(follower, ''), 1, cast(floor(n_chars / 2) as int)))")
    df = df.withColumn("edited", F.when(~F.col("guest"), edited)).drop("follower")
    df = _fingerprinted(df, "text", "own").drop("text")
    df = df.withColumn("own_set", hashes("own")).withColumn("next_set", F.lead("own_set").over(order))
    df = _fingerprinted(df.where(~F.col("guest")), "edited", "changed").withColumn("changed_set", hashes("changed"))
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("changed").alias("edited_fingerprint"),
        likeness("own_set", "changed_set").alias("near_edited"),
        likeness("own_set", "next_set").alias("near_next"),
    )


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(documents(spark, sf_dir))
