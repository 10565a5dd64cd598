"""Personal data: fixed forms, and identifiers found by patterns that the fixed forms induce.

Base spans are the matches of four forms (email, ip, card, phone), leftmost and non-overlapping for each kind. They
seed the rest: every base span and every other identifier-like run (an @ or at least ``LEAST_DIGITS``
digits, without white space or in groups joined by single spaces, dots, hyphens or brackets) has lexical patterns: its form (digits
and letters by class), the word before, the two words before, the words on both sides, and its form after the word before. Patterns and
the distinct values that they hold form a graph. In each round a pattern is scored for each kind: the scores of its values that are labelled
with it, over these plus those labelled otherwise plus ``UNKNOWN_SHARE`` for each value without a label plus ``PRIOR`` (a value
that nobody has labelled speaks against a pattern, but less than one of another kind). Patterns with ``LEAST_SEEDS`` labelled values
and a score of ``LEAST_SHARE`` pass labels to their other values, whose score is that of several patterns together; values of
``LEAST_SCORE`` that one context, at least, speaks for are labelled (a form alone never suffices, it supports contexts), keep their kind and their best score, and seed the next round, until nothing changes. Occurrences of
labelled values become spans; base spans are never dropped.

Null text has no spans. Offsets are code points, ends exclusive. Spans of different kinds may overlap, and found ones may lie within one another; found
ones never overlap a base span. Repeated rows have the same spans each. Ties between kinds go to the kind
listed first. Without seeds nothing is found. Extra columns, whatever their names, are ignored by find_personal_data() and
kept by redact(). An empty table gives no rows. Values and texts may be of any length; context words are those that
begin within ``REACH`` characters of the span.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import begin, checkpoint, documents, pieces

KINDS = ("email", "ip", "card", "phone")
LEAST_DIGITS = 5
#: Longer values are told apart by a hash.
MOST_CHARS = 64
#: What patterns of a form alone begin with; all others hold words of the context.
FORM = "f "
#: A pattern needs labelled values of such scores together, and such a score, to pass a label on.
LEAST_SEEDS, LEAST_SHARE = 3.0, 0.6
LEAST_SCORE = 0.75
#: What a value without a label counts against a pattern, and what every pattern has against it.
UNKNOWN_SHARE, PRIOR = 0.25, 1.0
#: Rounds end when no value is new and scores rise by less than this on average.
LEAST_GAIN = 1e-4
#: Context words are looked for in so many characters on each side.
REACH = 60

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]+")
_GROUPS = re.compile(r"[0-9]++(?:(?:[ .-]|\)[ .-]?\(?|[ .-]\()[0-9]++)++")
_LETTERS = re.compile(r"[^\W\d_]+")
_TRIM = " \t\r\n.,;:!?\"'()[]{}<>|*#%$&="


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ to both sides, so that long runs without one cost nothing."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            out.append((start, domain.end()))
            low = domain.end()
        at = text.find("@", max(at + 1, low))
    return out


def _small(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) < 4 and int(bare or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; kinds by their place in KINDS."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _only_digits(m[0])) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return out


def other_runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like runs that touch no base span: without white space, and those that joined groups of digits span."""
    marks = [m.span() for m in _DIGIT.finditer(text)]
    at = text.find("@")
    while at >= 0:
        marks.append((at, at))
        at = text.find("@", at + 1)
    out, low = [], 0
    taken = sorted((s, e) for _, s, e in base)

    def add(start: int, end: int) -> int:
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        low, run = end, text[start:end]
        start += len(run) - len(run.lstrip(_TRIM))
        run = run.strip(_TRIM)
        end = start + len(run)
        if run and start > 0 and text[start - 1] == "(" and run.count(")") > run.count("("):
            start -= 1
        if run and ("@" in run[1:] or sum(c in "0123456789" for c in run) >= LEAST_DIGITS) and not any(s < end and start < e for s, e in taken):
            out.append((start, end))
        return low

    for mark, _ in sorted(marks):
        if mark >= low:
            low = add(mark, mark)
    for m in _GROUPS.finditer(text):
        if " " in m[0]:
            add(*m.span())
    return sorted(set(out))


def value_of(run: str) -> str:
    run = run.lower()
    return run if len(run) <= MOST_CHARS else hashlib.blake2b(run.encode("utf-8", "surrogatepass"), digest_size=32).hexdigest()


def form_of(run: str) -> str:
    """Digits as 0, each run of letters as a; of a long run its first part and its length in digits."""
    form = _LETTERS.sub("a", re.sub("[0-9]", "0", run))
    return form if len(form) <= MOST_CHARS else f"{form[:MOST_CHARS]}~{form.count('0')}"


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a span: its form, its neighbouring words, lower-cased, digits as 0, and both together."""
    plain = lambda words: [_DIGIT.sub("0", w.lower()) for w in words]
    left = plain(text[max(0, start - REACH) : start].split()[-2:])
    right = plain(text[end : end + REACH].split()[:1])
    form = form_of(text[start:end])
    out = [FORM + form]
    if left:
        out += [f"1 {left[-1]}", f"lf {left[-1]} {form}"]
        if len(left) > 1:
            out.append(f"2 {left[0]} {left[1]}")
        if right:
            out.append(f"b {left[-1]} _ {right[0]}")
    return out


SCAN = "doc_id long, body long, base array<struct<kind: int, start: int, end: int>>, runs array<struct<kind: int, start: int, end: int, value: string, patterns: array<string>>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: its base spans, and every identifier-like run with its patterns (kind null: not labelled)."""
    span = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
    kinds = pa.int64(), pa.int64(), pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        begin("pii")
        for part in pieces(batches):
            base, runs = [], []
            for text in part.column(2).to_pylist():
                found = base_spans(text) if text else []
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                others = other_runs(text, found) if text and ("@" in text or _DIGIT.search(text)) else []
                runs.append([{"kind": k, "start": s, "end": e, "value": value_of(text[s:e]), "patterns": patterns(text, s, e)} for k, s, e in [*found, *((None, s, e) for s, e in others)]])
            yield pa.record_batch([pa.array(c, t) for c, t in zip((part.column(0), part.column(1), base, runs), kinds, strict=True)], ["doc_id", "body", "base", "runs"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("body"), "text").mapInArrow(run, SCAN)


def label_values(scanned: DataFrame) -> DataFrame:
    """(value, kind, score): the values that are no seeds and were labelled, with the kind of the best score.

    A seed of several kinds has the first of them. A pattern's edges are never held together: they are counted by value, then summed.
    """
    runs = scanned.select(F.explode("runs").alias("r")).select("r.kind", "r.value", "r.patterns")
    seeds = checkpoint(runs.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0)))
    edges = runs.select("value", F.explode("patterns").alias("pattern")).distinct()
    # a pattern with fewer values has nothing to pass on; as a table, so that the join can split a pattern of very many values
    wide = checkpoint(edges.groupBy("pattern").agg(F.count("*").alias("held")).where(F.col("held") > LEAST_SEEDS))
    edges = checkpoint(edges.join(wide, "pattern"))
    labels, before = seeds, None
    while True:
        own = edges.join(labels, "value").groupBy("pattern", "held", "kind").agg(F.sum("score").alias("own"), F.count("*").alias("n"))
        all_kinds = Window.partitionBy("pattern")  # as many rows as kinds
        against = F.sum("own").over(all_kinds) - F.col("own") + UNKNOWN_SHARE * (F.col("held") - F.sum("n").over(all_kinds)) + PRIOR
        scored = own.withColumn("share", F.col("own") / (F.col("own") + against))
        trusted = checkpoint(scored.where((F.col("own") >= LEAST_SEEDS) & (F.col("share") >= LEAST_SHARE)).select("pattern", "kind", "share"))
        by_context = F.max(~F.startswith("pattern", F.lit(FORM))).alias("by_context")
        reached = edges.join(trusted, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-9)))))).alias("score"), by_context).where("by_context").drop("by_context")
        had = labels.select("value", F.col("kind").alias("had"), F.col("score").alias("had_score"))
        reached = reached.where(F.col("score") >= LEAST_SCORE).join(had, "value", "left").where("had is null or kind = had")
        reached = reached.select("value", "kind", F.greatest("score", F.coalesce("had_score", F.lit(0.0))).alias("score"))
        # labels stay, and take the better score
        found = labels.select("value", "kind", "score").union(reached).join(seeds.select("value"), "value", "left_anti")
        best = found.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("m"))
        labels = checkpoint(seeds.union(best.select("value", (-F.col("m.k")).alias("kind"), F.col("m.score").alias("score"))))
        now = labels.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if before and now[0] == before[0] and now[1] - before[1] <= LEAST_GAIN * now[0]:
            break
        before = now
    return labels.join(seeds.select("value"), "value", "left_anti")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, body, base, found: arrays of (kind, start, end); ``body`` is xxhash64 of the text."""
    scanned = checkpoint(scan(docs))
    more = label_values(scanned)
    runs = scanned.select("doc_id", "body", F.explode("runs").alias("r")).where("r.kind is null").select("doc_id", "body", "r.start", "r.end", "r.value").distinct()
    spans = runs.join(more, "value").groupBy(F.col("doc_id").alias("id"), F.col("body").alias("own")).agg(F.sort_array(F.collect_list(F.struct(F.col("kind").cast("int").alias("kind"), "start", "end"))).alias("found"))
    out = scanned.select("doc_id", "body", "base").join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("body").eqNullSafe(F.col("own")), "left")
    return out.select("doc_id", "body", "base", F.coalesce("found", F.expr("cast(array() as array<struct<kind: int, start: int, end: int>>)")).alias("found"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind as listed, then start."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets, and n_chars renewed.

    Overlapping spans are replaced together, under the kind of the first of them. Columns keep their order, values and names.
    """
    spans = find_personal_data(docs).select("doc_id", "body", F.concat("base", "found").alias("spans")).where(F.size("spans") > 0).dropDuplicates(["doc_id", "body"])

    def run(batches):
        begin("pii")
        for part in pieces(batches):
            texts = []
            for text, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if found:
                    parts, low = [], 0
                    for s in sorted(found, key=lambda s: (s["start"], s["kind"])):
                        if s["start"] >= low:
                            parts += [text[low : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                        low = max(low, s["end"])
                    text = "".join([*parts, text[low:]])
                texts.append(text)
            yield pa.record_batch([pa.array(texts, pa.string()), part.column(2)], ["text", "row"])

    text = F.col("row.text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumns({"id": F.col("row.doc_id").cast("long"), "own": F.when(text.isNotNull(), F.xxhash64(text))})
    rows = rows.join(spans, F.col("id").eqNullSafe(spans["doc_id"]) & (F.col("own") == spans["body"]), "left")
    rest = F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != "text"])
    rows = rows.select(text.alias("text"), "spans", rest.alias("row"))
    done = rows.mapInArrow(run, StructType([StructField("text", StringType()), StructField("row", rows.schema["row"].dataType)]))
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    own = {"text": F.col("text"), "n_chars": n_chars}
    return done.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find_personal_data(documents(spark, sf_dir))
    of_kind = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(of_kind, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_found"), (F.size("base") + F.size("found")).cast("long").alias("n_spans"))
