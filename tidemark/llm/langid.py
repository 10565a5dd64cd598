"""Language identification by interpolated Kneser-Ney character models, one a language.

A text is the sequence of its letter runs (Unicode category L), lower-cased; each word is read as a space, its letters and a
space, and every symbol but the first is predicted from up to ORDER - 1 symbols of the same word. The
training words of each language are counted over all labelled documents but a tenth; n-grams, continuation counts, discounts,
the totals of contexts and the discounted shares are computed in Spark from all distinct words. What tasks hold is bounded: of
each language and order the QUOTA commonest n-grams, by whole levels of count. The mass of the n-grams left out goes to
their context's back-off weight, so every distribution still adds up to one; with no more n-grams than that the model is exact.
It is stored as sorted arrays of n-gram hashes, each with the languages that have it.

A document gets the language of the lowest cross-entropy a symbol; its score is the posterior share of
that language at a fixed sharpness, between 0 and 1. It is rejected if it has no letter, or if its
cross-entropy lies too far beyond that of the language's training words, in deviations of a text of as many words. How far is
too far is calibrated on the tenth of the labelled documents that was not counted: FALSE_REJECTS of them lie beyond it, but never
less than LEAST_LIMIT deviations.

Null text, and text without letters, gives ``und`` with score 0 and is rejected. Ties go to the
language that sorts first. Without any labelled text all is ``und`` and nothing is rejected. Repeated rows are counted and
predicted each; extra columns, whatever their names, are never read, nor are lang, source or doc_id for a prediction. An empty
table gives no rows. Very long texts take memory in proportion to their words.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin, crc_fold, documents, id_crc32, pieces, written

ORDER = 4
#: N-grams of a language and order that each task holds at most.
QUOTA = 200_000
#: Entries of a task's memories of words.
MEMORY_WORDS = 400_000
#: A text counts as at most so many symbols in its score.
SHARPNESS = 40.0
#: Documents differ by so many nats a symbol however long they are.
BETWEEN = 0.125
#: The share of held-out labelled documents that rejection may cost, and the least limit in deviations.
FALSE_REJECTS, LEAST_LIMIT = 0.001, 6.0
#: One labelled document in so many is held out of the counts for calibration.
HELD_OUT = 10
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LONGEST = 200


def letter_words(text: str | None) -> list[str]:
    """The letter runs of the lower-cased text; very long runs in pieces."""
    text = (text or "").lower()
    found = _WORDS.findall(text)
    if not text.isascii() and not all(map(str.isalpha, found)):  # numerals such as Roman ones are no letters
        found = [x for w in found for x in ([w] if w.isalpha() else "".join([c if c.isalpha() else " " for c in w]).split())]
    return found if not found or max(map(len, found)) <= _LONGEST else [w[k : k + _LONGEST] for w in found for k in range(0, len(w), _LONGEST)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of ``docs``: counted in each task, then summed by Spark."""

    def run(batches):
        begin("langid")
        held: dict[str, Counter] = {}

        def flush():
            rows = [(lang, w, n) for lang, own in held.items() for w, n in own.items()]
            held.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

        for part in pieces(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(letter_words(text))
            if sum(map(len, held.values())) > MEMORY_WORDS:
                yield flush()
        if any(held.values()):
            yield flush()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_tables(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, size, gram, c): counts of the longest n-grams and of those at a word's start, continuation counts below.

    A gram that starts a word has no left neighbour, so its continuation count is its count.
    """
    padded = words.select("lang", F.concat(F.lit(" "), "word", F.lit(" ")).alias("w"), "n")
    ends = padded.select("lang", "n", "w", F.explode(F.sequence(F.lit(2), F.length("w"))).alias("end"))
    longest = ends.select("lang", F.expr(f"substring(w, greatest(end - {order - 1}, 1), least(end, {order}))").alias("gram"), "n")
    table = longest.groupBy("lang", "gram").agg(F.sum("n").alias("c"))
    tables = []
    for size in range(order, 0, -1):
        whole = table.where(F.length("gram") == size)
        tables.append(whole.select("lang", F.lit(size).alias("size"), "gram", "c"))
        if size > 1:
            below = whole.select("lang", F.expr("substring(gram, 2)").alias("gram"), F.lit(1).cast("long").alias("c"))
            table = table.where(F.length("gram") < size).union(below).groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def gram_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points; rows of one width."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        out = (out + codes[:, k].astype(np.uint64) + np.uint64(1)) * _BASE
        out ^= out >> np.uint64(31)
    return out


@dataclass
class Table:
    """Values of (hash, language) pairs: sorted distinct hashes, where each one's entries begin, and their languages and values."""

    keys: np.ndarray
    begin: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, lang: np.ndarray, value: np.ndarray) -> Table:
        order = np.argsort(hashes, kind="stable")
        keys, first = np.unique(hashes[order], return_index=True)
        return cls(keys, np.append(first, len(hashes)).astype("i4"), lang[order].astype("i2"), value[order].astype("f4"))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, language, value) of all entries of the queried hashes."""
        if not len(self.keys):
            return np.zeros(0, int), np.zeros(0, "i2"), np.zeros(0, "f4")
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        query = np.flatnonzero(self.keys[at] == keys)
        low = self.begin[at[query]]
        count = self.begin[at[query] + 1] - low
        entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(query, count), self.lang[entry], self.value[entry]


@dataclass
class Model:
    """``grams[k]``: discounted shares of (k + 1)-grams; ``contexts[k]``: back-off weights of their first k symbols, 1 if absent;
    ``floor``: the probability of any symbol below all orders; ``mean``, ``spread``: nats a symbol of the training words, and their
    deviation; ``limit``: deviations beyond which a text is rejected."""

    languages: list[str]
    grams: list[Table]
    contexts: list[Table]
    floor: float = 1e-6
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = LEAST_LIMIT

    def log_windows(self, codes: np.ndarray) -> np.ndarray:
        """(windows, languages): natural log probability of each window's last symbol; zeros stand before a word's first space."""
        order = codes.shape[1]
        p = np.full((len(codes), len(self.languages)), self.floor, "f4")
        for k, (grams, contexts) in enumerate(zip(self.grams, self.contexts, strict=True)):
            use = np.flatnonzero(codes[:, order - 1 - k])
            own = codes[use, order - 1 - k :]
            for table, times in ((contexts, True), (grams, False)):
                query, lang, value = table.find(gram_hash(own[:, :-1] if times else own))
                if times:
                    p[use[query], lang] *= value
                else:
                    p[use[query], lang] += value
        return np.log(p)

    def score_words(self, words: list[str]) -> np.ndarray:
        """(words, languages + 1): natural log probability by language, and the number of symbols.

        Every distinct window of symbols is looked up once.
        """
        if not words:
            return np.zeros((0, len(self.languages) + 1), "f4")
        order = len(self.grams)
        pad = "\0" * (order - 2)
        flat = np.frombuffer("".join([f"{pad} {w} " for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = np.array(list(map(len, words))) + 1
        starts = np.cumsum(symbols) - symbols
        at = np.arange(symbols.sum()) + np.repeat((order - 1) * np.arange(1, len(words) + 1), symbols)
        codes = np.stack([flat[at - k] for k in range(order - 1, -1, -1)], 1)
        _, first, window = np.unique(gram_hash(codes), return_index=True, return_inverse=True)
        found = self.log_windows(codes[first])
        return np.column_stack((np.add.reduceat(found[window], starts, axis=0), symbols.astype("f4")))


def model_tables(words: DataFrame, order: int = ORDER, quota: int = QUOTA) -> tuple[DataFrame, DataFrame]:
    """Shares (lang, size, gram, value) and back-off weights (lang, size, gram: the context, value) of what tasks hold.

    The discount of each order and language is n1 / (n1 + 2 n2), 0.5 if either is 0; it, and contexts' totals, are those of all n-grams.
    """
    grams = written(gram_tables(words, order).withColumn("context", F.expr("substring(gram, 1, size - 1)")))
    level = F.floor(F.log2("c") * 8).cast("int")
    of_order = grams.groupBy("lang", "size", level.alias("level")).agg(F.count("*").alias("n"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
    rows: dict[tuple[str, int], list] = {}
    for r in of_order.collect():  # a few dozen levels a language and order
        rows.setdefault((r.lang, r.size), []).append(r)
    rules = []
    for (lang, size), own in rows.items():
        n1, n2, held, least = sum(r.n1 for r in own), sum(r.n2 for r in own), 0, 1 << 30
        for r in sorted(own, key=lambda r: -r.level):
            if held + r.n > quota:
                break
            held, least = held + r.n, r.level
        rules.append((lang, size, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5, least))
    rules = F.broadcast(words.sparkSession.createDataFrame(rules, "lang string, size int, discount double, least int"))
    totals = grams.groupBy("lang", "size", "context").agg(F.sum("c").alias("total"))
    rows = grams.join(totals, ["lang", "size", "context"]).join(rules, ["lang", "size"])
    rows = rows.where(level >= F.col("least")).withColumn("value", (F.col("c") - F.col("discount")) / F.col("total"))
    kept = written(rows.select("lang", "size", "gram", "context", "value"))
    left = kept.groupBy("lang", "size", F.col("context").alias("gram")).agg((1 - F.sum("value")).alias("value"))
    return kept.select("lang", "size", "gram", "value"), left


def build(shares, left, order: int = ORDER) -> Model:
    """From pandas tables of model_tables()."""
    languages = sorted(set(shares["lang"]))
    number = {lang: k for k, lang in enumerate(languages)}

    def tables(rows, shorter: int) -> list[Table]:
        out = []
        for size in range(1, order + 1):
            own = rows[rows["size"] == size]
            codes = np.frombuffer("".join(own["gram"]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(own), size - shorter)
            out.append(Table.of(gram_hash(codes), own["lang"].map(number).to_numpy(dtype="i2"), own["value"].to_numpy()))
        return out

    return Model(languages, tables(shares, 0), tables(left, 1))


def _frame(rows: DataFrame) -> pd.DataFrame:
    """The rows on the driver by way of Arrow, without a Python object a row; equal strings are one object."""
    return rows.toArrow().to_pandas(self_destruct=True, split_blocks=True)


def train(labelled: DataFrame, order: int = ORDER, quota: int = QUOTA) -> Model | None:
    """Fit on all rows of (doc_id, text, lang) with a language and a text; the driver takes what tasks will hold."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    held_out = F.floor(crc_fold("doc_id", 3 * HELD_OUT) / 3) == 0  # independent of the remainder by 3
    words = written(word_counts(labelled.where(~held_out)))
    shares, left = model_tables(words, order, quota)
    shares = _frame(shares)
    if not len(shares):
        return None
    model = build(shares, _frame(left), order)
    del shares
    gc.collect()
    model.mean, model.spread = word_statistics(words, model)
    model.limit = calibrated_limit(labelled.where(held_out), model)
    return model


def word_statistics(words: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """By language: nats a symbol of the training words, and the deviation of a word's."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        begin("langid")
        own = shared.value
        number = {lang: i for i, lang in enumerate(own.languages)}
        sums = np.zeros((len(own.languages), 4))
        for part in pieces(batches, 20_000):
            lang = np.array([number[x] for x in part.column(0).to_pylist()])
            n = part.column(2).to_numpy()
            found = own.score_words(part.column(1).to_pylist()).astype(float)
            loss, size = -found[np.arange(len(lang)), lang], found[:, -1]
            for k, x in enumerate((n * size, n * loss, n, n * (loss / size) ** 2)):
                sums[:, k] += np.bincount(lang, weights=x, minlength=len(sums))
        yield pa.record_batch([pa.array(range(len(sums)), pa.int64()), *[pa.array(sums[:, k]) for k in range(4)]], ["i", "symbols", "loss", "words", "square"])

    mean, spread = np.zeros(len(model.languages)), np.ones(len(model.languages))
    sums = words.select("lang", "word", "n").mapInArrow(run, "i long, symbols double, loss double, words double, square double")
    for r in sums.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("symbols", "loss", "words", "square")]).collect():
        if r.words:
            mean[r.i] = r.loss / r.symbols
            spread[r.i] = max(r.square / r.words - mean[r.i] ** 2, 0.01) ** 0.5
    return mean, spread


def calibrated_limit(held_out: DataFrame, model: Model) -> float:
    """The deviations that FALSE_REJECTS of the held-out labelled texts exceed, LEAST_LIMIT at least."""
    shared = held_out.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        begin("langid")
        judge = Judge(shared.value)
        for part in pieces(batches):
            found = judge(part.column(0).to_pylist())[3]
            yield pa.record_batch([pa.array(found[np.isfinite(found)])], ["excess"])

    found = held_out.select("text").mapInArrow(run, "excess double")
    found = found.agg(F.percentile_approx("excess", 1 - FALSE_REJECTS, 100_000).alias("limit")).first()
    return max(LEAST_LIMIT, found.limit or 0.0)


class Judge:
    """Judges some texts at a time, with a bounded memory of the scores of words."""

    def __init__(self, model: Model | None):
        self.model = model
        self.known: dict[str, int] = {}
        self.table = np.empty((0, 1 + len(model.languages) if model else 1), "f4")
        self.most = min(MEMORY_WORDS, (1 << 25) // self.table.shape[1])

    def numbers(self, words: list[str]) -> list[int]:
        """Each word's row in ``table``."""
        known = self.known
        if len(known) > self.most:
            known.clear()
        new = list(set(words).difference(known))
        if new:
            used = len(known)
            scored = self.model.score_words(new)
            if used + len(scored) > len(self.table):  # grow by half at least, so that copying stays in proportion
                self.table = np.concatenate((self.table[:used], np.empty((max(len(scored), used // 2, 10_000), self.table.shape[1]), "f4")))
            self.table[used : used + len(scored)] = scored
            known.update(zip(new, range(used, used + len(new)), strict=True))
        return list(map(known.__getitem__, words))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: language, score, cross-entropy, deviations beyond the language's mean (nan without letters), whether it is rejected."""
        own, n = self.model, len(texts)
        if own is None:
            return [UNKNOWN] * n, np.zeros(n), np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, bool)
        words = [letter_words(t) for t in texts]
        sizes = np.array(list(map(len, words)))
        has = np.flatnonzero(sizes)
        score, entropy, excess = np.zeros(n), np.full(n, np.nan), np.full(n, np.nan)
        langs = np.full(n, UNKNOWN, object)
        if len(has):
            at = self.numbers([w for own_words in words for w in own_words])
            sums = np.add.reduceat(self.table[at], (np.cumsum(sizes) - sizes)[has], axis=0, dtype=float)
            loss = -sums[:, :-1] / sums[:, -1:]
            best = loss.argmin(1)
            least = loss[np.arange(len(has)), best]
            score[has] = 1 / np.exp((least[:, None] - loss) * np.minimum(sums[:, -1:], SHARPNESS)).sum(1)
            langs[has], entropy[has] = np.array(own.languages, object)[best], least
            if own.mean is not None:
                excess[has] = (least - own.mean[best]) / np.sqrt(own.spread[best] ** 2 / sizes[has] + BETWEEN**2)
        return langs.tolist(), score, entropy, excess, ~(excess <= own.limit)


def predict(docs: DataFrame, model: Model | None, fold: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected: one row a document, no exchange."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        begin("langid")
        judge = Judge(shared.value)
        for part in pieces(batches):
            langs, score, entropy, _, rejected = judge(part.column(1).to_pylist())
            held_out = [id_crc32(key) % fold == held for key in part.column(0).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(held_out), pa.array(langs, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def accept(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the rows that the model rejects; texts cross to Python and back once, no exchange."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        begin("langid")
        judge = Judge(shared.value)
        for part in pieces(batches):
            yield part.filter(pa.array(~judge(part.column("text").to_pylist())[4]))

    return docs.mapInArrow(run, docs.schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, train(docs.where(crc_fold("doc_id", 3) != 1)))
