"""Scoring documents with a gated recurrent language model whose output softmax is factored by classes.

Words are counted over all training documents. The commonest HEAD words are put into classes by rank and
predicted as class times word in class, both from the recurrent state. Every other word belongs to one of REST
classes by its last two characters; the state predicts the class, and within it the smoothed counts decide,
with one share for all unseen words. So every token, seen or not, has a probability.

Texts are split once, into a table of their words' numbers that training and scoring read.
The network is trained by truncated backpropagation in numpy: in each round every task starts from the
common weights, follows a fixed share of its training documents (another one each round, until all have been followed),
and its weights are averaged with those of all other tasks by Spark, in proportion to their tokens. So the weights depend a
little on how the input is split. Scoring carries the state through a whole document, however long: memory is linear in the
tokens of a block, time in the longest document's steps.

Null text is empty text: it has its end token only. held_out rows are never counted or trained on. A null doc_id
counts as the empty text in the fold. Repeated rows are counted and scored each. Extra columns, whatever their names, are ignored.
Without training documents every base and model probability is 1 (the rule's limit). An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, begin, checkpoint, crc_fold, documents, id_crc32, pieces, written

#: The end token's word; no word is empty.
END = ""
STATE, HEAD, CLASS_SIZE, REST = 16, 1024, 32, 48
#: Words whose counts every task holds; the others' counts come by a join.
KNOWN = 200_000
COUNTED_AT_ONCE = 500_000
#: Rounds of training; each takes one of as many parts of the training documents, by their ids, so together they take all.
ROUNDS = SHARES = 3
LANES, STEPS, RATE = 512, 16, 0.02
SCORE_LANES, SCORE_STEPS, SCORE_TOKENS, TRAIN_TOKENS = 512, 32, 6_000_000, 1_500_000
#: Tokens after which training starts from the zero state again, so that lanes are of equal length.
SEGMENT = 512
SMOOTH = 0.1


def rest_class(word: str) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % REST


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Weights. Inputs and outputs are numbered: head words by rank, then the rest classes."""

    head: int
    inputs: np.ndarray  # (head + REST, 3 STATE)
    recur: np.ndarray  # (STATE, 3 STATE)
    to_class: np.ndarray  # (STATE, classes)
    class_bias: np.ndarray
    to_word: np.ndarray  # (head classes, STATE, CLASS_SIZE)
    word_bias: np.ndarray  # (head classes, CLASS_SIZE); -1e9 where a class has no such word

    NAMES = ("inputs", "recur", "to_class", "class_bias", "to_word", "word_bias")

    @classmethod
    def fresh(cls, head_counts: np.ndarray, rest_counts: np.ndarray, seed: int = 7) -> Network:
        """Small random weights; biases that give the training counts."""
        draw = np.random.default_rng(seed)
        head = len(head_counts)
        classes = -(-head // CLASS_SIZE)
        padded = np.zeros(classes * CLASS_SIZE)
        padded[:head] = head_counts + SMOOTH
        padded = padded.reshape(classes, CLASS_SIZE)
        mass = np.concatenate((padded.sum(1), rest_counts + SMOOTH))
        word = np.where(padded > 0, np.log(np.maximum(padded, 1e-30) / padded.sum(1, keepdims=True)), -1e9)
        small = lambda *shape: draw.normal(0, 0.08, shape).astype("f4")
        return cls(head, small(head + REST, 3 * STATE), small(STATE, 3 * STATE) * 3, small(STATE, classes + REST), np.log(mass / mass.sum()).astype("f4"), small(classes, STATE, CLASS_SIZE), word.astype("f4"))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def filled(self, values: np.ndarray) -> Network:
        out, at = {}, 0
        for n in self.NAMES:
            old = getattr(self, n)
            out[n] = values[at : at + old.size].reshape(old.shape).astype("f4")
            at += old.size
        return Network(self.head, **out)

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step from states and input rows: the new states, and what the way back needs."""
        a = h @ self.recur
        gates = _sigmoid(x[:, : 2 * STATE] + a[:, : 2 * STATE])
        z, r, a = gates[:, :STATE], gates[:, STATE:], a[:, 2 * STATE :]
        n = r * a
        n += x[:, 2 * STATE :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, a

    @staticmethod
    def _softmax(states: np.ndarray, weights: np.ndarray, target: np.ndarray, grad: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each row's target; adds to ``grad``, and gives the gradient by the states, if asked.

        ``states`` has a last column of ones, ``weights`` the bias as its last row.
        """
        p = states @ weights
        if np.abs(weights[:-1]).sum(0).max() + weights[-1].max() > 80:  # states lie between -1 and 1, so else nothing overflows
            p -= p.max(1, keepdims=True)
        at = np.arange(0, p.size, p.shape[1])
        at += target
        out = p.ravel()[at]
        np.exp(p, out=p)
        total = p @ np.ones(p.shape[1], p.dtype)
        out -= np.log(total)
        if grad is None:
            return out, None
        p *= np.reciprocal(total)[:, None]
        p.ravel()[at] -= 1
        grad += states.T @ p
        return out, p @ weights[:-1].T

    def log_probability(self, states: np.ndarray, target: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural log of the class (and, for head words, word) probabilities; adds to ``grads``."""
        heads = self.to_word.shape[0]
        states = np.column_stack((states, np.ones(len(states), "f4")))
        cls = np.where(target < self.head, target // CLASS_SIZE, heads + target - self.head).astype("i2")
        more = [None] * (heads + 1)
        if grads is not None:
            more = [np.zeros((STATE + 1, self.to_class.shape[1]), "f4"), *np.zeros((heads, STATE + 1, CLASS_SIZE), "f4")]
        out, back = self._softmax(states, np.vstack((self.to_class, self.class_bias)), cls, more[0])
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(heads + 1, dtype="i2"))
        order = order[: edges[-1]]
        s, at = states.take(order, 0), target[order] % CLASS_SIZE
        weights = np.concatenate((self.to_word, self.word_bias[:, None]), 1)
        found = np.empty(len(order), out.dtype)
        turned = np.empty((len(order), STATE), "f4")
        for c in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            mine = slice(edges[c], edges[c + 1])
            found[mine], turn = self._softmax(s[mine], weights[c], at[mine], more[c + 1])
            if turn is not None:
                turned[mine] = turn
        out[order] += found
        if grads is not None:
            back[order] += turned
            grads["states"] = back
            grads["to_class"] += more[0][:-1]
            grads["class_bias"] += more[0][-1]
            grads["to_word"] += np.stack(more[1:])[:, :-1]
            grads["word_bias"] += np.stack(more[1:])[:, -1]
        return out


def lanes(lengths: np.ndarray, count: int) -> list[list[int]]:
    """Documents dealt to lanes of nearly equal length, the longest lane first."""
    heap = [(0, k, []) for k in range(min(count, len(lengths)))]
    for doc in np.argsort(-lengths, kind="stable").tolist():
        total, k, own = heapq.heappop(heap)
        own.append(doc)
        heapq.heappush(heap, (total + int(lengths[doc]), k, own))
    return [own for _, _, own in sorted(heap, key=lambda x: (-x[0], x[1]))]


class Streams:
    """Documents laid end to end in lanes, the longest lane first, so that the lanes in use at a step are the first ones.

    Holds three numbers a token, however unequal the documents are.
    """

    def __init__(self, docs: list[np.ndarray], count: int):
        dealt = lanes(np.array([len(d) for d in docs]), count)
        self.sizes = np.array([sum(len(docs[k]) for k in own) for own in dealt])
        self.begin = np.cumsum(self.sizes) - self.sizes
        order = [k for own in dealt for k in own]
        lengths = [len(docs[k]) for k in order]
        self.tokens = np.concatenate([docs[k] for k in order])
        self.owner = np.repeat(np.array(order, "i4"), lengths)
        self.first = np.zeros(len(self.tokens), bool)
        self.first[np.cumsum(lengths) - lengths] = True
        self.steps = int(self.sizes[0])

    def windows(self, size: int):
        """For each window: the tokens' places, step after step, where each step begins among them, and whether each starts a document."""
        used = np.searchsorted(-self.sizes, -np.arange(1, self.steps + 1), "right")
        for low in range(0, self.steps, size):
            own = used[low : low + size]
            at = np.concatenate([self.begin[:n] + low + k for k, n in enumerate(own.tolist())])
            yield at, [0, *np.cumsum(own).tolist()], self.first[at]


def score_block(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each whole document of numbered tokens; states go on across windows."""
    flow = Streams(docs, SCORE_LANES)
    out, h = np.zeros(len(docs)), np.zeros((len(flow.sizes), STATE), "f4")
    for at, edges, first in flow.windows(SCORE_STEPS):
        tokens = flow.tokens[at]
        x, states = net.inputs.take(tokens, 0), np.empty((len(at), STATE), "f4")
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            h = h[: high - low]
            h[first[low:high]] = 0  # a document starts from the zero state
            states[low:high] = h
            h = net.step(h, x[low:high])[0]
        out += np.bincount(flow.owner[at], weights=net.log_probability(states, tokens), minlength=len(docs))
    return out


class Adam:
    """Moments of each weight; updates in place."""

    def __init__(self, net: Network, rate: float):
        self.m = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
        self.v = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
        self.k, self.rate = 0, rate

    def update(self, net: Network, grads: dict[str, np.ndarray], scale: float) -> None:
        self.k += 1
        size = self.rate / (1 - 0.9**self.k)
        for n, g in grads.items():
            g *= scale
            m, v = self.m[n], self.v[n]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            g *= g
            v += 0.01 * g
            np.divide(v, 1 - 0.99**self.k, out=g)
            np.sqrt(g, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= size
            weights = getattr(net, n)
            weights -= g


def window_gradients(net: Network, h: np.ndarray, tokens: np.ndarray, edges: list[int], first: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the loss of one window that is entered with states ``h``, and the states after it."""
    x, before, kept = net.inputs.take(tokens, 0), np.empty((len(tokens), STATE), "f4"), []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        h = h[: high - low]
        h[first[low:high]] = 0
        before[low:high] = h
        h, *rest = net.step(h, x[low:high])
        kept.append(rest)
    grads = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    net.log_probability(before, tokens, grads)
    out = grads.pop("states")
    back, pre, turned = np.zeros((0, STATE), "f4"), np.empty((len(tokens), 3 * STATE), "f4"), net.recur.T.copy()
    # of the input rows, and of what the states give: the last third of these is seen through the reset gate
    through = np.empty_like(pre)
    for k in range(len(kept) - 1, -1, -1):
        own = slice(edges[k], edges[k + 1])
        z, r, n, a = kept[k]
        wide = np.zeros((len(z), STATE), "f4")
        wide[: len(back)] = back
        gain = wide * z
        fresh = wide - gain
        dn = fresh * (1 - n * n)
        pre[own, :STATE] = fresh * (before[own] - n) * z
        pre[own, STATE : 2 * STATE] = dn * a * r * (1 - r)
        pre[own, 2 * STATE :] = dn
        through[own, : 2 * STATE] = pre[own, : 2 * STATE]
        through[own, 2 * STATE :] = dn * r
        back = through[own] @ turned
        back += gain
        back += out[own]
        back[first[own]] = 0
    grads["recur"] += before.T @ through
    order = np.argsort(tokens.astype("i2"), kind="stable")
    rows, starts = np.unique(tokens[order], return_index=True)
    grads["inputs"][rows] = np.add.reduceat(pre[order], starts, axis=0)
    return grads, h


def train_block(net: Network, docs: list[np.ndarray], rate: float = RATE) -> Network:
    """Truncated backpropagation over windows of STEPS tokens; states, not gradients, cross windows."""
    flow = Streams([d[k : k + SEGMENT] for d in docs for k in range(0, len(d), SEGMENT)], LANES)
    net = net.filled(net.flat())
    adam, h = Adam(net, rate), np.zeros((len(flow.sizes), STATE), "f4")
    for at, edges, first in flow.windows(STEPS):
        grads, h = window_gradients(net, h, flow.tokens[at], edges, first)
        norm = sum(float(np.vdot(g, g)) for g in grads.values()) ** 0.5 / len(at)
        adam.update(net, grads, min(1.0, 1.0 / max(norm, 1e-9)) / len(at))
    return net


@dataclass
class Lexicon:
    """Counts of the known words, their numbers, and the totals of all training words."""

    counts: dict[str, int]
    number: dict[str, int]
    tokens: int
    kinds: int
    rest_tokens: np.ndarray
    rest_kinds: np.ndarray
    net: Network | None = field(default=None)

    def prepare(self) -> None:
        """The known words' places, and by place the number and the logs of the base and in-class shares."""
        words = [*self.counts, *(() if END in self.counts else (END,))]
        head = len(self.number)
        counts = np.array([self.counts.get(w, 0) for w in words], float)
        classes = np.array([rest_class(w) for w in words])
        in_head = np.array([w in self.number for w in words])
        self.place = {w: i for i, w in enumerate(words)}
        # the last row is that of place -1, a word that isn't known: it adds nothing
        self.numbered = np.array([*(self.number.get(w, head + r) for w, r in zip(words, classes.tolist(), strict=True)), 0], "i4")
        log_base = np.log10((counts + SMOOTH) / self.base_total())
        log_rest = np.where(in_head, 0.0, np.log10((counts + SMOOTH) / self.rest_total()[classes]))
        self.values = np.vstack((np.column_stack((log_base, log_rest, counts > 0)), np.zeros(3)))
        self.rest_number = lru_cache(1 << 16)(lambda end: head + rest_class(end))

    def base_total(self) -> float:
        return self.tokens + SMOOTH * (self.kinds + 1)

    def rest_total(self) -> np.ndarray:
        return self.rest_tokens + SMOOTH * (self.rest_kinds + 1)

    def places(self, words: list[str]) -> np.ndarray:
        """Places of a document's words and its end; -1 for a word that isn't known."""
        if not hasattr(self, "place"):
            self.prepare()
        return np.fromiter(map(self.place.get, [*words, END], repeat(-1)), "i4", len(words) + 1)

    def numbers(self, words: list[str], places: np.ndarray | None = None) -> tuple[np.ndarray, list[str]]:
        """Input and output numbers of a document's words and its end, and the words that aren't known."""
        places = self.places(words) if places is None else places
        out, unknown = self.numbered[places], np.flatnonzero(places < 0)
        tail = [words[i] for i in unknown.tolist()]
        if tail:
            out[unknown] = [self.rest_number(w[-2:]) for w in tail]
        return out, tail


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows; the empty word counts the rows."""

    def run(batches):
        begin("gru")
        held: Counter = Counter()

        def flush():
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for part in pieces(batches):
            for text in part.column(0).to_pylist():
                held.update(ascii_words(text or ""))
                held[END] += 1
            if len(held) > COUNTED_AT_ONCE:
                yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rest_column(word: str):
    return (F.crc32(F.expr(f"right({word}, 2)").cast("binary")) % REST).cast("int")


def lexicon(words: DataFrame, known: int = KNOWN, head: int = HEAD) -> tuple[Lexicon, DataFrame]:
    """From (word, n): what the driver holds, and the (word, n) of all other words.

    The known words are those of the highest count levels, as many whole levels as hold ``known`` words at most.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.sum("n").alias("tokens")).collect()
    least, held = 1 << 30, 0
    for r in sorted(levels, key=lambda r: -r.level):
        if held + r.k > known:
            break
        least, held = r.level, held + r.k
    counts = {r.word: r.n for r in words.where((level >= least) | (F.col("word") == END)).collect()}
    first = sorted(set(counts) - {END}, key=lambda w: (-counts[w], w))[: head - 1]
    ranked = sorted([*first, END], key=lambda w: (-counts.get(w, 0), w))
    number = {w: i for i, w in enumerate(ranked)}
    rest_tokens, rest_kinds = np.zeros(REST), np.zeros(REST)
    for r in words.groupBy(rest_column("word").alias("r")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        rest_tokens[r.r], rest_kinds[r.r] = r.n, r.k
    for w in ranked:
        if w in counts:
            rest_tokens[rest_class(w)] -= counts[w]
            rest_kinds[rest_class(w)] -= 1
    lex = Lexicon(counts, number, sum(r.tokens for r in levels), sum(r.k for r in levels), rest_tokens, rest_kinds)
    return lex, words.where((level < least) & (F.col("word") != END))


NUMBERED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, numbers binary, tail array<string>"


def number_documents(docs: DataFrame, lex: Lexicon, fold: int = 10) -> DataFrame:
    """The numbers of each whole text's tokens, 16 bits each, and what the counts of known words give; ``tail``: the words that no task knows."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    names = [x.split()[0] for x in NUMBERED.split(", ")[:8]] + ["tail"]

    def run(batches):
        begin("gru")
        own = shared.value
        for part in pieces(batches):
            ids, rows, numbers, tails = part.column(1).to_pylist(), [], [], []
            for key, text in zip(ids, part.column(2).to_pylist(), strict=True):
                words = ascii_words(text or "")
                places = own.places(words)
                number, tail = own.numbers(words, places)
                numbers.append(number.astype("<u2").tobytes())
                tails.append(tail)
                base, within, seen = (np.ones(len(places)) @ own.values.take(places, 0)).tolist()
                rows.append((id_crc32(key) % fold == 0, len(words) + 1, int(seen), base, within))
            kinds = pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()
            yield pa.record_batch([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], pa.array(numbers, pa.binary()), pa.array(tails, pa.list_(pa.string()))], names)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(run, NUMBERED)


def fit(numbered: DataFrame, lex: Lexicon, rounds: int = ROUNDS, shares: int = SHARES) -> Network:
    """Fit on numbered training documents: one share of them a round, averaged over all tasks by Spark."""
    spark = numbered.sparkSession
    head_counts = np.array([lex.counts.get(w, 0) for w in sorted(lex.number, key=lex.number.get)], float)
    net = Network.fresh(head_counts, lex.rest_tokens)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(net)

        def run(batches, shared=shared):
            begin("gru")
            model, held, size, total = shared.value, [], 0, 0
            for part in pieces(batches):
                for x in part.column(0).to_pylist():
                    held.append(np.frombuffer(x, "<u2").astype("i4"))
                    size += len(held[-1])
                if size > TRAIN_TOKENS:
                    model, total = train_block(model, held), total + size
                    held, size = [], 0
            if held:
                model, total = train_block(model, held), total + size
            if total:
                yield pa.record_batch([pa.array([total], pa.int64()), pa.array([model.flat()], pa.list_(pa.float32()))], ["tokens", "weights"])

        part = numbered.where(crc_fold("doc_id", 10 * shares) % shares == k % shares)
        rows = part.select("numbers").mapInArrow(run, "tokens long, weights array<float>")
        summed = rows.select("tokens", F.posexplode("weights").alias("i", "w")).groupBy("i").agg((F.sum(F.col("w") * F.col("tokens")) / F.sum("tokens")).alias("w"))
        got = summed.toPandas()
        if len(got):
            values = np.empty(len(got))
            values[got["i"].to_numpy()] = got["w"].to_numpy()
            net = net.filled(values)
        shared.unpersist()
    return net


def train(docs: DataFrame, lex: Lexicon, rounds: int = ROUNDS, shares: int = SHARES) -> Network:
    """fit() on the texts of ``docs``."""
    return fit(number_documents(docs, lex), lex, rounds, shares)


def score_documents(docs: DataFrame, fold: int = 10, known: int = KNOWN, head: int = HEAD, rounds: int = ROUNDS, shares: int = SHARES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    words = checkpoint(count_words(docs.where(crc_fold("doc_id", fold) != 0)))
    lex, tail_words = lexicon(words, known, head)
    numbered = written(number_documents(docs, lex, fold))
    trained = lex.tokens > 0
    net = fit(numbered.where("not held_out"), lex, rounds, shares) if trained else None
    base_total, rest_total = lex.base_total(), lex.rest_total()
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        begin("gru")
        own, held, numbers, size = shared.value, [], [], 0

        def block():
            found = score_block(own, numbers) / math.log(10) if own else np.zeros(len(numbers))
            out, at = [], 0
            for part in held:
                part = part.drop_columns(["numbers"])
                k = part.schema.get_field_index("within")
                out.append(part.set_column(k, "score", pa.array(part.column(k).to_numpy() + found[at : at + part.num_rows])))
                at += part.num_rows
            return out

        for part in pieces(batches):
            held.append(part)
            new = [np.frombuffer(x, "<u2").astype("i4") for x in part.column("numbers").to_pylist()]
            numbers += new
            size += sum(map(len, new))
            if size >= SCORE_TOKENS:
                yield from block()
                held, numbers, size = [], [], 0
        if held:
            yield from block()

    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    scored = numbered.select(*kept, "within", "numbers").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    # the counts of the words that no task holds; a word without a count was never seen in training
    rare = numbered.select("row", F.explode("tail").alias("word"))
    rare = rare.join(tail_words, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    of_class = F.get(F.array(*[F.lit(float(x)) for x in rest_total]), rest_column("word"))
    sums = rare.groupBy("row").agg(
        F.sum(F.log10((F.col("c") + SMOOTH) / base_total)).alias("more_base"),
        F.sum(F.log10((F.col("c") + SMOOTH) / of_class)).alias("more_score"),
        F.count_if(F.col("c") > 0).alias("more_known"),
    )
    out = scored.join(sums, "row", "left")
    more = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    base = more("base_score", "more_base")
    score = more("score", "more_score") if trained else base
    return out.select("doc_id", "held_out", "n_tokens", more("n_known", "more_known").cast("long").alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op6_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
