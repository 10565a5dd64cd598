"""Order-preserving packing of token streams into sequences of at most ``window`` tokens.

The documents of an input split, in their stored order, form one token stream. A window may
end at a document's end, after a sentence, or, inside a sentence longer than ``stride``, at
every ``stride``-th token. A dynamic program over these places minimises padding plus a
penalty for each cut document or sentence plus a small charge a window. The best start of a
window that ends at a place is the least of ``cost + place`` over the places at most
``window`` before it, kept in a monotone queue; windows whose length is a power of two need
no padding and are compared apart.

Streams are packed in blocks of ``BLOCK_TOKENS``, which bounds the memory of a task. Splits
are packed independently, without an exchange, so a recomputed split gives the same rows.
Null text is empty text: such a document is its closing id alone. Repeated rows, equal or null
ids are each packed; extra columns, whatever their names, are dropped. An empty table gives no rows. A document longer than a block is
a block of its own. Which documents share a sequence depends on how the input is split.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import WordCoder, coder, default_vocabulary, forget
from .common import begin, documents, pieces

WINDOW = 2048
#: The id that closes each document.
CLOSE = 1
#: Penalties in tokens: of a window, of one that ends inside a document, inside a sentence.
PER_WINDOW, IN_DOCUMENT, IN_SENTENCE = 4, 4, 24
STRIDE = 128
BLOCK_TOKENS = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ends(own: WordCoder) -> np.ndarray:
    """Whether a token, by its id, ends a sentence: its text has nothing but .!? and ends a word."""
    ends = np.zeros(max(own.token_text) + 1, dtype=bool)
    for number, text in own.token_text.items():
        bare = text.removesuffix(own.mark)
        ends[number] = bare != text and bool(bare) and not bare.strip(".!?")
    return ends


def places(ids: np.ndarray, ends: np.ndarray, is_end: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Where a window may end, ascending and from 0, and the penalty of each place.

    ``ends``: the ends of the documents in the stream ``ids``. Every sentence end is a place.
    """
    marks = np.union1d(np.flatnonzero(is_end[ids]) + 1, ends)
    before = np.concatenate(([0], marks[:-1]))
    more = (marks - before - 1) // stride
    long = np.flatnonzero(more > 0)
    forced = np.concatenate([before[k] + stride * np.arange(1, more[k] + 1) for k in long]) if len(long) else np.empty(0, int)
    at = np.concatenate((marks, forced))
    cost = np.concatenate((np.where(np.isin(marks, ends), 0, IN_DOCUMENT), np.full(len(forced), IN_SENTENCE)))
    order = np.argsort(at, kind="stable")
    return np.concatenate(([0], at[order])), np.concatenate(([0], cost[order]))


def cut(at: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """The chosen window ends, ascending; ``at`` and ``cost`` as from places()."""
    where, price = at.tolist(), (cost + PER_WINDOW).tolist()
    # by place: the places that lie a power of two, less than a window, before it
    number = np.full(int(at[-1]) + 1, -1, "i4")
    number[at] = np.arange(len(at))
    ends, starts = [], []
    for p in (1 << k for k in range((window - 1).bit_length())):
        low = np.searchsorted(at, p)
        found = number[at[low:] - p]
        ends.append(np.flatnonzero(found >= 0) + low)
        starts.append(found[found >= 0])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    unpadded, edges = starts[order].tolist(), np.searchsorted(ends[order], np.arange(len(at) + 1)).tolist()
    best, back = [0] * len(where), [0] * len(where)
    keys, numbers, head = [0], [0], 0  # the queue: best + place, ascending, and the places' numbers
    low = 0
    for j in range(1, len(where)):
        here = where[j]
        while where[numbers[head]] < here - window:
            head += 1
        start = numbers[head]
        least = keys[head] + window - here
        high = edges[j + 1]
        if high > low:
            if least > best[start]:  # a full window has no padding to save
                for i in unpadded[low:high]:
                    if best[i] < least:
                        least, start = best[i], i
            low = high
        best[j], back[j] = least + price[j], start
        key = best[j] + here
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            numbers.pop()
        keys.append(key)
        numbers.append(j)
    out, j = [], len(where) - 1
    while j:
        out.append(where[j])
        j = back[j]
    return out[::-1]


def pack_block(keys: list, tokens: list[bytes], is_end: np.ndarray, first: int) -> pa.RecordBatch:
    """The pieces of one block; sequences are numbered from ``first``."""
    stream = b"".join(tokens)
    ids = np.frombuffer(stream, dtype="<u4")
    sizes = np.array([len(t) // 4 for t in tokens])
    ends = np.cumsum(sizes)
    cuts = np.array(cut(*places(ids, ends, is_end)))
    edges = np.concatenate(([0], np.union1d(cuts, ends)))
    begin, length = edges[:-1], np.diff(edges)
    doc, seq = np.searchsorted(ends, begin, "right"), np.searchsorted(cuts, begin, "right")
    view = memoryview(stream)
    crc = [zlib.crc32(view[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
    columns = [pa.array(keys, pa.int64()).take(pa.array(doc)), begin - (ends - sizes)[doc], length, np.array(crc, dtype="int64"), sizes[doc], first + seq, begin - np.concatenate(([0], cuts))[seq]]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a piece: a document's ``length`` ids from ``start`` on stand in a sequence at ``offset``."""
    closing = CLOSE.to_bytes(4, "little")

    def run(batches):
        begin("bpe", forget)
        own = coder(path)
        is_end = sentence_ends(own)
        first = TaskContext.get().partitionId() << 40
        keys, tokens, held = [], [], 0
        rows = (row for part in pieces(batches) for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
        for key, ids in own.encode_all(rows):
            keys.append(key)
            tokens.append(ids + closing)
            held += len(tokens[-1]) // 4
            if held >= block_tokens:
                out = pack_block(keys, tokens, is_end, first)
                first = out.column(5)[-1].as_py() + 1
                keys, tokens, held = [], [], 0
                yield out
        if keys:
            yield pack_block(keys, tokens, is_end, first)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_vocabulary())
