"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A word's units are the byte characters of its UTF-8 form, the last of them in a
variant that carries the end-of-word mark. For every prefix of the units exactly one
token can be the last of the prefix's encoding: of the vocabulary's entries that are a
suffix of the prefix (found by one pass of a suffix-linked automaton), it is the one
that the last token of the remaining prefix can stand before without a merge across
their border. Back-pointers from the whole word give the exact ids; no merge is replayed.

Null text counts as empty text: no ids, empty decoded text. Repeated rows are encoded
each. Extra columns, whatever their names, are ignored by the query and kept by nothing. An empty table gives no rows. Very long texts are
encoded whole, chunk by chunk; a long run without white space takes time and memory in proportion.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import begin, documents, pieces

#: Entries of each of the two generations of a Python worker's memories of chunks and of the words in them.
MEMORY_CHUNKS, MEMORY_WORDS = 400_000, 250_000
#: Words share the work of their first units; so many beginnings are remembered.
HEAD, MEMORY_HEADS = 5, 150_000
#: Longer chunks and words are encoded anew each time.
MEMORY_CHARS = 48
PLAIN_ENDS = frozenset(".,;:!?")
#: Kinds of characters, and what an apostrophe that begins a word takes with it.
SPACE, LETTER, DIGIT, OTHER = range(4)
_SPACE = re.compile(rb"[ \t-\r]")
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Texts are encoded together up to so many characters.
TOGETHER_CHARS = 4_000_000
#: So many of their words are put at their places at a time.
SIDE_BY_SIDE = 1 << 18
#: Places of the memory of pair tests, a power of two.
MEMORY_PAIRS = 1 << 19
#: Moves a unit to its end-of-word variant, beyond all byte characters.
_END = 0x1000
_NEVER = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in set(own) else next(rest)) for b in range(256)]


@lru_cache(1)
def kinds() -> np.ndarray:
    """Of each code point: white space, letter, digit or other, as the pre-tokenizer's pattern has them."""
    every, out = "".join(map(chr, range(0x110000))), np.full(0x110000, OTHER, "u1")
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            out[found.start() : found.end()] = kind
    return out


def word_array(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """Where the words of a text in UTF-8 begin, and the words: what the pre-tokenizer's pattern finds one by one."""
    raw, table = np.frombuffer(data, "u1"), kinds()
    kind, wide = table[:256][raw], raw >= 0x80
    if wide.any():  # all bytes of a character have its kind
        high = raw[wide]
        lead = high[high >= 0xC0]
        kind[wide] = np.repeat(table[np.frombuffer(high.tobytes().decode().encode("utf-32-le"), "<u4")], 2 + (lead >= 0xE0) + (lead >= 0xF0))
    starts = np.empty(len(raw), bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts |= (kind == DIGIT) & (raw & 0xC0 != 0x80)  # digits are words of their own
    quotes = np.flatnonzero(starts & (raw == ord("'")))
    for end in ENDINGS:
        here = quotes[quotes + len(end) < len(raw)]
        for k, letter in enumerate(end, 1):
            here = here[raw[here + k] == letter]
        starts[here + 1] = False
        after = here + 1 + len(end)
        starts[after[after < len(raw)]] = True
    at = np.flatnonzero(starts)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw))), pa.py_buffer(data))
    real = kind[at] != SPACE
    return at[real], words.filter(pa.array(real))


def slices(plain: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of little more than ``most`` bytes, cut at white space."""
    low = 0
    while len(plain) - low > most and (space := _SPACE.search(plain, low + most)):
        yield plain[low : space.start()]
        low = space.start()
    yield plain[low:] if low else plain


class Memory:
    """The last results of a function of a string, in two generations of bounded size."""

    def __init__(self, compute: Callable[[str], bytes], most: int):
        self.compute, self.most = compute, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, key: str) -> bytes:
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.compute(key)
            if len(key) <= MEMORY_CHARS:
                if len(self.young) >= self.most:
                    self.old, self.young = self.young, {}
                self.young[key] = got
        return got

    def known(self, key: str) -> bytes | None:
        return self.young.get(key) or self.old.get(key)

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class SuffixAutomaton:
    """States of the vocabulary's entries read unit by unit, linked to the longest suffix that is a state too.

    ``found[state]``: (entry, length) of every entry that ends there, the longest first. Links that were followed are remembered as
    steps of their own, REMEMBERED of them at most.
    """

    REMEMBERED = 400_000

    def __init__(self, entries: Iterable[tuple[str, int]]):
        self.next: list[dict[str, int]] = [{}]
        self.found: list[tuple[tuple[int, int], ...]] = [()]
        for units, number in entries:
            state = 0
            for unit in units:
                state = self.next[state].setdefault(unit, len(self.next))
                if state == len(self.next):
                    self.next.append({})
                    self.found.append(())
            self.found[state] = ((number, len(units)),)
        self.link, self.left = [0] * len(self.next), self.REMEMBERED
        row = list(self.next[0].values())
        while row:  # state by state, the shorter first
            below = []
            for state in row:
                for unit, after in self.next[state].items():
                    link = self.link[after] = self.follow(self.link[state], unit)
                    self.found[after] += self.found[link]
                    below.append(after)
            row = below

    def follow(self, state: int, unit: str) -> int:
        """The state after ``unit`` by way of the links."""
        while unit not in self.next[state]:
            if not state:
                return 0
            state = self.link[state]
        return self.next[state][unit]

    def step(self, state: int, unit: str) -> int:
        """follow(), remembered."""
        after = self.follow(state, unit)
        if self.left:
            self.left -= 1
            self.next[state][unit] = after
        return after


class WordArrays:
    """The automaton as sorted arrays, by which the prefixes of many words are encoded side by side, a unit of all words at a time."""

    UNITS = 1 << 13

    def __init__(self, automaton: SuffixAutomaton, fits: Callable[[int, int], bool]):
        steps = sorted((state * self.UNITS + ord(unit), after) for state, own in enumerate(automaton.next) for unit, after in own.items())
        self.steps, self.after = (np.array(c) for c in zip(*steps, strict=True))
        self.link = np.array(automaton.link)
        self.first = np.concatenate(([0], np.cumsum(list(map(len, automaton.found)))))
        self.token, self.length = (np.array(c) for c in zip(*[x for own in automaton.found for x in own], strict=True))
        self.fits, self.pairs, self.fit = fits, np.full(MEMORY_PAIRS, -1), np.zeros(MEMORY_PAIRS, bool)

    def fits_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pair test of each two tokens; each place of the memory has the last pair that fell there."""
        pair = left << 32 | right
        place = (left * 40503 + right * 2654435761 >> 7) & (MEMORY_PAIRS - 1)
        new, held = np.flatnonzero(self.pairs[place] != pair), self.fit[place]
        if len(new):
            own, back = np.unique(pair[new], return_inverse=True)
            found = np.array([self.fits(x >> 32, x & 0xFFFFFFFF) for x in own.tolist()])[back]
            held[new] = found
            self.pairs[place[new]] = pair[new]
            # of two pairs for one place only one is kept, and its own result with it
            kept = self.pairs[place[new]] == pair[new]
            self.fit[place[new][kept]] = found[kept]
        return held

    def step(self, state: np.ndarray, unit: np.ndarray) -> np.ndarray:
        out, state, todo = np.zeros_like(state), state.copy(), np.arange(len(state))
        while len(todo):
            key = state[todo] * self.UNITS + unit[todo]
            at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            there = self.steps[at] == key
            out[todo[there]] = self.after[at[there]]
            todo = todo[~there]
            todo = todo[state[todo] > 0]
            state[todo] = self.link[state[todo]]
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word, given as units, as little-endian 32-bit integers."""
        sizes = np.array(list(map(len, words)))
        order = np.argsort(-sizes, kind="stable")
        sizes, longest = sizes[order], int(sizes.max())
        units = np.frombuffer("".join([words[i].ljust(longest, "\0") for i in order.tolist()]).encode("utf-32-le"), "<u4").reshape(len(words), longest).astype(int)
        last, size = np.full((len(words), longest + 1), -1), np.zeros((len(words), longest + 1), int)
        state = np.zeros(len(words), int)
        for end in range(1, longest + 1):
            n = int(np.searchsorted(-sizes, -end, "right"))  # words that are as long
            state = self.step(state[:n], units[:n, end - 1])
            at, stop, todo = self.first[state], self.first[state + 1], np.arange(n)
            while len(todo := todo[at[todo] < stop[todo]]):
                token, length = self.token[at[todo]], self.length[at[todo]]
                before = last[todo, end - length]
                fit = length == end
                test = np.flatnonzero(~fit & (before >= 0))
                fit[test] = self.fits_all(before[test], token[test])
                last[todo[fit], end], size[todo[fit], end] = token[fit], length[fit]
                todo = todo[~fit]
                at[todo] += 1
        found, row, at = [], np.arange(len(words)), sizes.copy()
        while len(row):
            if not size[row, at].all():
                raise ValueError("the vocabulary lacks a unit")
            found.append((row, last[row, at]))
            at = at - size[row, at]
            row, at = row[at > 0], at[at > 0]
        rows, ids = np.concatenate([r for r, _ in found[::-1]]), np.concatenate([i for _, i in found[::-1]])
        stream = ids[np.argsort(rows, kind="stable")].astype("<u4").tobytes()
        edges = [0, *(4 * np.cumsum(np.bincount(rows, minlength=len(words)))).tolist()]
        out = [b""] * len(words)
        for k, i in enumerate(order.tolist()):
            out[i] = stream[edges[k] : edges[k + 1]]
        return out


class WordCoder:
    """Encodes words of one vocabulary file. Holds no more than the file and bounded memories of chunks, words and pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model = stored["model"]
        self.mark = model["end_of_word_suffix"] or ""
        self.token_text: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.token_text |= {i: t for t, i in self.special.items()}
        vocabulary = model["vocab"]
        self.made_at = dict.fromkeys(vocabulary.values(), -1)  # rank of the merge that makes a token
        self.halves: dict[int, tuple[int, int]] = {}
        self.pair_rank: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair = vocabulary[left], vocabulary[right]
            whole = vocabulary[left + right]
            self.pair_rank[pair] = rank
            if whole not in self.halves:
                self.halves[whole] = pair
                self.made_at[whole] = rank
        special = set(self.special.values())
        entries = ((self.units(t[: -len(self.mark)]) if self.mark and t.endswith(self.mark) and t != self.mark else t, n) for t, n in vocabulary.items() if n not in special)
        self.automaton = SuffixAutomaton(entries)
        self.arrays = WordArrays(self.automaton, self._fits)
        self.byte_text = byte_characters()
        self.fits = lru_cache(1 << 18)(self._fits)
        self._spines: tuple[dict[int, list[int]], dict[int, list[int]]] = {}, {}
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token_bytes = {i: int(i).to_bytes(4, "little") for i in self.token_text}
        self._words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.heads: dict[str, tuple[tuple[int, ...], tuple[int, ...], int]] = {}
        self.word = Memory(self._word, MEMORY_WORDS)
        self.chunk = Memory(self._chunk, MEMORY_CHUNKS)

    @staticmethod
    def units(characters: str) -> str:
        return characters[:-1] + chr(ord(characters[-1]) + _END)

    def _spine(self, token: int, side: int) -> list[int]:
        """The pieces of ``token`` at its left (0) or right (1) border, in the order of their making."""
        out = self._spines[side].get(token)
        if out is None:
            below = [] if token not in self.halves else self._spine(self.halves[token][side], side)
            out = self._spines[side][token] = [*below, token]
        return out

    def _fits(self, left: int, right: int) -> bool:
        """Whether the text of two adjacent tokens is encoded as just these two.

        Both are built piece by piece. In between, the pieces that touch the border would be
        merged if that merge ranks before the next one on either side; equal ranks go left first.
        """
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            next_a = self.made_at[a[i + 1]] if i + 1 < len(a) else _NEVER
            next_b = self.made_at[b[j + 1]] if j + 1 < len(b) else _NEVER
            across = self.pair_rank.get((a[i], b[j]), _NEVER)
            if across < next_a and across <= next_b and across != _NEVER:
                return False
            if next_a == next_b == _NEVER:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def encode_units(self, units: str) -> list[int]:
        """Ids of one word given as units."""
        n, head = len(units), units[:HEAD]
        begun = self.heads.get(head) if n > HEAD else None
        if begun is None:
            last, size, state = [-1], [0], 0
        else:
            last, size, state = [*begun[0]], [*begun[1]], begun[2]
        fits, after, found, step = self.fits, self.automaton.next, self.automaton.found, self.automaton.step
        for end in range(len(last), n + 1):
            unit = units[end - 1]
            known = after[state].get(unit)
            state = step(state, unit) if known is None else known
            for token, length in found[state]:
                before = end - length
                if not before or last[before] >= 0 and fits(last[before], token):
                    last.append(token)
                    size.append(length)
                    break  # this prefix has its last token, there is no other
            else:
                last.append(-1)
                size.append(0)
            if end == HEAD and n > HEAD:
                if len(self.heads) >= MEMORY_HEADS:
                    self.heads.clear()
                self.heads[head] = tuple(last), tuple(size), state
        out, at = [], len(units)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def units_of(self, word: str) -> str:
        return self.units(word if word.isascii() and word.isprintable() else "".join([self.byte_text[b] for b in word.encode()]))

    def _word(self, word: str) -> bytes:
        return b"".join([self.token_bytes[i] for i in self.encode_units(self.units_of(word))])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk without white space as little-endian 32-bit integers."""
        if chunk.isalpha():
            return self.word(chunk)
        if chunk[-1] in PLAIN_ENDS and chunk[:-1].isalpha():  # what the pattern below would find
            return self.word(chunk[:-1]) + self.word(chunk[-1])
        return b"".join(map(self.word, self._words.findall(chunk)))

    def parts(self, text: str) -> list[str]:
        """A text's special tokens, at odd places, and what stands between them."""
        return self._split.split(text) if self._split and "<" in text else [text]

    @staticmethod
    def plain(part: str) -> str:
        return (part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")).lower()

    def chunks(self, plain: str) -> list[str]:
        """No word of the pre-tokenizer spans white space, so chunks are encoded one by one."""
        # split() also cuts at the four separators, which are words here
        return self._words.findall(plain) if any(c in plain for c in "\x1c\x1d\x1e\x1f") else plain.split()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        found: list[bytes] = []
        for k, part in enumerate(self.parts(text or "")):
            if k % 2:
                found.append(self.token_bytes[self.special[part]])
            else:
                chunk = self.chunk
                known = chunk.young.get  # a generation that ends meanwhile is still true
                found += [known(w) or chunk(w) for w in self.chunks(self.plain(part))]
        return b"".join(found)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of these different words. Those that are not remembered are encoded side by side; very long ones are left to
        encode_units()."""
        found = list(map(self.word.known, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        short = [k for k in new if len(words[k]) <= MEMORY_CHARS]
        if short:
            for k, ids in zip(short, self.arrays.encode([self.units_of(words[k]) for k in short]), strict=True):
                found[k] = ids
                self.word.put(words[k], ids)
        for k in new:
            if found[k] is None:
                found[k] = self.word(words[k])
        return found

    def encode_all(self, rows: Iterable[tuple[object, str | None]]) -> Iterator[tuple[object, bytes]]:
        """Of rows of a key and a text: the key and encode() of the text. The words of several texts are cut by numpy and their different
        ones found by Arrow, so that Python handles each word once; its ids are then put at all its places."""
        keys, held, chars = [], [], 0
        for key, text in rows:
            keys.append(key)
            held.append(text or "")
            chars += len(held[-1])
            if chars >= TOGETHER_CHARS:
                yield from zip(keys, self._together(held), strict=True)
                keys, held, chars = [], [], 0
        yield from zip(keys, self._together(held), strict=True)

    def _together(self, texts: list[str]) -> list[bytes]:
        plain, special, edges = [], {}, [0]
        for text in texts:
            for k, part in enumerate(self.parts(text)):
                if k % 2:
                    special[len(plain)] = self.token_bytes[self.special[part]]
                    plain.append(b"")
                else:
                    plain += slices(self.plain(part).encode(), TOGETHER_CHARS)
            edges.append(len(plain))
        found: list[bytes] = []
        held, size = [], 0
        for part in plain:  # a very long text is many of them
            held.append(part)
            size += len(part)
            if size >= TOGETHER_CHARS:
                found += self._side_by_side(held)
                held, size = [], 0
        if held:
            found += self._side_by_side(held)
        for k, ids in special.items():
            found[k] = ids
        return [found[a] if b - a == 1 else b"".join(found[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _side_by_side(self, plain: list[bytes]) -> list[bytes]:
        data = b"\n".join([*plain, b""])  # white space parts the words of one text from the next one's
        at, words = word_array(data)
        words = words.dictionary_encode()
        ids = self.encode_words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.array(list(map(len, ids)), "i4") // 4
        table, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes, dtype=int) - sizes
        own, ends = words.indices.to_numpy(), np.zeros(len(at) + 1, int)
        np.cumsum(sizes[own], out=ends[1:])
        stream = bytearray(4 * int(ends[-1]))
        ids_at = np.frombuffer(stream, "<u4")
        for low in range(0, len(own), SIDE_BY_SIDE):  # a few words at a time need little memory
            here = own[low : low + SIDE_BY_SIDE]
            begin, end = ends[low], ends[low + len(here)]
            ids_at[begin:end] = table[np.repeat(first[here] - ends[low : low + len(here)], sizes[here]) + np.arange(begin, end)]
        to = (4 * ends[np.searchsorted(at, np.cumsum([0, *[len(p) + 1 for p in plain]]))]).tolist()
        view = memoryview(stream)
        return [bytes(view[a:b]) for a, b in zip(to[:-1], to[1:], strict=True)]

    def encode_ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype="<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' texts joined by spaces: the vocabulary file names no decoder."""
        return " ".join(map(self.token_text.__getitem__, ids))


@lru_cache(2)
def coder(path: str) -> WordCoder:
    """One coder a worker process and file; the garbage collector passes over its states."""
    made = WordCoder(path)
    gc.freeze()
    return made


def forget() -> None:
    """Let the coders go: they refer to themselves, so the collector must see them again to free them."""
    coder.cache_clear()
    gc.unfreeze()


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ids array<int> and decoded string of every whole text."""

    def run(batches):
        begin("bpe", forget)
        own = coder(path)
        for part in pieces(batches):
            found = [own.encode_ids(t).astype("int32") for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(found, pa.list_(pa.int32())), pa.array([own.decode(x.tolist()) for x in found], pa.string())], ["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and the decoded text of every whole text: one row a document, no exchange."""

    def run(batches):
        begin("bpe", forget)
        own, sha = coder(path), hashlib.sha256
        for part in pieces(batches):
            n, a, b = [], [], []
            for text in part.column(1).to_pylist():
                ids = own.encode(text)
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(own.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(documents(spark, sf_dir), default_vocabulary())
