"""Collocations against plain Python: nulls, ties, repeated rows, very long texts, clashing columns, runs beyond memory."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least, top):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, tuple(words[k : k + size])) for k in range(len(words) - size + 1))
    out = {}
    able = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    for (lang, p), a in able.items():
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: B023, E731
        if not any(x == lang and 100 * b >= 80 * a and inside(q) for (x, q), b in able.items()):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def table(seed):
    draw = random.Random(seed)
    words = ["the", "The", "of", "river", "ünder", "stone", "x y", "\u000bq", "𝔘", "￮", "é"]
    text = lambda n: "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", " \t ", ", ", ".", "\r\n"]) for _ in range(n))
    rows = [(k, text(draw.choice([0, 1, 5, 40])), draw.choice(["en", "de", None, "und"])) for k in range(120)]
    rows += [(200, None, "en"), (201, None, None), (202, "", "fr"), (203, " \t ,;", "fr"), (204, text(6000), "en"), (205, "go " * 500, "de"), (None, "the river", None), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize(("least", "top"), [(3, 2000), (2, 7)])
def test_collocations_equal_plain_counts(spark, monkeypatch, least, top):
    rows = table(least)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("piece", "m", "gram", "n", "bucket", "level", "rank", "words")})
    got = phrases.collocations(docs, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, top)


def test_nothing_to_count(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, ",.", "en")], SCHEMA)).count() == 0


def test_runs_in_small_chunks_are_the_same(monkeypatch):
    """Runs of one chunk or of many add up alike, also when duckdb spills; no frequent run is lost by the bit table."""
    draw = random.Random(5)
    piece = [" ".join(str(draw.randint(0, 3000)) for _ in range(draw.randint(1, 9))) for _ in range(20_000)]
    m = np.array([draw.randint(1, 5) for _ in piece])
    lang = pa.array(["a" if k % 3 else "b" for k in range(len(piece))])
    whole, hashes = phrases.runs(lang, pa.array(piece), m, 1, None)
    want = Counter()
    for x, p, k in zip(lang.to_pylist(), piece, m.tolist(), strict=True):
        for w in p.split():
            want[x, w] += k
    held = Counter({(r["lang"], r["gram"]): r["n"] for r in whole.to_pylist()})
    assert held == want and (phrases.run_hashes(whole.column(0), whole.column(1), 1) == hashes).all()
    monkeypatch.setattr(phrases, "BUCKET_MEMORY", "16MB")
    parts = [phrases.runs(lang[k : k + 500], pa.array(piece[k : k + 500]), m[k : k + 500], 1, None)[0] for k in range(0, len(piece), 500)]
    got = Counter({(r["lang"], r["gram"]): r["n"] for part in phrases.summed(iter(parts), 30) for r in pa.record_batch(part).to_pylist()})
    assert got == Counter({k: v for k, v in want.items() if v >= 30}) and len(got) > 1000


def test_scores_beyond_64_bits(spark):
    big = 6 * 10**12
    rows = [("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 1)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, words int, gram string, n long")).first()
    assert got.score == 2_000_000 * (big - 1) // (2 * big + 7) and (got.l, got.r) == (big, big + 7)
