"""Near misses are compared by their rarest values: few copies of sets, no link lost."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import minhash


def edited(seed, documents, changes):
    draw = random.Random(seed)
    base = [f"b{k}" for k in range(110)]
    out = []
    for _ in range(documents):
        own = list(base)
        for i in draw.sample(range(110), draw.choice(changes)):
            own[i] = f"w{draw.randint(0, 5000)}"
        out.append(" ".join(own))
    return out


def dealt_rows(spark, monkeypatch, texts):
    rows, real = [], minhash.meetings
    monkeypatch.setattr(minhash, "meetings", lambda tokens: rows.append(minhash.checkpoint(real(tokens))) or rows[-1])
    found = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 85)
    kept = found.where("kept").count()
    return (rows[0].count() if rows else 0), kept


def test_copies_of_sets_grow_with_the_group(spark, monkeypatch):
    """Four times as many near misses need a few copies of sets a document, far from sixteen times as many."""
    few, _ = dealt_rows(spark, monkeypatch, edited(1, 500, (2, 3, 4)))
    monkeypatch.undo()
    many, kept = dealt_rows(spark, monkeypatch, edited(1, 2000, (2, 3, 4)))
    assert 0 < few and many <= 8 * 2000 and many <= 8 * few and kept > 1500


def test_prefixes_hold_a_common_value_of_every_link():
    draw = np.random.default_rng(3)
    links = 0
    for percent in (80, 85, 100):
        for _ in range(400):
            n = int(draw.integers(1, 60))
            a = draw.choice(1000, n, replace=False)
            keep = a[draw.random(n) < draw.uniform(0.75, 1)]
            b = np.union1d(keep, draw.choice(np.arange(1000, 1100), int(draw.integers(0, 8)), replace=False))
            if not len(b):
                continue
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (n + len(b) - common):
                links += 1
                small, large = sorted((np.sort(a), np.sort(b)), key=len)
                index, probe = minhash.prefixes(len(small), percent)[0], minhash.prefixes(len(large), percent)[1]
                assert set(small[:index].tolist()) & set(large[:probe].tolist())
    assert links > 200


@pytest.mark.parametrize("block", [1, 3, 512])
def test_meetings_miss_no_pair_that_may_join(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = random.Random(block)
    rows = [(t, r, r % 7 if t % 2 else r % 3, 10, draw.random() < 0.4) for t in range(12) for r in range(25) if draw.random() < 0.6]
    tokens = spark.createDataFrame(rows, "token long, rep long, component long, n long, index boolean")
    places = minhash.meetings(tokens).groupBy("token", "lo", "hi").agg(F.collect_list(F.struct("mine", "rep")).alias("sets")).collect()
    met = set()
    for p in places:
        a, b = ([s.rep for s in p.sets if s.mine == m] for m in (0, 1))
        met |= {(p.token, *sorted((x, y))) for x in a for y in (a if p.lo == p.hi else b) if x != y}
    for t in range(12):
        own = [r for r in rows if r[0] == t]
        for x in own:
            for y in own:
                if x[1] < y[1] and x[2] != y[2] and (x[4] or y[4]):
                    assert (t, x[1], y[1]) in met
