"""The corpus operators against plain Python on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, components, gru, langid, linededup, media, minhash, packing, pii, warc, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = "the of and river stone light under never small green house water cloud seven metal".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "ing", "ed", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " ", "a", "one two", "x" * 5000, prose(1, 200), prose(1, 200), prose(2, 60) + "\nline b\nline c\nline d", "q\n" + prose(2, 60) + "\nline b\nline c\nline d\nend", prose(3, 90), prose(3, 90) + " more", "Ünï 中文 ÇA <|endoftext|> é", "a\nb\na\nb\na\nb\na"]
    rows = [(k, t, "en" if k % 2 else None, "s", len(t or ""), "e") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id", "en", None, 5, None), rows[6]], SCHEMA)


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_empty_tables(spark, docs):
    none = docs.where("doc_id = -1")
    path = bpe.default_vocabulary()
    for found in (winnowing.compare_neighbours(none), pii.find_personal_data(none), media.store_texts(none), bpe.digest_documents(none, path), packing.pack_documents(none, path), gru.score_documents(none), langid.predict(none, langid.train(none)), linededup.dedup_lines(none), minhash.near_duplicates(none)):
        assert found.count() == 0


def test_winnowing_minimum(spark):
    texts = ["", "!!", "a b", prose(5, 80), "go " * 60]
    rows = winnowing.with_fingerprint(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), "text", "fp").orderBy("k").collect()
    assert [len(r.fp) for r in rows[:3]] == [0, 1, 1]
    # the rightmost of equal minima: in a text of one word every window of equal hashes keeps its last
    assert [x.position for x in rows[4].fp] == list(range(winnowing.WINDOW - 1, 60 - winnowing.GRAM + 1))
    tokens = re.findall(r"[^\W_]{1,12}", texts[3].lower())
    hashed = dict((r.w, r.h) for r in spark.createDataFrame([(w,) for w in set(tokens)], "w string").select("w", F.xxhash64("w").alias("h")).collect())
    turn = lambda x, k: ((x << k) | (x >> (64 - k))) & (2**64 - 1)
    grams = []
    for k in range(len(tokens) - winnowing.GRAM + 1):
        h = 0
        for w in tokens[k : k + winnowing.GRAM]:
            h = turn(h, 1) ^ (hashed[w] & (2**64 - 1))
        grams.append(h)
    key = lambda k: ((grams[k] << 26) % 2**64 + 2**63) % 2**64 - k
    chosen = sorted({min(range(s, s + winnowing.WINDOW), key=key) for s in range(len(grams) - winnowing.WINDOW + 1)})
    assert [(x.hash % 2**64, x.position) for x in rows[3].fp] == [(grams[k], k) for k in chosen]


def test_winnowing_without_separators(spark):
    """Texts in one run keep most of their fingerprint when they start a few letters later."""
    draw = random.Random(11)
    runs = ["".join(draw.choice(letters) for _ in range(3000)) for letters in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "0123456789abcdef", "".join(map(chr, range(0x4E00, 0x4E80))), "".join(map(chr, range(0x430, 0x450))))]
    rows = [(2 * k + j, t[j * 7 :]) for k, t in enumerate(runs) for j in range(2)]
    df = winnowing.with_fingerprint(spark.createDataFrame(rows, "k int, text string"), "text", "fp")
    got = {r.k: {x.hash for x in r.fp} for r in df.collect()}
    for k in range(len(runs)):
        assert len(got[2 * k] & got[2 * k + 1]) > 0.9 * len(got[2 * k]) > 10


def test_winnowing_likeness_by_brute_force(spark):
    texts = {k: prose(70 + k // 2, 40 + k) for k in range(12)} | {20: "", 21: "!!", 22: "a b"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    plain = {r.text: {x.hash for x in r.fp} for r in winnowing.with_fingerprint(spark.createDataFrame([(t,) for t in {*texts.values(), *(edited(texts, k) for k in texts)}], "text string"), "text", "fp").collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    ids = sorted(texts, reverse=True)
    for r in winnowing.compare_neighbours(rows, 3).collect():
        own, after = plain[texts[r.doc_id]], plain[texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]]
        assert r.near_next == pytest.approx(like(own, after)) and r.near_edited == pytest.approx(like(own, plain[edited(texts, r.doc_id)]))
        chosen = {int(x.split(":")[0], 16) for x in r.edited_fingerprint.split(",") if x}
        assert chosen == {h % 2**64 for h in plain[edited(texts, r.doc_id)]}


def edited(texts, key):
    ids = sorted(texts, reverse=True)
    own, after = texts[key], texts[ids[(ids.index(key) + 1) % len(ids)]]
    return own[: len(own) - len(own) // 2] + after[: len(own) // 2]


@pytest.mark.parametrize("parts", [1, 4])
def test_winnowing_neighbours(spark, docs, parts):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in winnowing.compare_neighbours(rows, parts).collect()}
    texts = sorted(plain(rows), reverse=True)
    for (k, t), (_, after) in zip(texts, [*texts[1:], texts[0]], strict=True):
        half = len(t) // 2
        assert got[k].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    assert got[7].near_next == 1.0 and got[6].fingerprint == got[7].fingerprint
    assert winnowing.compare_neighbours(docs, parts).count() == docs.count()


def test_base_spans_match_the_plain_forms():
    forms = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
    draw = random.Random(3)
    for _ in range(5000):
        text = "".join(draw.choice("a@.b-1 2+3().9%_0") for _ in range(draw.randint(0, 60)))
        want = []
        for k, form in enumerate(forms):
            for m in re.finditer(form, text):
                digits = re.sub(r"\D", "", m[0])
                if k == 0 or k == 1 and all(int(p) < 256 for p in m[0].split(".")) or k == 2 and 16 <= len(digits) <= 19 and pii.luhn(digits) or k == 3 and 8 <= len(digits) <= 15:
                    want.append((k, *m.span()))
        assert sorted(pii.base_spans(text)) == want
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    pii.base_spans("a" * 300_000 + "@" + "1" * 300_000 + "1." * 100_000)  # linear in the text


def test_patterns_discover_identifiers(spark):
    texts = [f"please mail us at user{k}@site{k}.example.org today" for k in range(8)]
    texts += ["please mail us at bob99887@intranet today", "we saw 1234567 of them", None, ""]
    rows = spark.createDataFrame([(k, t, "en", "s", 0, "e") for k, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r.found for r in pii.find_personal_data(rows).collect()}
    assert [(s.kind, texts[8][s.start : s.end]) for s in found[8]] == [(0, "bob99887@intranet")]
    assert all(not found[k] for k in found if k != 8)
    cleaned = {r.doc_id: r for r in pii.redact(rows).collect()}
    assert cleaned[8].text == "please mail us at <EMAIL> today" and cleaned[8].n_chars == len(cleaned[8].text)
    assert cleaned[9].text == texts[9] and cleaned[10].text is None and cleaned[0].extra == "e"


def test_patterns_discover_grouped_digits_and_chains(spark):
    texts = [f"please call me on +1 838 555 {7100 + k} now" for k in range(12)]
    wanted = ["838 555 7235", "(838) 555-7236", "4111 1111 1111 1112", "user@" + "x" * 80]
    texts += [f"please call me on {w} now" for w in wanted]
    sizes = [64, 32, 16, 8, 4]  # each context holds the values of two links of the chain; the first ones are seeds
    link = [[f"u{c}x{k}@site.example.org" if c == 0 else f"u{c}x{k}@intranet" for k in range(n)] for c, n in enumerate(sizes)]
    for c, word in enumerate("abcd"):
        texts += [f"xx{word} yy{word} {v} zz{word}" for v in link[c] + link[c + 1]]
    rows = spark.createDataFrame([(k, t, "en", "s", 0, "e") for k, t in enumerate(texts)], SCHEMA)
    found = {texts[r.doc_id][s.start : s.end] for r in pii.find_personal_data(rows).collect() for s in r.found}
    assert set(wanted) <= found and set(link[3]) <= found and set(link[4]) <= found


def plain_labels(scanned):
    """The pattern-instance graph scored by plain loops: value -> (kind, score) of the values that are no seeds."""
    seeds, edges = {}, {}
    for row in scanned:
        for r in row.runs:
            edges.setdefault(r.value, set()).update(r.patterns)
            if r.kind is not None:
                seeds[r.value] = min(r.kind, seeds.get(r.value, 9))
    held = Counter(p for own in edges.values() for p in own)
    labels, before = {v: (k, 1.0) for v, k in seeds.items()}, None
    while True:
        own, n = Counter(), Counter()
        for v, (k, score) in labels.items():
            for p in edges.get(v, ()):
                own[p, k] += score
                n[p] += 1
        total = Counter()
        for (p, _), x in own.items():
            total[p] += x
        share = {(p, k): x / (total[p] + pii.UNKNOWN_SHARE * (held[p] - n[p]) + pii.PRIOR) for (p, k), x in own.items() if held[p] > pii.LEAST_SEEDS and x >= pii.LEAST_SEEDS}
        best = {}
        for v, own_patterns in edges.items():
            for k in range(4):
                trusted = [p for p in own_patterns if share.get((p, k), 0) >= pii.LEAST_SHARE]
                score = 1 - math.prod(max(1 - share[p, k], 1e-9) for p in trusted)
                if v not in seeds and any(not p.startswith("f ") for p in trusted) and score >= pii.LEAST_SCORE and labels.get(v, (k,))[0] == k and score > best.get(v, (0, 0))[1] + 1e-12:
                    best[v] = (k, max(score, labels.get(v, (k, 0.0))[1]))
        labels = {**{v: x for v, x in labels.items() if v not in best}, **best}
        now = len(labels), sum(x for _, x in labels.values())
        if before and now[0] == before[0] and now[1] - before[1] <= pii.LEAST_GAIN * now[0]:
            return {v: x for v, x in labels.items() if v not in seeds}
        before = now


def test_pattern_scores_are_those_of_plain_loops(spark):
    draw, texts = random.Random(12), []
    makers = (lambda: f"a{draw.randrange(99)}@b{draw.randrange(9)}.org", lambda: ".".join(str(draw.randrange(256)) for _ in range(4)), lambda: "".join(draw.choice("0123456789") for _ in range(16)), lambda: f"+1 ({draw.randrange(1000):03}) 555-{draw.randrange(10000):04}", lambda: f"id{draw.randrange(10**7)}", lambda: f"x{draw.randrange(99)}@local")
    for _ in range(400):
        k = draw.randrange(6)
        context = draw.choice(["write to", "from host", "card no", "call me", "so that"]) if draw.random() < 0.3 else ("write to", "from host", "card no", "call me", "card no", "write to")[k]
        texts.append(f"we {context} {makers[k]()} {draw.choice(WORDS)}")
    texts += ["", None, "no data", "4111111111111111 " * 3]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    scanned = pii.scan(rows).cache()
    want = plain_labels(scanned.collect())
    got = {r.value: (r.kind, r.score) for r in pii.label_values(scanned).collect()}
    assert len(want) > 10 and len({k for k, _ in want.values()}) > 1
    assert got.keys() == want.keys()
    assert all(got[v][0] == want[v][0] and got[v][1] == pytest.approx(want[v][1], abs=1e-9) for v in want)
    spans = {r.doc_id: r.found for r in pii.find_personal_data(rows).collect()}
    assert {texts[k][s.start : s.end].lower() for k, found in spans.items() for s in found} == set(want)


def test_contexts_find_planted_identifiers_among_decoys(spark):
    """Ten contexts, each with a few seeds and planted identifiers of other forms; as many decoys of the same forms elsewhere, of which the form alone says nothing."""
    draw = random.Random(21)
    contexts = [f"{a} {b}" for a, b in zip("reach dial ring contact mobile line desk agent support help".split(), "me us him at number direct phone via team now".split(), strict=True)]
    elsewhere = ["order no", "part code", "lot id", "serial is", "invoice of", "total was", "batch ref", "page of", "build tag", "case nr"]
    makers = [lambda: f"{draw.randrange(100, 1000)} {draw.randrange(100, 1000)} {draw.randrange(1000, 10000)}", lambda: f"{draw.randrange(100, 1000)}-{draw.randrange(1000, 10000)}", lambda: f"({draw.randrange(100, 1000)}) {draw.randrange(100, 1000)}-{draw.randrange(1000, 10000)}"]
    seeds = [(f"we {c} +1 {draw.randrange(100, 1000)} 555 {draw.randrange(1000, 10000)} {draw.choice(WORDS)}", None) for c in contexts for _ in range(12)]
    planted = [(c, draw.choice(makers)()) for c in contexts for _ in range(12)]
    decoys = [(c, draw.choice(makers)()) for c in elsewhere for _ in range(12)]
    texts = [t for t, _ in seeds] + [f"we {c} {v} {draw.choice(WORDS)}" for c, v in planted + decoys]
    draw.shuffle(texts)
    found = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {texts[r.doc_id][s.start : s.end] for r in found for s in r.found}
    right = got & {v for _, v in planted}
    assert len(right) >= 0.9 * len({v for _, v in planted}) and len(right) >= 0.9 * len(got)


def test_nothing_to_label(spark):
    rows = spark.createDataFrame([(1, "no data"), (2, None), (3, "order 1234567 of 7654321")], "doc_id long, text string")
    assert [r.found for r in pii.find_personal_data(rows).collect()] == [[], [], []]
    assert pii.redact(rows.withColumn("n_chars", F.lit(0).cast("long"))).select("text").collect()[2].text == "order 1234567 of 7654321"


def test_media(spark, docs):
    for r in media.store_texts(docs).collect():
        if r.doc_id is None:
            continue
        raw = dict(plain(docs.where("doc_id is not null")))[r.doc_id].encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    draw = np.random.default_rng(0)
    image = draw.integers(0, 256, (6, 10), dtype=np.uint8)
    np.testing.assert_array_equal(media.decode(media.encode_pgm(image)), image)
    np.testing.assert_array_equal(media.decode(b"P2\n# c\n2 2 255\n1 2\n3 4"), [[1, 2], [3, 4]])
    np.testing.assert_array_equal(media.decode(b"P4\n3 1\n" + bytes([0b10100000])), [[1, 0, 1]])
    assert media.decode(b"P6 1 1 255\n" + bytes([9, 8, 7])).tolist() == [[[9, 8, 7]]]
    bmp = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + bytes([3, 2, 1, 0, 6, 5, 4, 0])
    assert media.decode(bmp).tolist() == [[[4, 5, 6]], [[1, 2, 3]]]
    np.testing.assert_allclose(media.resize(image.astype(float), 3, 5), image.reshape(3, 2, 5, 2).mean((1, 3)))
    assert media.resize(image.astype(float), 4, 7).mean() == pytest.approx(image.mean())
    rows = spark.createDataFrame([(1, media.encode_pgm(image)), (2, b"P9"), (3, None)], "k int, data binary")
    got = {r.k: r for r in media.image_features(rows, "k", "data").collect()}
    assert got[1].dhash and len(got[1].tiles) == 4 and got[2].error and got[3].dhash is None


def test_bpe_and_packing(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = plain(docs)
    want = sorted((k is None, k or 0, hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest()) for k, t in texts)
    got = bpe.digest_documents(docs, bpe.default_vocabulary()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256, r.decoded_sha256) for r in got) == want
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = packing.pack_documents(rows, bpe.default_vocabulary(), block_tokens=300).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for k, t in plain(rows):
        ids, at = [*library.encode(t, add_special_tokens=False).ids, 1], 0
        for p in sorted(by_doc[k], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= packing.WINDOW


def test_packing_is_optimal():
    draw = random.Random(5)
    for _ in range(30):
        at = np.cumsum([0, *[draw.randint(1, 9) for _ in range(25)]])
        cost = np.array([0, *[draw.choice([0, 4, 24]) for _ in range(25)]])
        best = [0] + [math.inf] * 25
        pad = lambda n: 0 if n & (n - 1) == 0 else 32 - n
        for j in range(1, 26):
            best[j] = min(best[i] + pad(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= 32) + cost[j] + packing.PER_WINDOW
        total, low = 0, 0
        for c in packing.cut(at, cost, 32):
            total += pad(int(c - low)) + cost[list(at).index(c)] + packing.PER_WINDOW
            low = c
        assert low == at[-1] and total == best[-1]


def test_short_sentences_are_places():
    is_end = np.array([False, False, True])
    ids = np.array([*[0, 0, 0, 0, 2] * 900, 1, *[0, 2, 1]])
    at, cost = packing.places(ids, np.array([4501, 4504]), is_end)
    assert at.tolist() == [0, *range(5, 4501, 5), 4501, 4503, 4504]
    assert packing.IN_SENTENCE not in cost and cost[np.isin(at, [4501, 4504])].tolist() == [0, 0]
    assert all(c % 5 == 0 or c > 4500 for c in packing.cut(at, cost))


def test_recurrent_model(spark):
    rows = spark.createDataFrame([(k, prose(k, 40) if k % 9 else None, "en", "s", 0, "e") for k in range(60)], SCHEMA)
    tokens = {k: [*(prose(k, 40).lower().split() if k % 9 else []), ""] for k in range(60)}
    held = {k for k in tokens if zlib.crc32(str(k).encode()) % 10 == 0}
    counts = Counter(w for k, t in tokens.items() if k not in held for w in t)
    total, kinds = sum(counts.values()), len(counts)
    for known in (5, 200_000):  # with few known words, most counts come by the join
        for r in gru.score_documents(rows, known=known, head=4, rounds=1, shares=1).collect():
            t = tokens[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(t), sum(counts[w] > 0 for w in t), total)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t))
            assert r.score < 0


def test_training_reaches_every_share(spark):
    assert {k % gru.SHARES for k in range(gru.ROUNDS)} == set(range(gru.SHARES))
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 16 > 2 and zlib.crc32(str(k).encode()) % 10]
    rows = spark.createDataFrame([(k, prose(k, 40)) for k in ids], "doc_id long, text string")
    lex, _ = gru.lexicon(gru.count_words(rows), head=16)
    for part in (rows.where(f"doc_id = {k}") for k in ids[:3]):
        assert not np.array_equal(gru.train(part, lex).flat(), gru.train(part, lex, rounds=0).flat())


def test_gradients():
    draw = np.random.default_rng(0)
    net = gru.Network.fresh(draw.integers(1, 50, 70).astype(float), np.ones(gru.REST))
    states, target = draw.normal(size=(9, gru.STATE)).astype("f4"), np.array([0, 1, 31, 32, 69, 70, 71, 117, 3])
    probability = np.array([np.exp(net.log_probability(states[:1], np.array([k]))) for k in range(70 + gru.REST)])
    assert probability.sum() == pytest.approx(1, abs=1e-4)
    grads = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    net.log_probability(states, target, grads)
    for n, at in (("to_class", (2, 1)), ("class_bias", (0,)), ("to_word", (0, 3, 1)), ("word_bias", (1, 0))):
        own, size = getattr(net, n), 1e-2
        own[at] += size
        up = -net.log_probability(states, target).sum()
        own[at] -= 2 * size
        down = -net.log_probability(states, target).sum()
        own[at] += size
        assert grads[n][at] == pytest.approx((up - down) / (2 * size), abs=2e-2)
    docs = [np.array([1, 2, 3, 4] * 30, "i4")] * 20
    trained = gru.train_block(gru.train_block(net, docs, 0.05), docs, 0.05)
    assert gru.score_block(trained, docs[:1])[0] > gru.score_block(net, docs[:1])[0] + 50


def plain_log_probability(net, ids):
    """One token after the other, every softmax written out in double precision."""
    h, total, heads = np.zeros(gru.STATE), 0.0, net.to_word.shape[0]
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for k in ids.tolist():
        classes = soft(h @ net.to_class + net.class_bias)
        if k < net.head:
            c = k // gru.CLASS_SIZE
            total += math.log(classes[c] * soft(h @ net.to_word[c] + net.word_bias[c])[k % gru.CLASS_SIZE])
        else:
            total += math.log(classes[heads + k - net.head])
        x, a = net.inputs[k].astype(float), h @ net.recur
        z, r = (1 / (1 + np.exp(-(x + a)[j * gru.STATE : (j + 1) * gru.STATE])) for j in (0, 1))
        n = np.tanh(x[2 * gru.STATE :] + r * a[2 * gru.STATE :])
        h = (1 - z) * n + z * h
    return total


def random_network(seed, head=70):
    draw = np.random.default_rng(seed)
    net = gru.Network.fresh(draw.integers(1, 50, head).astype(float), np.ones(gru.REST))
    values = net.flat()
    return net.filled(np.where(values > -1e8, values + draw.normal(0, 0.4, len(values)), values))


def test_scores_are_a_plain_forward_pass(monkeypatch):
    monkeypatch.setattr(gru, "SCORE_STEPS", 7)
    monkeypatch.setattr(gru, "SCORE_LANES", 5)
    draw, net = np.random.default_rng(2), random_network(1)
    docs = [draw.integers(0, 70 + gru.REST, n).astype("i4") for n in (1, 40, 3, 9, 17, 2, 2, 1, 25, 8, 100)]
    np.testing.assert_allclose(gru.score_block(net, docs), [plain_log_probability(net, d) for d in docs], rtol=1e-4)


def test_gradients_through_time():
    draw, net = np.random.default_rng(3), random_network(2)
    docs = [draw.integers(0, 70 + gru.REST, n).astype("i4") for n in (6, 4, 9, 3)]
    flow = gru.Streams(docs, 2)
    [(at, edges, first)] = list(flow.windows(64))
    enter = lambda: np.zeros((2, gru.STATE), "f4")
    grads, _ = gru.window_gradients(net, enter(), flow.tokens[at], edges, first)
    used = int(docs[2][0])
    for n, where in (("recur", (3, 5)), ("recur", (7, 20)), ("recur", (1, 40)), ("inputs", (used, 4)), ("inputs", (used, 18)), ("inputs", (used, 40))):
        own, size = getattr(net, n), 1e-2
        own[where] += size
        up = -sum(plain_log_probability(net, d) for d in docs)
        own[where] -= 2 * size
        down = -sum(plain_log_probability(net, d) for d in docs)
        own[where] += size
        assert grads[n][where] == pytest.approx((up - down) / (2 * size), abs=2e-2, rel=2e-2)


def test_one_very_long_text_among_short_ones():
    docs = [np.zeros(200_000, "i4"), *[np.ones(20, "i4")] * 600]
    flow = gru.Streams(docs, gru.SCORE_LANES)
    assert len(flow.tokens) == len(flow.owner) == len(flow.first) == 212_000
    assert sum(len(at) for at, _, _ in flow.windows(gru.SCORE_STEPS)) == 212_000


def test_the_model_beats_the_counts_on_held_out_texts(spark):
    draw = random.Random(8)

    def chain(n):  # each word all but settles the next one
        at, out = draw.randrange(15), []
        for _ in range(n):
            at = (at * 4 + (1 if draw.random() < 0.9 else draw.randrange(15))) % 15
            out.append(WORDS[at])
        return " ".join(out)

    rows = spark.createDataFrame([(k, chain(120)) for k in range(1500)], "doc_id long, text string").coalesce(2)
    held = gru.score_documents(rows).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert held.s / held.n > held.b / held.n + 0.2


def test_language(spark):
    other = "der die und haus wasser licht stein grün wolke niemals sieben metall".split()
    draw = random.Random(1)
    rows = [(k, prose(k, 30) if k % 2 else " ".join(draw.choice(other) for _ in range(30)), "en" if k % 2 else "de", "s", 0, "e") for k in range(80)]
    table = spark.createDataFrame([*rows, (100, None, "en", "s", 0, "e"), (101, "123 !!", "de", "s", 0, "e"), (102, "zqxj vkwqz xxqzj qqqw zzkx " * 9, None, "s", 0, "e")], SCHEMA)
    model = langid.train(table.where("doc_id < 60"))
    got = {r.doc_id: r for r in langid.predict(table, model).collect()}
    assert all(got[k].lang_pred == ("en" if k % 2 else "de") and got[k].score > 0.9 and not got[k].rejected for k in range(80))
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[100].rejected and got[102].rejected
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(80))
    # every context's probabilities over the alphabet add up to one with the unseen share
    ones = np.bincount(model.grams[0].lang, weights=model.grams[0].value) + model.contexts[0].value[np.argsort(model.contexts[0].lang)]
    assert ones == pytest.approx([1, 1])
    assert set(langid.accept(table, model).select("doc_id").toPandas().doc_id) == set(range(80))


def plain_kneser_ney(counts, order=4):
    """log P of a word by interpolated Kneser-Ney with dictionaries; ``counts``: word -> n of one language."""
    tables = {k: Counter() for k in range(1, order + 1)}
    for w, n in counts.items():
        padded = f" {w} "
        for end in range(2, len(padded) + 1):
            gram = padded[max(end - order, 0) : end]
            tables[len(gram)][gram] += n
    for k in range(order, 1, -1):
        for gram in tables[k]:
            tables[k - 1][gram[1:]] += 1
    discount, total, kinds = {}, Counter(), Counter()
    for k, own in tables.items():
        n1, n2 = (sum(c == x for c in own.values()) for x in (1, 2))
        discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        for gram, c in own.items():
            total[k, gram[:-1]] += c
            kinds[k, gram[:-1]] += 1

    def p(gram):
        if not gram:
            return 1e-6
        k, context = len(gram), gram[:-1]
        if not total[k, context]:
            return p(gram[1:])
        share = max(tables[k][gram] - discount[k], 0) / total[k, context]
        return share + discount[k] * kinds[k, context] / total[k, context] * p(gram[1:])

    return lambda w: sum(math.log(p(f" {w} "[max(e - order, 0) : e])) for e in range(2, len(w) + 3))


def test_language_scores_are_plain_kneser_ney(spark):
    letters = "abcdeéßжя"
    draw, rows = random.Random(4), []
    for k in range(300):
        lang = ("aa", "bb", "cc")[k % 3]
        rows.append((k, " ".join("".join(draw.choice(letters[k % 3 * 2 : k % 3 * 2 + 5]) for _ in range(draw.randint(1, 6))) for _ in range(20)), lang))
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: Counter() for lang in model.languages}
    for k, t, lang in rows:
        if zlib.crc32(str(k).encode()) % 30 // 3 != 0:  # the others calibrate
            counts[lang].update(t.split())
    words = ["a", "abc", "ßжя", "zzz", "éaéaéaéaéa", "b" * 30, *list(counts["aa"])[:50], *list(counts["cc"])[:50]]
    found = model.score_words(words)
    for i, lang in enumerate(model.languages):
        plain = plain_kneser_ney(counts[lang])
        np.testing.assert_allclose(found[:, i], [plain(w) for w in words], rtol=2e-4)
    assert found[:, -1].tolist() == [len(w) + 1 for w in words]
    # with a quota some n-grams are left out, and each context's shares and back-off weight still add up to one
    small, left = (t.toPandas() for t in langid.model_tables(langid.word_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string")), quota=40))
    assert small.groupby(["lang", "size"]).size().max() <= 40 < len(langid.build(small, left).grams[3].keys) + 200
    small["context"] = small["gram"].str[:-1]
    sums = small.groupby(["lang", "size", "context"])["value"].sum()
    whole = sums + left.set_index(["lang", "size", "gram"])["value"].rename_axis(["lang", "size", "context"])
    assert whole.notna().all() and np.allclose(whole, 1) and (left["value"] > 0).all()


def test_language_edges(spark):
    assert langid.letter_words("½ ② Ⅻ 12 _ ٣") == [] and langid.letter_words("aⅫb_cé") == ["a", "b", "cé"]
    rows = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    model = langid.train(rows)
    assert model is None and langid.accept(rows, model).count() == 3
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.predict(rows, model).collect()} == {("und", 0.0, False)}


def test_language_rejection_is_calibrated(spark):
    draw = random.Random(6)
    rows = [(k, prose(k, draw.choice([3, 20, 60])), "en") for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table)
    fresh = spark.createDataFrame([(k, prose(10_000 + k, draw.choice([3, 20, 60]))) for k in range(400)], "doc_id long, text string")
    junk = spark.createDataFrame([(k, " ".join("".join(draw.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(12))) for k in range(100)], "doc_id long, text string")
    assert langid.predict(fresh, model).where("rejected").count() <= 4
    assert langid.predict(junk, model).where("rejected").count() >= 98


def test_line_dedup(spark, docs):
    first, out, gone = {}, {}, {}
    rows = sorted({(k is not None, k or 0, t) for k, t in ((r.doc_id, r.text) for r in docs.collect()) if t is not None})
    for has, k, t in rows:
        lines = t.split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(x.strip(" ") for x in w):
                if w in first and first[w] != (has, k, t, i):
                    gone.setdefault((has, k, t), set()).update(range(i, i + 3))
                first.setdefault(w, (has, k, t, i))
        out[has, k, t] = [x for i, x in enumerate(lines) if i not in gone.get((has, k, t), ())]
    found = linededup.dedup_lines(docs).collect()
    assert len(found) == docs.count() and found[0].extra is not None
    want = Counter("\n".join(out[(r.doc_id is not None, r.doc_id or 0, r.text)]) if r.text is not None else None for r in docs.collect())
    assert Counter(r.text for r in found) == want
    assert {r.doc_id: r.n_removed for r in found}[9] == 4 and {r.doc_id: r.text for r in found}[13] == "a\nb"


def brute_components(texts, percent):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(sets[k]), find(k)) for k in texts}


def test_near_duplicates(spark, docs):
    texts = {k: t for k, t in plain(docs) if k is not None}
    base = prose(50, 120).split()
    for k in range(100, 140):  # a chain in which only neighbours are near
        base[(k * 7) % 120] = f"w{k}"
        texts[k] = " ".join(base)
    rows = spark.createDataFrame([(k, t, "en", "s", 0, "e") for k, t in texts.items()] + [(None, texts[6], "en", "s", 0, "e")], SCHEMA)
    want = brute_components(texts, 85)
    got = minhash.near_duplicates(rows, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    kept = minhash.keep_first(rows, 85)
    assert kept.columns == rows.columns and kept.count() == len(set(c for _, c in want.values())) + 1


def test_blocks_miss_no_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    base, texts = prose(60, 80).split(), {}
    for k in range(30):  # each differs from the common base, and from all others, in a few words
        own = list(base)
        for i in range(k % 3):
            own[(k * 11 + i * 29) % 80] = f"w{k}{i}"
        texts[k] = " ".join(own)
    rows = spark.createDataFrame([(k, t, "en", "s", 0, "e") for k, t in texts.items()], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(rows, 85).collect()}
    assert got == brute_components(texts, 85)


def test_a_large_group_near_the_threshold(spark):
    """Hundreds of edited copies, most pairs of which are candidates of a likeness between 0.7 and 0.9."""
    draw, base, texts = random.Random(9), prose(61, 110).split(), {}
    for k in range(700):
        own = list(base)
        for i in draw.sample(range(110), draw.choice([1, 2, 2, 3])):
            own[i] = f"w{draw.randint(0, 10**9)}"
        texts[k] = " ".join(own)
    rows = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(rows, 85).collect()}
    assert got == brute_components(texts, 85)


def test_common_counts_and_forest():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 400, draw.integers(1, 300), dtype=np.uint64)) for _ in range(40)]
    want = [[len(np.intersect1d(x, y)) for y in sets[15:]] for x in sets[:15]]
    np.testing.assert_array_equal(minhash.common_counts(sets[:15], sets[15:]), want)
    side = [(k, k, x) for k, x in enumerate(sets)]
    links = minhash.forest(side, side, 30)
    linked = {(b, a) for a, b in combinations(range(40), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 30 * len(np.union1d(sets[a], sets[b]))}
    assert set(links) <= linked and len(links) < 40
    root = {k: k for k in range(40)}
    for _ in range(40):
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert len(links) == 40 - len(set(root.values()))


def test_runs_of_sorted_batches():
    import pyarrow as pa

    from tidemark.llm.common import runs_of

    keys = [1, 1, 1, 2, 3, 3, 3, 3, 4]
    for size in (1, 2, 3, 9):
        batches = [pa.record_batch([pa.array(keys[k : k + size]), pa.array(range(k, min(k + size, 9)))], ["k", "v"]) for k in range(0, 9, size)]
        assert [(t.column("k")[0].as_py(), t.column("v").to_pylist()) for t in runs_of(batches, ["k"])] == [(1, [0, 1, 2]), (2, [3]), (3, [4, 5, 6, 7]), (4, [8])]


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(200, 100), (100, 150), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 150: 100, 200: 100}


def test_components_of_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(components, "EDGES_A_TASK", 10)
    edges = [(1000 + k, 7) for k in range(60)] + [(7, 3), (500, 400), (1060, 2)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{1000 + k: 3 for k in range(60)}, 7: 3, 3: 3, 500: 400, 400: 400, 1060: 2, 2: 2}


def test_revisits(spark):
    at = lambda n: F.timestamp_seconds(F.lit(n))
    rows = [
        (1, "response", "http://www.A.org:80/x/?utm_a=1#f", 10, 200, {"ETag": '"v1"', "Content-Type": "text/html"}, "one"),
        (2, "response", "https://a.org/x", 20, 200, {"Last-Modified": "monday", "X": "1"}, "two"),
        (3, "revisit", "a.org/x", 15, 304, {"etag": 'W/"v1"', "content-type": "text/plain", "Expires": "soon"}, None),
        (4, "revisit", "https://a.org/x/", 20, 304, {"last-modified": "monday"}, None),
        (5, "revisit", "https://a.org/x", 30, 304, {"last-modified": "sunday"}, None),
        (6, "revisit", "https://a.org/x", 5, 304, None, None),
        (7, "revisit", "https://a.org/x", 12, 304, {}, None),
        (8, "revisit", None, 12, 304, {}, None),
        (9, "revisit", "https://a.org/x", None, 304, {}, None),
    ]
    table = spark.createDataFrame(rows, "record_id long, kind string, url string, s long, status int, headers map<string,string>, payload string").withColumn("at", F.timestamp_seconds("s"))
    for slices in (2, 64):
        got = {r.record_id: r for r in warc.resolve_revisits(table, slices).collect()}
        assert {k: (r.outcome, r.response_id) for k, r in got.items()} == {3: ("resolved", 1), 4: ("resolved", 2), 5: ("mismatch", 2), 6: ("orphan", None), 7: ("unconfirmed", 1), 8: ("orphan", None), 9: ("orphan", None)}
        assert got[3].headers == {"etag": 'W/"v1"', "content-type": "text/html", "expires": "soon"} and got[3].payload == "one" and got[3].status == 200
        assert got[5].payload is None


def test_pipeline(spark, tmp_path):
    texts = {k: prose(k, 60) for k in range(20)}
    texts |= {30: texts[3], 31: texts[4] + " again", 32: "zqxj vkwqz xxqzj qqqw " * 20, 33: None, 34: texts[5] + "\nmail me@here.example.org\nl2\nl3", 35: texts[6] + "\nmail me@here.example.org\nl2\nl3"}
    rows = spark.createDataFrame([(k, t, None if k == 32 else "en", "s", len(t or ""), "e") for k, t in texts.items()], SCHEMA)
    rows.drop("extra").write.parquet(str(tmp_path / "documents.parquet"))
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        seen[name] = frame.toPandas()
        if name != "packing":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            frame = spark.createDataFrame(seen[name], frame.schema)
    assert set(texts) - set(seen["language"].doc_id) == {32, 33}
    assert set(range(20)) <= set(seen["near_duplicates"].doc_id) and not {30, 31} & set(seen["near_duplicates"].doc_id)
    assert not seen["personal_data"].text.str.contains("@").any()
    assert set(seen["packing"].doc_id) == set(seen["personal_data"].doc_id)
    # which pieces there are depends on how the input is split; the tokens of each document do not
    whole = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    want = seen["packing"].groupby("doc_id").length.sum().to_dict()
    assert {r.doc_id: r.n for r in whole} == want and all(r.n == r.m for r in whole)
