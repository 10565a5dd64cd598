"""Every operator and stage on empty tables, on extra columns of clashing names, on very long texts and on repeated rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, gru, langid, linededup, media, minhash, packing, pii, warc, winnowing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CLASHES = ["__gone", "__spans", "__own", "__row", "__text", "__tokens", "body", "found", "row", "spans", "own", "gone", "n_lines", "n_removed", "component_id", "kept", "rep", "bucket", "u", "v", "word", "key", "tiles", "id", "value", "part", "h", "n", "k", "lines"]
WORDS = "the of and river stone light under never small green house water cloud seven metal".split()
PATH = bpe.default_vocabulary()

OPERATORS = {
    "winnowing": winnowing.compare_neighbours,
    "personal data": pii.find_personal_data,
    "redact": pii.redact,
    "media": media.store_texts,
    "digests": lambda d: bpe.digest_documents(d, PATH),
    "encode": lambda d: bpe.encode_documents(d, PATH),
    "packing": lambda d: packing.pack_documents(d, PATH),
    "recurrent": gru.score_documents,
    "language": lambda d: langid.predict(d, langid.train(d)),
    "near duplicates": minhash.near_duplicates,
}
A_ROW_EACH = [n for n in OPERATORS if n != "packing"]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    long = prose(3, 60_000) + " " + "z" * 30_000 + "\n" + "a@b.example.org +1 838 555 7235\n" * 40
    texts = [None, "", " \n \n ", "a", long, prose(1, 80), prose(1, 80), prose(2, 50) + "\nl1\nl2\nl3", prose(4, 50) + "\nl1\nl2\nl3", "½ ② Ⅻ", "中文 текст ñ ퟿"]
    rows = [(k, t, None if k in (3, 9) else "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id", None, None, None), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="module")
def clashing(table):
    return table.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators_on_empty_and_clashing_tables(table, clashing, name):
    operator = OPERATORS[name]
    assert operator(table.where("false")).count() == 0
    got = operator(clashing)
    rows = got.count()
    assert rows == table.count() if name in A_ROW_EACH else rows >= table.count()
    if name == "redact":
        assert got.columns == clashing.columns
        assert all(r["__spans"] == "own __spans" for r in got.collect())


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_empty_and_clashing_tables(spark, table, clashing, tmp_path, name, stage):
    read = lambda d, at: (d.write.parquet(f"{tmp_path}/{at}"), spark.read.parquet(f"{tmp_path}/{at}"))[1]
    assert stage(spark, read(table.where("false"), "none"), "").count() == 0
    plain, mixed = stage(spark, read(table, "plain"), ""), stage(spark, read(clashing, "mixed"), "")
    if name == "packing":
        assert plain.columns == mixed.columns and plain.agg(F.sum("length")).first() == mixed.agg(F.sum("length")).first()
        return
    assert plain.columns == COLUMNS and mixed.columns == clashing.columns
    of = lambda d: sorted(map(str, d.select(*COLUMNS).collect()))
    assert of(plain) == of(mixed)
    assert all(r[c] == f"own {c}" for r in mixed.select(*CLASHES).collect() for c in CLASHES)


def test_the_pipeline_leaves_one_table(spark, table, tmp_path):
    from tidemark.functions import lineage

    table.write.parquet(f"{tmp_path}/documents.parquet")
    since = lineage.given()
    rows = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert rows > 0 and lineage.given() == since + 1
    lineage.release(spark, since)
    assert lineage.given() == since


def test_lines_and_revisits_on_empty_and_clashing_tables(spark, table, clashing):
    assert linededup.dedup_lines(table.where("false")).count() == 0
    with pytest.raises(ValueError, match="n_lines, n_removed"):
        linededup.dedup_lines(clashing)
    got = linededup.dedup_lines(clashing, "lines_", "removed_")
    assert got.columns == [*clashing.columns, "lines_", "removed_"] and got.count() == clashing.count()
    schema = "record_id long, kind string, url string, at timestamp, status int, headers map<string,string>, payload string"
    records = spark.createDataFrame([(1, "response", "http://a/x", None, 200, None, "p" * 100_000), (2, "revisit", "http://a/x", None, 304, {}, None), (2, "revisit", "http://a/x", None, 304, {}, None)], schema)
    assert warc.resolve_revisits(records.where("false")).count() == 0
    extra = records.withColumns({c: F.lit(1) for c in ("site", "found", "__site", "__us", "own", "stored", "last")})
    assert [r.outcome for r in warc.resolve_revisits(extra).collect()] == ["orphan", "orphan"]


def test_images_of_an_empty_table(spark):
    none = spark.createDataFrame([], "k int, data binary")
    assert media.image_features(none, "k", "data").count() == 0


def test_area_means_of_any_shape(monkeypatch):
    draw = np.random.default_rng(3)
    for strip in (1, 3, 4096):
        monkeypatch.setattr(media, "STRIP", strip)
        for _ in range(20):
            (rows, cols), (h, w) = draw.integers(1, 12, 2), draw.integers(1, 15, 2)
            plane = draw.integers(0, 256, (rows, cols))
            fine = np.repeat(np.repeat(plane, h, 0), w, 1)  # every sample as h x w, so that every cell is whole
            want = fine.reshape(h, rows, w, cols).mean((1, 3))
            np.testing.assert_allclose(media.resize(plane, h, w), want, atol=1e-9)


def test_tiles_are_given_and_are_the_reduced_text(table):
    import io

    for r in media.store_texts(table.where("doc_id = 5")).collect():
        plane = np.frombuffer(prose(1, 80).encode().ljust(r.payload_bytes, b"\0"), "u1").reshape(-1, 64)
        want = np.rint(media.resize(plane, 16, 16)).astype("u1")
        assert len(r.tiles) == 4
        for t in r.tiles:
            np.testing.assert_array_equal(np.load(io.BytesIO(t.npy)), want[8 * t.row : 8 * t.row + 8, 8 * t.col : 8 * t.col + 8])


def test_repeated_ids_keep_one_row_of_each_group(spark):
    a, b, c = prose(11, 60), prose(12, 60), prose(13, 60)
    rows = [(1, a, "x"), (1, a, "y"), (1, b, "x"), (2, a + " more", "x"), (3, c, "x"), (4, c, "x"), (4, c, "y"), (None, a, "x"), (None, a, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted((r.doc_id or 0, r.text) for r in minhash.keep_first(table).collect())
    first = min((a, b), key=lambda t: table.sparkSession.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0])
    assert kept == sorted([(0, a), (0, a), (1, first), (3, c)])


def test_workers_let_a_coder_go_when_another_operator_begins(spark):
    """A coder that the collector passes over refers to itself, and stayed in its worker through all later stages."""
    from tidemark.llm.bpe import default_vocabulary
    from tidemark.llm.packing import pack_documents

    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(40)], "doc_id long, text string").repartition(4)
    assert pack_documents(docs, default_vocabulary()).agg(F.sum("length")).first()[0] > 40

    def run(batches):
        import gc

        import pyarrow as pa

        from tidemark.llm.common import begin

        for batch in batches:
            begin("another")
            gc.unfreeze()
            left = sum(type(x).__name__ == "WordCoder" for x in gc.get_objects())
            yield pa.record_batch([pa.array([left] * batch.num_rows, pa.int64())], ["left"])

    assert {r.left for r in spark.range(0, 16, 1, 16).mapInArrow(run, "left long").collect()} == {0}


def test_words_are_split_at_ascii_white_space_only_and_without_a_slow_search():
    """Other white space is looked for in every text; a pattern's search for it took longer than splitting."""
    import time

    from tidemark.llm.common import ascii_words

    for c in map(chr, range(0x3100)):
        text = f"aÉ{c}B x"
        assert ascii_words(text) == [w.decode() for w in "".join(x.lower() if x.isascii() else x for x in text).encode().split()]
    text = "x" * 4_000_000

    def least(f):
        spent = []
        for _ in range(7):
            since = time.process_time()
            f()
            spent.append(time.process_time() - since)
        return min(spent)

    assert least(lambda: ascii_words(text)) < 2.5 * least(lambda: text.lower().split())


def test_freed_native_memory_goes_back_when_lineage_is_cut(spark, monkeypatch):
    """glibc's arenas kept what the driver's short threads had freed: the pipeline's driver grew from stage to stage."""
    from tidemark.functions import lineage

    assert lineage.trim(spark)
    seen, trim = [], lineage.trim
    monkeypatch.setattr(lineage, "trim", lambda s: seen.append(trim(s)))
    monkeypatch.setattr(lineage, "TRIM_EVERY", 0.0)
    assert lineage.settled(spark.range(3)).count() == 3
    lineage.scratch(spark, "nothing")
    assert seen == [True, True]


def test_new_words_are_encoded_side_by_side(monkeypatch):
    """Packing took 514 CPU seconds a GB, half of them for words encoded one by one."""
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    texts = [None, "", " ", "ǅ É Σ", "\x1c a\x1db", "<unk> x </s>", "日本語テキスト 🎉🎉", "½②Ⅻ", "\x00\x01 \x7f", "1234567890" * 9, "it's we'll"]
    texts += [" ".join(f"ci{k * 7919 % 1013}ón quemente{chr(97 + k % 26)}{chr(97 + k % 17)}ta, rar{'aeiou'[j % 5] * (k % 4)}llo." for j in range(3)) for k in range(200)]
    monkeypatch.setattr(bpe, "TOGETHER_CHARS", 3000)
    monkeypatch.setattr(bpe, "MEMORY_PAIRS", 1 << 6)  # pairs drive one another out
    alone = []
    monkeypatch.setattr(bpe.WordCoder, "encode_units", lambda self, units: alone.append(units))
    own = bpe.WordCoder(path)
    got = list(own.encode_all(enumerate(texts)))
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    assert [k for k, _ in got] == list(range(len(texts)))
    for (_, ids), text in zip(got, texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert not alone


def test_python_sees_each_word_once_whatever_stands_beside_it(monkeypatch):
    """Packing took 462 CPU seconds a GB, most of them for looking up the chunks of all texts."""
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    draw = random.Random(11)
    odd = [*"''''stremvld,.! \t\n\x0b\x1c\x1d\x85\xa0　aeé١½5<>İ́", "<unk>", "</s>", "'s", "'ll", "'reve", "ßΣ", "日本", "\U0001d7d9", "🎉"]
    texts = ["".join(draw.choices(odd, k=draw.randint(0, 24))) for _ in range(3000)]
    texts += [f"word{'*' * (k % 7)} (word) word, 'word' word{k}" for k in range(3000)]
    library, own = Tokenizer.from_file(path), bpe.WordCoder(path)
    library.no_truncation()
    library.no_padding()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for chars in (2000, 10**7):  # several batches, and one
        monkeypatch.setattr(bpe, "TOGETHER_CHARS", chars)
        monkeypatch.setattr(bpe, "SIDE_BY_SIDE", 1000, raising=False)
        assert [np.frombuffer(ids, "<u4").tolist() for _, ids in own.encode_all(enumerate(texts))] == want
    fresh, seen = bpe.WordCoder(path), []
    made = fresh.units_of
    monkeypatch.setattr(fresh, "units_of", lambda word: seen.append(word) or made(word))
    monkeypatch.setattr(fresh, "_words", None)  # no text and no chunk is cut in Python
    monkeypatch.setattr(fresh, "chunk", None)
    assert len(list(fresh.encode_all(enumerate(texts[3000:])))) == 3000
    assert sorted(seen) == sorted({"word", "(", ")", ",", "'", *"0123456789", *["*" * k for k in range(1, 7)]})
    assert list(fresh.encode_all([])) == [] and list(fresh.encode_all([(None, None), (2, "")])) == [(None, b""), (2, b"")]


def test_a_very_long_text_is_cut_at_white_space_for_encoding(monkeypatch):
    """A text of 19 million characters took 540 MB beyond the coder."""
    assert [*bpe.slices(b"", 4)] == [b""] and [*bpe.slices(b"abcdefgh", 4)] == [b"abcdefgh"]
    assert [*bpe.slices(b"abcdef gh\tijklm  no", 4)] == [b"abcdef", b" gh\tijklm", b"  no"]
    own, sizes = bpe.WordCoder(bpe.default_vocabulary()), []
    text = "\n".join(f"word{k} it's\t<unk> é{'x' * (k % 90)},\x0b日本 " for k in range(500))
    want, made = own.encode(text), own._side_by_side
    monkeypatch.setattr(own, "_side_by_side", lambda plain: sizes.append(sum(map(len, plain))) or made(plain))
    monkeypatch.setattr(bpe, "TOGETHER_CHARS", 300)
    assert list(own.encode_all([(1, text), (2, None), (3, text.replace("<unk>", ""))])) == [(1, want), (2, b""), (3, own.encode(text.replace("<unk>", "")))]
    assert max(sizes) < 900
