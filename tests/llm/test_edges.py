"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import bloom_lookup, fertility, line_align, minhash_paths, mixing, pieces, quality, toxicity, url_rules, zstd_language
from nearfield.llm.text import WordHash

#: Names that the operators use inside, or did.
CLASH = """at bin bins blk cell cells chk cnt copies cut digest edited end fix g gone groups h hash heads held id ids inside is_url keep_hash keep_id key
last left lines m more n next nth o of ord order other own p part parts path place q rank removed rep rep_hash rest rid row range score sig side size sizes
sure t taken target tie th to tree u units use v verdict w weighted wt x y text_hash source_size n_shingles component_id _copies _gone _hash _id _lines
_o _ord _size _t _target _text_hash _th""".split()
WORDS = [f"w{k % 97}x{k % 31}" for k in range(400)]
LONG = " ".join(f"t{k * 7919 % 100003}" for k in range(60_000))


def table(spark):
    base = " ".join(WORDS)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, None, None, None),
        (4, "", "en", None),
        (5, " \n\t ", "fr", "b"),
        (None, base + " tail", "en", "a"),
        (None, None, None, None),
        (6, LONG, "fr", "b"),
        (7, "déjà vu 日本 🙂 \x00 ▁", "fr", None),
        (8, "123 456 !!", "de", "c"),
        (9, base.replace("w5x5", "zz"), "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (9, None, None), (None, 1, 1), (6, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "mix": lambda d, l: (lambda plan: plan.copies(plan.slim))(mixing.Mix(d)),
    "toxicity": lambda d, l: toxicity.score_toxicity(d, toxicity.learn_toxicity(d, l, F.lit(True))),
    "near_duplicates": lambda d, l: minhash_paths.near_duplicates(d),
    "lines": lambda d, l: line_align.remove_common_lines(d),
    "fertility": lambda d, l: fertility.judge_fertility(d),
    "quality": lambda d, l: quality.score_quality(d, quality.learn_quality(d, l, F.lit(True))),
    "pieces": lambda d, l: pieces.encode_documents(d),
    "fingerprints": lambda d, l: bloom_lookup.version_likeness(d),
    "language": lambda d, l: zstd_language.identify(d, zstd_language.learn(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, labels, name):
    out = OPERATORS[name](docs, labels).toPandas()
    assert len(out) == 12
    if "score" in out and name != "lines" and name != "mix":
        assert out.score.between(0, 1).all()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("mix", "lines")])
def test_no_labels_or_languages(docs, labels, name):
    assert OPERATORS[name](docs.withColumn("lang", F.lit(None).cast("string")), labels.limit(0)).count() == 12


def test_stages_keep_columns_and_take_odd_rows(spark, docs):
    for at in (docs, docs.limit(0), docs.select("doc_id", "text", "lang", "source")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, "")
            if name != "encoding":
                assert out.columns == at.columns and [f.dataType for f in out.schema] == [f.dataType for f in at.schema], name
                assert all(r.size == "x" and r._id == "x" for r in out.collect() if "size" in at.columns), name
            assert (out.count() == 0) == at.isEmpty(), name


def test_defined_results(docs):
    near = {(r.doc_id, r.n_shingles): r.component_id for r in minhash_paths.near_duplicates(docs).collect()}
    assert near[3, 0] == 3 and near[4, 0] == 4 and near[2, 396] == near[9, 396] == near[1, 396] == 1
    assert near[None, 397] == 1 and near[None, 0] is None
    enc = {r.doc_id: r for r in pieces.encode_documents(docs).collect()}
    assert enc[3].n_tokens == enc[4].n_tokens == 0 and enc[4].decoded == ""
    assert enc[7].decoded == "déjà vu 日本 🙂 \x00  "  # the space symbol reads as a space
    langs = {r.doc_id: r for r in zstd_language.identify(docs, zstd_language.learn(docs)).collect()}
    assert {langs[k].lang_pred for k in (3, 4, 5, 8)} == {"und"} and langs[3].rejected
    kept = minhash_paths.keep_first(docs.select("doc_id", "text"))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    words = {r.doc_id: r for r in fertility.judge_fertility(docs).collect()}
    assert words[3].n_words == 0 and words[3].base_failed and not words[3].kept


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/x?q"), (4, "x://net"), (None, "x://a.net/es/"), (5, "http://"), (5, "http://"), (6, "http://com/"), (7, "http://xcom/")], "page_id long, url string").withColumn("host", F.lit("x")).withColumn("key", F.lit(1))
    rules = spark.createDataFrame(url_rules.PRODUCTION_RULES + [(None, "/", "block")], "host string, path string, verdict string")
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in url_rules.match_urls(pages, rules).collect()}
    assert got[1, ""] == got[2, ""] == got[5, ""] == ("", None, "allow")
    assert got[3, "www.example.com"] == ("/en/x", "www.example.com/en/", "allow")
    assert got[4, "net"] == ("", None, "allow") and got[None, "a.net"] == ("/es/", "net/es/", "block")
    assert got[6, "com"][1] == "com/" and got[7, "xcom"][1] is None
    assert url_rules.match_urls(pages, rules.limit(0)).where("rule IS NOT NULL").count() == 0
    assert url_rules.match_urls(pages.limit(0), rules).count() == 0


def test_edited_text_and_order(spark):
    rows = [(3, "abcd efgh"), (1, "zz"), (2, None), (None, "q")]
    out = {r.doc_id: r for r in bloom_lookup.version_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[3].edited_sha256 == sha("abcd ") and out[2].edited_sha256 == sha("")
    assert out[1].edited_sha256 == sha("zq") and out[None].edited_sha256 == sha("q")


def test_fertility_by_chunks_equals_the_libraries():
    """Whole texts through both libraries; words that are known are not read again, and texts that no cut fits go whole."""
    import public_tokenizers as public

    with open(pieces.default_model(), "rb") as f, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as g:
        tool = fertility.Fertility(f.read(), g.read(), public.PATTERN, cache_limit=64)
    rng, odd = random.Random(4), 0
    parts = [*"abcdef   \n\n\t▁éß日🙂01.,!<", "the ", " of", "    ", "'s", "\x00", "\r\n", ";\r", "\xa0", "　", "\x85", "\x1c", "\x0b", "x" * 70]
    for k in range(4000):
        t = "".join(rng.choice(parts[: 23 if k % 2 else None]) for _ in range(rng.randrange(40)))
        ids, n = tool.pieces.encode(t), len(tool.bytes.encode_ordinary(t))
        counts, (a, b, share, _) = tool.measure(t, WordHash())
        assert counts == fertility.base_counts(t, WordHash())
        assert (a, b, share) == ((counts[1] / len(ids), counts[1] / max(1, n), tool.is_byte[ids].mean()) if ids else (0, 0, 0)), t
        try:
            assert tool.read(t)[1].tolist() == ids
        except fertility.Odd:
            odd += 1
    assert 1000 < odd < 3000 and len(tool) + len(tool.old) <= 128
    text = "one two three. " * 9
    tool.read(text)
    seen = []
    tool.bytes.encode_ordinary = lambda chunk, inner=tool.bytes.encode_ordinary: seen.append(chunk) or inner(chunk)
    tool.read(text)
    assert seen == ["one"]


def test_words_are_cut_from_marks_and_read_once():
    codec, lib = pieces.PieceCodec(pieces.read_vocabulary()), sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    read, cut = [], codec.cut
    codec.cut = lambda part: read.append(part) or cut(part)
    text = " ".join(f"zorvantelquu{mark}" for mark in ["", ".", ",", "###", "&&&", ")", "?!", "", "."])
    assert codec.encode(text) == lib.encode(text)
    assert sorted(read) == sorted(["▁zorvantelquu", ".", ",", "###", "&&&", ")", "?!"])
    rng = random.Random(8)
    parts = [*"abcdeéß²ªʰıп日한🙂٣059  ▁\n\r\t.,:;!?'()_-#&/", "ing", "tion", "ünd", "вет", "http", "();", "..."]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert codec.encode(t) == lib.encode(t), t
    for end in (*"²ʰªéпx日", "²", "e"):
        for mark in map(chr, range(33, 127)):
            assert codec.encode(f"ab{end}{mark}c {end}{mark}") == lib.encode(f"ab{end}{mark}c {end}{mark}"), (end, mark)
    long = "".join(rng.choice("abcdeinorstu") for _ in range(5000))
    for n in (255, 256, 257, 258, 5000):
        assert codec.encode(long[:n]) == lib.encode(long[:n]) and codec.encode(long[:n] + "日🙂é") == lib.encode(long[:n] + "日🙂é")


def test_toxicity_margins_are_of_unseen_texts(monkeypatch):
    """Texts that are confirmed and unlabelled are in one fold: models that know their texts by heart tell nothing of others."""
    texts = [np.array([k], np.int32) for k in range(90)]
    positive, unlabelled = texts[:20] + texts[:3], texts[::-1]
    seen = []

    def by_heart(known, others, prior):
        weights = np.zeros(1 << toxicity.BITS)
        weights[[int(d[0]) for d in known + others]] = 1.0
        return weights, 0.0

    monkeypatch.setattr(toxicity, "train_nnpu", by_heart)
    monkeypatch.setattr(toxicity, "least_risk_margin", lambda p, u, prior: seen.extend([p, u]) or 0.0)
    toxicity.train(positive, unlabelled, 0.2)
    assert [len(x) for x in seen] == [23, 90] and not any(x.any() for x in seen)
