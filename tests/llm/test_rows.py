"""Operators that work row by row, against brute force, the libraries, or by hand."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, licenses, quality, sentencepiece_codec, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "   ", "\n", "a", "one two", "a\n\n b\n", "\x00 nul", "é世界 👍", "x" * 3000, "word " * 2000, "▁▁ a▁b", "<s> </s> <0x41> <unk>", " " * 100, "tab\tx \r\n y", "trail  "]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "n", 5) for i, t in enumerate(ODD)] + [(1, "", "n", 5), (None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string, score int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# SentencePiece


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return sentencepiece_codec.Codec(f.read())


def encoded(codec, texts):
    ids, ends = codec.encode(texts)
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def test_codec_is_the_library(codec):
    want = [codec.library.encode(t or "", add_bos=True, add_eos=True) for t in ODD]
    assert encoded(codec, ODD) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abethino \n\t▁.,<>0"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=5))
def test_codec_on_any_text(codec, texts):
    assert encoded(codec, texts) == [codec.library.encode(t, add_bos=True, add_eos=True) for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abethinosr ▁\n", min_size=1, max_size=30))
def test_rows_and_heap_agree(codec, unit):
    ids, count = codec.rows([unit])
    assert ids.tolist() == codec.agenda(unit) and count.tolist() == [len(ids)]


def test_codec_cache_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CACHE_UNITS", 3)
    for t in ("one two three four", "five six seven eight", "one two"):
        assert encoded(codec, [t]) == [codec.library.encode(t, add_bos=True, add_eos=True)]


def test_a_wrong_agenda_is_an_error(codec, monkeypatch):
    monkeypatch.setattr(codec, "rows", lambda units: (np.zeros(len(units), np.int32), np.ones(len(units), np.int64)))
    with pytest.raises(AssertionError):
        codec.encode(["neverseenbefore"])


def test_encode_query(spark, odd):
    rows = sentencepiece_codec.encode(odd, MODEL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert len(rows) == len(ODD) + 2
    by_id = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        r = by_id[i]
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), library.decode(ids))
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode(empty(spark), MODEL).count() == 0
    assert "score" in rows[0].asDict() and rows[0].asDict().get("N_TOKENS") is None


# Token counts


def test_token_counts(spark, odd):
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_counts.read_ranks(VOCABULARY), special_tokens={})
    for rule in token_counts.RULES:
        rows = {r["doc_id"]: r for r in token_counts.count(odd, VOCABULARY, public_tokenizers.PATTERN, rule=rule).collect()}
        for i, t in enumerate(ODD):
            tokens = encoding.encode_ordinary(t or "")
            lines = [len(x.encode()) for x in (t or "").splitlines(keepends=True)] if t and "\r" not in t and "\x00" not in t else None
            assert rows[i]["n_tokens"] == len(tokens) == sum(rows[i]["section_tokens"])
            if lines:
                assert rows[i]["n_sections"] == len(lines)
    assert token_counts.count(empty(spark), VOCABULARY, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.count(odd, VOCABULARY, public_tokenizers.PATTERN, rule="last")


@given(st.lists(st.integers(1, 6), min_size=1, max_size=12), st.lists(st.integers(1, 9), min_size=1, max_size=6), st.sampled_from(token_counts.RULES))
def test_allocation(sizes, widths, rule):
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    bounds = np.unique(np.r_[np.minimum(np.cumsum(widths), total), total])
    want = [0] * len(bounds)
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        owners = [int(np.searchsorted(bounds, x, side="right")) for x in range(a, b)]
        want[owners[0] if rule == "first" else max(dict.fromkeys(owners), key=owners.count)] += 1
    assert token_counts.allocate(ends, bounds, rule).tolist() == want


# Decontamination


def brute_words(text):
    out, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            out, word = (out + [word], "") if word else (out, "")
        else:
            word += c
    return out + [word] * bool(word)


def brute_hits(text, items, n):
    words, hit, found = brute_words(text), set(), set()
    for name, item in items:
        own = brute_words(item)
        size = min(n, len(own))
        for i in range(len(own) - size + 1) if own else ():
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[i : i + size]:
                    hit.update(range(at, at + size))
                    found.add(name)
    return len(words), len(hit), sorted(x for x in found if x is not None)


words = st.lists(st.sampled_from(["a", "B", "cé", "d1", "-", "A"]), max_size=14).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), words), max_size=4), st.lists(st.tuples(st.sampled_from(["1", "2", None]), words), max_size=4))
def test_scan_is_brute_force(texts, items):
    counts, spans, found = decontaminate.Windows(items, 3).scan(texts)
    for t, c, s, f in zip(texts, counts, spans, found, strict=True):
        assert (c, sum(b - a for a, b in s), sorted(set(f))) == brute_hits(t, items, 3)


@pytest.mark.parametrize("most", [1 << 20, 30])
def test_mark_in_parts(spark, most):
    docs = spark.createDataFrame([(1, "x one two three four y", "keep"), (1, "x one two three four y", "keep"), (2, None, None), (None, "five six", ""), (4, "", "z")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(10, "one two three"), (11, "TWO, three: four!"), (9, "five six"), (12, ""), (13, None), (None, "x")], "item_id long, text string")
    rows = decontaminate.mark(docs, bench, keep=["doc_id"], n=3, max_broadcast_bytes=most).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["n_items"], r["contaminated"]) for r in rows)
    assert got == [("1", 6, 5, ["10", "11"], 2, True)] * 2 + [("2", 0, 0, [], 0, False), ("4", 0, 0, [], 0, False), ("None", 2, 2, ["9"], 1, True)]
    kept = decontaminate.remove_documents(docs, bench, n=3, max_broadcast_bytes=most)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4]
    cut = decontaminate.remove_spans(docs, bench, n=3, max_broadcast_bytes=most)
    assert sorted(str(r["text"]) for r in cut.collect()) == ["", "", " y", " y", "None"]


def test_decontaminate_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.mark(empty(spark), bench).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.mark(docs, bench).first()["n_hit"] == 0


# Language ID


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, langid.fit(docs)


def test_held_out_accuracy(spark, languages):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_predictions_use_the_text_only(spark, languages):
    docs, model = languages
    a = langid.predict(docs, model, keep=["doc_id"], spans=False)
    b = langid.predict(docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")), model, keep=["doc_id"], spans=False)
    assert sorted(a.collect()) == sorted(b.collect())


def test_odd_texts(spark, odd, languages):
    rows = langid.predict(odd, languages[1]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        t = next((t for i, t in enumerate(ODD) if i == r["doc_id"]), "null id")
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"], r["lang_spans"]) == ("und", 0.0, [])
        assert 0 <= r["score"] <= 1
    assert langid.predict(empty(spark), languages[1]).count() == 0
    assert langid.fit(empty(spark)).predict(["abc"])[0] == ["und"]


def test_mixed_text_has_spans(languages):
    docs, model = languages
    texts = {r["lang"]: r["text"] for r in docs.where("n_chars > 300").collect()}
    mixed = texts["de"][:250] + " " + texts["fr"][:250]
    _, _, spans = model.predict([mixed])
    assert [s[2] for s in spans[0]][:1] == ["de"] and spans[0][-1][2] == "fr"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.integers(-9, 9)] * 3), min_size=1, max_size=7), min_size=1, max_size=4), st.integers(1, 12))
def test_shortcut_equals_viterbi(docs, penalty):
    model = langid.LanguageModel(list("abc"), np.zeros((1, 3)), np.ones((1, 3), bool), float(penalty))
    scores = np.array([s for d in docs for s in d], dtype=float)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    w = langid.Words(np.zeros(0), np.zeros(len(scores)), np.ones(len(scores)), np.zeros(len(scores)), owner, np.zeros(len(scores)))
    model.word_scores = lambda _: scores
    path = model.decode(w, len(docs))
    for d in range(len(docs)):
        own, best = path[owner == d], langid.viterbi(scores[owner == d], penalty)
        value = lambda p, s=scores[owner == d]: s[np.arange(len(p)), p].sum() - penalty * (np.diff(p) != 0).sum()
        assert value(own) == value(best)


def test_scripts_narrow_candidates(spark):
    rows = [(i, "москва и это слова", "ru") for i in range(1, 8)] + [(i, "these are some words", "en") for i in range(11, 18)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict(["совсем другое", "other text"])[0] == ["ru", "en"]


# Quality


def test_em_recovers_labels():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.85, 0.8])
    right = rng.random((4000, 4)) < accuracy
    votes = np.where(right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((4000, 4)) < 0.2] = quality.ABSTAIN
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(rows, counts.astype(float), list("abcd"))
    assert abs(model.prior - 0.8) < 0.05
    assert np.abs(np.array(list(model.accuracies().values())) - accuracy).max() < 0.06
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93


def test_quality_on_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify(docs, quality.fit(docs)).join(labels, "doc_id").collect()
    assert sum(r["quality_keep"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.95
    assert all(0 <= r["quality_score"] <= 1 for r in rows)


def test_quality_odd(spark, odd):
    rows = quality.classify(odd.withColumn("QUALITY_KEEP", F.lit(1)), quality.fit(odd)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if not (r["text"] or "").strip():
            assert (r["quality_score"], r["quality_keep"]) == (0.0, False)
    nothing = quality.fit(empty(spark))
    assert quality.classify(empty(spark), nothing).count() == 0
    assert quality.classify(odd.where("doc_id = 5"), nothing).first()["quality_keep"]


# Licenses


def test_licenses(spark, odd):
    texts = [f"prose\n{licenses.TEMPLATES['MIT']}\nmore", licenses.TEMPLATES["MIT-text"].replace(", ", ",\n"), "Licensed under the Apache License, version 2", "Released under license", licenses.TEMPLATES["MIT"] + "\n" + licenses.TEMPLATES["GPL-3.0"]]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["license"] for r in rows] == ["MIT", "MIT-text", "Apache-2.0", None, "GPL-3.0"]
    assert rows[0]["dice"] == rows[1]["dice"] == 1.0 and 0.8 <= rows[2]["dice"] < 1
    assert rows[4]["licenses"] == ["GPL-3.0", "MIT"] and rows[3]["licenses"] == []
    out = licenses.scan(odd.withColumnRenamed("score", "Dice"))
    assert out.count() == odd.count() and out.where("license is not null").count() == 0
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(odd, templates={}).where("license is not null").count() == 0
    with pytest.raises(ValueError):
        licenses.scan(odd, templates={"x": "word"})


@given(st.integers(1, 400), st.sampled_from([0.5, 0.8, 0.9, 1.0]))
def test_size_bounds_lose_nothing(n, t):
    low, high = licenses.size_bounds(n, t)
    for m in {max(1, low - 1), high + 1} - {low}:
        assert 2 * min(m, n) / (m + n) < t
    assert 2 * min(low, n) / (low + n) >= t
