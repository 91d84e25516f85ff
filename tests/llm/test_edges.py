"""Inputs at the edge: very long texts, odd JSON, clashing names, notices in unusual places."""

import json

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import chat, decontaminate, langid, licenses, neardup, quality, sentencepiece_codec, simhash, token_counts, urlfilter

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = {"blanks": " " * 1_000_000, "one word": "x" * 1_000_000, "lines": "word\n" * 200_000, "words": "the cat sat on a mat " * 50_000, "five": "some words of a text " * 238_000}


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(LONG.values())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").cache()


def test_long_texts_by_operator(spark, long_docs):
    n = len(LONG)
    bench = spark.createDataFrame([("i", "cat sat on a mat the cat sat on a mat")], "item_id string, text string")
    assert quality.classify(long_docs, quality.fit(long_docs)).count() == n
    assert simhash.deduplicate(long_docs).count() == n
    hits = {r["doc_id"]: r["n_hit"] for r in decontaminate.mark(long_docs, bench, keep=["doc_id"]).collect()}
    assert hits == {0: 0, 1: 0, 2: 0, 3: 299_999, 4: 0}  # all words but the first "the"
    assert langid.predict(long_docs, langid.fit(long_docs), "text", ["doc_id"]).count() == n
    assert licenses.scan(long_docs).where("license is not null").count() == 0
    assert {r["doc_id"] for r in neardup.keep_first(long_docs).select("doc_id").collect()} == set(range(n))
    ids = {r["doc_id"]: r["n_tokens"] for r in sentencepiece_codec.encode(long_docs, MODEL, "text", ["doc_id"], with_ids=False).collect()}
    assert len(ids) == n and min(ids.values()) >= 2


def test_long_texts_by_stage(spark, long_docs, tmp_path):
    docs = long_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(f"{tmp_path}/{name}")
        assert {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/{name}").select("doc_id").collect()} <= set(range(len(LONG)))


def test_token_counts_of_long_blanks(spark, monkeypatch):
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_counts.read_ranks(VOCABULARY), special_tokens={})
    texts = ["a" + b * n + tail for b in (" ", "\n", "　", " \t") for n in (1, 5, 6, 40) for tail in ("", "b", "é b", "\x1cq", "1", "!")]
    monkeypatch.setattr(token_counts, "LONG_BLANKS", 5)
    monkeypatch.setattr(token_counts, "_LONG_RUN", token_counts.re.compile(token_counts._LONG_RUN.pattern.replace("{10001,}", "{6,}")))
    assert [token_counts.encode(encoding, t) for t in texts] == [encoding.encode_ordinary(t) for t in texts]
    monkeypatch.undo()
    df = spark.createDataFrame([(0, LONG["blanks"]), (1, LONG["blanks"] + "end\nof"), (2, LONG["one word"])], "doc_id long, text string")
    rows = token_counts.count(df, VOCABULARY, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [sum(r["section_tokens"]) for r in rows] == [r["n_tokens"] for r in rows]
    assert [r["n_sections"] for r in rows] == [1, 2, 1]


def test_sections_by_brute_force(spark):
    texts = ["one two\nthree\n\nfour", "a\r\nb\x00\nc", "naïve\n世界 text\n", "\n\n\n", "x" * 50 + "\n" + " " * 30 + "y"]
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_counts.read_ranks(VOCABULARY), special_tokens={})
    for rule in token_counts.RULES:
        rows = token_counts.count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCABULARY, public_tokenizers.PATTERN, rule=rule).orderBy("doc_id").collect()
        for text, row in zip(texts, rows, strict=True):
            line_of = [i for i, line in enumerate(text.encode().split(b"\n")) for _ in line + b"\n"][: len(text.encode())]
            counts, crossing, at = [0] * (line_of[-1] + 1), 0, 0
            for token in encoding.encode_ordinary(text):
                own = line_of[at : at + len(encoding.decode_single_token_bytes(token))]
                at += len(own)
                crossing += len(set(own)) > 1
                counts[own[0] if rule == "first" else max(dict.fromkeys(own), key=own.count)] += 1
            assert (row["section_tokens"], row["n_crossing"]) == (counts, crossing)


SCHEMAS = {"f": {"a": {"minimum": 3}, "b": {"min_length": 2}}}


def linked(spark, calls, results=()):
    c = spark.createDataFrame([(1, *x) for x in calls], chat.CALLS)
    return chat.link(c, spark.createDataFrame([(1, *x) for x in results], chat.RESULTS), SCHEMAS).collect()


@pytest.mark.parametrize("arguments", ['{"a": NaN}', '{"a": 1e999}', "[" * 200_000, "[" * 200_000 + "]" * 200_000])
def test_arguments_that_are_no_json(spark, arguments):
    (row,) = linked(spark, [("i", 1, 0, "f", arguments, [])])
    assert json.loads(row["message"])["call"]["arguments"] is None and row["errors"] == ["arguments are not an object"]


def test_surrogates_and_untyped_rules(spark):
    (row,) = linked(spark, [("i", 1, 0, "f", '{"a": "\\ud800", "b": 7, "\\udfff": 1}', [])])
    assert row["errors"] == ["\\udfff: unknown"] and '"a":"\\ud800"' in row["message"]
    assert json.loads(row["message"])["call"]["arguments"]["b"] == 7
    (row,) = linked(spark, [("i", 1, 0, "f", '{"a": 1, "b": "x"}', [])])
    assert row["errors"] == ["a: below 3", "b: shorter than 2"]


def test_null_ids_link_to_nothing(spark):
    rows = linked(spark, [(None, 1, 0, "f", "{}", [])], [(None, 1, "{}")])
    assert sorted(r["status"] for r in rows) == ["no_call", "no_result"]


def test_answers_are_counted(spark):
    (row,) = linked(spark, [("i", 1, 0, "f", "{}", [])], [("i", 3, "later"), ("i", 2, "first")])
    assert (row["answers"], row["result_turn"], row["copies"]) == (2, 2, 1)


def test_long_chains_are_levelled_or_an_error(spark):
    waits = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("b", None), ("c", None)], "k string, w string")
    assert {r["k"]: r["level"] for r in chat.levels(waits, max_rounds=3).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(RuntimeError, match="more than 2 levels"):
        chat.levels(waits, max_rounds=2)


def test_url_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", "mine", "too", 3)], "page_id long, url string, u string, won string, n int")
    rules = spark.createDataFrame([("block", "org", "/x"), ("allow", "org", "/x"), ("allow", None, "/")], "action string, host string, path string")
    for r in (rules, [("block", "org", "/x")]):
        row = urlfilter.judge(df, r).first()
        assert (row["u"], row["won"], row["n"], row["rule"], row["verdict"]) == ("mine", "too", 3, "org/x", "block")


def test_many_url_rules(spark):
    rules = [("block", f"h{i % 500}.net", "/" + "p" * (i // 500)) for i in range(20_000)]
    df = spark.createDataFrame([(1, "http://x.h7.net/ppppq"), (2, "http://" + "a." * 30_000 + "net/p")], "page_id long, url string")
    rows = urlfilter.judge(df, rules).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in rows] == [("h7.net/pppp", "block"), (None, "allow")]


def test_equal_length_rules_go_to_the_longer_host(spark):
    df = spark.createDataFrame([(1, "http://b.org/xy")], "page_id long, url string")
    assert urlfilter.judge(df, [("allow", "org", "/xy"), ("block", "b.org", "/")]).first()["rule"] == "b.org/"
    assert urlfilter.judge(df, [("allow", "org", "/xy"), ("block", "b.org", "")]).first()["rule"] == "org/xy"


def test_notices_in_unusual_places(spark):
    header = licenses.TEMPLATES["GPL-3.0-header"].replace(". ", ".\n\n").replace(" the ", "\nthe ")
    wrapped = licenses.TEMPLATES["BSD-2-Clause"].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ")
    texts = [header + "\n\nint main() { return 0; }\n" * 40, "x = 1\n" * 100 + wrapped + "\n" * 3 + "y = 2\n" * 100, "Some prose before it. Released under the MIT License. And then more prose follows here.", "plain prose " * 300, licenses.TEMPLATES["MIT-text"] + " " + "word " * 5000]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["license"] for r in rows] == ["GPL-3.0-header", "BSD-2-Clause", "MIT", None, "MIT-text"]


def test_equal_dice_goes_to_the_first_name(spark):
    df = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    row = licenses.scan(df, templates={"b": "one two three four", "a": "one two three four"}).first()
    assert (row["license"], row["licenses"]) == ("a", ["a", "b"])


def test_many_templates(spark):
    templates = {f"t{i:04}": f"notice number {i} of the series number {i} stands here" for i in range(1000)}
    df = spark.createDataFrame([(1, "see " + templates["t0777"] + " and nothing else")], "doc_id long, text string")
    out = licenses.scan(df, templates=templates)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 1_000_000 and out.first()["license"] == "t0777"


def test_the_sample_counts_copies_once(spark):
    rows = [(i, f"text number {i % 40} with some words to learn from and more of them") for i in range(4000)]
    scorer = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), max_train_docs=40)
    assert (scorer.weights != 0).sum() > 3
    nothing = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), max_train_docs=-1)
    assert nothing.bias != 0 and not nothing.weights.any()


def test_one_large_group_of_near_copies(spark):
    """5,000 distinct fingerprints within four bits of one, over many partitions: one component, no link lost."""
    base = 0x0123456789ABCDEF
    prints = {base}
    for a in range(64):
        for b in range(a + 1, 64):
            prints.add(base ^ (1 << a) ^ (1 << b))
            if len(prints) < 5000:
                prints.add(base ^ (1 << a) ^ (1 << b) ^ (1 << ((a + b) % 64)))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "simhash long").repartition(16)
    from quern.llm import components

    roots = components.components(simhash.link_fingerprints(df))
    assert roots.count() == len(signed) and roots.select("root").distinct().count() == 1


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from quern.llm import common

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)


def test_clashing_names_in_the_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    for c in ("lang_pred", "score", "quality_score", "quality_keep", "n_words", "items", "node", "simhash"):
        docs = docs.withColumn(c, F.lit("own"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == corpus_pipeline.COLUMNS
