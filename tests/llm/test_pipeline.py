"""The corpus pipeline on a small corpus, stage by stage."""

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from quern.llm import decontaminate, langid, quality, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas().set_index("doc_id")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.toPandas().set_index("doc_id"))
    return out


def test_columns_and_rows(stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert list(after.columns) == list(before.columns) == corpus_pipeline.COLUMNS[1:]
        assert set(after.index) <= set(before.index) and len(after) > 0
        assert (after["text"] == before.loc[after.index, "text"]).all()


def test_decisions(spark, stages):
    docs, by_language, good, single, clean, tokens = stages
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    langs, scores, _ = model.predict(docs["text"].tolist())
    assert {d for d, lang, s in zip(docs.index, langs, scores, strict=True) if lang != "und" and s >= 0.5} == set(by_language.index)
    rows = spark.createDataFrame([(int(d), t) for d, t in by_language["text"].items()], "doc_id long, text string")
    assert {r["doc_id"] for r in quality.classify(rows, quality.fit(rows)).where("quality_keep").collect()} == set(good.index)

    prints = {d: simhash.fingerprint(t) for d, t in good["text"].items()}
    root = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if root[a] < root[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[b], changed = root[a], True
    assert {d for d in root if root[d] == d} == set(single.index)

    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    _, spans, _ = decontaminate.Windows(items).scan(single["text"].tolist())
    assert {d for d, s in zip(single.index, spans, strict=True) if not s} == set(clean.index)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(tokens.index) == set(clean.index)
    for d, t in clean["text"].items():
        assert list(tokens.loc[d, "ids"]) == library.encode(t, add_bos=True, add_eos=True)


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    docs, by_language, good = stages[:3]
    clean = [d for d in labels.index[labels["quality"] == 1] if d in docs.index]
    assert sum(d in good.index for d in clean) / len(clean) > 0.96
    junk = [d for d in labels.index[labels["quality"] == 0] if d in docs.index]
    assert sum(d in good.index for d in junk) / len(junk) < 0.1


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out["doc_id"]) == set(stages[-1].index)


def test_an_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
