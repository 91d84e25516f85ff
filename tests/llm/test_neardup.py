"""Near-dedup of the pipeline against brute-force Jaccard similarity of 5-word shingles."""

import random

import pytest

import corpus_pipeline
from quern.llm import neardup


def brute_kept(docs):
    def shingles(text):
        words = (text or "").split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return {min(d for (d, _), r in zip(docs, root, strict=True) if r == x) for x in set(root)}


def made():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    texts = ["", None, " \n", "one two", "one  two", "a b c d"]
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([8, 40, 150, 400]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(2, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: rnd.choice([len(copy), len(copy), len(copy) * 9 // 10])]))
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [neardup.BLOCK, 3])
def test_all_near_copies(spark, block):
    docs = made()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in neardup.keep_first(df, block=block).collect()} == brute_kept([(d, (t or "").lower()) for d, t in docs])


def test_the_stage_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{folder}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, folder).collect()}
    assert kept == brute_kept([(d, (t or "").encode().lower().decode()) for d, t in docs])
    assert 1 in kept and 177 not in kept  # 0.83 similar, 9 bits of their fingerprints differ


def test_null_ids_and_repeated_rows(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text.upper())], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in neardup.keep_first(df).collect()) == ["1", "None"]
    assert neardup.keep_first(df.where("false")).count() == 0


def test_a_pair_is_a_row_at_its_first_key_only(spark):
    """Of two texts whose first keys tell where they meet, one row; with later keys only, one at each."""
    sketch = [0] * neardup.SKETCH_LONGS
    # Node: its keys, in order. The last one, of another size, has all of them.
    lists = {1: range(1, 31), 2: range(3, 33), 3: range(29, 60), 4: range(1, 60)}
    rest = spark.createDataFrame([(k, n, p, n) for n, keys in lists.items() for p, k in enumerate(keys)], "key long, node long, pos long, root long")
    info = spark.createDataFrame([(n, 3000 if n == 4 else 300, sketch) for n in lists], "node long, size long, sketch array<long>")
    for block in (neardup.BLOCK, 1):
        rows = [(r["a"], r["b"]) for r in neardup._between_roots(rest, info, block, True).collect()]
        # 1 and 2 share 28 keys, the first of them among the first of both; the others share 2 and 4, all
        # behind the first ones of one text.
        assert sorted(rows) == [(1, 2), *[(1, 3)] * 2, *[(2, 3)] * 4]
