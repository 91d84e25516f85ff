"""Benchmark decontamination by word n-grams.

A broadcast hash set of the benchmark's windows is scanned against every window of every
document. Words become numbers by a dictionary of the benchmark's words (0: not in it, so no
window can hold it), windows of numbers get a rolling 64-bit hash, and a window whose hash is in
the set is confirmed word for word. Documents, or only the covered spans, can then be removed.

Scale: one narrow pass over the documents, no shuffle. The benchmark is broadcast only in parts
of at most ``max_broadcast_bytes`` of text; a larger one is scanned part after part in the same
stage, each part adding its spans and items to the row.

Defined cases: a null text has no words; an item with fewer words than a window is one window
of its own length, an item without words has none; an item of null id takes part in hits but
is not listed; items with one id count once; empty tables give empty results or no hits.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import annotate

N = 10

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII digits, letters (lower-cased) and anything beyond ASCII."""
    return (text or "").encode().translate(_FOLD).split()


class Windows:
    """The distinct windows of a set of items, by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = N):
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.names = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                size = min(n, len(ids))
                found = by_length.setdefault(size, {})
                for i in range(len(ids) - size + 1):
                    found.setdefault(tuple(ids[i : i + size]), set()).add(k)
        self.by_length = {}
        for size, found in sorted(by_length.items()):
            rows = np.array(list(found), dtype=np.int32).reshape(len(found), size)
            seed = 1
            while True:  # until the hash has no collision among the windows
                weights = self._weights(seed)
                hashes = weights[rows[:, 0]].copy()
                for j in range(1, size):
                    hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + weights[rows[:, j]]
                order = np.argsort(hashes)
                if (np.diff(hashes[order]) != 0).all():
                    break
                seed += 1
            owners = list(found.values())
            self.by_length[size] = (hashes[order], rows[order], [sorted(owners[i]) for i in order.tolist()], seed)

    def _weights(self, seed: int) -> np.ndarray:
        return np.random.default_rng(seed).integers(0, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64)

    def scan(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """Of each text: its number of words, the covered word ranges, and the items found."""
        ids: list[int] = []
        counts: list[int] = []
        get = self.vocabulary.get
        for t in texts:
            words = words_of(t)
            counts.append(len(words))
            ids.extend(map(get, words, repeat(0)))
            ids.append(0)  # no window goes over the end of a text
        numbers = np.array(ids, dtype=np.int32)
        starts = np.cumsum([0, *(c + 1 for c in counts)])
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        owners: list[set[int]] = [set() for _ in texts]
        run = self._run_lengths(numbers)
        delta = np.zeros(len(numbers) + 1, dtype=np.int64)
        for size, (hashes, rows, of, seed) in self.by_length.items():
            at = np.flatnonzero(run >= size)
            if not len(at):
                continue
            weights = self._weights(seed)[numbers] if size > 1 or len(at) else None
            rolled = weights[at]
            for j in range(1, size):
                rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + weights[at + j]
            place = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            hit = hashes[place] == rolled
            at, place = at[hit], place[hit]
            same = np.ones(len(at), dtype=bool)
            for j in range(size):
                same &= numbers[at + j] == rows[place, j]
            at, place = at[same], place[same]
            np.add.at(delta, at, 1)
            np.add.at(delta, at + size, -1)
            for d, p in zip((np.searchsorted(starts, at, side="right") - 1).tolist(), place.tolist(), strict=True):
                owners[d].update(of[p])
        covered = np.r_[0, np.cumsum(delta[:-1]) > 0, 0].astype(np.int8)
        edges = np.diff(covered)
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        of_doc = np.searchsorted(starts, begin, side="right") - 1
        for d, a, b in zip(of_doc.tolist(), (begin - starts[of_doc]).tolist(), (end - starts[of_doc]).tolist(), strict=True):
            spans[d].append((a, b))
        return counts, spans, [[self.names[k] for k in sorted(x) if self.names[k] is not None] for x in owners]

    @staticmethod
    def _run_lengths(numbers: np.ndarray) -> np.ndarray:
        """At each place, how many known words follow one another from there on."""
        gaps = np.flatnonzero(numbers == 0)
        if not len(gaps):
            return np.zeros(0, dtype=np.int64)
        return gaps[np.searchsorted(gaps, np.arange(len(numbers)))] - np.arange(len(numbers))


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, n: int = N, max_broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``docs[keep]`` with n_words, hit_spans (word ranges), items, n_hit, n_items, contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // max_broadcast_bytes))
    keep = docs.columns if keep is None else keep
    keep = [c for c in keep if c.lower() not in ("n_words", "hit_spans", "items", "n_hit", "n_items", "contaminated")]
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__scanned"))
    for p in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p)
        shared = spark.sparkContext.broadcast([(r["id"], r["text"]) for r in part.toLocalIterator()])

        def make(shared=shared) -> Callable[[pa.Array], list[pa.Array]]:
            windows = Windows(shared.value, n)
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

            def work(texts: pa.Array) -> list[pa.Array]:
                counts, spans, found = windows.scan(texts.to_pylist())
                return [pa.array(counts, pa.int64()), pa.array([[{"begin": a, "end": b} for a, b in x] for x in spans], kind), pa.array(found, pa.list_(pa.string()))]

            return work

        out = annotate(out, "__scanned", make, f"n_words long, __spans{p} array<struct<begin:long,end:long>>, __items{p} array<string>", [*keep, *(f"__{x}{q}" for q in range(p) for x in ("spans", "items")), *(["__scanned"] if p < parts - 1 else [])])
    spans = F.array_sort(F.concat(*(F.col(f"__spans{p}") for p in range(parts))))
    merged = F.aggregate(
        spans,
        F.lit(None).cast("array<struct<begin:bigint,end:bigint>>"),
        lambda done, s: F.when(done.isNull(), F.array(s))
        .when(F.element_at(done, -1)["end"] >= s["begin"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["begin"].alias("begin"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))),
    )
    hit_spans = F.col("__spans0") if parts == 1 else F.coalesce(merged, F.array().cast("array<struct<begin:bigint,end:bigint>>"))
    out = out.select(*keep, "n_words", hit_spans.alias("hit_spans"), F.array_sort(F.array_distinct(F.concat(*(F.col(f"__items{p}") for p in range(parts))))).alias("items"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return out.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "contaminated": hit > 0})


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns as they were, without the contaminated ones."""
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    marked = mark(renamed, benchmark, f"c{names.index(text_col)}", **options)
    return marked.where(~F.col("contaminated")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what lies between them."""
    if text is None or not spans:
        return text
    raw = text.encode()
    folded = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8) != 0x20
    edges = np.diff(np.r_[0, folded, 0].astype(np.int8))
    begin, end = np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : begin[a]])
        at = end[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with the covered words cut from the text; the other columns as they were."""
    names = docs.columns
    marked = mark(docs.toDF(*[f"c{i}" for i in range(len(names))]), benchmark, f"c{names.index(text_col)}", **options)
    cut = F.pandas_udf(lambda t, s: t.combine(s, lambda x, y: cut_spans(x, [(p["begin"], p["end"]) for p in y])), "string")
    column = f"c{names.index(text_col)}"
    marked = marked.withColumn(column, F.when(F.col("contaminated"), cut(column, "hit_spans")).otherwise(F.col(column)))
    return marked.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
