"""Language identification.

Letters are mapped to scripts by fixed code point ranges; only languages that were seen in the
word's script compete for the word. A word's score for a language is the sum of smoothed log
probabilities of its letter trigrams (with word ends). Viterbi decoding over the words, with a
penalty for each switch, labels spans of mixed-language text; the language with the most letters
is the document's language and its share of the letters is the score.

Scale: the model is a table of ``2**BITS`` rows and one column a language, whatever the corpus.
Training takes at most about ``max_docs_per_lang`` documents of each language, chosen by a hash
of the id; counts are summed on the executors. Prediction is one narrow pass.

Defined cases: a null text, and a text without a letter, give ``und``, score 0 and no spans. A
null id is never held out and never trained on. Equal totals go to the alphabetically first
language. Without any training row every text is ``und``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import annotate, slices

BITS = 16
UNDETERMINED = "und"

#: First and last code point of the scripts told apart (Unicode blocks).
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF),
    ("hiragana", 0x3040, 0x309F),
    ("katakana", 0x30A0, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("han", 0x20000, 0x2FA1F),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter; its lower case; its script's number."""
    top = 0x110000
    letter = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(top)), bool, top)
    lower = np.arange(top, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        if len(low := chr(i).lower()) == 1:
            lower[i] = ord(low)
    script = np.zeros(top, dtype=np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return letter, lower, script


@dataclass
class Words:
    """The words (runs of letters) of many texts, laid end to end."""

    features: np.ndarray  # of each letter: the trigram's slot
    first: np.ndarray  # of each word: its first letter, as an index of ``features``
    letters: np.ndarray  # of each word
    script: np.ndarray  # of each word, by its first letter
    doc: np.ndarray  # of each word: the text's number
    begin: np.ndarray  # of each word: code points before it in its text


def words_of(texts: list[str | None]) -> Words:
    letter, lower, script = _tables()
    joined = "\n".join(t or "" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    is_letter = letter[points]
    low = np.where(is_letter, lower[points], 0).astype(np.uint32)
    at = np.flatnonzero(is_letter)
    previous, following = np.r_[np.uint32(0), low[:-1]], np.r_[low[1:], np.uint32(0)]
    mixed = (previous[at] * np.uint32(0x9E3779B1)) ^ (low[at] * np.uint32(0x85EBCA77)) ^ (following[at] * np.uint32(0xC2B2AE3D))
    features = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    new_word = np.r_[True, np.diff(at) > 1] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new_word)
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    start = at[first]
    doc = np.searchsorted(ends, start, side="right")
    return Words(features, first, np.diff(np.r_[first, len(at)]), script[points[start]], doc, start - np.r_[0, ends][doc])


@dataclass
class LanguageModel:
    langs: list[str]
    log_p: np.ndarray  # (2**BITS, languages) float32
    has_script: np.ndarray  # (scripts, languages) bool
    switch_penalty: float = 14.0

    def word_scores(self, words: Words) -> np.ndarray:
        if not len(words.first):
            return np.zeros((0, len(self.langs)))
        scores = np.add.reduceat(self.log_p[words.features], words.first, axis=0).astype(np.float64)
        allowed = self.has_script[words.script]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        return np.where(allowed, scores, scores.min(axis=1, keepdims=True) - 20.0 * words.letters[:, None])

    def decode(self, words: Words, n_docs: int) -> np.ndarray:
        """The language number of every word on the best path of its text."""
        scores = self.word_scores(words)
        n, k = scores.shape
        if not n or k < 2:
            return np.zeros(n, dtype=np.int64)
        bounds = np.searchsorted(words.doc, np.arange(n_docs + 1))
        busy = np.flatnonzero(np.diff(bounds))
        best = np.zeros(n_docs, dtype=np.int64)
        best[busy] = np.add.reduceat(scores, bounds[busy], axis=0).argmax(axis=1)
        path = best[words.doc]
        # A path that leaves the best single language for some words gains at most the sum of
        # ``gain`` over them and pays the penalty; so nothing can leave it where no run of
        # words sums to more than the penalty, and only the other texts need Viterbi.
        rows = np.arange(n)
        own = scores[rows, path]
        rest = scores.copy()
        rest[rows, path] = -np.inf
        gain = rest.max(axis=1) - own
        total = np.cumsum(gain)
        drop = words.doc * (2.0 * np.abs(gain).sum() + 1.0)
        lowest = np.minimum.accumulate(total - gain - drop) + drop
        over = np.unique(words.doc[total - lowest > self.switch_penalty])
        for d in over.tolist():
            a, b = bounds[d], bounds[d + 1]
            path[a:b] = viterbi(scores[a:b], self.switch_penalty)
        return path

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
        words = words_of(texts)
        path = self.decode(words, len(texts)) if self.langs else np.zeros(len(words.first), dtype=np.int64)
        k = max(1, len(self.langs))
        weight = np.bincount(words.doc * k + path, weights=words.letters, minlength=len(texts) * k).reshape(-1, k)
        total, best = weight.sum(axis=1), weight.argmax(axis=1)
        known = (total > 0) & bool(self.langs)
        langs = [self.langs[j] if ok else UNDETERMINED for j, ok in zip(best.tolist(), known.tolist(), strict=True)]
        score = np.where(known, weight.max(axis=1) / np.maximum(total, 1), 0.0).tolist()
        spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if self.langs and len(path):
            cut = np.flatnonzero(np.r_[True, (np.diff(path) != 0) | (np.diff(words.doc) != 0)])
            last = np.r_[cut[1:], len(path)] - 1
            for d, a, e, j in zip(words.doc[cut].tolist(), words.begin[cut].tolist(), (words.begin + words.letters)[last].tolist(), path[cut].tolist(), strict=True):
                spans[d].append((a, e, self.langs[j]))
        return langs, score, spans


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best path through (steps, states) scores when every change of state costs ``penalty``."""
    n, k = scores.shape
    rows = scores.tolist()
    value, back = rows[0], []
    states = range(k)
    for row in rows[1:]:
        top = max(value)
        source = value.index(top)
        limit = top - penalty
        back.append([j if value[j] >= limit else source for j in states])
        value = [(value[j] if value[j] >= limit else limit) + row[j] for j in states]
    state = value.index(max(value))
    path = [state]
    for step in reversed(back):
        state = step[state]
        path.append(state)
    return np.array(path[::-1], dtype=np.int64)


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs_per_lang: int = 4000, max_langs: int = 500, switch_penalty: float = 14.0) -> LanguageModel:
    """Learns from documents that are not held out, about ``max_docs_per_lang`` of each language.

    ``max_langs`` bounds the model; more languages are an error, none is left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & ~is_held_out(F.col("id")))
    sizes = rows.groupBy("lang").count().limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool), switch_penalty)
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1 << 20, int((1 << 20) * max_docs_per_lang / r["count"]) + 1))])
    sample = rows.where(F.pmod(F.xxhash64(F.col("id"), F.lit("langid")), F.lit(1 << 20)) < rate[F.col("lang")])
    number = {lang: i for i, lang in enumerate(langs)}
    slots = 1 << BITS

    def count(batches):
        sums = {}
        for batch in batches:
            texts, of = batch.column(0), batch.column(1).to_pylist()
            for start, length in slices(texts):
                words = words_of(texts.slice(start, length).to_pylist())
                lang = np.array([number[x] for x in of[start : start + length]])
                of_word = lang[words.doc]
                of_letter = np.repeat(of_word, words.letters)
                for j in np.unique(of_word).tolist():
                    if j not in sums:
                        sums[j] = np.zeros(slots + len(SCRIPT_NAMES), np.int64)
                    sums[j][:slots] += np.bincount(words.features[of_letter == j], minlength=slots)
                    sums[j][slots:] += np.bincount(words.script[of_word == j], minlength=len(SCRIPT_NAMES))
        for j, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at])], names=["lang", "slot", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    x = np.zeros((slots + len(SCRIPT_NAMES), len(langs)))
    x[counts["slot"].to_numpy(int), counts["lang"].to_numpy(int)] = counts["n"].to_numpy(float)
    grams, scripts = x[:slots], x[slots:]
    log_p = np.log(grams + 0.1) - np.log(grams.sum(axis=0) + 0.1 * slots)
    return LanguageModel(langs, log_p.astype(np.float32), scripts > 0.001 * np.maximum(scripts.sum(axis=0), 1), switch_penalty)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """``docs[keep]`` with ``lang_pred``, ``score`` and, if asked for, ``lang_spans`` (code point ranges)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB a language, whatever the corpus
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        learned = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            langs, score, found = learned.predict(texts.to_pylist())
            out = [pa.array(langs, pa.string()), pa.array(score, pa.float64())]
            return [*out, pa.array([[dict(zip(("begin", "end", "lang"), s, strict=True)) for s in x] for x in found], kind)] if spans else out

        return work

    new = "lang_pred string, score double" + ", lang_spans array<struct<begin:int,end:int,lang:string>>" * spans
    return annotate(docs, text_col, make, new, keep)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Fits on the documents that are not held out and labels every document."""
    model = fit(docs, id_col, text_col, lang_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = predict(rows.withColumn("held_out", is_held_out(F.col("doc_id"))), model, "text", ["doc_id", "held_out"])
    return out.withColumn("n_spans", F.size("lang_spans"))
