"""Token counts by section, from one encoding of each whole document.

A document is encoded once, by a byte-level BPE of the tiktoken kind. Its tokens' bytes, laid
end to end, are the document's, so a running sum of their lengths maps each token to its
byte span. The sections' spans are joined to the tokens' as intervals (both are sorted, so by
binary search), and a token that crosses a boundary is allocated by an explicit rule:

* ``first``: to the section with the token's first byte;
* ``most``: to the section with most of its bytes, on a tie to the earlier one.

The sections' counts always sum to the document's tokens.

Scale: one narrow pass, a row for each document with an array of its sections; the vocabulary
(under 1 MB) is broadcast.

Runs of over ``LONG_BLANKS`` blanks would overflow the tokeniser's regular expression. The pattern
takes such a run, but for its last blank if a word follows, as one piece; that piece is encoded
past the expression, and what lies between such runs by it, which gives the same tokens.

Defined cases: null and empty texts have no tokens and no sections; a text without line feeds is
one section; the line feed belongs to the line that it ends; special tokens' strings are
ordinary text. Extra columns are kept as asked for.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from quern.llm.common import annotate

RULES = ("first", "most")
LONG_BLANKS = 10_000
#: White space as the tokeniser's expression knows it (Unicode's White_Space).
_LONG_RUN = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_BLANKS + 1},}}")


def encode(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """The text's tokens; special tokens' strings are ordinary text."""
    out, at = [], 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def line_bounds(raw: bytes) -> np.ndarray:
    """Where the lines of a text end, in bytes."""
    ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 0x0A) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.r_[ends, len(raw)]


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. Empty sections have none."""
    if not len(token_ends):
        return np.zeros(len(section_ends), dtype=np.int64)
    begin = np.r_[0, token_ends[:-1]]
    section = np.searchsorted(section_ends, begin, side="right")
    if rule == "most":
        last = np.searchsorted(section_ends, token_ends, side="left")
        for t in np.flatnonzero(last > section).tolist():
            inside = np.arange(section[t], last[t] + 1)
            edges = np.minimum(section_ends[inside], token_ends[t])
            section[t] = inside[np.argmax(np.diff(np.r_[begin[t], edges]))]
    return np.bincount(section, minlength=len(section_ends))


def count(docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, rule: str = "first") -> DataFrame:
    """``docs[keep]`` with n_tokens, n_sections, n_crossing and section_tokens (of each line)."""
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        encoding = tiktoken.Encoding("documents", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        lengths = np.zeros(max(shared.value.values()) + 1, dtype=np.int64)
        for token, rank in shared.value.items():
            lengths[rank] = len(token)

        def work(texts: pa.Array) -> list[pa.Array]:
            totals, sections, crossings, counts = [], [], [], []
            for text in texts.to_pylist():
                if not text:
                    totals.append(0)
                    sections.append(0)
                    crossings.append(0)
                    counts.append([])
                    continue
                ends = np.cumsum(lengths[np.array(encode(encoding, text), dtype=np.int64)])
                raw = text.encode()
                if ends[-1] != len(raw):
                    raise AssertionError("the tokens' bytes are not the text's")
                bounds = line_bounds(raw)
                first, last = np.searchsorted(bounds, np.r_[0, ends[:-1]], side="right"), np.searchsorted(bounds, ends, side="left")
                totals.append(len(ends))
                sections.append(len(bounds))
                crossings.append(int((last > first).sum()))
                counts.append(allocate(ends, bounds, rule).tolist())
            return [pa.array(totals, pa.int64()), pa.array(sections, pa.int64()), pa.array(crossings, pa.int64()), pa.array(counts, pa.list_(pa.int64()))]

        return work

    return annotate(docs, text_col, make, "n_tokens long, n_sections long, n_crossing long, section_tokens array<long>", keep)
