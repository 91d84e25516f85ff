"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs that form a piece, ordered by score and then
from left to right, and merges its first entry until it is empty. Symbols that are no piece fall
back to bytes. Spaces become the meta symbol and one is put in front of the text.

A piece has the meta symbol only at its front (or is made of it), and none has a line feed
inside; both are read off the vocabulary. So no merge goes over the start of a run of meta
symbols or over a line feed, and the text's units between those places have agendas of their
own. The units of an Arrow batch are encoded side by side, each agenda being a row of an array
of pair ranks; long units get a heap. Units seen before are kept in a bounded cache.

The library checks each batch: every unit that is new is encoded with it too, and a difference
is an error. Decoding is the library's.

Scale: one narrow pass; the model (under 1 MB) is broadcast; memory is bounded by the slice of
text at hand, its longest unit, and ``CACHE_UNITS``.

Defined cases: a null text is encoded as the empty one; the empty text has no pieces, only the
begin and end ids if asked for. A vocabulary that breaks the assumption about the meta symbol is
encoded with whole texts as units. Models of another type, with a normaliser, or with
user-defined pieces are refused with ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from quern.llm.common import annotate

META = "▁"
CACHE_UNITS = 400_000
#: Longer units (in symbols) get a heap of their own; shorter ones are rows of an array.
ROW_SYMBOLS = 24
NONE = np.int32(2**31 - 1)


class Codec:
    """Encodes and decodes with one model, given as its bytes."""

    def __init__(self, model: bytes, check: bool = True):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        normal = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no other normalisation")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.check = check
        self.pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        scores = {i: proto.pieces[i].score for i in self.pieces.values()}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {i: ranks[s] for i, s in scores.items()}
        inside = any(META in p.lstrip(META) for p in self.pieces)
        feeds = any("\n" in p and len(p) > 1 for p in self.pieces)
        self.unit = re.compile("(?s:.+)" if inside else f"{META}+[^{META}]*|[^{META}]+" if feeds else f"{META}+[^{META}\n]*|\n[^{META}\n]*|[^{META}\n]+")
        # Symbols of the row agendas: pieces keep their ids, other characters get ids beyond.
        self.size = len(proto.pieces)
        keys, made = [], []
        for piece, i in self.pieces.items():
            for cut in range(1, len(piece)):
                a, b = self.pieces.get(piece[:cut]), self.pieces.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    made.append(i)
        order = np.argsort(keys)
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_piece = np.array(made, dtype=np.int32)[order]
        by_piece = np.full(self.size, NONE, dtype=np.int32)
        by_piece[list(self.rank)] = list(self.rank.values())
        self.pair_rank = by_piece[self.pair_piece]
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in self.pieces.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        self.cache: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.cache.clear()
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)

    def _fallback(self, symbol: str) -> list[int]:
        i = self.pieces.get(symbol)
        return [i] if i is not None else [self.bytes[b] for b in symbol.encode()]

    def agenda(self, unit: str) -> list[int]:
        """The ids of one unit by a heap of (rank, left place, lengths) entries."""
        symbols: list[str] = list(unit)
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            i = self.pieces.get(symbols[left] + symbols[right])
            if i is not None:
                heapq.heappush(heap, (self.rank[i], left, right, len(symbols[left]) + len(symbols[right])))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        while heap:
            _, left, right, length = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != length:
                continue  # one of the two was merged meanwhile
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [i for s in symbols if s for i in self._fallback(s)]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; NONE if they form no piece."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_rank[at], NONE), np.where(found, self.pair_piece[at], -1)

    def rows(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short units, end to end, and how many each has; one agenda a row."""
        lengths = np.array([len(u) for u in units])
        points = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        n, width = len(units), int(lengths.max())
        filled = np.arange(width) < lengths[:, None]
        symbol = np.full((n, width), -1, dtype=np.int32)
        symbol[filled] = self.chars[points]
        unknown = filled & (symbol < 0)
        code = np.zeros((n, width), dtype=np.int32)
        code[filled] = points
        symbol[unknown] = -2 - code[unknown]
        rank = np.full((n, width), NONE, dtype=np.int32)
        piece = np.full((n, width), -1, dtype=np.int32)
        if width > 1:
            rank[:, :-1], piece[:, :-1] = self._pairs(symbol[:, :-1], symbol[:, 1:])
        out_symbol, out_length = symbol.copy(), lengths.copy()
        live = np.arange(n)
        while len(live):
            at = rank.argmin(axis=1)  # the first entry of each agenda: best score, then leftmost
            row = np.arange(len(live))
            more = rank[row, at] != NONE
            if not more.all():
                out_symbol[live[~more], : symbol.shape[1]] = symbol[~more]
                live, symbol, rank, piece, at = live[more], symbol[more], rank[more], piece[more], at[more]
                row = np.arange(len(live))
                if not len(live):
                    break
            out_length[live] -= 1
            width = symbol.shape[1]
            merged = piece[row, at]
            column = np.arange(width - 1)
            take = column + (column > at[:, None])
            symbol = np.take_along_axis(symbol, take, axis=1)
            rank = np.take_along_axis(rank, take, axis=1)
            piece = np.take_along_axis(piece, take, axis=1)
            symbol[row, at] = merged
            right = np.where(at + 1 < width - 1, symbol[row, np.minimum(at + 1, width - 2)], -1)
            rank[row, at], piece[row, at] = self._pairs(merged, right)
            inner = at > 0
            r, a = row[inner], at[inner]
            rank[r, a - 1], piece[r, a - 1] = self._pairs(symbol[r, a - 1], symbol[r, a])
        filled = np.arange(out_symbol.shape[1]) < out_length[:, None]
        flat, of = out_symbol[filled], np.repeat(np.arange(n), out_length)
        odd = np.flatnonzero(flat < 0)
        if not len(odd):
            return flat, out_length
        spelled = [[self.bytes[b] for b in chr(-2 - s).encode()] for s in flat[odd].tolist()]
        repeats = np.ones(len(flat), dtype=np.int64)
        repeats[odd] = [len(s) for s in spelled]
        ids = np.repeat(flat, repeats)
        begins = np.cumsum(repeats) - repeats
        for k, s in zip(begins[odd].tolist(), spelled, strict=True):
            ids[k : k + len(s)] = s
        return ids, np.bincount(of, weights=repeats, minlength=n).astype(np.int64)

    def _add(self, new: list[str]) -> None:
        """Puts new units into the cache, checked against the library."""
        short = [u for u in new if len(u) <= ROW_SYMBOLS]
        long = [u for u in new if len(u) > ROW_SYMBOLS]
        parts, counts = [], []
        for at in range(0, len(short), 50_000):
            ids, count = self.rows(short[at : at + 50_000])
            parts.append(ids)
            counts.append(count)
        for u in long:
            ids = np.array(self.agenda(u), dtype=np.int32)
            parts.append(ids)
            counts.append(np.array([len(ids)]))
        units = short + long
        ids = np.concatenate([*parts, np.zeros(0, np.int32)])
        count = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
        if self.check:
            self._compare(units, ids, count)
        self.cache.update(zip(units, range(len(self.cache), len(self.cache) + len(units)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(count)])
        self.ids = np.concatenate([self.ids, ids])

    def _compare(self, units: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        """Raises unless the library gives the same ids. It puts a meta symbol before its input;
        a unit without one gets a line feed there, which merges with nothing. (It drops an input
        that is nothing but that meta symbol, which is one piece.)"""
        if META in units:
            k = units.index(META)
            at = int(count[:k].sum())
            if count[k] != 1 or ids[at] != self.library.piece_to_id(META):
                raise AssertionError("the meta symbol is not one piece")
            units, ids, count = units[:k] + units[k + 1 :], np.delete(ids, at), np.delete(count, k)
        if not units:
            return
        texts = [u[1:] if u[0] == META else u if u[0] == "\n" else "\n" + u for u in units]
        skip = np.array([0 if u[0] == META else 1 if u[0] == "\n" else 2 for u in units])
        theirs = self.library.encode([t.replace(META, " ") for t in texts], num_threads=1)
        lengths = np.array([len(t) for t in theirs])
        flat = np.array(list(chain.from_iterable(theirs)), dtype=np.int32)
        starts = np.cumsum(lengths) - lengths
        keep = np.ones(len(flat), dtype=bool)
        for extra in (1, 2):
            keep[starts[skip >= extra] + extra - 1] = False
        if not (np.array_equal(lengths - skip, count) and np.array_equal(flat[keep], ids)):
            raise AssertionError("the agenda's ids differ from the library's")

    def encode(self, texts: list[str | None], begin: bool = True, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end to end, and the places where each text's ids end."""
        units = [self.unit.findall(META + t.replace(" ", META)) if t else [] for t in texts]
        if len(self.cache) > CACHE_UNITS:
            self._reset()
        seen = self.cache
        new = set(chain.from_iterable(units)) - seen.keys()
        if new:
            self._add(sorted(new))
        counts = np.array([len(u) for u in units], dtype=np.int64)
        slots = np.array(list(map(seen.__getitem__, chain.from_iterable(units))), dtype=np.int64)
        lengths = self.starts[slots + 1] - self.starts[slots]
        total = np.r_[0, np.cumsum(lengths)]
        ends = total[np.cumsum(counts)]
        where = np.repeat(self.starts[slots] - total[:-1], lengths) + np.arange(total[-1])
        ids, sizes = self.ids[where], np.diff(np.r_[0, ends])
        extra = int(begin) + int(end)
        if not extra:
            return ids, ends
        out = np.empty(len(ids) + extra * len(texts), dtype=np.int32)
        stops = np.cumsum(sizes + extra)
        first = stops - sizes - extra
        inner = np.ones(len(out), dtype=bool)
        if begin:
            out[first], inner[first] = self.begin, False
        if end:
            out[stops - 1], inner[stops - 1] = self.end, False
        out[inner] = ids
        return out, stops

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, check: bool = True, with_ids: bool = True) -> DataFrame:
    """``docs[keep]`` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded."""
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        codec = Codec(model.value, check)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids, ends = codec.encode(texts.to_pylist())
            starts = np.r_[0, ends[:-1]].astype(np.int64)
            raw = ids.astype("<u4").tobytes()
            spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
            digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans]
            decoded = [codec.decode(ids[a:b].tolist()) for a, b in spans]
            out = [pa.array(ends - starts, pa.int64()), pa.array(digests, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())]
            return [*out, pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.string())] if with_ids else out

        return work

    new = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return annotate(docs, text_col, make, new, keep)
