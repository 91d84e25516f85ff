"""Exact top-k inner-product search with a bit-sliced index.

The index holds blocks of rows. Of each block, every attribute (vector component, as a whole
number) is quantised by dropping its ``DROPPED`` lowest bits and kept as bit slices: one bitmap
over the block's rows for each remaining bit. A query's score is a sum of attribute slices,
each counted with the weight of a set bit of the query's component: bitmaps of one weight are
added three at a time by a full adder (sum and carry bitmaps), until one bitmap a weight is
left. Signs are handled by adding complements of slices and constants.

The result is again a bit-sliced number. The k-th largest quantised score is found from its
most significant slice downward: with the rows that are surely above (G) and those that agree so
far (E), the slice either splits E or is added to G. What quantising dropped is bounded, for
each query, so rows that can't reach the k-th score are out by one more pass over the slices;
the boundary rows that remain are scored exactly from the block's raw values.

Scale: rows are dealt into blocks of at most about ``ROW_BLOCK`` rows (fewer for long vectors), and
each query is copied to each block. One exchange brings a block's rows and then its queries to a
task, which builds the block's index once, lets the queries stream past it and hands on at most k
rows for each. While blocks are fewer than cores, each is copied for several parts of the queries.
Results are merged by a rank per query, limited before the shuffle. Nothing is broadcast.

Defined cases: vectors that are null, empty or hold a null or a non-finite component take no
part; vectors of unlike lengths are compared as if zeros followed the shorter; equal scores go
to the smaller id, null ids last; a query does not meet rows with its own id, so repeated rows
of one id are not partners of each other but count as candidates one by one. Whole-number
components beyond +-2**62, and scores of the result beyond a long, are an error; scores are never
rounded or wrapped. No queries or no candidates give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import short_batches

ROW_BLOCK = 1 << 16
#: Bytes of a block's vectors, at most.
BLOCK_BYTES = 32 << 20
DROPPED = 3
SCALE = 256


class Block:
    """A block of rows: ids, whole-number vectors, and the bit slices of their attributes."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, dropped: int = DROPPED):
        self.ids, self.values, self.dropped = ids, values, dropped
        self.rows, self.dims = values.shape
        self.largest = max(-int(values.min(initial=0)), int(values.max(initial=0)))
        high = values >> dropped
        self.low = int(high.min(initial=0))  # so that what is sliced is not negative
        shifted = (high - self.low).astype(np.uint64)
        self.bits = int(shifted.max(initial=0)).bit_length()
        self.words = -(-self.rows // 64)
        padded = np.zeros((self.dims, self.words * 64), dtype=np.uint64)
        padded[:, : self.rows] = shifted.T
        self.slices = np.empty((self.dims, self.bits, self.words), dtype=np.uint64)
        for b in range(self.bits):
            plane = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
            self.slices[:, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
        self.all = np.full(self.words, ~np.uint64(0))
        if self.rows % 64:
            self.all[-1] = np.uint64((1 << (self.rows % 64)) - 1)

    def sum_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bit slices of sum(query * high) - offset, never negative, and the offset.

        A negative weight -w times x is w times (2**bits - 1 - x) less a constant.
        """
        columns: list[list[np.ndarray]] = []
        offset = 0
        for q, slices in zip(query.tolist(), self.slices, strict=True):
            offset += q * self.low
            if q < 0:
                offset += q * ((1 << self.bits) - 1)
                slices = ~slices
                q = -q
            place = 0
            while q:
                if q & 1:
                    while len(columns) < place + self.bits:
                        columns.append([])
                    for b in range(self.bits):
                        columns[place + b].append(slices[b])
                q >>= 1
                place += 1
        out: list[np.ndarray] = []
        place = 0
        while place < len(columns):
            if place + 1 == len(columns) and len(columns[place]) > 1:
                columns.append([])
            carries = columns[place + 1] if place + 1 < len(columns) else []
            bitmaps = columns[place]
            while len(bitmaps) > 1:
                # Full adders on stacks of bitmaps: a third each as first, second and third input.
                if len(bitmaps) == 2:
                    a, b = bitmaps
                    bitmaps = [a ^ b]
                    carries.append(a & b)
                    break
                third = len(bitmaps) // 3
                a, b, c = (np.stack(bitmaps[i * third : (i + 1) * third]) for i in range(3))
                half = a ^ b
                carries.extend((a & b) | (c & half))
                bitmaps = [*(half ^ c), *bitmaps[3 * third :]]
            out.append(bitmaps[0] if bitmaps else np.zeros(self.words, dtype=np.uint64))
            place += 1
        return out, offset

    def kth_largest(self, slices: list[np.ndarray], k: int) -> int:
        """The k-th largest number (or the least, if there are fewer), from the top slice down."""
        above, equal, value = 0, self.all.copy(), 0
        for b in reversed(range(len(slices))):
            ones = equal & slices[b]
            n = int(np.bitwise_count(ones).sum())
            if above + n >= k:
                equal, value = ones, value | (1 << b)
            else:
                above += n
                equal &= ~slices[b]
        return value

    def at_least(self, slices: list[np.ndarray], value: int) -> np.ndarray:
        """Row numbers whose number is ``value`` or more, from the top slice down."""
        if value <= 0:
            return np.arange(self.rows)
        if value.bit_length() > len(slices):
            return np.zeros(0, dtype=np.int64)
        more, equal = np.zeros(self.words, dtype=np.uint64), self.all.copy()
        for b in reversed(range(len(slices))):
            if value >> b & 1:
                equal &= slices[b]
            else:
                more |= equal & slices[b]
                equal &= ~slices[b]
        return np.flatnonzero(np.unpackbits((more | equal).view(np.uint8), bitorder="little"))

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and exact scores of the best k rows of other ids, best first."""
        own = int((self.ids == query_id).sum())
        slices, _ = self.sum_slices(query)
        kth = self.kth_largest(slices, min(k + own, self.rows))
        # Dropped bits add between sum(q * rest) over negative q and that over positive q.
        total = sum(map(abs, query.tolist()))
        slack = ((1 << self.dropped) - 1) * total
        rows = self.at_least(slices, kth - -(-slack // (1 << self.dropped)))
        rows = rows[self.ids[rows] != query_id]
        if total * self.largest < 1 << 63:
            scores = self.values[rows] @ query
        else:  # beyond 64 bits: Python's whole numbers
            scores = self.values[rows].astype(object) @ query.astype(object)
        order = np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k], dtype=np.int64) if scores.dtype == object else np.lexsort((self.ids[rows], -scores))[:k]
        if any(not -(1 << 63) <= x < 1 << 63 for x in scores[order].tolist()):
            raise OverflowError("a score does not fit in a long")
        return rows[order], scores[order].astype(np.int64)


#: Stands for a null id; sorts last.
NO_ID = np.iinfo(np.int64).max


def whole_vector(vector: Column) -> Column:
    """floor(256 * x) of each component x as a double; null for vectors that take no part."""
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    too_large = F.raise_error(F.lit("a whole-number component is beyond +-2**62")).cast("long")
    whole = F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * SCALE) < float(1 << 62), F.floor(x.cast("double") * SCALE)).otherwise(too_large))
    return F.when(usable, whole)


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _search_cells(dims: int, k: int, dropped: int):
    """The k best of each query in its cell, of rows (cell, asks, id, v), sorted by cell and asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block = None, [], None
        for batch in batches:
            cells, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ids = pc.fill_null(batch.column(2), int(NO_ID)).to_numpy(zero_copy_only=False)
            values = _matrix(batch.column(3), dims)
            cuts = np.r_[0, np.flatnonzero((np.diff(cells) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1, len(ids)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, held, block = cells[a], [], None
                if not asks[a]:
                    held.append((ids[a:b], values[a:b]))
                    continue
                if block is None:
                    if not held:
                        continue
                    block, held = Block(*(np.concatenate(x) for x in zip(*held, strict=True)), dropped), []
                found = [(np.full(min(k, block.rows), ids[i]), *block.top(values[i], int(ids[i]), k)) for i in range(a, b)]
                qids, rows, scores = (np.concatenate(x) for x in zip(*((q[: len(r)], r, s) for q, r, s in found), strict=True))
                best = block.ids[rows]
                yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(best, mask=best == NO_ID), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", row_block: int = ROW_BLOCK, query_block: int | None = None, dropped: int = DROPPED) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best partners of each query row.

    ``query_block`` is the number of queries that a task takes at most (about), else cores decide.
    """
    short_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole_vector(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("v").isNotNull())
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    size = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.max(F.size("v")).alias("d"), F.max(largest).alias("m")).first()
    dims, cores = size["d"] or 1, vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-size["n"] // max(1, min(row_block, BLOCK_BYTES // (8 * dims)))))
    parts = max(1, -(-size["q"] // query_block) if query_block else min(cores // blocks, -(-size["q"] // 64)))
    kind = next(t for t, most in (("smallint", 1 << 15), ("int", 1 << 31), ("bigint", 1 << 63)) if (size["m"] or 0) < most)
    v = F.col("v").cast(f"array<{kind}>").alias("v")
    # Rows that repeat an id and a vector are dealt by the place that they are read from as well.
    block = F.pmod(F.xxhash64("id", "v", F.spark_partition_id()), F.lit(blocks))
    copied = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    index = rows.select("id", v, block.alias("b"), copied(parts).alias("p")).select((F.col("b") * parts + F.col("p")).alias("cell"), F.lit(False).alias("asks"), "id", "v")
    queries = rows.where("q").select("id", v, F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts)).alias("p"), copied(blocks).alias("b")).select((F.col("b") * parts + F.col("p")).alias("cell"), F.lit(True).alias("asks"), "id", "v")
    dealt = index.unionAll(queries).repartitionById(blocks * parts, F.col("cell").cast("int")).sortWithinPartitions("cell", "asks")
    found = dealt.mapInArrow(_search_cells(dims, k, dropped), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
