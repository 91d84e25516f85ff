"""Near copies of a given similarity: SimHash links, completed to all links by an exact join.

Two texts link if the sets of their shingles of ``WORDS`` = 5 words (ASCII letters in lower case)
have a Jaccard similarity of at least ``SIMILARITY`` = 4 / 5. The SimHash operator (``simhash``)
over the same shingles gives the first candidates. Texts of that similarity can differ in any
number of a fingerprint's bits, so it can't give them all; the rest come from prefix filtering: if
every set is put into one common order, linked sets share a shingle among their first
n - ceil(4 n / 5) + 1. Those are the keys. The closer the sizes the more keys they share at least;
a text that shares fewer keys with texts of other components has no link to them. Shingles that a sample finds common come last in the
order, which changes the number of candidates but not the links. Sizes, and parity sketches that
can only underestimate how much two sets differ, prune candidates; the words confirm each link.

Scale: one pass over the texts makes all keys. Equal texts are one node, named by a 64-bit hash of
the text. Each text first meets one other (the member met at most of its keys), so rows grow with
members; then, where a key has members of several components, only those meet, in pairs of blocks
of about ``BLOCK`` members, and only the closest pair of two components becomes a row, at the first
key that the two texts share (their first ``FIRSTS`` keys tell which); only where
that pair is no link all pairs of the two components do. Common shingles' keys are at most ``MAX_COMMON`` and
combine before the shuffle. Texts are fetched for candidates only, behind a bitmap of fixed size.

Defined cases: texts under five words are one shingle; null, empty and blank texts link with each
other; rows with a null id stay, and may link others; of repeated rows with one id one stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import annotate, ascii_lower, cut_lineage, few, short_batches
from quern.llm.components import components
from quern.llm.simhash import link_fingerprints, shingle_hashes, simhash

WORDS = 5
#: Least similarity, as a fraction of whole numbers.
SIMILARITY = (4, 5)
BLOCK = 2048
#: Texts that one copy of another text meets.
SPREAD = 2000
SKETCH_LONGS = 16
#: Documents of the sample that orders shingles, and the most shingles that it sends to tasks.
SAMPLE_DOCS, MAX_COMMON = 4000, 100_000
#: Bits of the bitmaps that keep texts from being fetched in vain (2 MB).
BITMAP_BITS, BITMAP_PART = 24, 15


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    found = ascii_lower(text).split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def similar(a: set[bytes], b: set[bytes]) -> bool:
    shared = len(a & b)
    return SIMILARITY[1] * shared >= SIMILARITY[0] * (len(a) + len(b) - shared)


def _hashes(text: str | None) -> np.ndarray:
    """The hash of each shingle, repeats included; texts without words have one of their own."""
    found = shingle_hashes(text, WORDS)
    return found if len(found) else np.zeros(1, np.uint64)


def _sketch(distinct: np.ndarray, longs: int = SKETCH_LONGS) -> np.ndarray:
    """For each of 64 * ``longs`` classes of shingles (a power of two), whether their number is odd."""
    odd = np.bincount((distinct & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wide_longs(n: int) -> int:
    """Longs of a set's wide sketch: two to four classes a shingle."""
    return max(SKETCH_LONGS, (1 << (2 * n - 1).bit_length()) // 64)


def _but_prefix(n: int | np.ndarray) -> int | np.ndarray:
    """Shingles of a set of n that are none of its keys."""
    return -(-SIMILARITY[0] * n // SIMILARITY[1]) - 1


def _sizes_fit(x: Column, y: Column) -> Column:
    return SIMILARITY[1] * F.least(x, y) >= SIMILARITY[0] * F.greatest(x, y)


def in_bitmap(rows: DataFrame, by: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` parted in those that may have a long of ``wanted`` (one column) and those that can't."""

    def place(c: Column) -> Column:
        return F.pmod(c, F.lit(1 << BITMAP_BITS))

    mask = F.lit((1 << BITMAP_PART) - 1)
    at = place(F.col(wanted.columns[0]))
    maps = wanted.groupBy(F.shiftright(at, BITMAP_PART).alias("__bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(mask)).alias("__map"))
    at = place(F.col(by))
    offset = at.bitwiseAND(mask)
    byte = F.conv(F.hex(F.substring(F.col("__map"), (F.shiftright(offset, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("__bucket", F.shiftright(at, BITMAP_PART)).join(F.broadcast(maps), "__bucket", "left")
    hit = F.coalesce(F.getbit(byte, offset.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    own = [F.col(f"`{c}`") for c in rows.columns]
    return met.where(hit).select(own), met.where(~hit).select(own)


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample share, and how many do."""
    share = min(1 << 20, (SAMPLE_DOCS << 20) // max(1, docs.count()) + 1)
    sample = docs.where(F.pmod(F.xxhash64("node", F.lit("order")), F.lit(1 << 20)) < share)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        seen: set[int] = set()

        def work(texts: pa.Array) -> list[pa.Array]:
            out = []
            for text in texts.to_pylist():
                whole = xxhash.xxh64_intdigest(text or "")
                out.append([] if whole in seen else np.unique(_hashes(text)).view(np.int64))
                seen.add(whole)
            return [pa.array(out, pa.list_(pa.int64()))]

        return work

    each = annotate(sample, "text", make, "h array<long>", ["node"]).select(F.explode("h").alias("h"), "node").distinct()
    found = each.groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(MAX_COMMON).toPandas()
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], found["count"].to_numpy(np.int64)[order]


def _marked(docs: DataFrame) -> DataFrame:
    """Of every row: node, id; of each text's first row in a task also its simhash, size (of its
    set), keys and common (its prefix, by whether the sample knows the shingle) and sketches."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        common, count = shared.value
        seen: set[int] = set()

        def work(texts: pa.Array) -> list[pa.Array]:
            columns: list[list] = [[] for _ in range(6)]
            for text in texts.to_pylist():
                whole = xxhash.xxh64_intdigest(text or "")
                if whole in seen:
                    for c in columns:
                        c.append(None)
                    continue
                seen.add(whole)
                every = _hashes(text)
                h = np.unique(every)
                weight = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    weight = np.where(common[at] == h, count[at], 0)
                prefix = np.lexsort((h, weight))[: len(h) - _but_prefix(len(h))]
                known = weight[prefix] > 0
                keys = h[prefix].view(np.int64)
                bits = simhash(every)
                for c, v in zip(columns, (bits - (bits >> 63 << 64), len(h), keys[~known], keys[known], _sketch(h), _sketch(h, _wide_longs(len(h)))), strict=True):
                    c.append(v)
            longs = pa.list_(pa.int64())
            return [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), longs, longs, longs, longs), strict=True)]

        return work

    return annotate(docs, "text", make, "simhash long, size long, keys array<long>, common array<long>, sketch array<long>, wide array<long>", ["node", "id"])


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, node, pos) rows, sorted: (key, node, pos, hub) of keys with several nodes; the hub is the first.

    Only the first and the last row of a key are held from batch to batch.
    """
    held = np.zeros((3, 0), np.int64)
    told = False  # whether the held rows are out already
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
        fresh = np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]
        out = fresh.copy()
        out[: held.shape[1]] = not told
        key, node, pos = rows
        start = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(start) - 1
        size = np.bincount(group, weights=fresh)
        hub = node[start][group]
        out &= size[group] > 1
        first_of_last = int(np.flatnonzero(start)[-1])
        told = bool(size[-1] > 1)
        last = len(key) - 1
        held = rows[:, [first_of_last, last]] if node[last] != node[first_of_last] else rows[:, [first_of_last]]
        yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (key, node, pos, hub)], names=["key", "node", "pos", "hub"])


def _shared_keys(marked: DataFrame) -> DataFrame:
    """(key, node, pos, hub): the nodes of each key that has several, its place in their order, and
    the smallest of the nodes."""
    keyed = marked.select(F.posexplode("keys").alias("pos", "key"), "node").select("key", "node", "pos")
    rare = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_hubs, "key long, node long, pos long, hub long")
    # The common keys are at most MAX_COMMON, so their hubs may be broadcast and no text is dealt by one.
    known = marked.select(F.posexplode("common").alias("i", "key"), "node", F.size("keys").alias("n")).select("key", "node", (F.col("i") + F.col("n")).cast("long").alias("pos"))
    hubs = known.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    return rare.unionAll(known.join(F.broadcast(hubs), "key").select("key", "node", "pos", "hub"))


def _pruned(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of nodes, a < b, whose sizes and wide sketches allow a link."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    info = first.select("node", "size", "wide").dropDuplicates(["node"])
    side = lambda c: info.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("wide").alias(f"{c}_wide"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_sizes_fit(F.col("a_size"), F.col("b_size")))

    def folded(wide: str, other: str) -> Column:
        """Of sketches of fitting sizes one is at most twice as wide; its halves make one of half the width."""
        x, n = F.col(wide), F.size(other)
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    differ = F.aggregate(F.zip_with(folded("a_wide", "b_wide"), folded("b_wide", "a_wide"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = differ * sum(SIMILARITY) <= (SIMILARITY[1] - SIMILARITY[0]) * (F.col("a_size") + F.col("b_size"))
    return cut_lineage(both.where(fits).select("a", "b"))


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the (written) pairs (a, b) of nodes whose texts are similar."""
    used = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    texts, _ = in_bitmap(docs.select("node", "text"), "node", used)
    texts = texts.dropDuplicates(["node"])
    # A text that meets very many others is copied, so that they are spread.
    spread = cut_lineage(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SPREAD)).cast("long").alias("copies")).where("copies > 1"))
    copies = F.coalesce("copies", F.lit(1).cast("long"))
    dealt = pairs.join(spread, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), copies).alias("part"))
    hubs = texts.select(F.col("node").alias("a"), F.col("text").alias("s")).join(spread, "a", "left").select("a", "s", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("part"))
    both = dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b").join(hubs, ["a", "part"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, own = None, set()
        for batch in batches:
            good = []
            for s, t in zip(batch.column(2), batch.column(3), strict=True):
                s = s.as_py()
                if s != text or not own:  # rows of one a stand together
                    text, own = s, shingles(s)
                good.append(similar(own, shingles(t.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return cut_lineage(both.select("a", "b", "s", "t").mapInArrow(check, "a long, b long"))


#: Groups of at most so many rows are compared together, step by step; larger ones row by row.
FEW = 48
#: Each row carries the first so many keys of its text that other roots have.
FIRSTS = 8


def _met_before(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two texts surely share a key that comes before ``key``, by their first keys x and y (rows, ``FIRSTS``).

    If two such lists have keys in common, the first of them is the first key that the texts share,
    as each list holds all keys up to its last one.
    """
    common = (x[:, :, None] == y[:, None, :]).any(axis=2)
    return common.any(axis=1) & (x[np.arange(len(x)), common.argmax(axis=1)] != key)


def _pairs_in_groups(every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) of nodes that may be similar and have unlike roots, of rows (key, part, side,
    node, root, size, known, pos, sketch, firsts) sorted by key and part, with the roots (r < q), the number of sketch
    bits that differ (d) and whether the roots have more pairs (more). Of two roots only the
    closest pair is handed on, unless ``every``. A pair whose first keys tell where it meets first
    is handed on there only, so texts that share many keys don't make a row at each."""

    def allowed(key: np.ndarray, size: np.ndarray, known: np.ndarray, pos: np.ndarray, wide: np.ndarray, x: np.ndarray, y: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray | int]:
        """Those of the pairs of rows x and y that may be similar, and the bits that differ."""
        sketch, firsts = wide[:, :SKETCH_LONGS], wide[:, SKETCH_LONGS:]
        a, b = size[x], size[y]
        shared = -(-SIMILARITY[0] * (a + b) // sum(SIMILARITY))  # at least, if similar
        least = np.minimum(shared - _but_prefix(a), shared - _but_prefix(b))
        fits = (SIMILARITY[1] * np.minimum(a, b) >= SIMILARITY[0] * np.maximum(a, b)) & (np.minimum(known[x], known[y]) >= least)
        fits &= (pos[x] <= a - shared) & (pos[y] <= b - shared)  # they share such a key, if any
        x, y = x[fits], y[fits] if isinstance(y, np.ndarray) else y
        differ = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
        fits = differ * sum(SIMILARITY) <= (SIMILARITY[1] - SIMILARITY[0]) * (size[x] + size[y])
        x, y, differ = x[fits], y[fits] if isinstance(y, np.ndarray) else np.full(int(fits.sum()), y), differ[fits]
        here = ~_met_before(key[x], firsts[x], firsts[y])
        return x[here], y[here], differ[here]

    def together(rows: np.ndarray, wide: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """All pairs of small groups: each row with the next one, the next but one, ..."""
        key, part, side, node, root, size, known, pos = rows
        group = np.r_[0, np.cumsum((np.diff(key) != 0) | (np.diff(part) != 0))]
        at, step = np.arange(len(node) - 1), 1
        while len(at):
            at = at[at + step < len(node)]
            at = at[group[at] == group[at + step]]
            x = at[((side[at] == 0) | (side[at] != side[at + step])) & (root[at] != root[at + step])]
            x, y, differ = allowed(key.view(np.uint64), size, known, pos, wide, x, x + step)
            yield node[x], node[y], root[x], root[y], differ
            step += 1

    def one_by_one(rows: np.ndarray, wide: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """All pairs of one group. Rows of its commonest root meet only rows of other roots."""
        order = np.argsort(rows[5], kind="stable")
        key, _, side, node, root, size, known, pos = rows[:, order]
        wide = wide[order]
        _, number, members = np.unique(root, return_inverse=True, return_counts=True)
        largest = int(members.argmax())
        # Sizes ascend, so what may be similar to a row lies in a range of them.
        low = np.searchsorted(size, -(-SIMILARITY[0] * size // SIMILARITY[1]), side="left")
        high = np.searchsorted(size, SIMILARITY[1] * size // SIMILARITY[0], side="right")
        for y in np.flatnonzero(number != largest).tolist():
            x = np.arange(low[y], high[y])
            x = x[(number[x] != number[y]) & ((number[x] == largest) | (x > y)) & ((side[x] == 0) | (side[x] != side[y]))]
            x, of, differ = allowed(key.view(np.uint64), size, known, pos, wide, x, y)
            yield node[x], node[of], root[x], root[of], differ

    def finished(rows: np.ndarray, wide: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.r_[0, np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1, rows.shape[1]]
        sizes = np.diff(cuts)
        small = np.repeat(sizes <= FEW, sizes)
        found = list(together(rows[:, small], wide[small])) if small.any() else []
        for g in np.flatnonzero(sizes > FEW).tolist():
            found += one_by_one(rows[:, cuts[g] : cuts[g + 1]], wide[cuts[g] : cuts[g + 1]])
            if sum(len(x[0]) for x in found) > 100_000:
                yield told(found)
                found = []
        if any(len(x[0]) for x in found):
            yield told(found)

    def told(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        x, y, p, q, d = (np.concatenate(c) for c in zip(*found, strict=True))
        a, b, r, q = np.minimum(x, y), np.maximum(x, y), np.minimum(p, q), np.maximum(p, q)
        more = np.ones(len(a), bool)
        if not every:
            order = np.lexsort((b, a, d, q, r))
            a, b, r, q, d = (c[order] for c in (a, b, r, q, d))
            first = np.flatnonzero(np.r_[True, (np.diff(r) != 0) | (np.diff(q) != 0)])
            of = np.repeat(first, np.diff(np.r_[first, len(a)]))
            more = np.maximum.reduceat((a != a[of]) | (b != b[of]), first)
            a, b, r, q, d = (c[first] for c in (a, b, r, q, d))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, r, q, d, more)], names=["a", "b", "r", "q", "d", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:8]])
            lists = (batch.column(i).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(batch), -1) for i in (8, 9))
            held.append((rows, np.hstack(list(lists))))
            if (held[0][0][:2, 0] == rows[:2, -1]).all():
                continue  # all of one group as yet
            rows, wide = np.concatenate([r for r, _ in held], axis=1), np.concatenate([s for _, s in held])
            last = np.flatnonzero((rows[:2, :-1] != rows[:2, 1:]).any(axis=0))[-1] + 1
            held = [(rows[:, last:], wide[last:])]
            yield from finished(rows[:, :last], wide[:last])
        if held:
            yield from finished(np.concatenate([r for r, _ in held], axis=1), np.concatenate([s for _, s in held]))

    return run


def _between_roots(rest: DataFrame, info: DataFrame, block: int, every: bool) -> DataFrame:
    """Candidates (a, b, r, q, d, more) of unlike roots of ``rest`` (key, node, pos, root) that share a key."""
    open_keys = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("key", F.ceil(F.col("n") / F.lit(block)).cast("long").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    # A member of block m meets each block o in the part (min, max); within its own, as side 0.
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct((F.least(o, F.col("m")) * F.col("blocks") + F.greatest(o, F.col("m"))).alias("part"), F.when(o == F.col("m"), 0).when(o > F.col("m"), 1).otherwise(2).cast("long").alias("side")))
    # A node shares no more keys with nodes of other roots than it has open ones.
    of_node = Window.partitionBy("node")
    known = F.count("*").over(of_node)
    place = F.dense_rank().over(of_node.orderBy("pos", "key"))
    first = F.sort_array(F.collect_set(F.when(F.col("place") <= FIRSTS, F.struct("pos", "key"))).over(of_node))["key"]
    # Lists of one length: shorter ones repeat their first key.
    first = F.concat(first, F.array_repeat(first[0], F.lit(FIRSTS) - F.size(first)))
    opened = rest.join(open_keys, "key").withColumn("place", place).withColumn("known", known).withColumn("firsts", first)
    dealt = opened.join(info, "node").withColumn("m", mine)
    rows = dealt.select("key", "node", "root", "size", "known", "pos", "sketch", "firsts", F.explode(parts).alias("p"))
    rows = rows.select("key", F.col("p.part").alias("part"), F.col("p.side").alias("side"), "node", "root", "size", "known", "pos", "sketch", "firsts")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_pairs_in_groups(every), "a long, b long, r long, q long, d long, more boolean")


def roots_of(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (node, id, text): (node, root) of the nodes that link, and (node, id) of all rows."""
    short_batches(docs.sparkSession)
    marked = cut_lineage(_marked(docs), as_it_lies=True)
    first = marked.where("size is not null")
    shared = cut_lineage(_shared_keys(first))
    info = first.select("node", "size", "sketch").dropDuplicates(["node"])

    prints = first.groupBy("simhash").agg(F.min("node").alias("least"))
    linked = link_fingerprints(prints.select("simhash"), block=block)
    by_print = linked.join(prints.select(F.col("simhash").alias("a"), F.col("least").alias("x")), "a").join(prints.select(F.col("simhash").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same_print = first.join(prints, "simhash").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    by_key = shared.where("node <> hub").groupBy("node").agg(F.mode("hub").alias("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    before = components(_verified(_pruned(by_print.unionAll(same_print).unionAll(by_key), first), docs))

    # The closest pair of each two components that share a key.
    rest = cut_lineage(shared.join(before, "node", "left").select("key", "node", "pos", F.coalesce("root", "node").alias("root")))
    order = F.col("d") * F.lit(1 << 50) + F.pmod(F.xxhash64("a", "b"), F.lit(1 << 50))
    pair = F.xxhash64("a", "b")
    asked = _between_roots(rest, info, block, False).groupBy("r", "q").agg(F.min_by("a", order).alias("a"), F.min_by("b", order).alias("b"), (F.bool_or("more") | (F.min(pair) != F.max(pair))).alias("many"))
    asked = cut_lineage(asked)
    good = _verified(_pruned(asked, first), docs)
    links = before.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(good)

    # Where that pair is no link, but others may be, all of them.
    failed = cut_lineage(asked.where("many").join(good, ["a", "b"], "left_anti").select("r", "q"))
    if not failed.isEmpty():
        either = failed.select(F.col("r").alias("root")).unionAll(failed.select(F.col("q").alias("root"))).distinct()
        left = _between_roots(rest.join(either, "root", "left_semi"), info, block, True).join(failed, ["r", "q"]).join(asked.select("a", "b"), ["a", "b"], "left_anti")
        links = links.unionAll(_verified(_pruned(left, first), docs))
    return components(links), marked.select("node", "id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The documents without those whose group of near copies has a smaller id; rows with a null id stay."""
    rows = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    roots, ids = roots_of(rows, block)
    ids = ids.where(F.col("id").isNotNull())
    lowest = cut_lineage(ids.join(roots, "node").groupBy("root").agg(F.min("id").alias("least")))
    of_node = roots.join(lowest, "root").select("node", "least")
    alone = ids.groupBy("node").agg(F.min("id").alias("least")).join(roots, "node", "left_anti")
    least = cut_lineage(of_node.unionAll(alone.select("node", "least")))
    # Only ids that go, or that several rows have, need a join; all other rows pass as they are.
    decided = ids.join(least, "node").groupBy("id").agg(F.bool_or(F.col("id") == F.col("least")).alias("first"), F.count("*").alias("n")).where("not first or n > 1")
    decided = cut_lineage(decided.select(F.col("id").alias("__id"), F.col("first").alias("__first")))
    hashed = docs.withColumn("__hash", F.xxhash64(F.col(id_col)))
    maybe, others = in_bitmap(hashed, "__hash", decided.select(F.xxhash64("__id").alias("h")))
    null = F.col(id_col).isNull()
    checked = maybe.where(~null).join(decided, maybe[id_col] == decided["__id"], "left").where("__first is null or __first").dropDuplicates([id_col])
    return few(checked).select(docs.columns).unionAll(others.where(~null).select(docs.columns)).unionAll(docs.where(null))
