"""Near-duplicate documents by SimHash, with pigeonring filtering.

Two fingerprints link if they differ in at most ``TAU`` = 4 of 64 bits. The bits are laid on a
ring of ``len(WIDTHS)`` = 5 segments. For differences d_0..d_4 that sum to at most 4 there is a
start i such that every chain of l segments from i on has a sum of at most l * 4 / 5 (the strong
form of the pigeonring principle). Rounded down the budgets are 0, 1, 2, 3, 4: the first segment
must agree, the first two may differ in one bit, the first three in two, and so on.

The candidates' keys come from the three-segment chain. Its first segment agrees. Either the
second agrees too, or one half of it does and then, as the third may hold one difference only, one
half of the third does. So each distinct fingerprint makes 25 keys (5 starts, each with one key of
the first kind and four of the second) of about 26 bits. Candidates are those that share a key, all
chains prune them, and the whole distance confirms.

Scale: copies with one fingerprint are merged first, so a group of equal texts is one row. Keys
that many distinct fingerprints share are dealt over pairs of blocks of at most about ``BLOCK``
members, and each block pair hands on only a spanning forest of the links that it found. So no
task holds more than two blocks of a key, and rows grow with members times blocks, never with
the pairs in a group. Only linked fingerprints go to their component's row, and by a join of two
written tables, whose hot components adaptive execution splits.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other
fingerprint; texts under four words are one shingle; rows with a null id get a fingerprint and
their component (whose id is the smallest non-null id, null if there is none); repeated rows
are kept. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import annotate, ascii_lower, cut_lineage, few, short_batches
from quern.llm.components import components

TAU = 4
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
BLOCK = 2048
#: So many keys with more than a block of members are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000
SEED = 42


def shingle_hashes(text: str | None, words_per_shingle: int, seed: int = SEED) -> np.ndarray:
    """The hash of each word shingle, in order, repeats included; of no words, none."""
    words = ascii_lower(text).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < words_per_shingle:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = words_per_shingle - 1
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """64-bit SimHash over word shingles, repeats included."""
    return simhash(shingle_hashes(text, words_per_shingle))


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, words_per_shingle: int = 4) -> DataFrame:
    """``docs[keep]`` with ``simhash``, the fingerprint as a (signed) long."""

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        return lambda texts: [pa.array(np.array([fingerprint(t, words_per_shingle) for t in texts.to_pylist()], dtype=np.uint64).view(np.int64))]

    return annotate(docs, text_col, make, "simhash long", keep)


#: Keys of each start, and the bits that a key's part after the first segment takes.
KINDS, PART_BITS = 5, 14


def _keys(fp: str) -> F.Column:
    """The 25 keys of a fingerprint: a start, its segment, and what else of its chain must agree."""
    segments = [F.shiftrightunsigned(F.col(fp), s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(STARTS, WIDTHS, strict=True)]
    halves = [(x.bitwiseAND(F.lit((1 << (w // 2)) - 1)), F.shiftright(x, w // 2)) for x, w in zip(segments, WIDTHS, strict=True)]
    out = []
    for i in range(5):
        second, third = (i + 1) % 5, (i + 2) % 5
        parts = [segments[second], *(x * F.lit(1 << 7) + y for x in halves[second] for y in halves[third])]
        out += [(F.lit((KINDS * i + kind) << (PART_BITS + 13)) + segments[i] * F.lit(1 << PART_BITS) + part).cast("long") for kind, part in enumerate(parts)]
    return F.array(*out)


def chains_hold(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether all chains from ``start`` on stay within l * TAU / 5, and so the whole distance."""
    differ = x ^ y
    masks = np.array([(1 << w) - 1 for w in WIDTHS], dtype=np.uint64)
    shifts = np.array(STARTS, dtype=np.uint64)
    ok, total = np.ones(len(x), dtype=bool), np.zeros(len(x), dtype=np.int64)
    for length in range(1, 6):
        segment = (start + length - 1) % 5
        total += np.bitwise_count((differ >> shifts[segment]) & masks[segment])
        ok &= total <= length * TAU // 5
    return ok


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between fingerprints, those that join two trees when taken in turn."""
    if len(a) < 2:
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)):
        p, q = root(i), root(j)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append(k)
    return a[kept], b[kept]


def _links_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, part, fp, side) that are sorted by key and part.

    Members of one group (key and part) are compared with each other; side 1 and side 2 of a pair of blocks
    only across. Groups that end within a batch are handled at once, the last one is carried on.
    """
    held: list[np.ndarray] = []

    def compare(rows: np.ndarray) -> pa.RecordBatch:
        key, part, fp, side = rows
        group = np.r_[0, np.cumsum((np.diff(key) != 0) | (np.diff(part) != 0))]
        bits, start = fp.view(np.uint64), (key >> (PART_BITS + 13)) // KINDS
        links: list[tuple[np.ndarray, np.ndarray]] = []
        at, step = np.arange(len(fp) - 1), 1
        while len(at):
            at = at[at + step < len(fp)]
            at = at[group[at] == group[at + step]]
            across = at[(side[at] == 0) | (side[at] != side[at + step])]
            good = across[chains_hold(bits[across], bits[across + step], start[across])]
            if len(good):
                links.append((fp[good], fp[good + step]))
                if sum(len(x) for x, _ in links) > 4 * len(fp) + 100_000:
                    links = [spanning_forest(*(np.concatenate(x) for x in zip(*links, strict=True)))]
            step += 1
        a, b = spanning_forest(*(np.concatenate(x) for x in zip(*links, strict=True))) if links else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        held.append(rows)
        if (rows[:2, 0] == rows[:2, -1]).all() and (len(held) == 1 or (held[0][:2, 0] == rows[:2, -1]).all()):
            continue  # all of one group as yet
        rows = np.concatenate(held, axis=1)
        last = np.flatnonzero((rows[:2, :-1] != rows[:2, 1:]).any(axis=0))[-1] + 1
        held = [rows[:, last:]]
        yield compare(rows[:, :last])
    if held:
        yield compare(np.concatenate(held, axis=1))


def link_fingerprints(distinct: DataFrame, col: str = "simhash", block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints that have the same connected components as all
    links at ``TAU`` or fewer differing bits."""
    keyed = distinct.select(F.col(col).alias("fp"), F.explode(_keys(col)).alias("key"))
    large = cut_lineage(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    large = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("long")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    # A member of block m meets each block o in the part (min, max); within its own, as side 0.
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct((F.least(o, F.col("m")) * F.col("blocks") + F.greatest(o, F.col("m"))).alias("part"), F.when(o == F.col("m"), 0).when(o > F.col("m"), 1).otherwise(2).cast("long").alias("side")))
    dealt = (
        keyed.join(large, "key", "left")
        .withColumn("blocks", F.coalesce(blocks, F.lit(1).cast("long")))
        .withColumn("m", mine)
        .select("key", "fp", F.explode(pairs).alias("p"))
        .select("key", F.col("p.part").alias("part"), "fp", F.col("p.side").alias("side"))
    )
    short_batches(distinct.sparkSession)
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_links_in_groups, "a long, b long")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id, simhash (signed), fingerprint (16 hex digits) and component_id of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut_lineage(fingerprints(rows, "text", ["doc_id"], words_per_shingle), as_it_lies=True)
    distinct = rows.groupBy("simhash").agg(F.min("doc_id").alias("first_id"))
    linked = components(link_fingerprints(distinct.select("simhash"), block=block))
    members = linked.join(distinct, F.col("node") == F.col("simhash")).select("root", "first_id")
    # Both sides of each join by root or fingerprint are written tables: a hot one can be split.
    lowest = cut_lineage(members.groupBy("root").agg(F.min("first_id").alias("component_id")))
    labels = linked.join(lowest, "root").select(F.col("node").alias("simhash"), "component_id")
    unlinked = distinct.join(labels, "simhash", "left_anti").select("simhash", F.col("first_id").alias("component_id"))
    of_class = cut_lineage(labels.unionAll(unlinked))
    return few(rows.join(of_class, "simhash")).select("doc_id", "simhash", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose component has a smaller id; rows with a null id stay.

    Of repeated rows with one id one stays.
    """
    classes = deduplicate(docs, id_col, text_col)
    kept = classes.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(kept, id_col, "left_semi").dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
