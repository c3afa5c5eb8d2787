"""Near-duplicate detection by b-bit MinHash.

1. Every text becomes its set of distinct word shingles (64-bit hashes), its
   minima under HASHES permutations, the lowest BITS bits of each minimum packed
   into a signature of 64-bit words, and BANDS keys of ROWS minima each. Texts with one set are collapsed
   to the smallest id by a partial aggregation, whatever their number.
2. Band candidates: in each bucket every set is paired with the bucket's smallest
   id only, which is an aggregation and a join, never a group in one task.
3. A pair's similarity is estimated from its signatures: of the exclusive or, the
   bits of each minimum are folded into one and counted, and the share of equal
   minima is corrected for chance collisions. Pairs SIGMAS standard errors under the
   threshold go; the others are decided on their full sets.
4. Links make components. A bucket whose sets are then not all in one component
   gets a second look: its sets outside the largest component meet all its sets
   of other components, in pairs of salted blocks, by signature. Components that may be
   linked make clusters, and the full sets of a cluster meet in pairs of blocks
   of about SIDE sets, by products of indicator matrices. A task returns a forest
   over components, never pairs, so no link between components is lost and the
   rows stay linear.

A pair at the threshold of 0.85 misses every bucket with probability 2e-8.

Defined cases: a text without a word (or null) has an empty set and is linked
with nothing; with fewer words than a shingle its whole sequence is the one
shingle; a null id is linked with nothing, its component is null and it is kept;
rows that share an id are one document; ids are whole numbers; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Roller, cut, drop_stage, mix, slices, stage, word_spans
from .components import components

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Bits kept of each minimum; 64 is a multiple.
BITS = 4
WORDS = HASHES * BITS // 64
SIGMAS = 6.0
#: Signatures of a bucket, and sets of a cluster, that meet in one task.
BLOCK = 1024
SIDE = 256

_ROLLER = Roller(404)
_RNG = np.random.default_rng(4)
_A = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ORDER = [np.uint64(int(x) | 1) for x in _RNG.integers(1 << 40, 1 << 62, 16)]
_BAND = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingles(texts: pa.Array, words: int, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all shingles of some rows (repeats included), and where each row's begin (rows + 1 entries)."""
    for s in slices(texts):
        starts, ends, at = word_spans(s)
        prefix = _ROLLER.prefix(LOWER[s.raw] if lower else s.raw)
        h = _ROLLER.spans(prefix, starts, ends)
        n = np.diff(at)
        total = np.where(n >= words, n - words + 1, (n > 0).astype(n.dtype))
        first = np.append(0, np.cumsum(total))
        begin = np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], total)
        size = np.repeat(np.minimum(n, words), total)
        x = np.zeros(len(begin), np.uint64)
        for k in range(words):
            inside = size > k
            if inside.all():
                x = (x + h[begin + k]) * _ORDER[k % 16]
            else:
                x[inside] = (x[inside] + h[begin[inside] + k]) * _ORDER[k % 16]
        yield mix(x), first


def _sketch(words: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for x, first in shingles(batch.column(1), words, lower):
                n = len(first) - 1
                size, key = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
                for i in range(n):
                    own = np.sort(x[first[i] : first[i + 1]])
                    if len(own):
                        own = own[np.append(True, own[1:] != own[:-1])]
                        size[i] = len(own)
                        key[i] = np.add.reduce(own * np.uint64(0x9FB21C651E98DF25)), np.add.reduce(mix(own))
                some = np.flatnonzero(size)
                minima = np.zeros((HASHES, len(some)), np.uint32)
                if len(some):
                    high, starts = (x >> np.uint64(32)).astype(np.uint32), first[:-1][some]
                    for k in range(HASHES):
                        minima[k] = np.minimum.reduceat(high * _A[k] + _B[k], starts)
                bands = np.zeros((len(some), BANDS), np.uint64)
                for b in range(BANDS):
                    h = np.full(len(some), _BAND[b], np.uint64)
                    for r in range(ROWS):
                        h = mix(h ^ minima[b * ROWS + r].astype(np.uint64)) + _BAND[b]
                    bands[:, b] = h
                low = pack(minima.T)
                sig = [b""] * n
                for j, i in enumerate(some.tolist()):
                    sig[i] = low[j].tobytes()
                offsets = np.append(0, np.cumsum(np.where(size > 0, BANDS, 0))).astype(np.int32)
                key = key.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(size), pa.array(np.ascontiguousarray(key[:, 0])), pa.array(np.ascontiguousarray(key[:, 1])), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel().view(np.int64)))],
                    ["doc_id", "n_shingles", "key1", "key2", "sig", "bands"],
                )
                row += n

    return run


def pack(minima: np.ndarray) -> np.ndarray:
    """The lowest bits of each row's minima, end to end in words."""
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minima), WORDS, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def _signatures(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint64).reshape(-1, WORDS)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of signatures (last axis: words)."""
    x = a ^ b
    fold = x.copy()
    for k in range(1, BITS):
        fold |= x >> np.uint64(k)
    ones = np.uint64(sum(1 << i for i in range(0, 64, BITS)))  # the lowest bit of each minimum
    differ = np.bitwise_count(fold & ones).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return (1 - differ / HASHES - chance) / (1 - chance)


def cutoff(similarity: float) -> float:
    """SIGMAS standard errors of the estimate below a similarity."""
    chance = 1 / (1 << BITS)
    same = similarity + (1 - similarity) * chance
    return similarity - SIGMAS * np.sqrt(same * (1 - same) / HASHES) / (1 - chance)


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_signatures(batch.column(i).to_pylist()) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(estimate(a, b) >= least))

    return run


class _Forest:
    """Union-find over component ids, inside one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _alike(least: float):
    """In a pair of blocks of one bucket: which components may be linked, as a forest over them.

    Sets outside the bucket's largest component meet the block's sets by signature.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out_, in_ = group[group["outside"]], group[~group["outside"]]
        forest, found = _Forest(), []
        if len(out_) and len(in_):
            a, b = (_signatures(list(x["sig"])) for x in (out_, in_))
            c, d = out_["comp"].to_numpy(), in_["comp"].to_numpy()
            for i in range(len(a)):
                for x in np.unique(d[(d != c[i]) & (estimate(a[i], b) >= least)]).tolist():
                    if forest.join(int(c[i]), x):
                        found.append((int(c[i]), x))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def common(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all sets of b, by products of indicator matrices."""
    sizes = [len(x) for x in (*a, *b)]
    both, column = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(a), len(b)), np.int64)
    for low in range(0, len(both), width):
        i, j = np.searchsorted(column, (low, low + width))
        part = np.zeros((len(sizes), min(width, len(both) - low)), np.float32)
        part[row[i:j], column[i:j] - low] = 1
        total += (part[: len(a)] @ part[len(a) :].T).astype(np.int64)  # sums of at most `width` ones are exact
    return total


def _links(percent: int):
    """In a pair of blocks of one cluster: links between components on full sets, as a forest over them."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        p, q = group["p"].iloc[0], group["q"].iloc[0]
        left = group[group["block"] == p]
        right = group[group["block"] == q]
        forest, found = _Forest(), []
        if len(left) and len(right):
            a, b = ([np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in (left, right))
            both = common(a, b)
            union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b]) - both
            c, d = left["comp"].to_numpy(), right["comp"].to_numpy()
            i, j = np.nonzero((100 * both >= percent * union) & (c[:, None] != d))
            m, n = left["id"].to_numpy(), right["id"].to_numpy()
            found = [(m[x], n[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(int(c[x]), int(d[y]))]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _sets(words: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for x, first in shingles(batch.column(1), words, lower):
                n = len(first) - 1
                own = [np.unique(x[first[i] : first[i + 1]]).tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(own, pa.binary())], ["id", "shingles"])
                row += n

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    sigs = reps.select("rep", "sig")
    pairs = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = cut(pairs.select("a", "b", "sa", "sb").mapInArrow(_likely(cutoff(percent / 100)), "a long, b long"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long").distinct())


def _second_look(shared: DataFrame, one: DataFrame, sets: DataFrame, joined: DataFrame, percent: int) -> DataFrame | None:
    """Links between components that share a bucket but whose sets were not paired with each other; None without any."""
    member = shared.select("bucket", "rep").join(joined, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("component", "rep").alias("comp"))
    parts = member.groupBy("bucket", "comp").count()
    parts = parts.groupBy("bucket").agg(F.max_by("comp", F.struct("count", "comp")).alias("major"), F.sum("count").alias("n"), F.max("count").alias("_most"), F.count("*").alias("k"))
    # in a bucket of two sets the one pair was tested
    rows = lambda n: F.ceil(n / BLOCK).cast("int")
    parts = parts.filter("k > 1 and n > 2").select("bucket", "major", rows(F.col("n")).alias("_in"), rows(F.col("n") - F.col("_most")).alias("_out"))
    unsure = member.join(parts, "bucket").join(one.select("rep", "sig"), "rep")
    # both sides in blocks, so that a group stays bounded however many sets are outside
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = unsure.select("bucket", own("_in").alias("i"), every("_out").alias("o"), F.lit(False).alias("outside"), "comp", "sig")
    outside = unsure.filter("comp <> major").select("bucket", every("_in").alias("i"), own("_out").alias("o"), F.lit(True).alias("outside"), "comp", "sig")
    alike = cut(inside.unionByName(outside).groupBy("bucket", "i", "o").applyInPandas(_alike(cutoff(percent / 100)), "a long, b long").distinct())
    if not alike.limit(1).count():
        return None
    # components that may be linked make clusters; a cluster's sets meet in pairs of bounded blocks
    clusters = components(alike)
    clusters = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct()).withColumnsRenamed({"node": "comp", "component": "cluster"})
    members = one.select("rep").join(joined, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("comp")).join(clusters, "comp")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("_n"))
    members = members.join(sizes, "cluster").select("cluster", "comp", F.col("rep").alias("id"), F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int").alias("block"), "_n")
    spread = members.join(sets, "id").select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other"))
    spread = spread.select("cluster", F.least("block", "_other").alias("p"), F.greatest("block", "_other").alias("q"), "block", "id", "comp", "shingles")
    return cut(spread.groupBy("cluster", "p", "q").applyInPandas(_links(percent), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Links hold where 100 * |A & B| >= percent * |A | B| over the sets of word shingles.
    """
    sketches = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketch(words, lower), "doc_id long, n_shingles long, key1 long, key2 long, sig binary, bands array<long>"), "sketches")
    full = sketches.filter("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"))
    # the signature depends on the set alone, so that of the smallest id does for all
    one = full.join(reps.withColumnRenamed("rep", "doc_id"), ["key1", "key2", "doc_id"], "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps, one = cut(reps), stage(one, "representatives")
    buckets = one.select("rep", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("_last")).filter("hub < _last").select("bucket", "hub")
    shared = stage(buckets.join(hubs, "bucket"), "buckets")  # only buckets of two sets or more
    pairs = shared.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    needed = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(needed, "doc_id", "left_semi")
    sets = stage(texts.mapInArrow(_sets(words, lower), "id long, shingles binary"), "sets")
    links = _confirmed(pairs, one, sets, percent)
    joined = cut(components(links))
    more = _second_look(shared, one, sets, joined, percent)
    if more is not None:
        joined = cut(components(links.unionByName(more)))
    for table in (shared, sets, one):
        drop_stage(table)
    classes = reps.join(joined, F.col("rep") == F.col("node"), "left").select(F.col("key1").alias("_k1"), F.col("key2").alias("_k2"), F.coalesce("component", "rep").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "key1", "key2").join(classes, (F.col("key1") == F.col("_k1")) & (F.col("key2") == F.col("_k2")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
