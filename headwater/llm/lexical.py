"""Ranked lexical search over a clustered index with exact stopping.

1. Recursive graph bisection: halves of a set of documents exchange documents while
   that lowers the logarithmic gap cost of the terms' postings, and are split again. It is
   fitted on a bounded sample (SAMPLE documents by hash, of each the SKETCH terms of
   smallest hash) and leaves for each node of the tree what a term adds to the cost of the
   left half over that of the right one.
2. Every document walks down the tree by the sum over its terms, whatever it holds,
   and so gets its place in the new order. A leaf is cut into as many shards as its documents
   and postings need, so a leaf with a third of all documents is many shards.
3. A shard is inverted in one task: for each term its documents (by place in the shard), their
   frequencies and the largest part that the term can add to a score there.
4. The terms' bounds add up to a bound for each query and shard. Shards are visited in the order of
   these bounds, in rounds that grow eightfold; a query stops when the next bound is below its
   last kept score. A bound equal to that score is still visited, as a tie may go to a smaller
   doc_id. So the result is that of a full scan, whatever the sample.

A query's terms and a shard's postings meet in a group of one shard and at most about
QUERIES queries; only the best of each come out of it.

Defined cases: a null text has no terms, as one without letters or digits, and is never found;
a query without terms finds nothing; repeated rows are found each, null ids after all others of their score;
repeated queries are answered each; an empty table gives an empty result; other columns are ignored; ids are whole numbers.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stage

#: Documents that the bisection is fitted on, and terms of each.
SAMPLE = 4096
SKETCH = 64
LEVELS = 6
#: Exchanges within a node, and the documents from which a node is split.
EXCHANGES = 12
SMALL = 8
#: Documents and postings of a shard, about.
SHARD_DOCS = 2048
SHARD_POSTINGS = 1 << 19
#: Queries that meet a shard in one group, about.
QUERIES = 256
#: Shards of the first round; each round has eight times as many.
FIRST = 4

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LAST_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are lower-cased."""
    return _TERM.findall(text.encode().lower()) if text else []


# --- bisection --------------------------------------------------------------


def _cost(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    """Bits of the gaps between a term's documents, for terms with so many documents in each half."""
    return left * np.log2(n_left / (left + 1)) + right * np.log2(n_right / (right + 1))


def bisect(doc: np.ndarray, term: np.ndarray, docs: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two halves of docs, and by term what a document of it adds to the left half's cost over the right one's.

    doc and term hold the postings of these documents.
    """
    at = np.full(int(docs.max()) + 1, -1)
    at[docs] = np.arange(len(docs))
    doc = at[doc]
    right = np.arange(len(docs)) >= len(docs) // 2
    for _ in range(EXCHANGES):
        side = right[doc]
        n = (len(docs) - int(right.sum()), int(right.sum()))
        d = [np.bincount(term[side == s], minlength=n_terms).astype(float) for s in (False, True)]
        now = _cost(d[0], d[1], *n)
        gain = [now - _cost(np.maximum(d[0] - 1, 0), d[1] + 1, *n), now - _cost(d[0] + 1, np.maximum(d[1] - 1, 0), *n)]
        each = np.bincount(doc, np.where(side, gain[1][term], gain[0][term]), minlength=len(docs))
        left_out, right_out = (np.flatnonzero(right == s) for s in (False, True))
        left_out, right_out = (x[np.argsort(-each[x], kind="stable")] for x in (left_out, right_out))
        k = min(len(left_out), len(right_out))
        k = int((each[left_out[:k]] + each[right_out[:k]] > 1e-9).sum())
        if not k:
            break
        right[left_out[:k]], right[right_out[:k]] = True, False
    side, n = right[doc], (len(docs) - int(right.sum()), int(right.sum()))
    d = [np.bincount(term[side == s], minlength=n_terms).astype(float) for s in (False, True)]
    adds = _cost(d[0] + 1, d[1], *n) - _cost(d[0], d[1] + 1, *n)
    return docs[~right], docs[right], np.where(d[0] + d[1] > 1, adds, 0)


def fit(sketches: list[list[bytes]]) -> dict[bytes, np.ndarray]:
    """For terms of two documents of the sample or more: what they add at each node of the tree, the root first."""
    counts = Counter(t for s in sketches for t in s)
    number = {t: i for i, t in enumerate(sorted(t for t, n in counts.items() if n > 1))}
    doc = np.array([i for i, s in enumerate(sketches) for t in s if t in number], np.int64)
    term = np.array([number[t] for s in sketches for t in s if t in number], np.int64)
    adds = np.zeros((len(number), (1 << LEVELS) - 1), np.float32)
    nodes = {0: np.arange(len(sketches))}
    for node in range((1 << LEVELS) - 1):
        docs = nodes.get(node, ())
        if len(docs) < SMALL or not len(number):
            continue
        inside = np.isin(doc, docs)
        nodes[2 * node + 1], nodes[2 * node + 2], adds[:, node] = bisect(doc[inside], term[inside], docs, len(number))
    return {t: adds[i] for t, i in number.items()}


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [sorted(set(terms(t)), key=lambda x: (zlib.crc32(x), x))[:SKETCH] for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(x) for x in own if x], pa.binary())], ["terms"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = fit([x.split(b" ") for b in batches for x in b.column(0).to_pylist()])
    yield pa.RecordBatch.from_arrays([pa.array(list(model), pa.binary()), pa.array([x.tobytes() for x in model.values()], pa.binary())], ["term", "adds"])


def tree(docs: DataFrame) -> dict[bytes, np.ndarray]:
    """The bisection of a sample of at most SAMPLE documents, SKETCH terms of each; its model has at most half as many terms as that has postings."""
    n = docs.count()
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, 2 * n // SAMPLE))) == 0).select("text")
    model = some.mapInArrow(_sketched, "terms binary").limit(SAMPLE).coalesce(1).mapInArrow(_fitted, "term binary, adds binary").collect()
    return {bytes(r["term"]): np.frombuffer(r["adds"], np.float32) for r in model}


def leaf(own: list[bytes], model: dict[bytes, np.ndarray]) -> int:
    """The leaf that a document of these terms gets to."""
    adds = [a for t in own if (a := model.get(t)) is not None]
    if not adds:
        return 0
    adds, node = np.sum(adds, axis=0), 0
    for _ in range(LEVELS):
        node = 2 * node + (2 if adds[node] > 0 else 1)
    return node - (1 << LEVELS) + 1


# --- index ------------------------------------------------------------------


def _forward(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.value
        for batch in batches:
            keep, leaves, n, k, own, tfs = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if counts := Counter(terms(text)):
                    keep.append(i)
                    leaves.append(leaf(list(counts), of))
                    n.append(sum(counts.values()))
                    k.append(len(counts))
                    own.append(b" ".join(counts))
                    tfs.append(np.fromiter(counts.values(), np.int32, len(counts)).tobytes())
            arrays = [pa.array(leaves, pa.int32()), batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(own, pa.binary()), pa.array(tfs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["leaf", "doc_id", "n", "k", "terms", "tfs"])

    return run


def part_of_score(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term of weight 1 adds to the score of a document of n terms."""
    m = 100 - 25 + (25 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


INDEX = "shard long, term binary, docs array<int>, tfs array<int>, high long, ids array<long>, ns array<long>"


def _inverted(docs: int, total: int):
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(shard: pa.Table) -> pa.Table:
        n = shard["n"].to_numpy()
        own = pa.array(b" ".join(shard["terms"].to_pylist()).split(b" "), pa.binary()).dictionary_encode()
        tf = np.frombuffer(b"".join(shard["tfs"].to_pylist()), np.int32)
        code, doc = own.indices.to_numpy(), np.repeat(np.arange(len(n), dtype=np.int32), shard["k"].to_numpy())
        order = np.argsort(code, kind="stable")
        at = np.searchsorted(code[order], np.arange(len(own.dictionary) + 1)).astype(np.int32)
        doc, tf = doc[order], tf[order]
        high = np.maximum.reduceat(part_of_score(tf.astype(np.int64), n[doc], docs, total), at[:-1])
        k = len(high)
        number = pa.array(np.full(k + 1, shard["shard"][0].as_py()))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(at, at[-1])), pa.array(x))  # noqa: E731  the last row, of the documents, has none
        whole = lambda c, t: pa.concat_arrays([pa.nulls(k, pa.list_(t)), pa.array([shard[c].to_pylist()], pa.list_(t))])
        columns = [number, pa.concat_arrays([own.dictionary, pa.nulls(1, pa.binary())]), lists(doc), lists(tf), pa.array(np.append(high, 0)), whole("doc_id", pa.int64()), whole("n", pa.int64())]
        return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


class Index:
    """The staged shards of all documents: a row for each term of a shard, and one, without a term, for its documents."""

    def __init__(self, postings: DataFrame, docs: int, total: int):
        self.postings, self.docs, self.total = postings, docs, total


def build(docs: DataFrame) -> Index:
    """The clustered index of all documents (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    model = spark.sparkContext.broadcast(tree(docs))
    forward = stage(docs.mapInArrow(_forward(model), "leaf int, doc_id long, n long, k long, terms binary, tfs binary"), "forward")
    sizes = forward.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum("k").alias("k")).collect()  # one row a leaf
    n, total = (sum(r[c] for r in sizes) for c in ("docs", "n"))
    shards = [0] * (1 << LEVELS)
    for r in sizes:
        shards[r["leaf"]] = max(-(-r["docs"] // SHARD_DOCS), -(-r["k"] // SHARD_POSTINGS))
    parts = F.greatest(F.get(F.array(*map(F.lit, shards)), F.col("leaf")), F.lit(1))
    shard = F.col("leaf").cast("long") * (1 << 32) + F.pmod(F.xxhash64("doc_id", "terms", F.monotonically_increasing_id()), parts)
    placed = forward.select(shard.alias("shard"), "doc_id", "n", "k", "terms", "tfs")
    return Index(stage(placed.groupBy("shard").applyInArrow(_inverted(n, max(total, 1)), INDEX), "index"), n, total)


# --- search -----------------------------------------------------------------


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(q, t, n) for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t, n in Counter(terms(text)).items()]
        q, t, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(t, pa.binary()), pa.array(n, pa.int64())], ["query", "term", "repeats"])


def _scored(docs: int, total: int, top: int):
    def run(shard: pa.Table, visits: pa.Table) -> pa.Table:
        found = {"query": [], "doc_id": [], "score": []}
        own = shard.to_pylist() if len(visits) else []
        if head := next((r for r in own if r["term"] is None), None):
            n, ids = np.array(head["ns"], np.int64), head["ids"]
            order = np.array([_LAST_ID if x is None else x for x in ids], np.int64)
            parts = {}
            for r in own:
                if r["term"] is not None:
                    at = np.array(r["docs"], np.int64)
                    parts[r["term"]] = at, part_of_score(np.array(r["tfs"], np.int64), n[at], docs, total)
            for v in visits.to_pylist():
                score = np.zeros(len(n), np.int64)
                for term, weight in zip(v["terms"], v["weights"], strict=True):
                    if (hit := parts.get(term)) is not None:
                        score[hit[0]] += weight * hit[1]
                some = np.flatnonzero(score > 0)
                for i in some[np.lexsort((order[some], -score[some]))[:top]].tolist():
                    for c, x in zip(found.values(), (v["query"], ids[i], int(score[i])), strict=True):
                        c.append(x)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in found.items()})

    return run


def search(index: Index, queries: DataFrame, top: int = 20) -> DataFrame:
    """The `top` documents of each of queries (item_id, text): item_id, rank, doc_id, score; the larger score first, then the smaller id."""
    items = stage(queries.select(F.monotonically_increasing_id().alias("query"), "item_id", "text"), "queries")
    asked = cut(items.select("query", "text").mapInArrow(_asked, "query long, term binary, repeats long"))
    # of the index only what the queries ask for
    hits = stage(index.postings.join(asked.select("term").distinct(), "term", "left_semi").drop("ids", "ns"), "hits")
    df = hits.groupBy("term").agg(F.sum(F.size("docs")).cast("long").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.docs).cast("long") + 2).cast("double") / (2 * F.col("df") + 1)))
    blocks = max(1, -(-items.count() // QUERIES))
    asked = cut(asked.join(df.select("term", weight.cast("long").alias("weight")), "term").select("query", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), "term", (F.col("repeats") * F.col("weight")).alias("weight")))
    whole = cut(asked.groupBy("query", "block").agg(F.collect_list(F.struct("term", "weight")).alias("t")).select("query", "block", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")))
    bounds = hits.select("shard", "term", "high").join(asked, "term").groupBy("query", "block", "shard").agg(F.sum(F.col("high") * F.col("weight")).alias("bound"))
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "shard")
    bounds = stage(bounds.withColumn("place", F.row_number().over(order)), "bounds")
    heads = index.postings.filter("term is null")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found, low, many = None, 0, FIRST
    while True:
        visits = bounds.filter((F.col("place") > low) & (F.col("place") <= low + many) & (F.col("bound") > 0))
        if found is not None:
            last = found.filter(F.col("rank") == top).select("query", F.col("score").alias("last"))
            visits = visits.join(last, "query", "left").filter(F.col("last").isNull() | (F.col("bound") >= F.col("last")))
        visits = cut(visits.select("query", "block", "shard"))
        if found is not None and not visits.limit(1).count():
            break
        groups = visits.select("shard", "block").distinct()
        postings = hits.withColumns({c: F.lit(None).cast("array<long>") for c in ("ids", "ns")}).unionByName(heads)
        postings = postings.join(groups, "shard").select("shard", "block", "term", "docs", "tfs", "ids", "ns")
        asking = visits.join(whole.drop("block"), "query").select(F.col("shard").alias("at"), F.col("block").alias("of"), "query", "terms", "weights")
        new = postings.groupBy("shard", "block").cogroup(asking.groupBy("at", "of")).applyInArrow(_scored(index.docs, max(index.total, 1), top), "query long, doc_id long, score long")
        found = new if found is None else new.unionByName(found.drop("rank"))
        found = cut(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top))
        low, many = low + many, 8 * many
    return found.join(items.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
