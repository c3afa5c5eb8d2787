"""Best-fit packing of tokenised documents into sequences of fixed length.

Bulk-synchronous best fit, longest first. Sorted by length, documents fall into
at most `capacity` runs of one length, and the gaps of open sequences into runs of
one width; both are rows of one table, which is all that a round sees.
In a round a sweep passes over documents and gaps from the largest size down. A
run of documents meets its successor, the narrowest gap not yet taken that holds
its length; conflicts over gaps are resolved by rank: the i-th documents of the
run go to the i-th gap, as many side by side as fit, and what is left of the
longer run goes to the next gaps. The gaps shrink by what they took and take part
again in the next round. Documents that no gap can hold open sequences, all those
of over half the capacity and those of nearly the greatest length left; shorter
ones wait for the gaps these leave. Each round is a step over the table, written
to the shared folder.

The rounds yield a plan by length and rank, and every document finds its place
there by its own rank among those of its length. The plan and the table have a
few entries for each length, whatever the number of documents.

Defined cases: a null or empty text is one piece of the end token alone; a null
id is an id of its own; repeated rows are packed each; an empty table gives an
empty result; other columns are ignored; ids may have any type.
"""

from __future__ import annotations

import array
import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, made_schema, ranked, shuffle_key, stage

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k"
#: Words kept by a worker's cache; it starts anew when full.
CACHE = 400_000
#: Share of the greatest length left from which waiting documents open sequences together.
NEARLY = 0.8

PIECES = "piece int, start long, length long, ids_crc32 long"


class Ids(dict):
    """Ids of a space and a word, as little-endian unsigned 32-bit bytes, made when first asked for.

    The vocabulary's pattern always begins a token at a space between two visible
    characters, so words can be encoded apart. Words that may hold the special
    token's text go to the full tokenizer.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        ids = self.full.encode(text, add_special_tokens=False).ids if "<|" in text else self.fast(text)
        return array.array("I", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) > 2 and word[-1] in ",." and word[:-1].isalpha():
            ids = self[word[:-1]] + self.whole(word[-1])
        else:
            ids = self.whole(f" {word}")
        if len(word) < 40:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids

    #: A space with white space, or nothing, on both sides: words can't be encoded apart there.
    bound = re.compile(r"(?:^|\s) (?:\s|\Z)")

    def encode(self, text: str) -> bytes:
        if self.bound.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


_IDS: dict[str, Ids] = {}


def _pieces(name: str, capacity: int, end: int):
    last = array.array("I", [end]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _IDS.get(name) or _IDS.setdefault(name, Ids(name))
        for batch in batches:
            out = ([], [], [], [], [])
            for i in range(batch.num_rows):
                raw = ids.encode(batch.column(1)[i].as_py() or "") + last
                n = len(raw) // 4
                at, number = 0, 0
                while at < n:  # the first piece takes the remainder
                    size = (n - at - 1) % capacity + 1 if at == 0 else capacity
                    for column, x in zip(out, (i, number, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])), strict=True):
                        column.append(x)
                    at, number = at + size, number + 1
            rest = [pa.array(x, t) for x, t in zip(out[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), *rest], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def tokenize(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece of at most `capacity` ids; only the first piece of a longer document is shorter."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end), made_schema(docs, ["doc_id"], PIECES))


def sweep(docs: list[list[int]], gaps: list[list[int]], capacity: int, used: int) -> tuple[list[tuple[int, ...]], list[list[int]], list[list[int]], int]:
    """One round over docs [length, rank, n] and gaps [width, sequence, n], from the largest size down.

    Gives the places (length, rank, n, sequence, offset, each), the documents and gaps for
    the next round and the number of sequences in use. `each` documents lie side by side
    in a sequence, from `sequence` on and `offset` within it.
    """
    gaps = sorted(gaps, reverse=True)
    places, open_, after, waiting, i = [], [], [], [], 0
    for length, rank, n in sorted(docs, key=lambda d: (-d[0], d[1])):
        while i < len(gaps) and gaps[i][0] >= length:  # the last one pushed is the narrowest
            open_.append(list(gaps[i]))
            i += 1
        while n and open_:
            width, first, k = open_[-1]
            each = min(n, width // length)
            took = min(n // each, k)
            places.append((length, rank, took * each, first, capacity - width, each))
            after.append([width - each * length, first, took])
            rank, n = rank + took * each, n - took * each
            open_[-1][1:] = first + took, k - took
            if took == k:
                open_.pop()
        if n:
            waiting.append([length, rank, n])
    after = [g for g in (*after, *open_, *gaps[i:]) if g[0] > 0 and g[2] > 0]
    widest = max((g[0] for g in after), default=0)
    longest = max((d[0] for d in waiting if d[0] > widest), default=0)
    left, gap = [], 0  # gap: of the sequence `used - 1` that takes what doesn't fill one of its own
    for length, rank, n in waiting:
        if length <= widest or length < NEARLY * longest and 2 * length <= capacity:
            left.append([length, rank, n])
            continue
        each = capacity // length
        if took := n // each:
            if gap:
                after.append([gap, used - 1, 1])
            places.append((length, rank, took * each, used, 0, each))
            after.append([capacity - each * length, used, took])
            rank, n, used, gap = rank + took * each, n - took * each, used + took, 0
        while n:
            if gap < length:
                if gap:
                    after.append([gap, used - 1, 1])
                used, gap = used + 1, capacity
            k = min(n, gap // length)
            places.append((length, rank, k, used - 1, capacity - gap, k))
            rank, n, gap = rank + k, n - k, gap - k * length
    after = [g for g in (*after, [gap, used - 1, 1]) if g[0] > 0]
    return places, left, after, used


#: kind: 0 gap (a width, b first sequence, n), 1 documents (a length, b first rank, n), 2 place, 3 sequences in use (n).
_STATE = "kind int, a long, b long, n long, sequence long, offset long, each long"


def _swept(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        of = lambda kind: [[r["a"], r["b"], r["n"]] for r in rows if r["kind"] == kind]
        used = sum(n for _, _, n in of(3))
        places, docs, gaps, used = sweep(of(1), of(0), capacity, used)
        out = [(2, *p) for p in places]
        for kind, some in ((0, gaps), (1, docs), (3, [[0, 0, used]])):
            out += [(kind, *r, 0, 0, 0) for r in some]
        types = (pa.int32(), *[pa.int64()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in _STATE.split(", ")])

    return run


def plan(lengths: DataFrame, capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Rounds of best fit over (length, n), one row a length: the entries (length, rank, n, sequence, offset, each).

    The table of a round has at most one row for each length and some for each width.
    """
    zero = F.lit(0).cast("long")
    state = lengths.select(F.lit(1).alias("kind"), F.col("length").cast("long").alias("a"), zero.alias("b"), F.col("n").cast("long").alias("n"), zero.alias("sequence"), zero.alias("offset"), zero.alias("each"))
    entries = []
    while True:
        # the sweep runs in one task; places go to the driver round by round
        state = cut(state.coalesce(1).mapInArrow(_swept(capacity), _STATE))
        found = state.filter("kind in (1, 2)").collect()
        entries += [(r["a"], r["b"], r["n"], r["sequence"], r["offset"], r["each"]) for r in found if r["kind"] == 2]
        if not any(r["kind"] == 1 for r in found):
            return entries
        state = state.filter("kind <> 2")


def _place(entries: list[tuple[int, ...]]):
    table = np.array(sorted(entries), np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # lengths are small and ranks below 2**48, so both fit one sortable number
        begins = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(begins, (length << 48) + rank, "right") - 1] if len(length) else table[:0]
            i = rank - row[:, 1]
            columns = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 3] + i // np.maximum(row[:, 5], 1)), pa.array(row[:, 4] + i % np.maximum(row[:, 5], 1) * length)], [*[n for n in batch.schema.names if n != "rank"], "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents with the sequence and the offset at which each lies."""
    pieces = stage(tokenize(docs, tokenizer, capacity, end), "pieces")
    entries = plan(pieces.groupBy("length").agg(F.count("*").alias("n")), capacity)
    keyed = pieces.withColumn("_key", shuffle_key(F.concat_ws(",", F.col("doc_id"), F.col("piece")), "pack"))
    placed = ranked(keyed, ["length"], ["_key", "doc_id", "piece", "ids_crc32"], None, "rank").select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return placed.mapInArrow(_place(entries), made_schema(docs, ["doc_id"], f"{PIECES}, sequence_id long, offset long"))
