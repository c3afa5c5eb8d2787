"""Alignment of two tokenizers' tokens by the bytes they cover.

1. A text, with a space before it, is cut at single spaces between other characters. No token of
   a byte-level BPE (A) or a piece BPE (B) goes on over such a space, so the segments between are encoded
   apart, each once as long as a worker keeps it, and cut into groups at the byte offsets at which tokens of both end;
   a text's groups are those of its segments in order. A row keeps their digest, its distinct groups with their numbers, and its distinct id pairs.
2. An id pair's count is one aggregation over the distinct pairs of each row.
3. Counts go back to the distinct groups of the corpus, then the groups' sums to the rows.
   In both joins the keys that hold over 1/HEAVY of all go by broadcast; they are
   fewer than HEAVY whatever the corpus, and no other key has a larger share than that.

Defined cases: texts that are null or empty, or whose tokens' bytes differ from the
text's for A or B, have no tokens: zeros, and an empty groups column; each row is a document, repeated rows and
null ids too; an empty table gives an empty result; other columns are ignored, ids may have any type.
"""

from __future__ import annotations

import array
import base64
import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import made_schema, stage

TOKENIZER_A = "byte_bpe_50k"
TOKENIZER_B = "piece_bpe_32k"
#: Keys with over this part of all that a table counts are joined by broadcast.
HEAVY = 8192
#: Texts that are encoded together, and segments and characters that a worker keeps.
ROWS = 256
CACHE = 150_000
CHARS = 8_000_000
#: Tokens of a side beyond which a group's id pairs are made distinct at once.
LONG = 8

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, tally array<struct<pair: string, n: bigint>>, pairs array<bigint>"


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself where it is visible Latin, else the next of those from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """A byte-level BPE; the strings of special tokens are plain text."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in piece if c in letters)
        self.sizes = np.array([len(b) for b in self.bytes], np.int32)
        self.encode = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encode(f" {text}"), np.uint32)

    def segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all and the number of each one's: those without white space at an end are encoded in one text, as each begins a token at its space."""
        bare = np.array([s.strip() == s for s in segments])
        joined = [s for s in segments if s.strip() == s]
        ids = np.array(self.encode("".join([f" {s}" for s in joined])), np.uint32)
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(s.encode()) + 1 for s in joined])) + 1
        if bare.all():
            return ids, np.diff(ends, prepend=0)
        own = iter(np.split(ids, ends[:-1]))
        parts = [next(own) if x else self.whole(s) for s, x in zip(segments, bare, strict=True)]
        return np.concatenate(parts), np.array(list(map(len, parts)))


class Pieces:
    """A piece BPE, which puts a space before each text.

    If no piece of the model goes on over a space after another character, a text can be encoded in segments.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int32)
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)

    def segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all and the number of each one's."""
        found = self.model.encode(segments, num_threads=1)
        return np.array(list(itertools.chain.from_iterable(found)), np.uint32), np.array(list(map(len, found)))


class Both:
    """Groups of texts by two tokenizers; segments and their groups are kept until they are too many."""

    #: A single space between other characters: no token of either goes on over it.
    bound = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, a: str, b: str):
        self.own = BytePairs(a), Pieces(b)
        self.digits = [str(i) for i in range(max(len(e.bytes) for e in self.own))]
        self.forget()

    def forget(self) -> None:
        #: of a segment its groups as text and the bytes of their places; None if its tokens' bytes are not its own
        self.kept: dict[str, tuple[str, bytes] | None] = {}
        #: of a group its place, and by that the bytes of its id pairs and of its numbers of tokens
        self.chars, self.places, self.pairs, self.sizes = 0, {}, [], []

    def of(self, texts: list[str | None]) -> Iterator[list[tuple[str, bytes]]]:
        """The segments of each text; none if it has no tokens."""
        cut = self.bound.split if self.own[1].apart else lambda t: [t]
        apart = [cut(t) if t else [] for t in texts]
        if len(self.kept) > CACHE or self.chars > CHARS:
            self.forget()
        self.add([s for s in dict.fromkeys(itertools.chain(*apart)) if s not in self.kept])
        for segments in apart:
            found = [self.kept[s] for s in segments]
            yield [] if None in found else found

    def add(self, segments: list[str]) -> None:
        if not segments:
            return
        self.chars += sum(map(len, segments))
        coded = [e.segments(segments) for e in self.own]
        raw = [f" {s}".encode() for s in segments]
        right = np.logical_and(*[self._right(e, *c, raw) for e, c in zip(self.own, coded, strict=True)])
        self.kept.update(dict.fromkeys(itertools.compress(segments, (~right).tolist())))
        if not right.any():
            return
        # both sides have the same bytes, so one after the other they still end together
        ids = [x[np.repeat(right, n)] for x, n in coded]
        ends = [np.cumsum(e.sizes[x], dtype=np.int64) for e, x in zip(self.own, ids, strict=True)]
        common = np.intersect1d(*ends, assume_unique=True)
        last = [np.searchsorted(e, common) + 1 for e in ends]
        first = [np.concatenate([[0], x[:-1]]) for x in last]
        sizes = np.stack([y - x for x, y in zip(first, last, strict=True)], axis=1)
        n = np.where(sizes.max(axis=1) > LONG, 0, sizes.prod(axis=1))
        of, upto = np.repeat(np.arange(len(n)), n), np.cumsum(n)
        at = np.arange(len(of)) - (upto - n)[of]
        keys = (ids[0][first[0][of] + at // sizes[of, 1]].astype(np.int64) << 32) + ids[1][first[1][of] + at % sizes[of, 1]]
        keys, sizes = keys.tobytes(), sizes.tobytes()
        x, y = ([self.digits[i] for i in side.tolist()] for side in ids)
        names, spans = [], zip(*[z.tolist() for z in (first[0], last[0], first[1], last[1])], strict=True)
        start = 0
        for g, ((i, j, k, m), end) in enumerate(zip(spans, (8 * upto).tolist(), strict=True)):
            name = f"{x[i] if j - i == 1 else ','.join(x[i:j])}|{y[k] if m - k == 1 else ','.join(y[k:m])}"
            names.append(name)
            if name not in self.places:
                self.places[name] = len(self.pairs)
                many = np.array([(int(a) << 32) + int(b) for a in set(x[i:j]) for b in set(y[k:m])], np.int64).tobytes() if start == end else keys[start:end]
                self.pairs.append(many)
                self.sizes.append(sizes[16 * g : 16 * g + 16])
            start = end
        places = np.array([self.places[n] for n in names], np.int32).tobytes()
        upto = np.searchsorted(common, ends[0][np.cumsum(coded[0][1][right]) - 1]) + 1
        i = 0
        for s, j in zip(itertools.compress(segments, right.tolist()), upto.tolist(), strict=True):
            self.kept[s] = names[i] if j - i == 1 else ";".join(names[i:j]), places[4 * i : 4 * j]
            i = j

    def _right(self, encoder: BytePairs | Pieces, ids: np.ndarray, n: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether each segment's tokens have its bytes."""
        found = b"".join(map(encoder.bytes.__getitem__, ids.tolist()))
        ends = np.concatenate([[0], np.cumsum(encoder.sizes[ids], dtype=np.int64)])[np.cumsum(n)]
        if found == b"".join(raw) and np.array_equal(ends, np.cumsum(list(map(len, raw)))):
            return np.ones(len(raw), bool)
        return np.array([found[i:j] == x for (i, j), x in zip(itertools.pairwise([0, *ends.tolist()]), raw, strict=True)])


_BOTH: dict[tuple[str, str], Both] = {}


def _aligned(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _BOTH.get((a, b)) or _BOTH.setdefault((a, b), Both(a, b))
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                numbers, digests, groups, counts, pairs = [], [], [], [], []
                for own in both.of(part.column(1).to_pylist()):
                    digests.append(hashlib.sha256(";".join([x[0] for x in own]).encode()).hexdigest() if own else "")
                    places, n = np.unique(np.frombuffer(b"".join([x[1] for x in own]), np.int32), return_counts=True)
                    held = places.tolist()
                    x, y = np.frombuffer(b"".join([both.sizes[p] for p in held]), np.int64).reshape(-1, 2).T
                    numbers.append((n @ x, n @ y, n.sum(), n @ (x * y)))
                    groups.append(places)
                    counts.append(n)
                    pairs.append(np.unique(np.frombuffer(b"".join([both.pairs[p] for p in held]), np.int64)))
                names = list(both.places)
                ends = lambda lists: pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
                flat = pa.array([names[p] for p in np.concatenate(groups).tolist()], pa.string())
                tally = pa.StructArray.from_arrays([flat, pa.array(np.concatenate(counts), pa.int64())], ["pair", "n"])
                arrays = [
                    *map(pa.array, np.array(numbers, np.int64).T),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(ends(groups), tally),
                    pa.ListArray.from_arrays(ends(pairs), pa.array(np.concatenate(pairs))),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "tally", "pairs"])

    return run


def aligned_groups(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """doc_id, the numbers of tokens, groups and links, the digest of the groups, and the distinct groups (`a1,a2|b1`) with their numbers and the distinct id pairs they link."""
    return docs.select("doc_id", "text").mapInArrow(_aligned(a, b), made_schema(docs, ["doc_id"], ALIGNED))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ids(written: Column) -> Column:
    """Both sides of a written group, as arrays of ids."""
    return F.transform(F.split(written, r"\|"), lambda side: F.transform(F.split(side, ","), lambda x: x.cast("long")))


def _key(a: Column, b: Column) -> Column:
    """An id pair as a number: the A id in the high half, the B id in the low one."""
    return F.shiftleft(a, 32) + b


def _links(written: Column) -> Column:
    """The id pairs of a written group with their numbers of links, (key, n)."""
    counted = F.transform(_ids(written), lambda x: F.transform(F.array_distinct(x), lambda d: F.struct(d.alias("id"), F.size(F.filter(x, lambda y: y == d)).cast("long").alias("n"))))
    return _let(counted, lambda s: F.flatten(F.transform(F.get(s, F.lit(0)), lambda a: F.transform(F.get(s, F.lit(1)), lambda b: F.struct(_key(a["id"], b["id"]).alias("key"), (a["n"] * b["n"]).alias("n"))))))


def align(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> tuple[DataFrame, DataFrame]:
    """Per document its groups, and per id pair its count and whether that is its A id's highest.

    Both are staged tables: (uid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, tally, pairs), tally an
    array of a written group and its number (pair, n), and (key, count, best), key as in _key.
    """
    made = stage(aligned_groups(docs, a, b).withColumn("uid", F.monotonically_increasing_id()), "aligned")
    counts = made.select(F.explode("pairs").alias("key")).groupBy("key").count()
    counts = stage(counts, "pairs")
    highest = counts.groupBy(F.shiftright("key", 32).alias("_a")).agg(F.max("count").alias("_most"))
    counts = counts.join(highest, F.shiftright("key", 32) == F.col("_a")).select("key", "count", (F.col("count") == F.col("_most")).alias("best"))
    return made, stage(counts, "counts")


def _looked_up(rows: DataFrame, table: DataFrame, key: str, share: str) -> DataFrame:
    """rows with what table holds for their key, inner.

    Keys with over 1/HEAVY of all of table's `share` are joined by broadcast: they are fewer than HEAVY.
    """
    least = table.agg((F.coalesce(F.sum(share), F.lit(0)) / HEAVY).alias("least")).first()["least"]
    heavy, light = table.filter(F.col(share) > least), table.filter(F.col(share) <= least)
    known = rows.join(F.broadcast(heavy), key, "left")
    rest = known.filter(F.col(share).isNull()).select(rows.columns).join(light, key)
    return known.filter(F.col(share).isNotNull()).unionByName(rest)


def link_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document (uid) the sums over its links: n_best and count_sum. Each distinct group is summed up once."""
    tally = aligned.select("uid", F.explode("tally").alias("t")).select("uid", "t.*")
    distinct = stage(tally.groupBy("pair").agg(F.count("*").alias("held")), "groups")
    links = _looked_up(distinct.select("pair", F.explode(_links(F.col("pair"))).alias("x")).select("pair", "x.*"), counts, "key", "count")
    sums = links.groupBy("pair").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("of_best"), F.sum(F.col("n") * F.col("count")).alias("of_count"))
    sums = stage(sums.join(distinct, "pair"), "sums")
    every = _looked_up(tally, sums, "pair", "held")
    return every.groupBy("uid").agg(F.sum(F.col("n") * F.col("of_best")).alias("n_best"), F.sum(F.col("n") * F.col("of_count")).alias("count_sum"))


def aligned_documents(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    aligned, counts = align(docs, a, b)
    sums = link_counts(aligned, counts).withColumnRenamed("uid", "_uid")
    out = aligned.drop("tally", "pairs").join(sums, F.col("uid") == F.col("_uid"), "left")
    sum_of = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", sum_of("n_best"), sum_of("count_sum"), "groups_sha256")
