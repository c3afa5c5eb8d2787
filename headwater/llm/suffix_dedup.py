"""Removal of long repeated byte strings by prefix-free parsing.

1. Parse. Rolling-hash triggers cut every text into phrases that overlap by a
   trigger, so the parse of a string depends on the string alone.
2. Dictionary. Phrases are sorted over ranges by their first bytes and, where these
   are equal, by two independent hashes of 64 bits of the whole, since only equality
   matters beyond. Equal neighbours are one phrase, and its place in the order is its
   rank; phrases without a second one have none, and a repeated string holds none of
   them whole. The phrase at an edge of a range, whose equals may lie beyond, is named
   by a digest instead.
3. Parse order. All windows of `length` bytes with the same first and last trigger
   inside form a class: they share the phrases between the two (the core) and reach
   into the phrases before and after. A class is the meeting of a suffix of one
   dictionary phrase, a run of the parse and a prefix of another phrase. Classes are
   brought into one order over ranges by the core (the rank of its first phrase,
   then a hash of the ranks after it, since only equality matters beyond) and by the
   ranks of the phrases they reach into. Neighbours then tell: equal in all, every
   window of the class repeats; equal in the core alone, the suffix and the prefix
   decide; alone, nothing repeats. Windows that hold no phrase whole are classed by
   denser triggers, with hashes of the bytes in place of ranks; those without any that
   repeat within a stretch of texts, as in runs of one byte, are settled before the sort.
4. What is left lies at the ends of repeats. There windows are compared one by one,
   by two independent hashes of their bytes, of 64 and 32 bits, for one class of each
   reach.

Repeated passages of whole words are found in the same order: their windows are
PASSAGE words long and begin at words.

Every sorted table is read as a stream with one row of state; ranges split by row, so
a passage that a third of all texts share spreads evenly. Texts are shuffled once, by
a number given to each row, so repeated rows stay apart; the rows must come in the
same order whenever the input is read, as those of a table do.

Defined cases: a null text is empty; texts shorter than `length` lose nothing;
windows with one trigger at most are classed by a denser set of triggers, those
without any by themselves; a null id is an id like any;
rows that repeat in id and text each count as a place where strings start; a very
long text is parsed in pieces; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, Slice, Trigger, drop_stage, made_schema, mix, release, slices, stage, word_spans

LENGTH = 400
#: Words of a passage.
PASSAGE = 50
TRIGGER = 16
#: One position in PERIOD is a trigger.
PERIOD = 64
#: The same for windows that hold one trigger at most.
DENSE = 24
#: One text in so many is looked at for the bounds of ranges of classes.
PART = 16
#: Bytes hashed at a time.
PIECE = 1 << 20
#: Bytes of a phrase that it is sorted by before its hashes.
HEAD = 8

#: Two hashes of a span; different texts that agree in the first are as rare as the prime of its modulus makes them.
_CORE, _REACH = Roller(61), Trigger(63)
#: Choose the phrases, and the denser phrases of some windows.
_COARSE, _FINE = Trigger(61), Trigger(62)
_EDGE = 1 << 62
#: In place of a rank: a run of windows known to repeat.
SETTLED = -2


def span_hashes(roller: Roller | Trigger, raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the spans [first, last) of raw, sorted by their beginnings, over pieces of it."""
    out, i = np.zeros(len(first), np.uint64), 0
    while i < len(first):
        low = int(first[i])
        j = max(i + 1, int(np.searchsorted(first, low + PIECE)))
        high = int(last[i:j].max())
        prefix = roller.prefix(raw[low:high])
        out[i:j] = roller.spans(prefix, first[i:j] - low, last[i:j] - low)
        i = j
    return out


def find_triggers(trigger: Trigger, raw: np.ndarray, at: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all triggers and the rows they lie in."""
    found = [np.zeros(0, np.int64)]
    for low in range(0, max(0, len(raw) - TRIGGER + 1), PIECE):
        h = trigger.rolling(raw[low : low + PIECE + TRIGGER - 1], TRIGGER)
        found.append(np.flatnonzero((h >> np.uint64(32)) < np.uint64((1 << 32) // period)) + low)
    places = np.concatenate(found)
    row = np.searchsorted(at, places, "right") - 1
    inside = places + TRIGGER <= at[row + 1]
    return places[inside], row[inside]


class Parse:
    """The phrases of some texts that lie end to end.

    trigger, row: places of all triggers, and the rows they lie in. Row r with m triggers has
    the phrases up to its first trigger, from each trigger to the next, and from its last one:
    m + 1 in all, each with the trigger at either end. Phrase k + r + 1 begins at trigger k.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, period: int = PERIOD):
        self.raw, self.at = raw, at
        self.trigger, self.row = find_triggers(_COARSE, raw, at, period)
        rows = len(at) - 1
        self.base = np.append(0, np.cumsum(np.bincount(self.row, minlength=rows) + 1))  # first phrase of each row
        self.first = np.empty(self.base[-1], np.int64)
        self.last = np.empty(self.base[-1], np.int64)
        self.first[self.base[:-1]] = at[:-1]
        self.first[np.arange(len(self.trigger)) + self.row + 1] = self.trigger
        self.last[self.base[1:] - 1] = at[1:]
        self.last[np.arange(len(self.trigger)) + self.row] = self.trigger + TRIGGER
        self.of = np.repeat(np.arange(rows), np.diff(self.base))
        #: 0 between two triggers, 1 up to the first, 2 from the last, 3 without a trigger
        self.kind = np.zeros(self.base[-1], np.int64)
        self.kind[self.base[:-1]] += 1
        self.kind[self.base[1:] - 1] += 2

    def keys(self) -> np.ndarray:
        """What the phrases are sorted by: a row of bytes each."""
        at = self.first[:, None] + np.arange(HEAD)
        inside = at < self.last[:, None]
        head = np.where(inside, self.raw[np.minimum(at, max(0, len(self.raw) - 1))], 0) if len(self.raw) else np.zeros(at.shape)
        kind = self.kind.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        hashes = [mix(span_hashes(r, self.raw, self.first, self.last) + kind).astype(">u8").view(np.uint8).reshape(-1, 8) for r in (_CORE, _REACH)]
        return np.concatenate([head.astype(np.uint8), *hashes], axis=1)


def byte_windows(parse: Parse, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, f, g) of the classes of windows of `length` bytes: f and g, the first and the last trigger inside."""
    at, trigger, of = parse.at, parse.trigger, parse.row
    end = at[1:] - length + 1  # of each row's window starts
    some = end > at[:-1]
    # a class begins at a row's start, past a trigger, and where a trigger comes into reach
    past, comes = trigger + 1, trigger + TRIGGER - length
    first = np.unique(np.concatenate([at[:-1][some], past[past < end[of]], comes[(comes > at[of]) & (comes < end[of])]]))
    row = np.searchsorted(at, first, "right") - 1
    n = np.minimum(np.append(first[1:], len(parse.raw)), end[row]) - first
    f, g = np.searchsorted(trigger, first), np.searchsorted(trigger, first + length - TRIGGER, "right") - 1
    return row, first - at[row], n, f, g


def word_windows(parse: Parse, words: int) -> tuple[np.ndarray, ...]:
    """The same for windows of `words` words, numbered by the word at which they begin; and the words' begins and ends."""
    begin, end, at = word_spans(Slice(0, len(parse.at) - 1, parse.raw, parse.at))
    n = np.maximum(np.diff(at) - words + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n))[:-1], n)
    w = k + at[row]
    f = np.searchsorted(parse.trigger, begin[w])
    g = np.searchsorted(parse.trigger, end[w + words - 1] - TRIGGER, "right") - 1
    new = np.append(True, (row[1:] != row[:-1]) | (f[1:] != f[:-1]) | (g[1:] != g[:-1])) if len(row) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(row)))
    return row[new], k[new], size, f[new], g[new], begin, end, at


def spots(first: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
    """First window, number of windows and kind (0 bytes, 1 words) in one number."""
    return first.astype(np.int64) << 32 | n.astype(np.int64) << 1 | kind


def _unpack(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spot >> 32, spot >> 1 & 0x7FFFFFFF, spot & 1


def _batch(columns: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c) for c in columns], names.split())


def _dictionary(least: int):
    """(key, uid, number) of all phrases of texts of at least so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for s in slices(batch.column(1), 1 << 18):
                p = Parse(s.raw, s.at)
                some = (np.diff(s.at) >= least)[p.of]
                k = (np.arange(len(p.of)) - p.base[p.of]).astype(np.int32)
                keys = np.ascontiguousarray(p.keys()[some])
                offsets = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
                keys = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(keys)])
                yield _batch([keys, uid[s.first :][p.of[some]], k[some]], "key uid k")

    return run


def _neighbours(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch of a sorted partition, and for each row how many of its first `keys` columns equal the row before and the row
    after, -1 at the partition's edges."""

    def alike(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        out, still = np.zeros(len(a[0]), np.int64), np.ones(len(a[0]), bool)
        for x, y in zip(a, b, strict=True):
            still &= x == y
            out += still
        return out

    held, before = None, np.full(1, -1)
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            a, b = ([x.column(i).to_numpy() for i in range(keys)] for x in (held, batch))
            link = alike([x[-1:] for x in a], [x[:1] for x in b])
            inside = alike([x[1:] for x in a], [x[:-1] for x in a])
            yield held, np.append(before, inside), np.append(inside, link)
            before = link
        held = batch
    if held is not None:
        a = [held.column(i).to_numpy() for i in range(keys)]
        inside = alike([x[1:] for x in a], [x[:-1] for x in a])
        yield held, np.append(before, inside), np.append(inside, -1)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[Slice, Parse]]:
    for s in slices(batch.column(1), 1 << 18):
        yield s, Parse(s.raw, s.at)


def _own(column: pa.Array, s: Slice) -> tuple[np.ndarray, pa.Array]:
    """Rows of the slice that the entries of a list column belong to, and the entries."""
    own = column.slice(s.first, s.rows)
    return np.repeat(np.arange(s.rows), pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)), own.flatten()


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, k, rank) of phrases that have equals, from one range of the dictionary. The first and the last are named by a digest, since they may go on beyond."""
    from pyspark import TaskContext

    base, number, last = TaskContext.get().partitionId() << 40, -1, None
    held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the phrase that may be the last

    def named(key: bytes) -> int:
        return _EDGE | int.from_bytes(hashlib.sha256(key).digest()[:7], "big")

    def give(rows: list[tuple[np.ndarray, np.ndarray]], rank: int) -> pa.RecordBatch:
        uid, k = (np.concatenate(c) for c in zip(*rows, strict=True))
        return _batch([uid, k, np.full(len(uid), rank, np.int64)], "uid k rank")

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        uid, k = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        new = np.append(True, np.asarray(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False), bool))
        if last is not None and keys[0].as_py() == last:
            new[0] = False
        edges = np.append(np.flatnonzero(new), len(keys))
        if edges[0] > 0:
            held.append((uid[: edges[0]], k[: edges[0]]))
        if len(edges) == 1:
            continue
        if held and (number == 0 or sum(len(x) for x, _ in held) > 1):  # that phrase ends here
            yield give(held, named(last) if number == 0 else base + number)
        # phrases that begin and end in this batch
        inner = new.cumsum() - 1 + number + 1
        a, b = edges[0], edges[-2]
        if b > a:
            rank = base + inner[a:b]
            if number == -1:
                rank = np.where(inner[a:b] == 0, named(keys[0].as_py()), rank)
            keep = np.repeat(np.diff(edges[:-1]) > 1, np.diff(edges[:-1])) | (rank >= _EDGE)
            yield _batch([uid[a:b][keep], k[a:b][keep], rank.astype(np.int64)[keep]], "uid k rank")
        number += len(edges) - 1
        held, last = [(uid[b:], k[b:])], keys[b].as_py()
    if held:
        yield give(held, named(last))


class Dense:
    """Classes parted by a denser set of triggers, the others included."""

    def __init__(self, p: Parse, row: np.ndarray, first: np.ndarray, n: np.ndarray, begin, end):
        self.p, self.row, self.first, self.n, self.begin, self.end = p, row, first, n, begin, end
        self.trigger = np.zeros(0, np.int64)

    def __call__(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, first window, windows, f, g) of the parts of some classes, by first and last trigger inside."""
        more, _ = find_triggers(_FINE, self.p.raw, self.p.at, DENSE)
        self.trigger = np.union1d(self.p.trigger, more)
        n = self.n[which]
        row = np.repeat(self.row[which], n)
        x = np.repeat(self.first[which] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        f = np.searchsorted(self.trigger, self.begin(row, x))
        g = np.searchsorted(self.trigger, self.end(row, x) - TRIGGER, "right") - 1
        new = np.append(True, (row[1:] != row[:-1]) | (x[1:] != x[:-1] + 1) | (f[1:] != f[:-1]) | (g[1:] != g[:-1]))
        at = np.flatnonzero(new)
        return row[at], x[at], np.diff(np.append(at, len(row))), f[at], g[at]


def _same(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of pairs of hashes, and in that order which equal the one before, and which equal a neighbour."""
    order = np.lexsort((h2, h1))
    same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    again = np.append(np.zeros(min(1, len(order)), bool), same)
    return order, again, again | np.append(same, np.zeros(min(1, len(order)), bool))


def _joined(row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, n) of the runs of consecutive windows."""
    order = np.lexsort((first, row))
    row, first = row[order], first[order]
    at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (first[1:] > first[:-1] + 1))) if len(row) else np.zeros(0, np.int64)
    return row[at], first[at], np.diff(np.append(at, len(row)))


def _classes(length: int, words: int):
    """(head, rest, left, right, uid, spot) of the classes whose core repeats as far as single phrases tell."""
    factor = np.uint64(0x9FB21C651E98DF25)

    def hashed(raw: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Two hashes of each span."""
        order, out = np.argsort(low, kind="stable"), np.empty((2, len(low)), np.uint64)
        for i, roller in enumerate((_CORE, _REACH)):
            out[i, order] = mix(span_hashes(roller, raw, low[order], high[order]))
        return out

    def rows(p: Parse, rank: np.ndarray, row, first, n, f, g, kind, begin, end, dense) -> list[np.ndarray]:
        """begin, end: bytes of a window by row and number; dense: parts some classes by denser triggers."""
        salt = np.uint64(kind) * factor
        unknown = np.append(0, np.cumsum(rank < 0))
        # phrases [a, b) lie whole in the window
        a, b = f + row + 1, g + row + 1
        kept = np.flatnonzero(g > f)
        kept = kept[unknown[b[kept]] == unknown[a[kept]]]
        a, b = a[kept], b[kept]
        # hash of the ranks of a core, from prefix sums of mixed ranks
        prefix = _CORE.sums(mix(rank.astype(np.uint64) + np.uint64(1)) >> np.uint64(4))
        rest = mix(_CORE.spans(prefix, a, b) + (b - a).astype(np.uint64) * factor)
        head = rank[a] if len(a) else np.zeros(0, np.int64)
        out = [head, rest ^ salt, rank[a - 1], rank[b], row[kept], spots(first[kept], n[kept], kind)]
        few = np.flatnonzero(g <= f)
        if not len(few):
            return out
        row, first, n, f, g = dense(few)
        some = np.flatnonzero(g >= f)
        if len(some):
            r, x, count = row[some], first[some], n[some]
            spans = (dense.trigger[f[some]], dense.trigger[g[some]] + TRIGGER), (begin(r, x), end(r, x + count - 1))
            h = [hashed(p.raw, *span) for span in spans]
            positive = [(v >> np.uint64(2)).view(np.int64) for v in h[1]]
            more = [h[0][0].view(np.int64), h[0][1] ^ salt, *positive, r, spots(x, count, kind)]
            out = [np.concatenate(c) for c in zip(out, more, strict=True)]
        bare = np.flatnonzero(g < f)
        if len(bare):  # no trigger inside: every window by itself
            count = n[bare]
            x = np.repeat(first[bare] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            r = np.repeat(row[bare], count)
            h = hashed(p.raw, begin(r, x), end(r, x))
            first_, again, repeats = _same(h[0], h[1])
            lone = first_[~again]
            zero = np.zeros(len(lone), np.int64)
            more = [h[0][lone].view(np.int64), (h[1] ^ salt)[lone], zero, zero, r[lone], spots(x[lone], np.ones(len(lone), np.int64), kind)]
            own, low, count = _joined(r[first_[repeats]], x[first_[repeats]])
            anywhere = mix(own.astype(np.uint64) * factor + low.astype(np.uint64)).view(np.int64)
            done = [anywhere, np.zeros(len(own), np.uint64), np.full(len(own), SETTLED), np.full(len(own), SETTLED), own, spots(low, count, kind)]
            out = [np.concatenate(c) for c in zip(out, more, done, strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for s, p in _texts(batch):
                row, entries = _own(batch.column(2), s)
                rank = np.full(p.base[-1], -1, np.int64)
                if len(row):
                    rank[p.base[row] + entries.field(0).to_numpy()] = entries.field(1).to_numpy()
                low, high = (lambda r, x, p=p: p.at[r] + x), (lambda r, x, p=p: p.at[r] + x + length)
                own = byte_windows(p, length)
                found = [rows(p, rank, *own, 0, low, high, Dense(p, *own[:3], low, high))]
                *own, begin, end, at = word_windows(p, words)
                low, high = (lambda r, x, b=begin, at=at: b[at[r] + x]), (lambda r, x, e=end, at=at: e[at[r] + x + words - 1])
                found.append(rows(p, rank, *own, 1, low, high, Dense(p, *own[:3], low, high)))
                head, rest, left, right, of, spot = (np.concatenate(c) for c in zip(*found, strict=True))
                if len(head):
                    yield _batch([head, rest, left, right, uid[s.first :][of], spot], "head rest left right uid spot")

    return run


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From one range of the order: classes that repeat whole, and those whose windows must be compared."""
    held = None  # the first class of a core of which no second reach has come yet

    def asked(row: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return _batch([*row, np.array([False]), np.array([True])], "uid spot whole compare")

    for batch, before, after in _neighbours(batches, 4):
        left, right, uid, spot = (batch.column(i).to_numpy() for i in (2, 3, 4, 5))
        known, settled = (left >= 0) & (right >= 0), left == SETTLED
        lead = ~(known & (before == 4)) & ~settled  # the first of its reach
        whole = ~lead | known & (after == 4)
        compare = lead & (before != 0) & (before != 1)  # not the first of its core, or that can't be seen
        leads = np.flatnonzero(lead)
        if held is not None and len(leads):
            if before[leads[0]] >= 2:
                yield asked(held)
            held = None
        # the first of a core is compared if the next reach is of the same core
        opens = lead & ~compare
        compare[leads[:-1]] |= opens[leads[:-1]] & (before[leads[1:]] >= 2)
        if len(leads) and opens[leads[-1]]:
            held = uid[leads[-1] : leads[-1] + 1], spot[leads[-1] : leads[-1] + 1]
        keep = whole | compare
        if keep.any():
            yield _batch([uid[keep], spot[keep], whole[keep], compare[keep]], "uid spot whole compare")
    if held is not None:  # its core may go on beyond the range
        yield asked(held)


def _windows(length: int, words: int):
    """Hashes of the windows of the classes to compare; those that repeat within a stretch of texts are settled, and one of each goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for s in slices(batch.column(1), 1 << 18):
                row, entries = _own(batch.column(2), s)
                first, n, kind = _unpack(entries.to_numpy(zero_copy_only=False))
                begin, end, at = word_spans(s)
                for which in (0, 1):
                    mine = kind == which
                    count = n[mine]
                    if not len(count):
                        continue
                    r = np.repeat(row[mine], count)
                    x = np.repeat(first[mine] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                    a, b = (s.at[r] + x, s.at[r] + x + length) if which == 0 else (begin[at[r] + x], end[at[r] + x + words - 1])
                    order = np.argsort(a, kind="stable")
                    r, x, a, b = r[order], x[order], a[order], b[order]
                    found.append((mix(span_hashes(_CORE, s.raw, a, b) + np.uint64(which)), (mix(span_hashes(_REACH, s.raw, a, b)) >> np.uint64(32)).astype(np.uint32).view(np.int32), uid[s.first :][r], spots(x, np.ones(len(x), np.int64), which)))
                    size += len(x)
                    if size > 500_000:
                        yield _settled(found)
                        found, size = [], 0
        if found:
            yield _settled(found)

    return run


def _settled(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Windows that repeat here become runs, which lie anywhere in the order; one of each, and all others, ask for equals elsewhere."""
    h1, h2, uid, spot = (np.concatenate(c) for c in zip(*found, strict=True))
    order, again, repeats = _same(h1, h2)
    asks, known = order[~again], order[repeats]
    first, _, kind = _unpack(spot[known])
    columns = [[h1[asks]], [h2[asks]], [uid[asks]], [spot[asks]], [np.zeros(len(asks), bool)]]
    for which in (0, 1):
        own, low, n = _joined(uid[known][kind == which], first[kind == which])
        anywhere = mix(own.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + low.astype(np.uint64))
        for c, x in zip(columns, (anywhere, np.zeros(len(own), np.int32), own, spots(low, n, which), np.ones(len(own), bool)), strict=True):
            c.append(x)
    return _batch([np.concatenate(c) for c in columns], "h1 h2 uid spot known")


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted windows, those that have an equal neighbour, and the runs known before."""
    for batch, before, after in _neighbours(batches, 2):
        keep = pc.or_(batch.column(4), pa.array((before == 2) | (after == 2)))
        yield batch.select([2, 3]).filter(keep)


def merged(first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of bytes covered by windows starting in [first, first + n)."""
    order = np.argsort(first, kind="stable")
    a, b = first[order].astype(np.int64), (first[order] + n[order] - 1 + length).astype(np.int64)
    b = np.maximum.accumulate(b)
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(new[1:], True)]


def _remove(length: int, words: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw, found = (batch.column(2)[i].as_py() or "").encode(), batch.column(3)[i].values
                if found is None or not len(found):
                    out.append((len(raw), 0, 0, raw, [], 0, 0))
                    continue
                first, n, kind = _unpack(found.to_numpy())
                a, b = (merged(first[kind == 0], n[kind == 0], length)) if (kind == 0).any() else (np.zeros(0, np.int64),) * 2
                x, y = (merged(first[kind == 1], n[kind == 1], words)) if (kind == 1).any() else (np.zeros(0, np.int64),) * 2
                kept = b"".join(raw[p:q] for p, q in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                out.append((len(raw), int((b - a).sum()), len(a), kept, [{"first": p, "last": q} for p, q in zip(a.tolist(), b.tolist(), strict=True)], len(x), int((y - x).sum())))
            size, removed, runs, kept, where, passages, covered = zip(*out, strict=True) if out else ((),) * 7
            long = lambda x: pa.array(x, pa.int64())
            columns = [batch.column(1), long(size), long(removed), long(runs), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), long(passages), long(covered)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words"]
            if with_text:
                columns += [pa.array(where, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(kept, pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _by_text(rows: DataFrame, entry, name: str) -> DataFrame:
    """A row for each text with the list of its entries."""
    return rows.groupBy(F.col("uid").alias(f"_{name}")).agg(F.collect_list(entry).alias(name))


def _ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Sorted over ranges, which are split by row, so that equal keys may lie in several."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(ranges, *keys, "uid", *[c for c in df.columns if c in ("k", "spot")]).sortWithinPartitions(*keys)


def lexicographic(bounds: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """For each row the number of bounds (sorted rows of as many columns) that don't come after it."""
    out = np.zeros(len(columns[0]), np.int64)
    todo = [(np.arange(len(out)), 0, len(bounds), 0)]
    while todo:
        rows, low, high, c = todo.pop()
        if c == len(columns):
            out[rows] = high
            continue
        own, of = columns[c][rows], bounds[low:high, c]
        a, b = np.searchsorted(of, own, "left"), np.searchsorted(of, own, "right")
        out[rows] = low + a
        for first in np.unique(a[b > a]).tolist():  # bounds that agree so far
            some = (a == first) & (b > a)
            todo.append((rows[some], low + first, low + int(b[some][0]), c + 1))
    return out


def _with_range(run, bounds: np.ndarray):
    """Adds to the batches of run the range that each row belongs to."""

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            place = lexicographic(bounds, [c.to_numpy() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int32))], [*batch.schema.names, "range"])

    return ranged


def _in_ranges(texts: DataFrame, run, schema: str, keys: list[str]) -> DataFrame:
    """The rows that run makes of texts, sorted over ranges of all their columns.

    Spark's own ranges would run it twice, once to sample it. Here the bounds come from what one text in PART gives;
    one row for each range goes to the driver, as many as there are shuffle partitions.
    """
    ranges = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = texts.filter(F.pmod(F.xxhash64("uid"), F.lit(PART)) == 0).mapInArrow(run, schema)
    least = part.repartitionByRange(ranges, *part.columns).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(F.struct(*part.columns)).alias("b"))
    bounds = np.array(sorted(tuple(r["b"]) for r in least.collect())[1:], np.int64).reshape(-1, len(part.columns))
    placed = texts.mapInArrow(_with_range(run, bounds), f"{schema}, range int").repartitionById(ranges, "range")
    return placed.sortWithinPartitions(*keys).drop("range")


def _ranked(numbered: DataFrame, length: int, words: int) -> DataFrame:
    """(_ranks, ranks): the ranks of each text's phrases that have equals."""
    keys = numbered.select("uid", "text").mapInArrow(_dictionary(min(length, 2 * words - 1)), "key binary, uid long, k int")
    ranks = _ordered(keys, "key").mapInArrow(_ranks, "uid long, k int, rank long")
    return stage(_by_text(ranks, F.struct("k", "rank"), "ranks"), "ranks")


def _judged_runs(numbered: DataFrame, ranks: DataFrame, length: int, words: int) -> DataFrame:
    """(_runs, certain, unsure): each text's classes that repeat whole, and those to compare."""
    texts = numbered.select("uid", "text").join(ranks, F.col("uid") == F.col("_ranks"), "left")
    classes = _in_ranges(texts.select("uid", "text", "ranks"), _classes(length, words), "head long, rest long, left long, right long, uid long, spot long", ["head", "rest", "left", "right"])
    judged = classes.mapInArrow(_judged, "uid long, spot long, whole boolean, compare boolean")
    pick = lambda which: F.transform(F.filter("runs", lambda r: r[which]), lambda r: r["spot"])
    return stage(_by_text(judged, F.struct("spot", "whole", "compare"), "runs").select("_runs", pick("whole").alias("certain"), pick("compare").alias("unsure")), "runs")


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, words: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; n_passages and passage_words, the runs of at least `words` words that stand
    elsewhere too and their words; with_text adds the spans and the remaining bytes.

    Ranks and classes are steps of their own, written to the shared folder, so that the disk
    that each needs for its shuffles is free again before the next.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), "text", "doc_id")
    ranks = _ranked(numbered, length, words)
    release(docs.sparkSession)
    runs = _judged_runs(numbered, ranks, length, words)
    drop_stage(ranks)
    release(docs.sparkSession)
    texts = numbered.repartition("uid")
    unsure = runs.filter(F.size("unsure") > 0).select(F.col("_runs").alias("_unsure"), "unsure")
    # with doc_id, so that one exchange of the texts serves here and below
    windows = texts.join(unsure, F.col("uid") == F.col("_unsure")).select("uid", "text", "unsure", "doc_id").mapInArrow(_windows(length, words), "h1 long, h2 int, uid long, spot long, known boolean")
    # a window asks once for each stretch of texts, so one that many texts share has few rows
    equal = windows.repartition("h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(_equal_windows, "uid long, spot long")
    singles = _by_text(equal, "spot", "singles")
    certain = runs.select(F.col("_runs").alias("_certain"), "certain")
    out = texts.join(certain, F.col("uid") == F.col("_certain"), "left").join(singles, F.col("uid") == F.col("_singles"), "left")
    none = F.array().cast("array<bigint>")
    out = out.select("uid", "doc_id", "text", F.concat(F.coalesce("certain", none), F.coalesce("singles", none)).alias("_found"))
    made = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long"
    if with_text:
        made += ", spans array<struct<first:long,last:long>>, kept binary"
    return out.mapInArrow(_remove(length, words, with_text), made_schema(docs, ["doc_id"], made))
