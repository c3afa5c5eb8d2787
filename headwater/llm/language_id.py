"""Language identification with interpolated Kneser-Ney character models.

One model per language over character 4-grams, lower case, all but letters as
one space. The counts of 4-grams come from every training text by a distributed
sum; all lower orders are continuation counts, which follow from the 4-grams
alone. The models of all languages share sorted arrays of packed n-grams, with a
row of log-probabilities for each; a direct table of first probes stands before
the binary search. A text goes to the language of lowest cross-entropy a
character.

Rejection is calibrated on held-out text: one text in FOLDS, by a hash of the
text, is left out of a first set of models, and the mean and deviation of its
characters' cross-entropy in its own language are taken. A prediction is rejected
if its cross-entropy exceeds that mean by more than `SLACK` nats plus `DEVIATIONS`
standard errors. Both moments are sums over 4-grams, so no text is read again. The
models that predict are made from all training texts.

Bounds: no language and no 4-gram is left out. While the models have at most
MAX_CELLS probabilities (4-grams times languages) they are broadcast whole. Beyond
that the probabilities of all orders are tables, made by joins from all counts,
and only those of the most frequent 4-grams of each language, MAX_CELLS again, are
broadcast, to save work: the other 4-grams of a text are joined with the tables.
The results are the same whichever are broadcast. A row for each language and
power of two goes to the driver.

Defined cases: null text or one without a letter is `und` with score 0 and
rejected; null lang is never trained on; without any training text all are
`und`; a null id belongs to the training side; a language without held-out text
takes the moments of its training text; empty tables give empty results; of the
caller's other columns those named like a column made here give way, the rest are
kept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, made_schema, segment_sum, slices, stage

ORDER = 4
#: Probabilities that are broadcast, 4 bytes each.
MAX_CELLS = 4_000_000
#: One text of so many calibrates the rejection.
FOLDS = 8
SLACK = 0.5
DEVIATIONS = 6.0
#: Characters that count as independent in the score.
EVIDENCE = 200.0
UND = "und"

_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code point to 16-bit symbol: letters of the first plane stay, all but letters is a space.

    Letters beyond the first plane share the numbers that no letter of it has, none of them the
    space, in their own order: those of a script, and tens of thousands after each other, differ.
    """
    global _FOLD
    if _FOLD is None:
        letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        point = np.arange(sys.maxunicode + 1)
        free = np.flatnonzero(~letter[: 1 << 16])
        free = free[free != 32]
        symbol = np.where(point < 1 << 16, point, free[point % len(free)])
        _FOLD = np.where(letter, symbol, 32).astype(np.uint16)
    return _FOLD


def grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, packed 4-grams, letters of each row, first gram of each row and the end).

    A gram ends at each symbol that is no space after a space; three spaces stand before each text.
    """
    pad, join = pa.scalar("   ", pa.large_string()), pa.scalar("", pa.large_string())
    texts = pc.binary_join_element_wise(pad, pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), join)
    for s in slices(texts):
        points = np.frombuffer(s.raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        leads = np.zeros(len(s.raw) + 1, np.int64)
        np.cumsum((s.raw & 0xC0) != 0x80, out=leads[1:])
        at = leads[s.at]
        symbols = _fold()[points]
        wide = symbols.astype(np.uint64)
        packed = wide.copy()
        for back in range(1, ORDER):
            packed[back:] |= wide[:-back] << np.uint64(16 * back)
        letter = symbols != 32
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[at[:-1]] = False  # the first two spaces of a row follow another text
        keep[np.minimum(at[:-1] + 1, len(keep) - 1)] = False
        total = np.zeros(len(symbols) + 1, np.int64)
        np.cumsum(keep, out=total[1:])
        inked = np.zeros(len(symbols) + 1, np.int64)
        np.cumsum(letter, out=inked[1:])
        yield s.first, s.last, packed[keep], np.diff(inked[at]), total[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, held, gram, n) summed over a partition; the sums so far are given out when they grow large."""
    sums: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(key: tuple[str, bool]) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in sums[key]]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in sums[key]]), len(keys)).astype(np.int64)

    def give() -> Iterator[pa.RecordBatch]:
        for lang, held in list(sums):
            keys, n = merged((lang, held))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array([held] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "held", "gram", "n"])
        sums.clear()

    for batch in batches:
        kinds = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        names = sorted(set(kinds))
        place = {k: i for i, k in enumerate(names)}
        code = np.array([place[k] for k in kinds])
        for first, last, keys, _, at in grams(batch.column(2)):
            own = code[np.repeat(np.arange(first, last), np.diff(at))]
            for i in np.unique(code[first:last]).tolist():
                mine = np.sort(keys[own == i])
                if not len(mine):
                    continue
                edge = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                sums.setdefault(names[i], []).append((mine[edge], np.diff(np.append(edge, len(mine)))))
                size += len(edge)
            if size > 2_000_000:
                for key in list(sums):
                    sums[key] = [merged(key)]
                size = sum(len(k) for parts in sums.values() for k, _ in parts)
                if size > 1_000_000:
                    yield from give()
                    size = 0
    yield from give()


class Model:
    """Kneser-Ney models of several languages over shared sorted arrays."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each language the packed 4-grams and how often each occurs."""
        self.langs = langs
        n_langs = len(langs)
        tables: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        for keys, n in counts:
            order = np.argsort(keys)
            keys, n = keys[order], n[order].astype(np.float64)
            tables[ORDER].append((keys, n))
            for k in range(ORDER - 1, 0, -1):  # types of order k + 1 by their last k symbols
                keys, n = np.unique(keys & np.uint64((1 << 16 * k) - 1), return_counts=True)
                tables[k].append((keys, n.astype(np.float64)))
        self.keys: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.logp: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.back: list[np.ndarray] = [np.zeros((1, n_langs))]
        prob = np.full((1, n_langs), 1.0 / max(2, len({*np.concatenate([t[0] for t in tables[1]] or [[]])})))
        self.logp.append(np.log(prob))
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([t[0] for t in tables[k]]))
            ctx_keys = np.unique(keys >> np.uint64(16))
            ctx = np.searchsorted(ctx_keys, keys >> np.uint64(16))
            lower = np.searchsorted(self.keys[k - 1], keys & np.uint64((1 << 16 * (k - 1)) - 1)) if k > 1 else np.zeros(len(keys), np.int64)
            own, back = np.zeros((len(keys), n_langs)), np.ones((len(ctx_keys), n_langs))
            for i, (mine, n) in enumerate(tables[k]):
                at = np.searchsorted(keys, mine)
                ones, twos = (n == 1).sum(), (n == 2).sum()
                discount = min(0.95, ones / (ones + 2 * twos)) if ones and twos else 0.5
                total = np.bincount(ctx[at], n, len(ctx_keys))
                kinds = np.bincount(ctx[at], None, len(ctx_keys))
                seen = total > 0
                back[seen, i] = discount * kinds[seen] / total[seen]
                own[at, i] = (n - discount) / total[ctx[at]]
            prob = own + back[ctx] * prob[lower]
            self.keys.append(keys)
            self.logp.append(np.log(prob))
            self.contexts.append(ctx_keys)
            self.back.append(np.log(back))
        self.mean, self.deviation = np.zeros(n_langs), np.ones(n_langs)
        self.rows = self.logp[ORDER].astype(np.float32)
        self.bits = max(10, int(4 * len(self.keys[ORDER])).bit_length())
        self.first = np.zeros(1 << self.bits, np.int32)
        # written backwards, so that of grams with one probe the first in order stays
        self.first[self._probe(self.keys[ORDER])[::-1]] = np.arange(len(self.keys[ORDER]), dtype=np.int32)[::-1]

        for i, (mine, n) in enumerate(tables[ORDER]):
            self.calibrate(i, mine, n)

    def calibrate(self, i: int, grams: np.ndarray, n: np.ndarray, source: Model | None = None) -> None:
        """Takes the moments of a language's cross-entropy a character from these 4-grams, by the models of `source`."""
        if n.sum() > 0:
            x = -(source or self).search(grams)[:, i]
            self.mean[i] = np.average(x, weights=n)
            self.deviation[i] = np.sqrt(np.average((x - self.mean[i]) ** 2, weights=n))

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of each gram's last symbol in each language."""
        at = self.first[self._probe(keys)]
        out = self.rows[at]
        miss = np.flatnonzero(self.keys[ORDER][at] != keys)
        if miss.size:
            some, inverse = np.unique(keys[miss], return_inverse=True)
            out[miss] = self.search(some)[inverse]
        return out

    def search(self, keys: np.ndarray) -> np.ndarray:
        """By binary search from the highest order down, with the weights of unseen continuations."""
        out = np.zeros((len(keys), len(self.langs)))
        left = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            part = keys[left] & np.uint64((1 << 16 * k) - 1) if k < 4 else keys[left]
            at = np.minimum(np.searchsorted(self.keys[k], part), len(self.keys[k]) - 1)
            hit = self.keys[k][at] == part
            out[left[hit]] += self.logp[k][at[hit]]
            left, part = left[~hit], part[~hit]
            at = np.minimum(np.searchsorted(self.contexts[k], part >> np.uint64(16)), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == part >> np.uint64(16)
            out[left[known]] += self.back[k][at[known]]
        out[left] += self.logp[0]
        return out


def _suffix(gram: Column, k: int) -> Column:
    """The last k symbols of a packed gram."""
    return gram.bitwiseAND((1 << 16 * k) - 1)


class Tables:
    """The same models as tables of probabilities by order, for counts of any size, with a bounded part of them in arrays.

    seen: for each order (gram, _p: language to probability); unseen: for each order (ctx, _b: language to the weight of the
    lower order). Where a language is in neither map, the weight is 1. keys, rows: some 4-grams and their log-probabilities.
    """

    def __init__(self, langs: list[str], counts: DataFrame, some: DataFrame | None):
        """counts: (i, gram, n), i the place in langs; some: (i, power, share), what part of a language's 4-grams of each power of two of n is broadcast, in millionths; None for nothing, and no moments."""
        self.langs, self.seen, self.unseen = langs, [], []
        tables = [counts]
        for k in range(ORDER - 1, 0, -1):  # types of order k + 1 by their last k symbols
            tables.insert(0, cut(tables[0].groupBy("i", _suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n"))))
        self.base = 1.0 / max(2, tables[0].select("gram").distinct().count())
        p = None
        for k, table in enumerate(tables, 1):
            discounts = [0.5] * len(langs)
            for i, ones, twos in table.groupBy("i").agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect():
                if ones and twos:
                    discounts[i] = min(0.95, ones / (ones + 2 * twos))
            discount = F.element_at(F.array(*[F.lit(d) for d in discounts]), F.col("i") + 1)
            table = table.withColumn("ctx", F.shiftrightunsigned("gram", 16))
            back = table.groupBy("i", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            back = cut(back.select("i", "ctx", "total", (discount * F.col("kinds") / F.col("total")).alias("back")))
            table, lower = table.join(back, ["i", "ctx"]), F.lit(self.base)
            if p is not None:
                table = table.withColumn("low", _suffix(F.col("gram"), k - 1)).join(p.select("i", F.col("gram").alias("low"), F.col("p").alias("lower")), ["i", "low"])
                lower = F.col("lower")
            p = cut(table.select("i", "gram", "n", ((F.col("n") - discount) / F.col("total") + F.col("back") * lower).alias("p")))
            pairs = lambda x: F.map_from_entries(F.collect_list(F.struct("i", x)))
            self.seen.append(cut(p.groupBy("gram").agg(pairs("p").alias("_p"))))
            self.unseen.append(cut(back.groupBy("ctx").agg(pairs("back").alias("_b"))))
        self.mean, self.deviation = np.zeros(len(langs)), np.ones(len(langs))
        if some is None:
            return
        self.calibrate(p.select("i", "n", (-F.log("p")).alias("x")))
        sized = p.select("i", "gram", F.floor(F.log2("n")).cast("int").alias("power")).join(F.broadcast(some), ["i", "power"])
        own = self.logp(sized.filter(F.pmod(F.xxhash64("gram"), F.lit(1_000_000)) < F.col("share")).select("gram").distinct()).toArrow()
        keys = own.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rows = own.column("logp").combine_chunks().flatten().to_numpy().reshape(-1, len(langs))[order]

    def calibrate(self, scored: DataFrame) -> None:
        """Takes the moments of each language's cross-entropy from (i, n, x): 4-grams' counts and costs."""
        for i, mean in scored.groupBy("i").agg(F.sum(F.col("x") * F.col("n")) / F.sum("n")).collect():
            self.mean[i] = mean
        off = F.col("x") - F.element_at(F.array(*[F.lit(float(m)) for m in self.mean]), F.col("i") + 1)
        for i, variance in scored.groupBy("i").agg(F.sum(off * off * F.col("n")) / F.sum("n")).collect():
            self.deviation[i] = np.sqrt(variance)

    def logp(self, grams: DataFrame) -> DataFrame:
        """(gram, logp: an array by language) of distinct 4-grams, known or not."""
        return self._p(grams, ORDER).select("gram", F.transform("_v", lambda v: F.log(v)).alias("logp"))

    def _p(self, grams: DataFrame, k: int) -> DataFrame:
        out = grams.select("gram", F.shiftrightunsigned("gram", 16).alias("ctx"), _suffix(F.col("gram"), k - 1).alias("low"))
        out = out.join(self.seen[k - 1], "gram", "left").join(self.unseen[k - 1], "ctx", "left")
        lower = lambda i: F.lit(self.base)
        if k > 1:
            below = self._p(out.select(F.col("low").alias("gram")).distinct(), k - 1)
            out = out.join(below.select(F.col("gram").alias("low"), F.col("_v").alias("_l")), "low")
            lower = lambda i: F.get("_l", i)
        every = F.array(*[F.lit(i) for i in range(len(self.langs))])
        own = lambda i: F.coalesce(F.try_element_at("_p", i), F.coalesce(F.try_element_at("_b", i), F.lit(1.0)) * lower(i))
        return out.select("gram", F.transform(every, own).alias("_v"))


def train(rows: DataFrame, max_cells: int = MAX_CELLS, folds: int = FOLDS) -> Model | Tables | None:
    """The models of all languages of (lang, text) rows; None without any."""
    rows = rows.filter(F.col("lang").isNotNull())
    held = F.pmod(F.xxhash64("text"), F.lit(folds)) == 0
    counts = rows.select(F.col("lang").cast("string").alias("lang"), held.alias("held"), "text").mapInArrow(_count, "lang string, held boolean, gram long, n long")
    counts = cut(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("held")))
    # a row for each language and power of two: whether, or which part of, the models can be broadcast
    sizes: dict[str, dict[int, int]] = {}
    for r in counts.groupBy("lang", F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("k")).collect():
        sizes.setdefault(r["lang"], {})[r["p"]] = r["k"]
    langs = sorted(sizes)
    if not langs:
        return None
    if sum(sum(k.values()) for k in sizes.values()) * len(langs) <= max_cells:
        own = counts.select("lang", "gram", "n", "held").toArrow()
        place = pc.index_in(own.column("lang"), pa.array(langs)).to_numpy()
        gram, n, out = own.column("gram").to_numpy().view(np.uint64), own.column("n").to_numpy(), own.column("held").to_numpy()
        tables = [(gram[place == i], n[place == i], out[place == i]) for i in range(len(langs))]
        model = Model(langs, [(g, k) for g, k, _ in tables])
        first = Model(langs, [(g[k > h], (k - h)[k > h]) for g, k, h in tables])
        for i, (g, k, h) in enumerate(tables):
            if (k > h).any():
                model.calibrate(i, g[h > 0], h[h > 0], first)
        return model
    places = F.array(*[F.lit(lang) for lang in langs])
    counts = cut(counts.select((F.array_position(places, F.col("lang")) - 1).cast("int").alias("i"), "gram", "n", "held"))
    some = []
    for i, lang in enumerate(langs):
        room = max_cells // len(langs) ** 2
        for p in sorted(sizes[lang], reverse=True):  # the most frequent ones, and of the last power as many as there is room for
            some.append((i, p, int(1_000_000 * min(1.0, room / sizes[lang][p]))))
            room -= sizes[lang][p]
            if room <= 0:
                break
    some = rows.sparkSession.createDataFrame(some, "i int, power int, share int")
    model = Tables(langs, counts.select("i", "gram", "n"), some)
    left = counts.filter("n > held").select("i", "gram", (F.col("n") - F.col("held")).alias("n"))
    out = counts.filter("held > 0").join(left.select("i").distinct(), "i", "left_semi").select("i", "gram", F.col("held").alias("n"))
    scored = out.join(Tables(langs, left, None).logp(out.select("gram").distinct()), "gram")
    model.calibrate(cut(scored.select("i", "n", (-F.get("logp", F.col("i"))).alias("x"))))
    return model


PREDICTION = "lang_pred string, score double, cross_entropy double, rejected boolean"


def _verdict(m: Model | Tables, h: np.ndarray, n: np.ndarray, letters: np.ndarray, slack: float, deviations: float) -> list[pa.Array]:
    """PREDICTION's columns from texts' cross-entropies in each language, scored symbols and letters."""
    names = np.array([*m.langs, UND], object)
    b = h.argmin(axis=1)
    low = h[np.arange(len(b)), b]
    share = 1 / np.exp(-(h - low[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(axis=1)
    bad = low > m.mean[b] + slack + deviations * m.deviation[b] / np.sqrt(np.maximum(n, 1))
    none = letters == 0
    return [pa.array(names[np.where(none, len(m.langs), b)].tolist(), pa.string()), pa.array(np.where(none, 0.0, share)), pa.array(low, mask=none), pa.array(bad | none)]


NAMES = ["lang_pred", "score", "cross_entropy", "rejected"]


def predict(docs: DataFrame, model: Model | Tables | None, slack: float = SLACK, deviations: float = DEVIATIONS) -> DataFrame:
    """docs' columns other than text, then lang_pred, score, cross_entropy and rejected."""
    others = [c for c in docs.columns if c not in ("text", *NAMES)]
    if model is None:
        return docs.select(*[f"`{c}`" for c in others], F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    schema = made_schema(docs, others, PREDICTION)
    if isinstance(model, Tables):
        return _predict_by_join(docs.select(*[f"`{c}`" for c in others], "text"), model, slack, deviations)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = []
            for _, _, keys, letters, at in grams(batch.column(len(others))):
                n = np.diff(at)
                h = -segment_sum(m.score(keys), at) / np.maximum(n, 1)[:, None]
                found.append(_verdict(m, h, n, letters, slack, deviations))
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *[pa.concat_arrays(c) for c in zip(*found, strict=True)]], [*others, *NAMES])

    return docs.select(*[f"`{c}`" for c in others], "text").mapInArrow(run, schema)


class _Part:
    """What the executors need of Tables."""

    def __init__(self, tables: Tables):
        self.langs, self.mean, self.deviation, self.keys, self.rows = tables.langs, tables.mean, tables.deviation, tables.keys, tables.rows


def _predict_by_join(docs: DataFrame, tables: Tables, slack: float, deviations: float) -> DataFrame:
    """predict() with Tables; docs has text last. Texts' 4-grams that aren't broadcast meet their probabilities in a join."""
    others, n_langs = docs.columns[:-1], len(tables.langs)
    shared = docs.sparkSession.sparkContext.broadcast(_Part(tables))
    made = ["__sums", "__n", "__letters", "__grams", "__times"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            done = []
            for first, last, keys, letters, at in grams(batch.column(len(others))):
                place = np.minimum(np.searchsorted(m.keys, keys), max(0, len(m.keys) - 1))
                hit = m.keys[place] == keys if len(m.keys) else np.zeros(len(keys), bool)
                logp = np.zeros((len(keys), n_langs))
                logp[hit] = m.rows[place[hit]]
                row, left = np.repeat(np.arange(last - first), np.diff(at))[~hit], keys[~hit]
                order = np.lexsort((left, row))
                row, left = row[order], left[order]
                edge = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (left[1:] != left[:-1]))) if len(row) else np.zeros(0, np.int64)
                offsets = pa.array(np.searchsorted(row[edge], np.arange(last - first + 1)).astype(np.int32))
                done.append([
                    pa.ListArray.from_arrays(pa.array((np.arange(last - first + 1) * n_langs).astype(np.int32)), pa.array(segment_sum(logp, at).ravel())),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array(letters.astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(left[edge].view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(edge, len(row))).astype(np.int64))),
                ])
            if done:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *[pa.concat_arrays(c) for c in zip(*done, strict=True)]], [*others, *made])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                sums, n, letters = batch.columns[len(others) :]
                n = n.to_numpy()
                h = -sums.flatten().to_numpy().reshape(-1, n_langs) / np.maximum(n, 1)[:, None]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *_verdict(m, h, n, letters.to_numpy(), slack, deviations)], [*others, *NAMES])

    # staged, since the rows' numbers must stay the same on both sides of the join
    scanned = docs.mapInArrow(scan, made_schema(docs, others, "__sums array<double>, __n long, __letters long, __grams array<long>, __times array<long>"))
    scanned = stage(scanned.withColumn("__row", F.monotonically_increasing_id()), "language")
    left = scanned.select("__row", F.explode(F.arrays_zip("__grams", "__times")).alias("_g")).select("__row", F.col("_g.__grams").alias("gram"), F.col("_g.__times").alias("times"))
    known = tables.logp(left.select("gram").distinct())
    rest = left.join(known, "gram").groupBy("__row").agg(F.array(*[F.sum(F.col("times") * F.get("logp", F.lit(i))) for i in range(n_langs)]).alias("__rest"))
    sums = F.when(F.col("__rest").isNull(), F.col("__sums")).otherwise(F.zip_with("__sums", "__rest", lambda a, b: a + b))
    return scanned.join(rest, "__row", "left").select(*[f"`{c}`" for c in others], sums.alias("__sums"), "__n", "__letters").mapInArrow(judge, made_schema(docs, others, PREDICTION))
