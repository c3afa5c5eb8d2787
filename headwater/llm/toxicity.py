"""Toxicity by maximum-scoring segments of token log-odds.

Tokens (runs of letters, digits and bytes beyond ASCII, lower case) get the
log-odds of toxic against clean training documents under an informative Dirichlet
prior that follows the tokens' overall frequency. Documents are counted, not
tokens, so that one text's burst of a word counts once. A token keeps its
log-odds if a likelihood-ratio test, which stays finite where one class never
has the token, expects at most FALSE such tokens by chance; all others cost a
little. A linear-time scan then finds every maximal segment of positive total in
a text. With lambda, the positive root of E[exp(lambda * score)] = 1 over clean
tokens, and K, estimated from clean documents, a clean text of n tokens has about
K * n * exp(-lambda * S) segments of a total of S or more; segments under
`expect` are toxic passages. A document's score comes from the extreme value of
its best segment and its passages by a logistic fit. K and the fit are taken from
documents scored by the log-odds of the other half of the sample.

Bounds: the classifier is fitted on at most SAMPLE labelled rows of each class
(in the order of a hash of the id). A significant token stands in several of
these documents, so what is broadcast is a small part of the sample's tokens,
whatever the corpus; none is dropped. Scoring covers all texts whole.

Defined cases: a null or empty text has no tokens and gets the score of a text
without segments; a null id belongs to the training side but has no label;
repeated rows get a row each; labels that are null are not trained on, repeated
ones by id count once, the highest; without both classes all scores are 0; empty
tables give empty results; of the caller's other columns those named like a
column made here give way, the rest are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Roller, cut, made_schema, shuffle_key, slices, stage, word_spans

SAMPLE = 25_000
#: Documents that the prior counts for.
PRIOR = 20.0
#: Tokens that may pass the significance test by chance.
FALSE = 1.0
NEUTRAL = -0.12
FLOOR = -1.0
EXPECT = 0.05
THRESHOLD = 0.3

_GAP = np.ones(256, bool)
_GAP[128:] = False
for _first, _last in ((48, 57), (65, 90), (97, 122)):
    _GAP[_first : _last + 1] = False

_ROLLER = Roller(1010)


def tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the tokens of some rows, and where each row's begin (rows + 1 entries)."""
    for s in slices(texts):
        starts, ends, at = word_spans(s, _GAP)
        prefix = _ROLLER.prefix(LOWER[s.raw])
        yield _ROLLER.spans(prefix, starts, ends).view(np.int64), at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each token and half of the sample: toxic and clean documents that hold it, and how often the clean ones do."""
    for batch in batches:
        label, half = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        row, found = 0, []
        for keys, at in tokens(batch.column(2)):
            n = len(at) - 1
            of = np.repeat(np.arange(row, row + n), np.diff(at))
            order = np.lexsort((keys, of))
            keys, of = keys[order], of[order]
            edge = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))) if len(keys) else np.zeros(0, np.int64)
            found.append((keys[edge], of[edge], np.diff(np.append(edge, len(keys)))))
            row += n
        if found:
            keys, of, times = (np.concatenate(c) for c in zip(*found, strict=True))
            toxic = label[of]
            for h in (0, 1):
                mine = half[of] == h
                token, which = np.unique(keys[mine], return_inverse=True)
                counts = [np.bincount(which, w[mine], len(token)).astype(np.int64) for w in (toxic, 1 - toxic, times * (1 - toxic))]
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), h, np.int32)), *map(pa.array, counts)], ["token", "half", "toxic", "clean", "often"])


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [first, last) of one text's token scores, left to right, in linear time.

    Works on running sums: a candidate's left sum is that before it, its right sum that
    after it. A new positive token joins back to the nearest candidate with a lower left
    sum, unless no gain is left between the two. Each candidate links to the nearest
    earlier one of lower left sum, so the search skips what can't be it; once none is
    lower, all earlier candidates are final.
    """
    total = np.append(0.0, np.cumsum(scores)).tolist()
    done: list[tuple[int, int, float]] = []
    held: list[tuple[int, int, float, float, int]] = []  # first, last, left, right, link
    for p in np.flatnonzero(scores > 0).tolist():
        first, last, left, right = p, p + 1, total[p], total[p + 1]
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0:
                done += [(a, b, r - x) for a, b, x, r, _ in held]
                held = [(first, last, left, right, -1)]
                break
            if held[j][3] >= right:
                held.append((first, last, left, right, j))
                break
            first, _, left, _, link = held[j]
            del held[j:]
            j = link
    return done + [(a, b, r - x) for a, b, x, r, _ in held]


@dataclass
class Scorer:
    keys: np.ndarray  # sorted hashes of the significant tokens
    scores: np.ndarray
    rate: float  # lambda
    scale: float  # K
    weights: np.ndarray  # of the logistic fit

    def token_scores(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), NEUTRAL)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.scores[i], NEUTRAL)

    def expected(self, total: float, n: int) -> float:
        """How many segments of this total or more a clean text of n tokens has."""
        return self.scale * n * float(np.exp(-self.rate * total))

    def describe(self, texts: pa.Array, expect: float = EXPECT) -> np.ndarray:
        """Of each row: total of the best segment, tokens, passages, their share of the tokens."""
        out = []
        for keys, at in tokens(texts):
            own, n = np.zeros((len(at) - 1, 4)), np.diff(at)
            own[:, 1] = n
            scores = self.token_scores(keys)
            gain = np.append(0, np.cumsum(scores > 0))
            for row in np.flatnonzero(gain[at[1:]] > gain[at[:-1]]).tolist():
                found = segments(scores[at[row] : at[row + 1]])
                passages = [b - a for a, b, s in found if self.expected(s, n[row]) < expect]
                own[row, 0], own[row, 2:] = max(s for _, _, s in found), (len(passages), sum(passages) / n[row])
            out.append(own)
        return np.concatenate(out) if out else np.zeros((0, 4))

    def design(self, features: np.ndarray) -> np.ndarray:
        """The extreme value of the best segment, its evidence against a clean text, and the passages."""
        best, n, passages, share = features.T
        extreme = np.where(best > 0, self.rate * best - np.log(self.scale * np.maximum(n, 1)), 0.0)
        return np.column_stack([np.ones(len(best)), np.log1p(np.clip(extreme, 0, 40)), passages > 0, np.log1p(passages), share])

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(self.design(features) @ self.weights, -30, 30)))


def _positive_root(scores: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with sum(weights * exp(lambda * scores)) = 1; the mean score must be negative."""
    low, high = 0.0, 1.0
    value = lambda x: float(np.sum(weights * np.exp(np.minimum(x * scores, 600.0)))) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a ridge logistic fit."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - ridge * beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _odds(counts: DataFrame, n1: int, n0: int) -> Scorer:
    """Significant log-odds and lambda from (token, toxic, clean, often) of n1 toxic and n0 clean documents."""
    counts = counts.filter("toxic + clean > 0")
    n_tokens, often = counts.agg(F.count("*"), F.sum("often")).first()
    if not n_tokens or not often:
        return Scorer(np.zeros(0, np.int64), np.zeros(0), 1.0, 1.0, np.zeros(5))
    prior = F.lit(PRIOR / (n1 + n0)) * (F.col("toxic") + F.col("clean"))
    logit = lambda y, n: F.log((y + prior) / (F.lit(float(n + PRIOR)) - y - prior))
    part = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    y1, y0, n = F.col("toxic").cast("double"), F.col("clean").cast("double"), float(n1 + n0)
    both = y1 + y0
    ratio = 2 * (part(y1, both * (n1 / n)) + part(y0, both * (n0 / n)) + part(n1 - y1, (n - both) * (n1 / n)) + part(n0 - y0, (n - both) * (n0 / n)))
    known = counts.select("token", "often", prior.alias("prior"), (logit(y1, n1) - logit(y0, n0)).alias("odds"), ratio.alias("ratio"))
    # a likelihood ratio of x or more has a probability of exp(-x / 2) at most
    known = known.filter(F.col("ratio") > 2 * np.log(n_tokens / FALSE)).toPandas().sort_values("token")
    score = np.where(known["odds"] > 0, known["odds"], np.clip(known["odds"], FLOOR, NEUTRAL)).astype(float)
    share = (known["often"] + known["prior"]).to_numpy(float) / often
    rate = _positive_root(np.append(score, NEUTRAL), np.append(share, max(0.0, 1 - share.sum())))
    return Scorer(known["token"].to_numpy(np.int64), score, rate, 1.0, np.zeros(5))


def train(labelled: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """labelled: (doc_id, text) allowed in training; labels: (doc_id, toxic)."""
    none = Scorer(np.zeros(0, np.int64), np.zeros(0), 1.0, 1.0, np.zeros(5))
    rows = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = rows.join(labelled.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_key", shuffle_key(F.col("doc_id"), "toxicity"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return none
    picked = [rows.filter(F.col("toxic") == k).orderBy("_key", "doc_id").limit(sample) for k in (0, 1)]
    picked = cut(picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("_id"), "toxic", (F.col("_key") % 2).cast("int").alias("half")))
    # at most 2 * sample rows of three numbers: bounded, whatever the corpus
    texts = stage(labelled.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("toxic", "half", "text"), "toxicity")
    n = {(r["toxic"], r["half"]): r["count"] for r in texts.groupBy("toxic", "half").count().collect()}
    counts = texts.mapInArrow(_count, "token long, half int, toxic long, clean long, often long")
    counts = cut(counts.groupBy("token", "half").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "often")]))
    whole = counts.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "often")])
    scorer = _odds(whole, *(n.get((k, 0), 0) + n.get((k, 1), 0) for k in (1, 0)))
    made = "best double, tokens double, passages double, share double"
    x, y, w = [], [], []
    for h in (0, 1):
        if not all(n.get((k, i)) for k in (0, 1) for i in (0, 1)):
            break
        # documents of one half by the log-odds of the other
        other = _odds(counts.filter(F.col("half") == 1 - h), n[1, 1 - h], n[0, 1 - h])
        own = texts.filter(F.col("half") == h).select("toxic", "text")
        data = _apply(own, other, ["toxic"], lambda f: f, made).toPandas()
        clean = data[data["toxic"] == 0]
        # the rate of a Poisson process of segments, of which those above 0 are seen
        other.scale = max(1e-12, ((clean["best"] > 0).sum() + 0.5) / float((np.maximum(clean["tokens"], 1) * np.exp(-other.rate * clean["best"])).sum()))
        data = _apply(own, other, ["toxic"], lambda f: f, made).toPandas()  # passages depend on K
        x.append(other.design(data[[c.split()[0] for c in made.split(", ")]].to_numpy(float)))
        y.append(data["toxic"].to_numpy(float))
        w.append(other.scale)
    if not x:
        return none
    scorer.scale = float(np.exp(np.mean(np.log(w))))
    x, y = np.concatenate(x), np.concatenate(y)
    # classes are sampled apart: weights restore their shares among the labelled rows
    weight = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    scorer.weights = _logistic(x, y, weight * len(y) / weight.sum())
    return scorer


def _apply(docs: DataFrame, scorer: Scorer, others: list[str], last, columns: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = last(shared.value.describe(batch.column(len(others))))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *(pa.array(np.ascontiguousarray(c)) for c in out.T)], [*others, *names])

    return docs.select(*[f"`{c}`" for c in others], "text").mapInArrow(run, made_schema(docs, others, columns))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs' columns other than text, then score and the number and share of toxic passages."""
    made = "score double, passages double, share double"
    others = [c for c in docs.columns if c not in ("text", "score", "passages", "share")]
    return _apply(docs, scorer, others, lambda f: np.column_stack([scorer.score(f), f[:, 2:]]), made)


def passages(docs: DataFrame, scorer: Scorer, expect: float = EXPECT) -> DataFrame:
    """doc_id, first, last, total of every significant segment, in tokens of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out, row = [], 0
            for keys, at in tokens(batch.column(1)):
                scores = m.token_scores(keys)
                for k in range(len(at) - 1):
                    n = int(at[k + 1] - at[k])
                    out += [(row + k, a, b, s) for a, b, s in segments(scores[at[k] : at[k + 1]]) if m.expected(s, n) < expect]
                row += len(at) - 1
            if out:
                of, *rest = zip(*out, strict=True)
                rest = [pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *rest], ["doc_id", "first", "last", "total"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, first long, last long, total double")
