"""The training-data operators against brute force, on fixtures with every awkward case."""

import hashlib
import inspect
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from headwater.llm import chat_format, language_id, line_dedup, media, minhash, mixing, packing, quality_rules, queries, suffix_dedup, toxicity
from headwater.llm.common import ranked, running, shuffle_key
from headwater.llm.components import components
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, key1 long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(rng, n, letters="etaoinshr"):
    return ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n)]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = vocabulary(rng, 3000)
    rows = []

    def add(doc, text, lang="en", source="a"):
        rows.append((doc, text, lang, source, None if text is None else len(text), 1, 2))

    passage = " ".join(rng.choices(vocab, k=120))
    for i in range(n):
        lines = [" ".join(rng.choices(vocab, k=rng.randint(5, 40))) for _ in range(rng.randint(1, 8))]
        if i % 7 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        add(i, "\n".join(lines), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None, "ü"]))
    base = rng.choices(vocab, k=150)
    for i in range(20):  # a chain of near copies
        base = list(base)
        base[rng.randrange(150)] = rng.choice(vocab)
        add(100 + i, " ".join(base))
    for i in range(5):
        add(200 + i, rows[3][1], "fr", "c")
    add(300, None), add(301, ""), add(302, " \n\t "), add(303, "ab"), add(304, "ab cd"), add(305, "AB")
    add(None, "a null id with some words " * 30), add(306, "é日本語 \U0001f600 ünï <|endoftext|> a  b \n  c   "), add(307, None, None, None)
    add(308, "x" * 3000), add(309, "ab " * 5000)
    rows.append(rows[5]), rows.append(rows[5])
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def out(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# --- helpers ------------------------------------------------------------------


def test_ranked_matches_a_plain_running_sum(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id"), (F.col("id") % 7).alias("v")).withColumn("h", shuffle_key(F.col("id"), "t"))
    got = ranked(df, ["k"], ["h", "id"], "v", "before").collect()
    total = {}
    for r in sorted(got, key=lambda r: (r["k"], r["h"], r["id"])):
        assert r["before"] == total.get(r["k"], 0)
        total[r["k"]] = total.get(r["k"], 0) + r["v"]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links if p[0] is not None for x in p}
    assert got == {x: root(x) for x in nodes if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 ------------------------------------------------------------------------


def kneser_ney(text_counts, vocab):
    """Probability of a 4-gram by the textbook recursion over dicts."""
    tables = {4: dict(text_counts)}
    for k in (3, 2, 1):
        tables[k] = {}
        for g in tables[k + 1]:
            tables[k][g[1:]] = tables[k].get(g[1:], 0) + 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / vocab
        ones, twos = (sum(v == c for v in tables[k].values()) for c in (1, 2))
        d = min(0.95, ones / (ones + 2 * twos)) if ones and twos else 0.5
        same = {h: v for h, v in tables[k].items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        return max(same.get(g, 0) - d, 0) / total + d * len(same) / total * p(g[1:])

    return p


def pack_gram(g):
    return sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g))


def test_language_model_is_interpolated_kneser_ney():
    texts = {"x": "   abab abba bab", "y": "   cdcd abcd ddc"}
    counts = {k: {} for k in texts}
    for k, t in texts.items():
        for i in range(3, len(t)):
            counts[k][t[i - 3 : i + 1]] = counts[k].get(t[i - 3 : i + 1], 0) + 1
    model = language_id.Model(list(texts), [(np.array([pack_gram(g) for g in c], np.uint64), np.array(list(c.values()))) for c in counts.values()])
    vocab = len({g[-1] for c in counts.values() for g in c})
    queries = ["abab", "  ab", "bcda", "zzza", "cdcd", "aaaa", "qqqq"]
    got = np.exp(model.score(np.array([pack_gram(g) for g in queries], np.uint64)))
    for i, c in enumerate(counts.values()):
        p = kneser_ney(c, vocab)
        assert got[:, i] == pytest.approx([p(g) for g in queries], rel=1e-5)


def test_language_identification(spark, empty):
    rng = random.Random(5)
    vocabs = {"en": vocabulary(rng, 300, "etaoinshr"), "de": vocabulary(rng, 300, "eniräüst"), "el": vocabulary(rng, 300, "αβγδεικο")}
    rows = [(i, " ".join(rng.choices(v, k=60)), lang, "s", 0, 1, 2) for i, (lang, v) in enumerate(list(vocabs.items()) * 40)]
    train = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train(train.select("lang", "text"))
    odd = [(900, None), (901, ""), (902, "12 34 ..."), (903, "zzzz qqqq xxxx vvvv " * 50), (904, " ".join(rng.choices(vocabs["de"], k=4000)).upper())]
    test = [(1000 + i, " ".join(rng.choices(v, k=30)), lang) for i, (lang, v) in enumerate(list(vocabs.items()) * 5)]
    df = spark.createDataFrame([(a, b) for a, b, *_ in [*odd, *test]], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    assert len(got) == len(odd) + len(test)
    for i in (900, 901, 902):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[903]["rejected"] and got[903]["lang_pred"] in vocabs
    assert got[904]["lang_pred"] == "de" and not got[904]["rejected"]
    assert all(got[i]["lang_pred"] == lang and got[i]["score"] > 0.9 and not got[i]["rejected"] for i, _, lang in test)
    assert language_id.train(empty.select("lang", "text")) is None
    assert {r["lang_pred"] for r in language_id.predict(df, None).collect()} == {"und"}
    assert language_id.predict(empty.select("doc_id", "text"), model).count() == 0


@pytest.mark.parametrize("max_cells", [1, 3200])
def test_language_models_do_not_depend_on_what_is_broadcast(spark, max_cells):
    rng = random.Random(7)
    vocabs = {"en": vocabulary(rng, 200, "etaoinshr"), "de": vocabulary(rng, 100, "eniräüst"), "el": vocabulary(rng, 60, "αβγδεικο")}
    rows = [(i, " ".join(rng.choices(v, k=40)), lang, "s", 0, 1, 2) for i, (lang, v) in enumerate(list(vocabs.items()) * 10)]
    # a language whose 4-grams occur once each
    signs = [chr(0x4E00 + i) for i in range(3000)]
    rows += [(100 + i, "".join(signs[50 * i : 50 * i + 50]), "zh", "s", 0, 1, 2) for i in range(30)]
    train = spark.createDataFrame(rows, SCHEMA).select("lang", "text")
    whole, parted = language_id.train(train), language_id.train(train, max_cells=max_cells)
    assert whole.langs == parted.langs == ["de", "el", "en", "zh"]
    assert parted.mean == pytest.approx(whole.mean) and parted.deviation == pytest.approx(whole.deviation)
    test = [(i, t) for i, t, *_ in rows[::7]] + [(900, None), (901, "12 34"), (902, "zzzz qqqq " * 9), (902, "zzzz qqqq " * 9), (903, "".join(signs[1800:1860]))]
    test += [(None, " ".join(rng.choices(v, k=30))) for v in vocabs.values()]
    df = spark.createDataFrame(test, "doc_id long, text string")
    want, got = (sorted(map(tuple, language_id.predict(df, m).collect()), key=lambda r: repr((r[0], r[1], r[4], round(r[3] or 0, 4)))) for m in (whole, parted))
    assert len(got) == len(test) and {"zh"} <= {r[1] for r in got}
    for a, b in zip(want, got, strict=True):
        assert (a[0], a[1], a[4]) == (b[0], b[1], b[4])
        assert b[2] == pytest.approx(a[2], rel=1e-4, abs=1e-6) and (a[3] is b[3] is None or b[3] == pytest.approx(a[3], rel=1e-5))
    assert language_id.predict(df.limit(0), parted).count() == 0


@pytest.mark.parametrize("max_cells", [20_000_000, language_id.MAX_CELLS])
def test_no_language_is_left_out(spark, max_cells):
    """201 languages, the last of one text; each is found again."""
    rng = random.Random(21)
    rows = []
    for i in range(201):
        letters = "".join(chr(0x4E00 + 40 * i + k) for k in range(12))
        words = vocabulary(rng, 30, letters)
        rows += [(f"l{i:03d}", " ".join(rng.choices(words, k=25))) for _ in range(1 if i == 200 else 3)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    model = language_id.train(df, max_cells)
    assert len(model.langs) == 201 and isinstance(model, language_id.Model) == (max_cells > language_id.MAX_CELLS)
    some = df.filter("lang in ('l000', 'l077', 'l199', 'l200')")
    assert all(r["lang_pred"] == r["lang"] for r in language_id.predict(some, model).collect())


def test_rejection_is_calibrated_on_held_out_text(spark):
    """The moments are those of the held-out texts under models of the others, by plain sums."""
    rng = random.Random(31)
    words = vocabulary(rng, 400)
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(60)]
    df = spark.createDataFrame([("xx", t) for t in texts], "lang string, text string")
    held = {r["text"] for r in df.filter(F.pmod(F.xxhash64("text"), F.lit(4)) == 0).collect()}
    assert 0 < len(held) < 60
    counts = ({}, {})
    for t in texts:
        for i in range(len(t)):
            g = f"   {t}"[i : i + 4]
            if g[3] != " " or g[2] != " ":
                counts[t in held][g] = counts[t in held].get(g, 0) + 1
    p = kneser_ney(counts[0], len({g[-1] for g in counts[0]}))
    cost = [(-np.log(p(g)), n) for g, n in counts[1].items()]
    mean = sum(x * n for x, n in cost) / sum(n for _, n in cost)
    whole, parted = language_id.train(df, folds=4), language_id.train(df, max_cells=1, folds=4)
    assert whole.mean[0] == pytest.approx(mean, rel=1e-6) and parted.mean[0] == pytest.approx(mean, rel=1e-6)
    assert parted.deviation == pytest.approx(whole.deviation)


def test_held_out_languages(spark):
    """Held-out accuracy of the query on 1,000 documents."""
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op1_language_id(spark, sf).collect() if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) / len(got)
    print(f"held-out accuracy {right:.4f} of {len(got)}, rejected {sum(r['rejected'] for r in got)}")
    assert right >= 0.97 and sum(r["rejected"] for r in got) <= 0.03 * len(got)


def test_language_columns_may_clash(spark):
    df = spark.createDataFrame([("en", "some words of a text", 1, 2, "k")], "lang string, text string, score int, rejected int, doc_id string")
    got = language_id.predict(df, language_id.train(df.select("lang", "text"))).first()
    assert got.asDict().keys() == {"lang", "doc_id", "lang_pred", "score", "cross_entropy", "rejected"} and got["lang_pred"] == "en"


# --- 2 ------------------------------------------------------------------------


def test_packing_round_trip(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = [r.asDict() for r in packing.pack(docs).collect()]
    want = []
    for r in rows:
        ids = [*full.encode(r[1] or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 1024 + 1
        at = 0
        for k, size in enumerate([head, *[1024] * ((len(ids) - head) // 1024)]):
            want.append((r[0], k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at += size
    assert sorted(want, key=repr) == sorted(((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces), key=repr)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(p["length"] for p in pieces) // 1024) * 1.1 + 1
    assert packing.pack(empty).count() == 0


def best_fit_decreasing(lengths, capacity):
    """Sequences that best fit opens, one document after the other."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((fit if fit is not None else capacity) - x)
    return len(gaps)


def test_rounds_come_near_best_fit(spark):
    rng = random.Random(2)
    for capacity, n in ((10, 500), (64, 900), (64, 40), (7, 0)):
        lengths = [min(capacity, int(rng.paretovariate(0.8))) if n != 900 else rng.randint(1, capacity) for _ in range(n)]
        counts = sorted({(x, lengths.count(x)) for x in lengths})
        entries = packing.plan(spark.createDataFrame(counts, "length long, n long"), capacity)
        taken, ranks = {}, {}
        for length, rank, k, first, offset, each in entries:
            ranks.setdefault(length, []).extend(range(rank, rank + k))
            for i in range(k):
                taken.setdefault(first + i // each, []).append((offset + i % each * length, length))
        assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(k)) for x, k in counts}
        for own in taken.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        best = best_fit_decreasing(lengths, capacity)
        assert len(taken) <= best + max(1, 0.03 * best)
        assert not taken or max(taken) == len(taken) - 1


def test_sweep_takes_the_narrowest_gaps():
    """Documents meet the successors of their lengths; a gap is taken once a round, the i-th by the i-th."""
    places, left, gaps, used = packing.sweep([[6, 0, 3], [4, 0, 2], [1, 5, 1]], [[7, 0, 1], [6, 1, 1], [9, 2, 2], [3, 4, 1]], 10, 5)
    assert places == [(6, 0, 1, 1, 4, 1), (6, 1, 1, 0, 3, 1), (6, 2, 1, 2, 1, 1), (4, 0, 2, 3, 1, 2), (1, 5, 1, 4, 7, 1)]
    assert (left, used) == ([], 5)
    assert sorted(gaps) == [[1, 0, 1], [1, 3, 1], [2, 4, 1], [3, 2, 1]]
    # what no gap holds opens sequences; much shorter documents wait for the gaps that these leave
    places, left, gaps, used = packing.sweep([[5, 0, 3], [2, 0, 4]], [[1, 0, 1]], 10, 1)
    assert places == [(5, 0, 2, 1, 0, 2), (5, 2, 1, 2, 0, 1)] and left == [[2, 0, 4]] and used == 3
    assert sorted(gaps) == [[1, 0, 1], [5, 2, 1]]


# --- 3 ------------------------------------------------------------------------


def test_perspective_rotation(spark):
    rng = random.Random(13)
    conv = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo <|im_end|>"), (1, 2, "ann", None), (1, 70, "cy", "late"), (2, None, None, "x"), (None, 0, "a", "n"), (1, 0, "ann", "hi"), (3, 1, "ann", ""), (3, 2, "bob", "long " * 20000)]
    # a long conversation with null turns and many turns of one number, over several ranges
    conv += [(7, rng.choice([None, 5, 5, 6, i]), rng.choice(["ann", "bob"]), f"t{rng.randrange(90)}") for i in range(400)]
    df = spark.createDataFrame([(*c, 1, "p") for c in conv], "conv_id long, turn long, role string, text string, n int, part string").repartition(3)
    got = chat_format.rotate(df, turns=8).collect()
    speakers = {(c, r or "unknown") for c, _, r, _ in conv}
    own = {}
    for c, t, s, x in conv:
        own.setdefault(c, []).append((t is None, t or 0, s or "unknown", (x or "").replace("<|im_", "<||im_")))
    parts = {(c, k): sorted(turns)[8 * k : 8 * k + 8] for c, turns in own.items() for k in range(-(-len(turns) // 8))}
    assert sorted(((r["conv_id"], r["perspective"], r["part"]) for r in got), key=repr) == sorted(((c, s, k) for c, s in speakers for d, k in parts if c == d), key=repr)
    for r in got:
        text, mask = "", []
        for *_, s, x in parts[r["conv_id"], r["part"]]:
            text += "<|im_start|>assistant\n" if s == r["perspective"] else f"<|im_start|>user name={s}\n"
            if s == r["perspective"]:
                mask.append((len(text), len(text) + len(x) + len("<|im_end|>\n")))
            text += f"{x}<|im_end|>\n"
        assert (r["rendered"], [tuple(m) for m in r["mask"]], r["n_turns"]) == (text, mask, len(parts[r["conv_id"], r["part"]]))
    assert chat_format.rotate(df.limit(0)).count() == 0


# --- 4 ------------------------------------------------------------------------


def shingle_set(text, k, lower=True):
    text = "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(docs, rows, empty, words, percent):
    sets = [(r[0], shingle_set(r[1], words)) for r in rows]
    ids = sorted({d for d, s in sets if d is not None})
    comp = {d: d for d in ids}
    links = [(a, b) for a, s in sets for b, t in sets if a is not None and b is not None and a < b and s and t and 100 * len(s & t) >= percent * len(s | t)]
    for _ in ids:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    want = sorted(((d, len(s), comp.get(d), d is None or comp[d] == d) for d, s in sets), key=repr)
    assert out(minhash.near_duplicates(docs, words, percent), "doc_id", "n_shingles", "component_id", "kept") == want
    assert minhash.near_duplicates(empty).count() == 0


def test_similarity_is_estimated_from_bits():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 32, (4000, minhash.HASHES), dtype=np.uint32)
    for similarity in (0.0, 0.5, 0.85, 1.0):
        b = np.where(rng.random(a.shape) < similarity, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32))
        got = minhash.estimate(minhash.pack(a), minhash.pack(b))
        want = ((a & 15) == (b & 15)).sum(axis=1) / minhash.HASHES
        assert got == pytest.approx((want - 1 / 16) / (15 / 16))
        assert got.mean() == pytest.approx(similarity, abs=0.01)
        assert (got >= minhash.cutoff(similarity)).all()


def test_links_found_of_all_pairs(spark):
    """Recall against all pairs on the documents table of the tests."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {d: shingle_set(t, 3) for d, t in rows}
    by_shingle = {}
    for d, own in sets.items():
        for x in own:
            by_shingle.setdefault(x, []).append(d)
    near = {(a, b) for ids in by_shingle.values() for a, b in itertools.combinations(sorted(ids), 2)} if max(map(len, by_shingle.values())) < 200 else None
    pairs = near if near is not None else itertools.combinations(sorted(sets), 2)
    links = [(a, b) for a, b in pairs if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    comp = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    found = sum(comp[a] == comp[b] for a, b in links)
    print(f"links within a component: {found} of {len(links)}")
    assert found == len(links) > 50


def test_second_look_links_what_the_hub_misses(spark):
    rng = random.Random(9)
    base = vocabulary(rng, 400)
    rows = []
    for i in range(40):  # members agree with their neighbours, not with the smallest id
        w = list(base)
        for j in range(i * 6, i * 6 + 24):
            w[j] = f"v{j}"
        for j in range(i * 6):
            w[j] = f"u{j}"
        rows.append((i, " ".join(w)))
    sets = [shingle_set(t, 3) for _, t in rows]
    comp = list(range(40))
    for _ in comp:
        for a in range(40):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert [got[i] for i in range(40)] == comp


# --- 5 ------------------------------------------------------------------------


def brute_quality(rows, max_docs, keep):
    held = {}
    norm = lambda x: re.sub("[0-9]", "0", " ".join(WORD.findall(x))).lower()
    for d, t, _, s, *_ in rows:
        for line in {norm(x) for x in (t or "").split("\n")} - {""}:
            held.setdefault((s, line), set()).add((d, t))
    result = []
    for d, t, _, s, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        lost = sum(len(norm(x).split(" ")) for x in lines if len(held[s, norm(x)]) > max_docs)
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        result.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), failed, not failed and not 100 * (len(w) - lost) < keep * len(w), lost))
    return sorted(result, key=repr)


def test_quality_rules(spark, docs, rows, empty):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")
    small = [r for r in rows if len(r[1] or "") < 8000] + [(400, "a b c d e f g a b c d e f\n#x | y\n#x | y\n a b c d e f", "en", "a", 0, 1, 2)]
    df = spark.createDataFrame(small, SCHEMA)
    assert out(quality_rules.apply_rules(df, max_docs=2), *names) == brute_quality(small, 2, 30)
    assert quality_rules.apply_rules(empty).count() == 0
    kept = quality_rules.clean(df, max_docs=2)
    assert kept.columns == df.columns and 0 < kept.count() < len(small)
    odd = df.withColumnsRenamed({"lang": "uid", "n_chars": "_uid", "rank": "_id", "key1": "kept"})
    again = quality_rules.clean(odd, max_docs=2)
    assert again.columns == odd.columns and out(again, "doc_id", "text", "uid") == out(kept.withColumnRenamed("lang", "uid"), "doc_id", "text", "uid")


# --- 6 ------------------------------------------------------------------------


def brute_repeats(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            seen.setdefault(t[a : a + length], []).append((i, a))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                gone[i][a : a + length] = True
    return gone


def brute_passages(texts, words):
    """Runs of windows of so many words that occur twice, and the words they cover, by text."""
    spans = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    seen = {}
    for i, (t, w) in enumerate(zip(texts, spans, strict=True)):
        for k in range(len(w) - words + 1):
            seen.setdefault(t[w[k][0] : w[k + words - 1][1]], []).append((i, k))
    covered = [np.zeros(len(w), bool) for w in spans]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                covered[i][k : k + words] = True
    # runs of covered words that no window joins are apart, which can't be seen here unless windows are kept
    starts = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                starts[i].add(k)
    runs = [sum(1 for k in s if not any(j in s for j in range(k - words, k))) for s in starts]
    return [(r, int(c.sum())) for r, c in zip(runs, covered, strict=True)]


@pytest.mark.parametrize("length,words", [(40, 8), (400, 50)])
def test_suffix_dedup_matches_brute_force(docs, rows, empty, length, words):
    texts = [(r[1] or "").encode() for r in rows]
    gone, passages = brute_repeats(texts, length), brute_passages(texts, words)
    want = []
    for r, t, g, p in zip(rows, texts, gone, passages, strict=True):
        kept = np.frombuffer(t, np.uint8)[~g].tobytes()
        want.append((r[0], len(t), int(g.sum()), int((np.diff(np.append(0, g.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest(), *p))
    got = suffix_dedup.remove_repeats(docs, length, words=words)
    assert out(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words") == sorted(want, key=repr)
    assert suffix_dedup.remove_repeats(empty, length).count() == 0
    full = suffix_dedup.remove_repeats(docs, length, with_text=True)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in full.select("kept", "kept_sha256").collect())


def test_ranges_by_bounds_of_many_columns():
    rng = np.random.default_rng(1)
    bounds = np.array(sorted({tuple(r) for r in rng.integers(0, 3, (20, 3)).tolist()}), np.int64)
    rows = rng.integers(-1, 4, (500, 3))
    got = suffix_dedup.lexicographic(bounds, list(rows.T))
    assert got.tolist() == [sum(tuple(b) <= tuple(r) for b in bounds.tolist()) for r in rows.tolist()]
    assert not suffix_dedup.lexicographic(bounds[:0], list(rows.T)).any()


@pytest.mark.parametrize("part", [1, 16])
def test_suffix_dedup_over_many_ranges(spark, monkeypatch, part):
    """One passage in most texts, many short texts, long runs of one byte; many partitions, so that groups cross their edges."""
    monkeypatch.setattr(suffix_dedup, "PART", part)
    rng = random.Random(41)
    vocab = vocabulary(rng, 200)
    passage = " ".join(rng.choices(vocab, k=90))
    texts = []
    for i in range(150):
        a, b = (" ".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(2))
        texts.append(a + (passage if i % 3 else passage[: rng.randint(50, 500)]) + b)
    texts += ["ab" * 900, "ab" * 700, "z" * 600, "z" * 399, "", texts[0], texts[0], texts[1][5:]]
    gone, passages = brute_repeats([t.encode() for t in texts], 200), brute_passages([t.encode() for t in texts], 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9).cache()
    try:
        for n in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r["doc_id"]: (r["n_removed"], r["n_passages"], r["passage_words"]) for r in suffix_dedup.remove_repeats(df, 200, words=20).collect()}
            assert got == {i: (int(g.sum()), *p) for i, (g, p) in enumerate(zip(gone, passages, strict=True))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_parse_of_long_texts_in_pieces(monkeypatch):
    """Phrases and classes don't depend on the pieces; every window lies in one class."""
    rng = random.Random(11)
    words = vocabulary(rng, 500)
    shared = " ".join(rng.choices(words, k=150))
    texts = [" ".join(rng.choices(words, k=700)) + shared + " ".join(rng.choices(words, k=700)) for _ in range(3)] + ["", "y" * 2000, "short"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    whole = suffix_dedup.Parse(raw, at)
    keys = whole.keys()
    monkeypatch.setattr(suffix_dedup, "PIECE", 777)
    parts = suffix_dedup.Parse(raw, at)
    assert (parts.trigger == whole.trigger).all() and (parts.keys() == keys).all() and len(whole.trigger) > 100
    for r, t in enumerate(texts):  # phrases overlap by a trigger and make up the text
        own = [(int(whole.first[i]), int(whole.last[i])) for i in range(whole.base[r], whole.base[r + 1])]
        assert own[0][0] == at[r] and own[-1][1] == at[r + 1] and all(b == c + suffix_dedup.TRIGGER for (_, b), (c, _) in zip(own, own[1:], strict=False))
    row, first, n, f, g = suffix_dedup.byte_windows(whole, 400)
    places = [(r, x) for r, a, k in zip(row, first, n, strict=True) for x in range(a, a + k)]
    assert len(set(places)) == len(places) == sum(max(0, len(t.encode()) - 399) for t in texts)


def test_dictionary_ranks_follow_the_bytes():
    """Ranks ascend with the keys and are the same for equal ones; the phrases at the edges are named alike from either side."""
    import pyspark

    class Here:
        @staticmethod
        def get():
            return Here

        @staticmethod
        def partitionId():
            return 3

    keys = sorted([*random.Random(3).choices([b"a", b"b", b"c", b"d", b"ee", b"f"], k=39), b"cc"])
    real, pyspark.TaskContext = pyspark.TaskContext, Here
    try:
        for size in (1, 3, 7, 40):
            batches = [suffix_dedup._batch([pa.array(keys[i : i + size], pa.binary()), np.arange(i, min(40, i + size)), np.zeros(min(40, i + size) - i, np.int32)], "key uid k") for i in range(0, 40, size)]
            got = {}
            for b in suffix_dedup._ranks(iter(batches)):
                got.update(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
            edges = {keys[0], keys[-1]}
            assert set(got) == {i for i in range(40) if keys.count(keys[i]) > 1 or keys[i] in edges}  # a phrase alone has no rank
            by_key = {k: {got[i] for i in range(40) if keys[i] == k and i in got} for k in keys if keys.count(k) > 1 or k in edges}
            assert all(len(v) == 1 for v in by_key.values())
            inner = [by_key[k].pop() for k in sorted(by_key)][1:-1]
            assert inner == sorted(inner) and all(x >> 40 == 3 for x in inner) and got[0] > 1 << 62 < got[39]
    finally:
        pyspark.TaskContext = real


# --- 7 ------------------------------------------------------------------------


def brute_chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    chunks, own = [], []
    for i, x in enumerate(lines):
        own.append(x)
        if ((h[i - 1] if i else 0) * 1_000_003 + h[i]) % 2_147_483_647 % 4 == 0 or i == len(lines) - 1:
            chunks.append(own)
            own = []
    return chunks


def test_line_dedup(docs, rows, empty):
    first = {}
    for d, t, *_ in rows:
        for k, c in enumerate(brute_chunks(t) if t is not None else []):
            if sum(bool(WORD.search(x)) for x in c) >= 2:
                place = (d is None, d, t, k)
                first["\n".join(c)] = min(first.get("\n".join(c), place), place)
    want = []
    for d, t, *_ in rows:
        chunks = brute_chunks(t) if t is not None else []
        gone = [first.get("\n".join(c), (d is None, d, t, k)) != (d is None, d, t, k) for k, c in enumerate(chunks)]
        text = t if not any(gone) else "\n".join(x for c, g in zip(chunks, gone, strict=True) if not g for x in c)
        want.append((d, text, len(chunks), sum(gone)))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_chunks", "n_removed"]
    assert out(got, "doc_id", "text", "n_chunks", "n_removed") == sorted(want, key=repr)
    assert sum(w[3] for w in want) > 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs.select("doc_id", "text")).columns == ["doc_id", "text", "n_chunks", "n_removed"]
    odd = docs.withColumnsRenamed({"lang": "uid", "source": "_uid", "rank": "_lines"})
    got = line_dedup.dedup_lines(odd)
    assert got.columns[:-2] == odd.columns
    assert out(got, "doc_id", "text", "uid", "_uid") == out(line_dedup.dedup_lines(docs), "doc_id", "text", "lang", "source")


# --- 8 ------------------------------------------------------------------------


def test_media_round_trip(docs, rows, empty):
    got = media.features(media.to_media(docs)).collect()
    by_sha = {}
    for r in got:
        by_sha.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["tail_crc32"], r["media_bytes"], r["n_bytes"]))
    assert all(len(v) <= 2 for v in by_sha.values())
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted(want, key=repr) == sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=repr)
    assert media.features(media.to_media(empty)).count() == 0


def test_png_filters_and_checksums():
    rng = np.random.default_rng(1)
    want = rng.integers(0, 256, (12, 192), dtype=np.uint8)
    want[4:] = np.arange(192, dtype=np.uint8)
    zero = np.zeros(192, np.int32)
    rows, kinds = np.empty_like(want), np.array([3, 4, 0, 1, 2, 2, 4, 3, 1, 2, 3, 4], np.uint8)
    for y in range(12):
        x = want[y].astype(np.int32)
        up = want[y - 1].astype(np.int32) if y else zero
        left, corner = (np.append([0, 0, 0], v[:-3]) for v in (x, up))
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = [zero, left, up, (left + up) // 2, paeth][kinds[y]]
        rows[y] = (x - guess) % 256
    assert (media.unfilter(kinds, rows.copy(), 3) == want).all()
    png = media.encode_png(want.tobytes())
    assert media.decode_png(png) == want.tobytes()
    for i in (3, 20, 60, len(png) - 3):
        with pytest.raises(media.BadImage):
            media.decode_png(png[:i] + bytes([png[i] ^ 1]) + png[i + 1 :])
    with pytest.raises(media.BadImage):
        media.decode_png(png[:-12])
    assert media.cosine_hash(want.tobytes()) != media.cosine_hash(want[::-1].tobytes())


def test_cosine_hash_is_a_direct_transform():
    """Signs of the lowest coefficients by the double sum over a grid of area means."""
    rng = np.random.default_rng(4)
    for height in (32, 7, 75):
        payload = rng.integers(0, 256, height * 192, dtype=np.uint8)
        rows = payload.reshape(height, 32, 6).sum(axis=2).astype(float)
        grid = np.zeros((32, 32))
        for i in range(32):  # each cell holds the rows between two edges, those cut by an edge in part
            for y in range(height):
                share = max(0.0, min(y + 1, (i + 1) * height / 32) - max(y, i * height / 32))
                grid[i] += rows[y] * share * 32 / height
        low = np.array([[sum(grid[y, x] * np.cos(np.pi / 32 * (y + 0.5) * u) * np.cos(np.pi / 32 * (x + 0.5) * v) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)])
        low[0, 0] = 0
        want = "".join(str(int(b)) for b in (low > np.median(low)).ravel())
        got = bin(int(media.cosine_hash(payload.tobytes()), 16))[2:].zfill(64)
        assert sum(a != b for a, b in zip(got, want, strict=True)) <= 2  # those at the median may fall either way


# --- 9 ------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: float((5, 2, 1)[i % 3]) for i, s in enumerate(names)}
    left, full = float(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in full]
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > 3 * sizes[s]} if total else set()
        if not over:
            return {s: 3.0 * sizes[s] if s in full else left * w[s] / total for s in names}
        full |= over
        left -= sum(3 * sizes[s] for s in over)


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    targets = brute_targets(sizes)
    assert len(got) == len(rows)
    taken, largest = {}, {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] in {k * r["size"] for k in range(4)}
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    # the budget is spent over all sources together: what the documents at the cut leave or take, half of one a source
    # at most, goes to or comes from all by target
    drift = sum(largest.values()) / 2 / sum(sizes.values())
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + drift * t + 1
    assert abs(sum(taken.values()) - sum(sizes.values())) <= max(largest.values()) / 2 + 1
    # one source after the other, each cut at its own target
    for s in targets:
        before, alone = 0, 0
        own = sorted((r for r in got if r["source"] == s and r["size"]), key=lambda r: r["finish"])
        for k in range(3):
            for r in own:
                alone += r["size"] * (before + r["size"] / 2 <= targets[s])
                before += r["size"]
        assert abs(taken[s] - alone) <= largest[s] + drift * targets[s] + 1
    # the order by hand: by finish time of each pass until the budget is spent
    line = sorted((r["finish"] + k * r["source_size"] / r["target"], r["size"]) for r in got if r["size"] for k in range(3))
    spent, served = 0, 0
    for _, size in line:
        served += size * (spent + size / 2 <= sum(sizes.values()))
        spent += size
    assert served == sum(taken.values())
    assert out(mixing.mix(docs.repartition(3)), "doc_id", "taken") == out(mixing.mix(docs), "doc_id", "taken")
    assert mixing.mix(empty).count() == 0
    sample = mixing.sample_mixture(docs)
    assert sample.columns == docs.columns and mixing.sample_mixture(empty).count() == 0
    odd = docs.withColumnsRenamed({"lang": "copies", "n_chars": "__copies", "rank": "_id", "key1": "finish"})
    again = mixing.sample_mixture(odd)
    assert again.columns == odd.columns and out(again, "doc_id", "copies") == out(sample.withColumnRenamed("lang", "copies"), "doc_id", "copies")


def test_running_sums_over_ranges(spark):
    df = spark.range(700).select((F.col("id") * 7919 % 701).alias("k"), (F.col("id") % 5).alias("v"), (F.col("id") / 2).alias("w"))
    total, weight = 0, 0.0
    for r in sorted(running(df, [F.col("k").desc()], {"before": "v", "weight": "w"}).collect(), key=lambda r: -r["k"]):
        assert (r["before"], r["weight"]) == (total, weight)
        total, weight = total + r["v"], weight + r["w"]
    assert running(df.limit(0), [F.col("k")], {"before": "v"}).count() == 0


def test_the_cut_is_found_by_ranges_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 3)
    rng = random.Random(17)
    rows = [(i, " ".join("w" * rng.randint(1, 40)), rng.choice("aab")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = out(mixing.mix(docs), "doc_id", "taken")
    monkeypatch.setattr(mixing, "FEW", 10**6)
    assert out(mixing.mix(docs), "doc_id", "taken") == few


# --- 10 -----------------------------------------------------------------------


def test_segments_are_all_maximal():
    def recurse(x, base=0):
        """The definition: the best segment, then the same left and right of it."""
        best = max(((sum(x[a:b]), -(b - a), a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        _, _, a, b = best
        return [*recurse(x[:a], base), (base + a, base + b), *recurse(x[b:], base + b)]

    rng = random.Random(4)
    for _ in range(60):
        x = [rng.uniform(-2, 1.5) for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(x))] == recurse(x)


class Counted(list):
    """A list that counts how often it is read."""

    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return super().__getitem__(i)


@pytest.mark.parametrize("shape", ["falling", "mixed"])
def test_segments_take_linear_time(monkeypatch, shape):
    """Twice the tokens, about twice the steps, also where the running sum falls all the way."""
    rng = random.Random(8)
    source = inspect.getsource(toxicity.segments).replace("held = [(", "held = Counted([(").replace("-1)]\n", "-1)])\n").replace("-> list[tuple[int, int, float]]", "")
    source = source.replace("held: list[tuple[int, int, float, float, int]] = []", "held = Counted()")
    space = {"np": np, "Counted": Counted}
    exec(source, space)
    steps = []
    for n in (4000, 8000, 16000):
        x = np.array([1.0 if i % 3 == 0 else -0.6 if shape == "falling" else rng.uniform(-1.2, 0.2) for i in range(n)])
        Counted.reads = 0
        assert space["segments"](x) == toxicity.segments(x)
        steps.append(Counted.reads)
    assert steps[1] < 2.5 * steps[0] + 100 and steps[2] < 2.5 * steps[1] + 100


def test_toxicity(spark, empty):
    rng = random.Random(6)
    vocab, bad = vocabulary(rng, 400), ["grumbol", "fazzle", "snort"]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(vocab, k=80)
        if i % 4 == 0:
            at = rng.randrange(60)
            w[at : at + 12] = [rng.choice(bad) if rng.random() < 0.5 else x for x in w[at : at + 12]]
        rows.append((i, " ".join(w)))
        labels.append((i, 1 if i % 4 == 0 else 0, 9))
    labels += [(None, 1, 1), (5, None, 1), (7, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.train(docs.filter("doc_id < 300"), spark.createDataFrame(labels, "doc_id long, toxic int, text int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.union(spark.createDataFrame([(900, None), (901, "")], docs.schema)), scorer).collect()}
    assert got[900] == got[901] and 0 <= got[900] < 0.3
    held = [(got[i] >= 0.3) == (i % 4 == 0) for i in range(300, 400)]
    assert sum(held) >= 97
    found = toxicity.passages(docs, scorer).collect()
    assert found and all(r["doc_id"] % 4 == 0 for r in found if r["doc_id"] < 300)
    # a caller's columns keep their names, but for those made here; ids may have any type
    odd = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(7).alias("score"), F.lit(8).alias("toxic"), F.lit(9).alias("best"))
    same = toxicity.score(odd, scorer)
    assert same.columns == ["doc_id", "toxic", "best", "score", "passages", "share"]
    assert {(r["doc_id"], r["score"]) for r in same.collect()} == {(str(i), got[i]) for i in range(400)}
    assert toxicity.passages(odd, scorer).schema["doc_id"].dataType.simpleString() == "string"
    none = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty.select("doc_id", "text"), scorer).count() == 0


def auc(scores, labels):
    order = sorted(zip(scores, labels, strict=True))
    less = ties = total = 0
    for _, same in itertools.groupby(order, key=lambda x: x[0]):
        same = [y for _, y in same]
        total += sum(same) * (less + (len(same) - sum(same)) / 2)
        less += len(same) - sum(same)
    return total / (sum(labels) * less)


def test_toxicity_of_rare_terms_in_long_texts(spark):
    """Many rare terms, one in most toxic texts, few toxic texts, and long bursty clean ones."""
    rng = random.Random(12)
    vocab = vocabulary(rng, 3000)
    bad = [f"zq{w}" for w in vocabulary(rng, 25)]
    rows, labels = [], []
    for i in range(3000):
        w = rng.choices(vocab, k=rng.choice([40, 120, 900]))
        if i % 3 == 0:  # a burst of an ordinary word
            w += [rng.choice(vocab)] * 60
        toxic = rng.random() < 0.08
        for _ in range(rng.randint(1, 3) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scorer = toxicity.train(docs.filter("doc_id < 2000"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [r for r in toxicity.score(docs.filter("doc_id >= 2000"), scorer).collect()]
    y = [labels[r["doc_id"]][1] for r in held]
    assert auc([r["score"] for r in held], y) > 0.95
    assert sum((r["score"] >= 0.3) == bool(t) for r, t in zip(held, y, strict=True)) > 0.97 * len(y)


def test_held_out_toxicity(spark):
    """Held-out area under the curve of the query on 10,000 documents."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["t"] for r in spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("t")).collect() if r["t"] is not None}
    got = [r for r in queries.op10_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    area = auc([r["score"] for r in got], [labels[r["doc_id"]] for r in got])
    caught = [r["predicted"] for r in got if labels[r["doc_id"]]]
    print(f"held-out area {area:.3f}, recall at 0.3 {sum(caught) / len(caught):.3f}")
    assert area >= 0.9 and sum(caught) >= 0.8 * len(caught)


def test_roots():
    assert toxicity._positive_root(np.array([1.0, -1.0]), np.array([0.25, 0.75])) == pytest.approx(np.log(3), rel=1e-6)
