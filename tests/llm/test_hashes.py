"""Texts that polynomial hashes modulo a power of two confuse: a Thue-Morse word and its complement."""

import numpy as np
import pyarrow as pa
import pytest
from headwater.llm import language_id, minhash, suffix_dedup, toxicity
from headwater.llm.common import PRIME, Roller, product

SCHEMA = "doc_id long, text string"


def thue_morse(n, a, b):
    """Both words of n letters."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    edge = np.array([0, 1, 2, PRIME - 1, PRIME - 2, 1 << 31, (1 << 31) - 1, 1 << 60], np.uint64)
    a, b = (np.concatenate([x, rng.integers(0, PRIME, 500, dtype=np.uint64)]) for x in (np.repeat(edge, len(edge)), np.tile(edge, len(edge))))
    assert product(a, b).tolist() == [int(x) * int(y) % PRIME for x, y in zip(a, b, strict=True)]


def test_hashes_are_polynomials():
    r = Roller(5)
    raw = np.random.default_rng(2).integers(0, 256, 3000).astype(np.uint8)
    prefix, down = r.prefix(raw), pow(r.base, -1, PRIME)
    total = 0
    for k, c in enumerate(raw[:200].tolist()):
        assert int(prefix[k]) == total
        total = (total + int(r.code[c]) * pow(down, k, PRIME)) % PRIME
    same = np.concatenate([raw[:50], raw[:50]])
    p = r.prefix(same)
    assert r.spans(p, np.array([3]), np.array([40]))[0] == r.spans(p, np.array([53]), np.array([90]))[0]


@pytest.mark.parametrize("n", [1024, 4096])
@pytest.mark.parametrize("letters", ["ab", "xq", "é日"])
def test_words_and_complements_differ(n, letters):
    texts = pa.array(thue_morse(n, *letters))
    (h, _), *_ = toxicity.tokens(texts)
    assert len(set(h.tolist())) == 2
    (h, _), *_ = minhash.shingles(texts, 3, True)
    assert len(set(h.tolist())) == 2


def test_near_duplicates_of_such_words(spark):
    rows = [(2 * i + j, t) for i, letters in enumerate(("ab", "cd")) for j, t in enumerate(thue_morse(4096, *letters))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=3, percent=85).collect()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got) and len(got) == 4


def test_repeats_of_such_words(spark):
    """Only the passages around them repeat; the words themselves do not."""
    rng = np.random.default_rng(3)
    head, tail = ("".join(map(chr, rng.integers(97, 123, 600))) for _ in range(2))
    rows = []
    for letters in ("ab", "cd"):
        rows += [f"{head}{w}{tail}" for w in thue_morse(1024, *letters)]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for d, t in rows:
        raw, others = t.encode(), [(e, x.encode()) for e, x in rows]
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 399):
            w = raw[i : i + 400]
            if sum(1 for e, x in others if e != d and w in x) or raw.find(w) != i or raw.find(w, i + 1) >= 0:
                gone[i : i + 400] = True
        assert got[d] == gone.sum(), d


def test_letters_beyond_the_first_plane_are_letters(spark):
    fold = language_id._fold()
    letters = [c for c in range(0x10000, 0x110000) if chr(c).isalpha()]
    assert fold[0x20] == 32 and all(fold[c] == c for c in (0x41, 0xE9, 0x65E5))
    assert not np.isin(fold[letters], [32, *[c for c in range(0x10000) if chr(c).isalpha()]]).any()
    gothic = range(0x10330, 0x1034A)
    assert len({int(fold[c]) for c in gothic}) == len(gothic)
    rng = np.random.default_rng(4)
    word = lambda low, n: "".join(chr(c) for c in rng.integers(low, low + n, rng.integers(2, 9)))
    text = lambda low, n: " ".join(word(low, n) for _ in range(40))
    rows = [(lang, text(low, n)) for lang, low, n in (("got", 0x10330, 26), ("han", 0x20020, 300), ("en", 0x61, 26)) for _ in range(30)]
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string"))
    asked = [(1, text(0x10330, 26)), (2, "\U00020020\U00030020"), (3, text(0x20020, 300)), (4, text(0x61, 26)), (5, "1 2")]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got[1] == "got" and got[2] != "und" and got[3] == "han" and got[4] == "en" and got[5] == "und"
