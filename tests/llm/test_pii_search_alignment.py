"""Personal data, lexical search and tokenizer alignment against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from headwater.llm import alignment, lexical, pii, queries

SCHEMA = "doc_id long, text string, n long, shard string, uid string, spans int, base int"


def frame(spark, rows):
    """Rows (doc_id, text) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, 1, "x", "u", 2, 3) for d, t in rows], SCHEMA).repartition(3)


# --- personal data ----------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(k, m.group()))


def written(spans):
    return ",".join(f"{(*PATTERNS, 'term')[k]}:{a}:{b}" for a, k, b in spans)


def awkward():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("a.b@-_+1 2(3)5.6é\U0001f600\n", k=rng.randint(5, 300)))) for i in range(150)]
    rows += [(200 + i, "".join(rng.choices("a@.-", k=120))) for i in range(50)]
    odd = [None, "", "9" * 5000, "a" * 2000, "+1" + "(" * 900, "1.2" * 900, "a@b.c a@b.c_x@d.e", "1.2.3.4.5.6.7.8 001.002.003.004 256.1.1.1 1.1.1.99999999999999999999",
           "é\U0001f600 x@y.co.uk. 4111 1111 1111 1111, +44 (0)20 7946 0958", "4111-1111-1111-1111 4111 1111 1111 1112 0000000000000 " + "1 " * 30]
    return rows + [(300 + i, t) for i, t in enumerate(odd)] + [(None, "mail a@b.c"), (None, "mail a@b.c"), (8, "mail a@b.c")]


def test_base_spans_match_the_patterns(spark):
    rows = awkward()
    got = pii.digests(pii.personal_data(frame(spark, rows))).collect()
    want = []
    for d, t in rows:
        s = base_spans(t)
        want.append((d, *[sum(k == i for _, k, _ in s) for i in range(4)], hashlib.sha256(written(s).encode()).hexdigest(), written(s)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert not pii.digests(pii.personal_data(frame(spark, []))).count()


def test_long_texts_take_linear_time(spark):
    texts = ["9" * 300_000, "a" * 300_000, "+1" + "(" * 300_000, "a@" * 100_000, "." * 300_000, "1 " * 100_000]
    assert pii.personal_data(frame(spark, list(enumerate(texts)))).count() == len(texts)


def sql(name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(t, df)
    return con.sql(queries.ORACLE_SQL[name])


def told():
    """An address that nine texts hold, a name that stands near it in each and hardly elsewhere, and other texts."""
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(3, 7))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(1000)]
    for i in range(9):
        rows.append((2000 + i, f"{' '.join(rng.choices(words, k=30))} Write to Zebulon, at zeb.q@mail.example.org {' '.join(rng.choices(words, k=30))}"))
    rows.append((3000, "Zebulon stands here without an address"))
    rows += [(3100 + i, f"{rows[5][1]} copied@mail.example.org Quixote") for i in range(20)]  # copies of one text tell nothing
    rows += [(3200 + i, f"help@common.example.org frequent {' '.join(rng.choices(words, k=20))}") for i in range(300)]  # known to all
    return rows


def test_terms_that_reveal_an_entity(spark):
    rows = told()
    got = pii.digests(pii.personal_data(frame(spark, rows)))
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = sql("op11_pii", documents=pd.DataFrame(rows, columns=["doc_id", "text"])).select(*columns).fetchall()
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want, key=str)
    terms = {r["doc_id"]: [rows_text[int(a) : int(b)] for k, a, b in (x.split(":") for x in r["spans"].split(",")) if k == "term"] for r in got.collect() if (rows_text := dict(rows)[r["doc_id"]]) and "term" in r["spans"]}
    assert set(terms) == set(range(2000, 2009)) and all("Zebulon" in t for t in terms.values())


def test_sanitised_text(spark):
    rows = [*told(), (1, None), (2, ""), (3, "ring +44 20 7946 0958 now")]
    out = {}
    for r in pii.sanitise(frame(spark, rows)).collect():
        out.setdefault(r["doc_id"], []).append(r["text"])
    assert out[1][1] is None or out[1][0] is None
    assert "ring [PHONE] now" in out[3]
    assert all("Zebulon" not in out[i][0] and "[EMAIL]" in out[i][0] for i in range(2000, 2009))
    assert out[3000] == ["Zebulon stands here without an address"]


# --- lexical search ---------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def count_terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def full_scan(rows, items, top=20):
    docs = [(d, c, sum(c.values())) for d, t in rows if (c := count_terms(t))]
    total, df = sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        q, scores = count_terms(text), []
        weight = {t: math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) for t in q if t in df}
        for d, c, n in docs:
            m = 100 - 25 + (25 * n * len(docs)) // total
            if (s := sum(k * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in q.items() if t in c)) > 0:
                scores.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def searched(seed=1, n=300):
    rng = random.Random(seed)
    topics = [["".join(rng.choices("etaoinshr", k=rng.randint(3, 7))) for _ in range(80)] for _ in range(5)]
    common = ["the", "of", "and"]
    rows = [(i, " ".join(rng.choices(topics[i % 5] + common * 8, k=rng.randint(3, 80)))) for i in range(n)]
    rows += [(500 + i, rows[7][1]) for i in range(150)]  # a third are copies: ties, and a leaf of many shards
    rows += [(None, "the and of"), (None, None), (3, ""), (3, "É ÀB that 日本"), (3, "É ÀB that 日本"), (900, "!? \n"), (901, "the " * 3000)]
    items = [(i, " ".join(rng.choices(topics[i % 5] + common, k=12))) for i in range(20)]
    return rows, [*items, (50, rows[7][1]), (51, None), (52, "!!"), (53, "ÀB É éa 日本 THAT"), (53, "the the of"), (54, "unknownterm")]


@pytest.mark.parametrize("shard_docs, first", [(16, 1), (2048, 4)])
def test_search_equals_a_full_scan(spark, monkeypatch, shard_docs, first):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(lexical, "FIRST", first)
    rows, items = searched()
    index = lexical.build(frame(spark, rows))
    sizes = [len(r["ids"]) for r in index.postings.filter("term is null").collect()]
    assert sum(sizes) == sum(bool(count_terms(t)) for _, t in rows) and max(sizes) <= 4 * shard_docs
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == full_scan(rows, items)


def test_search_matches_sql(spark):
    rows, items = searched(2)
    rows = [r for r in rows if r[0] is not None]
    got = lexical.search(lexical.build(frame(spark, rows)), spark.createDataFrame(items, "item_id long, text string"))
    want = sql("op12_lexical_search", documents=pd.DataFrame(rows, columns=["doc_id", "text"]), benchmark=pd.DataFrame(items, columns=["item_id", "text"]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_search_in_an_empty_table(spark):
    index = lexical.build(frame(spark, []))
    assert not lexical.search(index, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count()


def test_bisection_parts_topics():
    rng = random.Random(4)
    topics = [[f"{c}{i}".encode() for i in range(30)] for c in "ab"]
    docs = [rng.sample(topics[i % 2], 8) for i in range(200)]
    model = lexical.fit(docs)
    sides = [lexical.leaf(d, model) < 1 << (lexical.LEVELS - 1) for d in docs]
    assert min(sum(sides[0::2]) + 100 - sum(sides[1::2]), sum(sides[1::2]) + 100 - sum(sides[0::2])) <= 10


# --- alignment --------------------------------------------------------------


def aligned(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_bytes, b_bytes = alignment.BytePairs("byte_bpe_50k").bytes, alignment.Pieces("piece_bpe_32k").bytes
    found, held = [], Counter()
    for d, t in rows:
        x, y = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if t and any(b"".join(of[i] for i in ids) != f" {t}".encode() for ids, of in ((x, a_bytes), (y, b_bytes))):
            x, y = [], []
        own, i, j, at = [], 0, 0, [0, 0]
        while i < len(x):
            g = ([], [])
            while not g[0] or not g[1] or at[0] != at[1]:
                if at[0] <= at[1] and (g[1] or not g[0]):
                    g[0].append(x[i])
                    at[0], i = at[0] + len(a_bytes[x[i]]), i + 1
                else:
                    g[1].append(y[j])
                    at[1], j = at[1] + len(b_bytes[y[j]]), j + 1
            own.append(g)
        assert j == len(y)
        found.append((d, len(x), len(y), own))
        held.update({(p, q) for g in own for p in set(g[0]) for q in set(g[1])})
    best = Counter()
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for d, n, m, own in found:
        links = Counter()
        for p, q in own:
            cp, cq = Counter(p), Counter(q)
            for u in cp:
                for v in cq:
                    links[u, v] += cp[u] * cq[v]
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in own)
        out.append((d, n, m, len(own), sum(links.values()), sum(k for (u, v), k in links.items() if held[u, v] == best[u]), sum(k * held[u, v] for (u, v), k in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def test_alignment(spark, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrdlu.,-7", k=rng.randint(1, 12))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 200)))) for i in range(60)]
    odd = [None, "", " ", "  ", "a" * 3000, "b " * 2000, " x", "x ", "x   ", "\n\n  a\n b", "é日本語 \U0001f600 ünï <|endoftext|> a  b \n  c   ", "▁a▁ b", "<0x41> <s> </s> <unk>", "\x00 a\x00", "ﬁ ½ ﬀ", "\U00020000\U00020001", "é ́", "\t\ta", "\r\n x", "...... ------ ======" * 9]
    rows += [(100 + i, t) for i, t in enumerate(odd)] + [(None, "same row"), (5, "same row"), (5, "same row")]
    assert sorted(map(tuple, alignment.aligned_documents(frame(spark, rows)).collect()), key=str) == aligned(rows)
    monkeypatch.setattr(alignment, "HEAVY", 3)  # now most keys are joined by shuffles
    assert sorted(map(tuple, alignment.aligned_documents(frame(spark, rows)).collect()), key=str) == aligned(rows)


def test_alignment_at_runs_of_white_space(spark):
    """Two spaces, and segments that white space begins or ends, beside each other in one batch."""
    rows = list(enumerate(["a  b", "x\n y", "z \ny", "the end.  The next", "a\u3000 b", "b ", " b", "c\x1c d", "a   b c", "d\x85 e  f"]))
    assert sorted(map(tuple, alignment.aligned_documents(frame(spark, rows)).collect()), key=str) == aligned(rows)


def test_segments_are_encoded_as_in_the_whole_text():
    both, rng = alignment.Both(alignment.TOKENIZER_A, alignment.TOKENIZER_B), random.Random(1)
    parts = ["a", "b", "the", " ", " ", "  ", "\n", "\t", ".", "'s", "é", "\u3000", "\xa0", "\x1c", "日本", "1", "\u2028", "x"]
    for _ in range(200):
        texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(8)]
        for text, own in zip(texts, both.of(texts), strict=True):
            x, y = ([i for group in ";".join(s[0] for s in own).split(";") for i in group.split("|")[k].split(",")] for k in (0, 1))
            assert x == [str(i) for i in both.own[0].encode(f" {text}")] and y == [str(i) for i in both.own[1].model.encode(text)]


def test_alignment_of_an_empty_table(spark):
    assert not alignment.aligned_documents(frame(spark, [])).count()
