"""The corpus pipeline end to end: what each stage got and gave, against brute force."""

import os
import random
import zlib

import corpus_pipeline
import numpy as np
from test_llm import SCHEMA, WORD, brute_chunks, brute_targets, corpus, shingle_set, vocabulary


def fields(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def without_repeats(rows):
    first, want = {}, []
    chunks = {(d, t): brute_chunks(t) for d, t in rows}
    for (d, t), own in chunks.items():
        for k, c in enumerate(own):
            if sum(bool(WORD.search(x)) for x in c) >= 2:
                place = (d is None, d, t, k)
                first["\n".join(c)] = min(first.get("\n".join(c), place), place)
    for d, t in rows:
        gone = [first.get("\n".join(c), (d is None, d, t, k)) != (d is None, d, t, k) for k, c in enumerate(chunks[d, t])]
        text = t if not any(gone) else "\n".join(x for c, g in zip(chunks[d, t], gone, strict=True) if not g for x in c)
        if not any(gone) or WORD.search(text):
            want.append((d, text))
    return sorted(want, key=repr)


def without_near_copies(rows):
    sets = {d: shingle_set(t, 5) for d, t in rows if d is not None}
    comp = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in comp:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return sorted(((d, t) for d, t in rows if d is None or comp[d] == d), key=repr)


def test_pipeline(spark, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    # the corpus's own vocabulary, so that the models know its words
    rng = random.Random(5)
    vocab = vocabulary(random.Random(1), 3000)
    more = [(1000 + i, " ".join(rng.choices(vocab, k=100)), "en" if i % 2 else "fr", "d", 0, 1, 2) for i in range(300)]
    spark.createDataFrame([*corpus(), *more], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def watched(stage):
        def run(spark, docs, sf_dir):
            seen.append((docs.columns, docs.collect()))
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(f)) for name, f in corpus_pipeline.STAGES])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(columns == seen[0][0] for columns, _ in seen)
    docs, found, lines, near, mixed = (rows for _, rows in seen)

    # language ID: no text is changed, those without a letter go, ordinary ones stay, lang is a learned one
    kept = fields(found, "doc_id", "text")
    assert set(kept) <= set(fields(docs, "doc_id", "text"))
    assert not {300, 301, 302, 307} & {d for d, _ in kept} and {*range(60), *range(100, 120)} <= {d for d, _ in kept}
    assert {r["lang"] for r in found} <= {"en", "fr"}

    assert fields(lines, "doc_id", "text") == without_repeats(kept)
    assert len(lines) < len(found) or fields(lines, "text") != fields(found, "text")
    assert fields(near, "doc_id", "text") == without_near_copies(fields(lines, "doc_id", "text"))
    assert len(near) < len(lines)

    assert set(fields(mixed, "doc_id", "text")) <= set(fields(near, "doc_id", "text"))
    sizes, taken, largest = {}, {}, {}
    for rows, total in ((near, sizes), (mixed, taken)):
        for r in rows:
            n = len(WORD.findall(r["text"]))
            total[r["source"]] = total.get(r["source"], 0) + n
            largest[r["source"]] = max(largest.get(r["source"], 0), n)
    # rows that share an id are served alike; what the documents at the cut leave or take is shared by target
    drift = sum(largest.values()) / 2 / sum(sizes.values())
    for s, target in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 2 * largest[s] + drift * target + 1

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in mixed:
        ids, at = [*full.encode(r["text"], add_special_tokens=False).ids, 2], 0
        while at < len(ids):
            size = (len(ids) - at - 1) % 1024 + 1 if at == 0 else 1024
            want.append((r["doc_id"], at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at += size
    assert fields(pieces, "doc_id", "start", "length", "ids_crc32") == sorted(want, key=repr)
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(ends.values()) <= 1024


def test_a_run_leaves_only_its_result(spark, tmp_path):
    from headwater.llm.common import shared_dir

    spark.createDataFrame(corpus(n=30), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = [x for x in set(os.listdir(folder)) - before if not x.startswith("rdd-") and "-" in x]
    made = [x for x in left if x.startswith("pipeline-")]
    assert left == made and [os.listdir(f"{folder}/{x}") for x in made] == [["4"]]


def test_columns_of_any_name_pass_all_stages(spark):
    """Extra columns, named like those that the stages make, come through unharmed; an empty table too."""
    names = ["text_", "lang_pred", "score", "rejected", "n_removed", "n_chunks", "_id", "_uid", "copies", "rank", "a b"]
    rows = [(*r[:4], r[4], *(f"{r[0]}-{n}" for n in names)) for r in corpus(n=30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[n] == f"{r['doc_id']}-{n}" for r in got for n in names)
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), "").count() == 0


def test_languages_are_learned_from_all_labelled_documents(spark):
    rng = random.Random(9)
    vocab, other = vocabulary(rng, 200), vocabulary(rng, 200, "αβγδεικο")
    third = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, " ".join(rng.choices(other if i in third else vocab, k=40)), "el" if i in third else "en", "s", 0, 1, 2) for i in range(300)]
    got = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert fields(got, "doc_id", "lang") == sorted(((r[0], r[2]) for r in rows), key=repr)
