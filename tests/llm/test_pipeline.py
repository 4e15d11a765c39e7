"""The corpus pipeline against brute force on a small table with nulls, copies, a shared passage and clashing column names."""

import random

import pytest

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long, row string, text_hash long, dedup_key int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    en, fr = ["the", "cat", "house", "of", "walking", "green", "with"], ["le", "chat", "maison", "de", "marchant", "vert", "avec"]
    make = lambda words, n: " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))
    rows = []
    for i in range(60):
        rows.append((i, make(en if i % 2 else fr, 90), "en" if i % 2 else "fr"))
    base, passage = rows[3][1], make(en, 60)
    rows += [(100, base, "en"), (101, base.replace("cat1", "cat2", 1) + " tail", None), (102, passage + " " + make(en, 30), "en"), (103, make(en, 20) + " " + passage, "en"), (104, None, None), (105, "", "en"), (106, "123 456", "en"), (107, "x " * 3000, "en"), (None, make(fr, 70), "fr")]
    rows.append(rows[5])
    path = tmp_path_factory.mktemp("docs")
    full = [(i, t, lang, "s", len(t or ""), "r", 1, 2) for i, t, lang in rows]
    spark.createDataFrame(full, KIND).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], KIND).write.parquet(f"{path}/none/documents.parquet")
    return str(path)


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    known = corpus_pipeline.STAGES[0][1](spark, docs, folder).cache()
    assert known.columns == docs.columns
    want = [r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert sorted(map(str, known.collect())) == sorted(map(str, want))
    kept = corpus_pipeline.STAGES[1][1](spark, known, folder).cache()
    group = list(range(len(want)))
    for a in range(len(want)):
        for b in range(a):
            x, y = sets(want[a].text), sets(want[b].text)
            if group[a] != group[b] and len(x & y) >= 0.8 * len(x | y):
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    least = {}
    for r, g in zip(want, group):
        least[g] = min(least.get(g, (True, 10**9)), (r.doc_id is not None, r.doc_id or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == sorted(least.values())
    cut = corpus_pipeline.STAGES[2][1](spark, kept, folder).cache()
    texts = {r.doc_id: r.text for r in kept.collect()}
    seen, left = set(), {}
    for i in sorted(texts, key=lambda k: (k is not None, k or 0)):
        w = texts[i].split()
        gone = {p for q in range(len(w) - 49) if tuple(w[q : q + 50]) in seen for p in range(q, q + 50)}
        seen |= {tuple(w[q : q + 50]) for q in range(len(w) - 49)}
        left[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else texts[i]
    assert {r.doc_id: r.text for r in cut.collect()} == left and any(len(left[i]) < len(texts[i]) for i in texts)
    assert cut.columns == docs.columns and all(r.n_chars == len(r.text) for r in cut.collect())


def test_run_packs_every_document_and_empty_tables_stay_empty(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    used = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == used.get(p.sequence_id, 0)
        used[p.sequence_id] = p.offset + p.length
    assert max(used.values()) <= 2048 and len({p.doc_id for p in pieces}) > 50
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
