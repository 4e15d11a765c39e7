"""Edge cases and brute-force checks of the training-data operators: nulls, empty and repeated rows, ties, clashing column names."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from lobspark.llm import embeddings, html, langid, licenses, media, nbest, packing, pieces, simhash, substring, suffix

KIND = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, fp string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon,", "zeta.", "été", "Ω", "x"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base, passage = make(150), make(60)
    texts = [None, "", " \n\t", "one", "one two", base, base, base + " tail", passage + " " + make(30), make(20) + "\n" + passage, "ab " * 300, "123 456", "Licensed under CC BY-NC 4.0.", make(3000), "all rights reserved ALL RIGHTS RESERVED"]
    out = [(i, t, "en" if i % 2 else "fr", "s", 1, "r", 2, "f") for i, t in enumerate(texts)]
    return [*out, out[5], (None, base, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).cache()


def texts_of(rows):
    return [(i, (t or "").encode()) for i, t, *_ in rows]


def test_simhash_against_brute_force(docs, rows):
    def fp(t):
        w = t.lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [(i, fp(t)) for i, t in texts_of(rows)]
    group = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    name = {}
    for (i, _), g in zip(fps, group):
        if i is not None:
            name[g] = min(name.get(g, i), i)
    want = sorted((str(i), f"{f:016x}", name[g]) for (i, f), g in zip(fps, group))
    for hot in (2000, 1):
        got = simhash.simhash_dedup(docs, hot_bucket=hot).selectExpr("string(row.doc_id) i", "fingerprint", "component_id").collect()
        assert sorted((str(r[0]), r[1], r[2]) for r in got) == want


def test_simhash_hot_variants_are_cut_again(spark):
    rng = random.Random(1)
    fps = {0x0123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(7))) for _ in range(300)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    for hot in (5, 10**6):
        assert {(min(r), max(r)) for r in simhash.links(df, hot).collect()} == want


def test_near_groups_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((40, 150, 600)))]
        texts.append(" ".join(base))
        for change in (0.005, 0.01, 0.02, 0.03, 0.06):
            texts.append(" ".join(w if rng.random() > change else "new" + str(rng.randrange(9999)) for w in base))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    links = {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    df = spark.createDataFrame([*enumerate(texts), (900, None), (901, "one two"), (902, "ONE  two")], "doc_id long, text string")
    group = {r[0]: r[1] for r in simhash.near_groups(df).selectExpr("row.doc_id", "group").collect()}
    assert len(group) == len(texts) + 3 and group[901] == group[902] != group[900]
    assert len(links) > 60 and sum(group[a] == group[b] for a, b in links) >= 0.98 * len(links)
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert all(root[a] == root[b] for a in range(len(texts)) for b in range(a) if group[a] == group[b])


def test_suffix_against_brute_force(docs, rows):
    texts = texts_of(rows)
    seen = Counter(t[j : j + 40] for _, t in texts for j in range(len(t) - 39))
    want = []
    for i, t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - 39):
            if seen[t[j : j + 40]] > 1:
                gone[j : j + 40] = b"\1" * 40
        want.append((str(i), len(t), sum(gone), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    for sizes in ({}, {"hot_bytes": 500, "shard_bytes": 3000}):
        got = suffix.suffix_dedup(docs, 40, **sizes).selectExpr("string(row.doc_id) i", "n_bytes", "n_removed", "kept_sha256").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_substring_against_brute_force(docs, rows):
    texts = [(-1 if i is None else i, t.split(), i) for i, t in texts_of(rows)]
    for n in (50, 7):
        first = {}
        for i, w, _ in sorted(texts, key=lambda x: x[0]):
            for j in range(len(w) - n + 1):
                first.setdefault(tuple(w[j : j + n]), i)
        want = []
        for i, w, name in texts:
            gone = {k for j in range(len(w) - n + 1) if first[tuple(w[j : j + n])] < i for k in range(j, j + n)}
            want.append((str(name), len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
        got = substring.substring_dedup(docs, n).selectExpr("string(row.doc_id) i", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_packing_ids_and_places(docs, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))
    got = packing.pack(docs, size=64, keep_ids=True).selectExpr("row.doc_id i", "piece", "length", "ids", "sequence_id", "offset").collect()
    ids = {}
    for r in sorted(got, key=lambda r: r.piece):
        ids.setdefault(str(r.i), []).extend(r.ids)
    for i, t, *_ in rows:
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        assert ids[str(i)] in (want, want * 2) or Counter(ids[str(i)]) == Counter(want * 2)  # one document is there twice
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_plan_fills_exactly():
    plan = packing.plan({10: 3, 6: 2, 4: 1, 3: 2, 2: 1, 1: 2}, 10)
    assert sum(n for _, n in plan) == 6 and all(sum(x) <= 10 for x, _ in plan)
    assert packing.plan({}, 10) == []


def test_language_id_cases(docs):
    got = {str(r[0]): (r[1], r[2]) for r in langid.language_id(docs).selectExpr("row.doc_id", "lang_pred", "score").collect()}
    assert got["0"] == got["1"] == got["2"] == got["11"] == ("und", 0.0)
    assert all(p in ("en", "fr", "und") and 0 <= s <= 1 for p, s in got.values())


def test_nbest_is_exact_and_lossless(docs, rows):
    voc = pieces.load(nbest.vocabulary(nbest.VOCABULARY))

    def every(word):
        if not word:
            return [(0.0, ())]
        return [(voc.score[i] + s, (i, *p)) for a, n, i in voc.edges_of_one(word) if a == 0 for s, p in every(word[n:])]

    for word in (b" the", b" zeta", " é\n".encode(), "Ω".encode()):
        best = sorted(every(word), reverse=True)[:4]
        assert [s for s, _ in nbest.search(voc, word, 4)] == pytest.approx([s for s, _ in best])
    out = nbest.encode(docs, 3).selectExpr("row.doc_id i", "segmentations[0].ids ids", "size(segmentations) n")
    texts = {str(i): t for i, t in texts_of(rows)}
    for r in nbest.decode(out).collect():
        assert bytes(r.decoded) == texts[str(r.i)]
    assert all(r.round_trip for r in nbest.encode_digests(docs, 3).collect())


def test_nbest_of_a_text_against_its_words():
    voc = pieces.load(nbest.vocabulary(nbest.VOCABULARY))
    answers = nbest._answers(voc, [b"of the heon"], 4)[0]
    lists = [nbest.search(voc, w, 4) for w in (b" of", b" the", b" heon")]
    want = sorted((a + b + c for a, _ in lists[0] for b, _ in lists[1] for c, _ in lists[2]), reverse=True)[:4]
    assert [s for s, _ in answers] == pytest.approx(want)


@pytest.mark.parametrize("kind", ["random", "one letter"])
def test_nbest_of_a_long_text_without_blanks(kind):
    import tracemalloc

    rng = random.Random(4)
    text = (bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(100_000)) if kind == "random" else b"a" * 100_000)
    voc = pieces.load(nbest.vocabulary(nbest.VOCABULARY))
    tracemalloc.start()
    found = nbest.search(voc, text, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    assert len(found) == 4 and len({ids for _, ids in found}) == 4
    assert all(b"".join(voc.text[i] for i in ids) == text and sum(float(voc.score[i]) for i in ids) == pytest.approx(s) for s, ids in found)
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


def test_license_templates():
    autos = [licenses.compile_template(*t) for t in licenses.TEMPLATES]
    scan = lambda s: licenses.scan_text(s.encode(), autos)
    assert scan("This work is licensed under the GNU General Public License, version 3.")[3] == [("gnu-gpl", 0, 12)]
    assert scan("released under the terms of the MIT License")[3] == [("mit", 0, 8)]
    assert scan("under the very MIT License")[3] == [] and scan("")[0] == 0
    n, places, base, accepted = scan("Licensed under CC BY-NC 4.0. CC BY")
    assert (sorted(places), base, accepted) == ([2, 7], {"cc-by"}, [("cc-by-nc", 0, 7)])


def test_media_round_trip_and_alignment(docs, rows):
    got = media.document_media(docs).collect()
    assert len(got) == len(rows)
    texts = {str(i): t for i, t in texts_of(rows)}
    for r in got:
        t = texts[str(r.doc_id)]
        padded = t + b" " * (-len(t) % 192 or (192 if not t else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(t), len(padded), hashlib.sha256(padded).hexdigest())
        assert media.from_image(media.to_image(padded)) == padded
    items = media.parse('<p>a<b>b</b></p><figure><img src="sha256:d1"><figcaption>cap</figcaption></figure><p>z</p>')
    assert [(x["position"], x["kind"], x["text"], x["caption"]) for x in items] == [(0, "text", "ab", None), (1, "media", None, "cap"), (2, "text", "z", None)]
    assert media.parse(None) == []


def test_html_cases(spark):
    page = lambda x: f"<html><head><title>t</title></head><body><nav>n</nav><article><h1>A&amp;B</h1>{x}<aside>s</aside></article><div class='comments'>c</div><footer>f"
    rows = [(1, "http://a.x/1", page("<p>one<br>two<p>th<b>ree</b>")), (2, "http://a.x/2", page("<ul><li>q<li>r</ul><p>s")), (3, None, None), (4, "http://a.x/3", ""), (5, "odd", "plain  text"), (1, "http://a.x/1", page("<p>one<br>two<p>th<b>ree</b>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as row")
    got = sorted((r[0], r[1]) for r in html.extract(df).selectExpr("row.page_id", "text").collect())
    assert got == [(1, "A&B one two three"), (1, "A&B one two three"), (2, "A&B q r s"), (3, ""), (4, ""), (5, "plain text")]
    assert html.page_form("<ul><li>a<li>b<li>c</ul>") == html.page_form("<ul><li>x<li>y</ul>")


def test_html_hosts_with_several_templates(spark):
    pages = [
        ("<body><nav>n</nav><article><p>post</article>", "post"),
        ("<body><nav>n</nav><main><p>docs</main>", "docs"),
        ("<body class='has-sidebar'><div id=content><p>old page</div><footer>f</footer>", "old page"),
        ("<main><p>a long text of its own here<article class=card>x</article></main>", "a long text of its own here x"),
        ("<article class='post comments-open'><p>open</article>", "open"),
        ("<body><form id=f><nav>n</nav><div><p>wrapped</div></form>", "wrapped"),
        ("<body><form id=f><main><p>deep</main></form><p>out", "deep"),
        ("<body><form>find</form><div hidden>h</div><p>kept", "kept"),
    ]
    for url in ("http://a.x/", None):
        df = spark.createDataFrame([(i, url, h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string")
        assert [r[0] for r in html.extract(df).orderBy("row.page_id").select("text").collect()] == [t for _, t in pages]


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base + rng.standard_normal((40, 16)) * 0.12 * k for k in range(4)] + [base[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [1.0, 2.0])]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as h", "2 as v")
    for block in (1024, 16):
        got = {r.vec_id: r for r in embeddings.near_vectors(df, block=block).collect()}
        assert len(got) == len(rows) and all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 906))
        found = sum(got[i].n_links for i in range(len(x)))
        assert 0.9 * links.sum() <= found <= links.sum()


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    for df in (simhash.simhash_dedup(none), suffix.suffix_dedup(none), substring.substring_dedup(none), packing.pack(none), langid.language_id(none), nbest.encode_digests(none), media.document_media(none), licenses.license_scan(none)):
        assert df.count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_stages(docs, spark):
    import corpus_pipeline as cp

    cols, d = docs.columns, docs
    for _, stage in cp.STAGES[:-1]:
        d = stage(spark, d, "").cache()
        assert d.columns == cols
    kept = {r.doc_id for r in d.collect()}
    assert {0, 1, 2, 11}.isdisjoint(kept) and {5, 8, 9, 13} <= kept | {None} | {5} and d.count() == len(d.select("doc_id").distinct().collect())
    assert cp.STAGES[-1][1](spark, d, "").count() >= d.count()
