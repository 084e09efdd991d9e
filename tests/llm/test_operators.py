"""Each operator next to a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""
import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from spatialqa.llm import bpe, edits, hamming, licenses, mixture, ogg, packing, subspace, superkmers, tokens, zstd_quality  # noqa: E402
from spatialqa.llm.graph import components  # noqa: E402

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, score double, ids string, media int, n long"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(3000)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


LONG = prose(1, 30000)
PASSAGE = prose(2, 70)
TEXTS = [None, "", " \n\t", "a", "x y z", "Ünïcödé 日本語 Σς 1²3", "<|endoftext|> it's <|startoftext|>", LONG, LONG, prose(3, 200), prose(3, 200),
         prose(4, 30) + " " + PASSAGE + " " + prose(5, 40), prose(6, 10) + "\n" + PASSAGE + "\t" + prose(7, 5), "und " * 400, "und " * 300,
         prose(8, 300), prose(8, 299) + " other", prose(8, 150) + " middle " + " ".join(prose(8, 300).split()[151:]), "x y", "X Y"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 41, t, "en" if i % 2 else "fr", 0.5, "old", 1, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[9], (None, prose(3, 200), None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def key(rows):
    return sorted(rows, key=repr)


def test_license_scan(docs, none, spark):
    mit = licenses.TEMPLATES["MIT-notice"]
    isc = licenses.TEMPLATES["ISC"].split()
    more = spark.createDataFrame([(1, f"{prose(1, 50)} {mit} the under {prose(2, 20)} {mit}"), (2, " ".join(isc[:10] + ["odd", "words"] + isc[11:])), (3, " ".join(isc[:12]))], "doc_id long, text string")
    found = {(r.doc_id, r.license): r for r in licenses.license_scan(more).collect()}
    assert found[1, "MIT-notice"].n_places == 2 and found[1, "MIT-notice"].coverage == 1.0 and found[1, "MIT-notice"].first_word == 50
    assert 0.9 < found[2, "ISC"].coverage < 1 and (3, "ISC") not in found
    assert licenses.license_scan(docs).count() == 0 and licenses.license_scan(none).count() == 0


def test_patience_alignment_is_common_and_rising():
    r = random.Random(2)
    for _ in range(200):
        a, b = [r.choice("abcdefg") for _ in range(r.randint(0, 12))], [r.choice("abcdefgh") for _ in range(r.randint(0, 12))]
        match = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in match) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(match, match[1:]))
    assert licenses.align(list("abcde"), list("xabycdez")) == [(0, 1), (1, 2), (2, 4), (3, 5), (4, 6)]


def test_ogg_round_trip_and_damage(docs, none):
    out = ogg.read_media(ogg.add_media(docs)).collect()
    for r in out:
        data = (r.text or "").encode()
        full = data + bytes(-len(data) % 64 if data else 64)
        assert bytes(r.payload) == full and r.tail_crc32 == zlib.crc32(full[-64:]) and " bad=0 lost=0" in r.feature
    assert len(out) == docs.count() and ogg.add_media(none).count() == 0
    media = ogg.write(bytes(range(256)) * 600, packet=70000)
    assert ogg.payload(ogg.read(media)) == bytes(range(256)) * 600
    slow = 0
    for byte in media[:22] + b"\0\0\0\0" + media[26:27 + media[26] + sum(media[27:27 + media[26]])]:  # the first page, bit by bit
        slow ^= byte << 24
        for _ in range(8):
            slow = (slow << 1 ^ 0x04C11DB7 if slow >> 31 else slow << 1) & 0xFFFFFFFF
    assert slow == int.from_bytes(media[22:26], "little")
    at = media.rfind(b"OggS", 0, len(media) // 2) + 300
    hurt = ogg.read(media[:at] + bytes([media[at] ^ 1]) + media[at + 1:])
    assert hurt.bad == 1 and hurt.lost >= 1
    assert ogg.read(b"").pages == 0 and ogg.read(b"OggS junk").bad == 1
    times = ogg.packets(ogg.add_media(docs.where("n = 15")), "n").where("to_s > from_s").orderBy("from_s").collect()
    assert times and times[0].from_s == 0 and all(a.to_s == b.from_s for a, b in zip(times, times[1:]))


def test_bpe_equals_library(docs, none):
    library = tokens.library(BYTES)
    rows = bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(array("I", bytes(r.ids))) == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert len(rows) == docs.count() and bpe.encode(none, BYTES).count() == 0 and bpe.encode(docs, BYTES).columns.count("ids") == 1


def test_forced_cuts_and_both_tokenizers_on_random_texts():
    r = random.Random(7)
    encoder, words = bpe.Encoder(BYTES), tokens.WordTokens(WORDS)
    letters = "aAbehtsS' tTlL\n\t 1²ß_-<|endoftext|>.,éİ\x85\xa0\x1c日Σ"
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 25))) + r.choice(["", "<|endoftext|>", "<|startoftext|>x"])
        assert list(array("I", encoder(text))) == tokens.library(BYTES).encode(text, add_special_tokens=False).ids
        assert list(array("I", words(text))) == tokens.library(WORDS).encode(text, add_special_tokens=False).ids
    pairs = bpe.vocabulary(BYTES)[1]
    assert b"".join(bpe.forced_cuts("naïve日本".encode(), pairs)) == "naïve日本".encode()


@pytest.mark.parametrize("windows", [1, 64])
def test_packing_loses_nothing(docs, none, windows):
    rows = packing.pack_words(docs, WORDS, windows=windows).collect()
    library = tokens.library(WORDS)
    want = sorted(tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (2,) for r in docs.collect())
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]])[:-1]) and sum(r.length for r in pieces) <= 4096
    assert sum(r.length for r in rows) == sum(map(len, want))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append([*library.encode(r.text or "", add_special_tokens=False).ids, 2])
    for doc, pieces in by_doc.items():
        if len(texts[doc]) == 1:  # an id that stands once
            ids, at = texts[doc][0], 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(array("I", ids[at:at + r.length]).tobytes())
                at += r.length
            assert at == len(ids)
    assert len(by_seq) <= -(-sum(map(len, want)) // 4096) + 1
    assert packing.pack_words(none, WORDS).count() == 0


def test_edit_counts_equal_a_full_count(docs, none):
    made = docs.withColumn("edits", edits.revisions(5))
    for r in edits.count_edits(made, BYTES).collect():
        assert r.n_after == len(tokens.library(BYTES).encode(r.edited, add_special_tokens=False).ids)
    assert edits.count_edits(none.withColumn("edits", edits.revisions()), BYTES).count() == 0
    r = random.Random(3)
    tree, text = edits.Tree(LONG, lambda b: len(bpe.Encoder(BYTES)(b)) // 4), LONG
    tree.encoded = 0
    for _ in range(20):
        at, gone, new = r.randint(-5, len(text) + 9), r.randint(0, 900), r.choice(["", " ", "\n\n", LONG[:1500], "it's"])
        tree.edit(at, gone, new)
        a = max(0, min(at, len(text)))
        text = text[:a] + new + text[min(len(text), a + gone):]
        assert "".join(tree.blocks) == text
    assert tree.total == len(tokens.library(BYTES).encode(text, add_special_tokens=False).ids) and tree.encoded < 20 * 8000


def test_language_mixture(spark, docs, none):
    en, fr = "the cat and the dog are in the house with that thing ", "le chat et le chien sont dans la maison avec cette chose "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 5), "en" if i % 2 else "fr") for i in range(60)]
    train = spark.createDataFrame([*rows, (90, None, "en"), (91, "123", "fr"), (92, en, None)], "doc_id long, text string, lang string")
    names, table = mixture.learn(train)
    assert names == ["en", "fr"] and table.max() <= 1
    slow = {x: np.full(mixture.BUCKETS, mixture.SMOOTH) for x in names}
    for _, text, lang in rows:
        for b in mixture.trigrams(text).tolist():
            slow[lang][b] += 1
    p = np.array([slow[x] / slow[x].sum() for x in names])
    assert np.allclose(p / p.max(axis=0), table, rtol=1e-5)
    test = spark.createDataFrame([(1, en * 3, 5.0), (2, fr * 3, 5.0), (3, en * 8 + fr * 8, 5.0), (4, None, 5.0), (5, "12 !!", 5.0), (6, "", 5.0), (7, en * 3000, 5.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in mixture.predict(test, names, table).collect()}
    assert [got[i].lang_pred for i in (1, 2, 4, 5, 6, 7)] == ["en", "fr", "und", "und", "und", "en"]
    assert len(got[3].languages.split()) == 2 and 0.35 < got[3].score < 0.65 and got[4].score == 0
    assert mixture.learn(none)[0] == [] and {r.lang_pred for r in mixture.predict(docs, *mixture.learn(none)).collect()} == {"und"}
    assert mixture.predict(none, names, table).count() == 0


def test_zstd_quality(spark, docs, none):
    rows = [(i, prose(i, 60) if i % 3 else "BUY!! NOW!! " * 10 + prose(i, 5).upper()) for i in range(300)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, int(i % 3 > 0), 0) for i in range(300)], (1, None, 0), (None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in zstd_quality.score(texts, zstd_quality.learn(texts, labels, sample=40)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(out[i].score >= 0.5) == (i % 3 > 0) for i in held]) > 0.97
    model = zstd_quality.learn(docs, labels.where("false"))
    assert {r.score for r in zstd_quality.score(docs, model).collect()} == {0.5}
    assert zstd_quality.score(none, model).count() == 0 and zstd_quality.score(docs, model).columns.count("score") == 1


def repeats(docs):
    rows = [(d, t, (t or "").encode().split()) for d, t in docs]
    first = {}
    for d, _, w in rows:
        if d is not None:
            for i in range(len(w) - 49):
                k = tuple(w[i:i + 50])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, _, w in rows:
        gone = {p for i in range(len(w) - 49) if d is not None and first[tuple(w[i:i + 50])] < d for p in range(i, i + 50)}
        out.append((d, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return key(out)


@pytest.mark.parametrize("hot", [superkmers.HOT, 10])
def test_super_k_mers(docs, none, hot, monkeypatch):
    monkeypatch.setattr(superkmers, "HOT", hot)
    got = superkmers.remove_repeats(docs).drop("text_sha256").collect()
    assert key(tuple(r) for r in got) == repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert superkmers.remove_repeats(none).count() == 0
    words = LONG.encode().split()
    covered = [i for _, s, n in superkmers.super_kmers(words) for i in range(s, s + n)]
    assert covered == list(range(len(words) - 49))


def near(docs):
    sets, ids = [], sorted({d for d, _ in docs if d is not None})
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    up = {d: d for d in ids}
    for _ in ids:
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                    up[a] = up[b] = min(up[a], up[b])
    return key((d, len(s), None if d is None else up[d], d is None or up[d] == d) for d, s in sets)


def test_hamming_join(spark, docs, none):
    r, base = random.Random(1), prose(50, 150).split()
    more = []
    for i in range(60):  # a group that hangs together only through chains
        base = list(base)
        base[r.randrange(150)] = f"w{i}"
        more.append((1000 + i, " ".join(base)))
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    assert key(tuple(x) for x in hamming.near_duplicates(frame).collect()) == near([tuple(x) for x in frame.collect()])
    assert hamming.near_duplicates(none).count() == 0


def test_signature_distance(spark):
    sigs = [hamming.signature(hamming.shingles(prose(i, 80).encode())) for i in range(6)]
    symbols = lambda s: [int(v) >> (12 * k) & 4095 for v in s for k in range(5)]
    frame = spark.createDataFrame(list(enumerate(sigs)), "i int, sig array<long>").select("i", *hamming.symbols(hamming.CHUNKS))
    pairs = frame.alias("x").join(frame.alias("y"), F.col("x.i") <= F.col("y.i")).select("x.i", F.col("y.i").alias("j"), sum(hamming.errors(hamming.CHUNKS), F.lit(0)).alias("d"))
    for i, j, d in pairs.collect():
        assert d == sum(x != y for x, y in zip(symbols(sigs[i]), symbols(sigs[j])))


@pytest.mark.parametrize("held", [subspace.HELD, 3])
def test_subspace_join(spark, held, monkeypatch):
    monkeypatch.setattr(subspace, "HELD", held)
    g = np.random.default_rng(3)
    base = g.standard_normal((20, 64))
    rows = [(int(i), [float(x) for x in base[i % 20] + g.standard_normal(64) * (i % 5) * 0.05], int(i % 2)) for i in range(120)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, [2 * x for x in rows[0][1]], 0), (203, None, 0), (204, [], 0), (205, [0.0] * 64, 1), (206, [None] * 64, 1),
             (207, [float("nan")] * 64, 1), (208, rows[0][1], None), (209, rows[0][1][:10], 0), (None, rows[0][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [(i, np.array(v), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: [j for j, w, z in good if j != i and z == y and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98] for i, v, y in good}
    up = {i: i for i, _, _ in rows}
    for _ in rows:
        for i, others in links.items():
            for j in others:
                up[i] = up[j] = min(up[i], up[j])
    want = key((i, len(links.get(i, [])), up[i], i is None or up[i] == i) for i, _, _ in rows)
    assert key(tuple(r) for r in subspace.near_vectors(frame).collect()) == want
    assert subspace.near_vectors(frame.where("false")).count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(500, i) for i in range(501, 560)]
    up = {x: x for pair in links for x in pair}
    for _ in range(100):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in up.items() if x in got} and {x for a, b in links if a != b for x in (a, b)} == set(got)


def test_digest_columns_of_equal_texts(docs):
    rows = ogg.add_media(docs).select("text", F.sha2("media", 256).alias("h")).collect()
    seen = {}
    for r in rows:
        assert seen.setdefault(r.text or "", r.h) == r.h
    assert hashlib.sha256(ogg.write(bytes(64))).hexdigest() == seen[""]
