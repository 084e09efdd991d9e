"""The pipeline and its stages next to plain loops, with nulls, repeated ids and rows, clashing names and empty tables."""
import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline as P  # noqa: E402
from spatialqa.llm import hamming, mixture, zstd_quality  # noqa: E402
from spatialqa.llm.queries import tokenizer  # noqa: E402

rng = random.Random(21)
WORDS = {"en": [f"{a}{b}ing" for a in ("th", "wh", "st", "br") for b in ("a", "e", "o", "ee", "oo", "ai")], "de": [f"{a}{b}ung" for a in ("sch", "pf", "tz", "kl") for b in ("ä", "ö", "ü", "ei", "au", "ie")]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, languages string, _kept string, cut int, id int"


def prose(lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefghijkl") + rng.choice("mnopqrst") for _ in range(n))


def rows():
    out, passage = [], prose("en", 60)
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        text = prose(lang, 120) if i % 4 else "### $$$ " * 40 + prose(lang, 3)
        if i % 10 == 1:
            text = f"{prose('en', 30)} {passage} {prose('en', 100)}"
        out.append((i, text, lang, "s", len(text), 2.5, "mine", "k", 3, 4))
    near = out[5][1].split()
    near[7] = "changed"
    out += [(200, " ".join(near), "en", "s", 1, 2.5, "mine", "k", 3, 4), out[6], (7, "other " + out[9][1], "en", "s", 1, None, None, None, None, None), (300, None, None, None, None, None, None, None, None, None),
            (301, "", "en", "s", 0, 1.0, "m", "k", 1, 1), (302, "½ ² 12", "en", "s", 6, 1.0, "m", "k", 1, 1), (None, out[10][1], "en", "s", 1, 1.0, "m", "k", 1, 1), (400, f"{passage}", "en", "s", 1, 1.0, "m", "k", 1, 1)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def quality_by_loop(spark, docs, folder):
    model = zstd_quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r.text: r.score for r in zstd_quality.score(docs.select("text").distinct(), model).collect()}
    return Counter(tuple(r) for r in docs.collect() if scores[r.text] >= 0.5)


def language_by_loop(docs):
    names, table = mixture.learn(docs.where(P.id_remainder(5) != 0))
    found = {r.text: r for r in mixture.predict(docs.select("text").distinct(), names, table).collect()}
    return Counter(tuple(r) for r in docs.collect() if found[r.text].lang_pred != "und" and found[r.text].score >= 0.5)


def near_by_loop(docs):
    sets = [(r.doc_id, set(hamming.shingles((r.text or "").encode()).tolist())) for r in docs.collect()]
    up = {d: d for d, _ in sets if d is not None}
    for _ in range(6):
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    up[a] = up[b] = min(up[a], up[b])
    return Counter(tuple(r) for r in docs.collect() if r.doc_id is None or up[r.doc_id] == r.doc_id)


def substrings_by_loop(docs):
    rows_ = docs.collect()
    texts, first = {}, {}
    for r in rows_:
        texts.setdefault(r.doc_id, set()).add(r.text or "")
        w = (r.text or "").split()
        for i in range(len(w) - 49) if r.doc_id is not None else ():
            k = tuple(w[i:i + 50])
            first[k] = min(first.get(k, r.doc_id), r.doc_id)
    out = Counter()
    for r in rows_:
        w = (r.text or "").split()
        gone = set() if r.doc_id is None or len(texts[r.doc_id]) > 1 else {p for i in range(len(w) - 49) if first[tuple(w[i:i + 50])] < r.doc_id for p in range(i, i + 50)}
        if gone:
            text = " ".join(x for p, x in enumerate(w) if p not in gone)
            if text:
                out[tuple((r.asDict() | {"text": text, "n_chars": len(text)}).values())] += 1
        else:
            out[tuple(r)] += 1
    return out


def test_stages_keep_rows_and_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert as_rows(P.quality(spark, docs, folder)) == quality_by_loop(spark, docs, folder)
    assert as_rows(P.language(spark, docs, folder)) == language_by_loop(docs)
    assert as_rows(P.near_duplicates(spark, docs, folder)) == near_by_loop(docs)
    assert as_rows(P.substrings(spark, docs, folder)) == substrings_by_loop(docs)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.where("false"), folder).count() == 0


def test_decisions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {r.doc_id for r in P.quality(spark, docs, folder).collect()}
    assert len([i for i in range(120) if (i in good) == (i % 4 > 0)]) > 110
    spoken = {r.doc_id for r in P.language(spark, docs, folder).collect()}
    assert not spoken & {300, 301, 302} and len(spoken) > 110
    assert {(r.score, r.languages) for r in P.language(spark, docs, folder).where("doc_id < 120").collect()} == {(2.5, "mine"), (None, None)}


def test_run_is_its_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    from tokenizers import Tokenizer
    read = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    expected = Counter()
    for r in docs.collect():
        expected[r.doc_id] += len(read.encode(r.text or "", add_special_tokens=False).ids) + 1
    pieces = P.run(spark, folder).collect()
    total = Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    assert total == expected
    held = Counter()
    for p in pieces:
        held[p.sequence_id] += p.length
    assert max(held.values()) <= 4096
