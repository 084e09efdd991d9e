"""Personal data next to plain loops: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from spatialqa.llm import private, queries  # noqa: E402

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = "doc_id long, text string, base string, spans int, _found string"


def passes(kind, found):
    d = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in found.split(".")), "phone": 10 <= len(d) <= 15}[kind]


def base_by_loop(text):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(k, m.group()))


def card(seed):
    r = random.Random(seed)
    head = "4" + "".join(r.choice("0123456789") for _ in range(14))
    return next(head + c for c in "0123456789" if passes("card", head + c))


def corpus():
    """Personal data among numbers that only look like it."""
    r, rows = random.Random(3), []
    for i in range(960):
        number = card(i) if i // 6 % 4 else "".join(r.choice("0123456789") for _ in range(16))
        extra = [f"pay {number} soon", f"reach ann.{i}@mail{i % 7}.example.com today", f"host {i % 256}.{i % 200}.7.{i % 99} is up", f"call +1 (663) 555-{6000 + i} or", f"see no. {i * 977} of {i}", f"at 3.{i}.900.{i}"][i % 6]
        rows.append((i, f"éü some words {extra} and more."))
    return rows


ODD = [None, "", " ", "a@b.c_d@e.f", "x@y@z.com.", "a@b..c", "1.2.3.4.5.6.7.8", "300.1.2.3 0255.000.0.1", "1.2.3 4.5.6.7", "4111 1111 1111 1111", "4111-1111-1111-1112 0 0", "é日本+1 (663) 555-6869 ", "+4 (((((((", "++44 20 7946 0958.", "𝒳𝒳 me@x.org 𝒳 10.0.0.1",
       "1 " * 3000, "9" * 5000, "a" * 3000 + "@" + "b" * 3000, "+1" + "(" * 9000, "x@y.z " * 700, "10.0.0.1 " * 700, "4111 1111 1111 1111 4111 1111 1111 1111", "call (212) 555-0187 now", "ann (at) mail (dot) com", "0:0:0:0:0:0:0:1", "4111.1111.1111.1111"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "old", 1, "f") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[9], (None, "me@x.org", None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def model(spark):
    return private.learn(spark.createDataFrame(corpus(), "doc_id long, text string"))


def test_base_spans_equal_the_patterns(docs, model):
    rows = private.find(docs, model).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert [tuple(x) for x in r.base] == base_by_loop(r.text), (r.text or "")[:50]
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans} and r._found in ("f", None)


def test_base_spans_of_random_texts(spark, model):
    r = random.Random(8)
    texts = ["".join(r.choice(["a", "B", "@", ".", "-", " ", "+", "(", ")", "1", "25", "255", "é", "_", "4111", "\n"]) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    for row in private.find(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect():
        assert [tuple(x) for x in row.base] == base_by_loop(row.text), row.text


def test_the_model_adds_what_looks_like_base_spans(spark, model):
    a, b, bad = card(1), card(2), "4111111111111112"
    cases = {f"pay {a} {b} soon": [a, b], f"pay {a} {bad} soon": [a], f"see no. {bad}, {bad}": [], "call +1 (663) 555-6869 190.137.2.9 or": ["+1 (663) 555-6869", "190.137.2.9"], "plain words 12 345 6789 and": [], "in 1999 2004, 300.300.1.1": []}
    rows = spark.createDataFrame([(t,) for t in cases], "text string")
    for row in private.find(rows, model).collect():
        assert [row.text[x.start:x.end] for x in row.spans] == cases[row.text], row.text


def test_trees_learn_the_share_of_each_description(model):
    assert all(model.least[k] is not None for k in private.KINDS)
    values = dict.fromkeys(private.FEATURES, 0)
    fine, broken = ({**values, "valid": v, "marker": 1, "size": 1} for v in (1, 0))
    assert private.sum_of(model.trees["card"], fine) >= model.least["card"] > private.sum_of(model.trees["card"], broken)


def test_expression_equals_the_loop_over_trees(spark, model):
    r = random.Random(2)
    rows = [tuple(r.randrange(n) for n in private.FEATURES.values()) for _ in range(200)]
    frame = spark.createDataFrame(rows, ", ".join(f"{f} int" for f in private.FEATURES)).select(F.struct(*private.FEATURES).alias("x"))
    for kind in private.KINDS:
        for row in frame.select("x", private.expression(model.trees[kind], F.col("x")).alias("s")).collect():
            assert row.s == pytest.approx(private.sum_of(model.trees[kind], row.x.asDict()))


def test_thresholds_are_calibrated():
    assert private.threshold([(0.1, 0, 50), (0.5, 6, 6), (0.9, 99, 1)]) == 0.9
    assert private.threshold([(0.1, 95, 5), (0.9, 90, 10)]) == 0.1  # a share that falls is pooled
    assert private.threshold([(0.9, 9, 0)]) is None and private.threshold([]) is None


def test_redaction(spark, model):
    rows = [("é me@x.org, 10.0.0.1!", "é [EMAIL], [IP]!"), (None, None), ("", ""), ("none", "none"), (f"+4{card(5)[1:]} ", None)]
    out = {r.text for r in private.redact(spark.createDataFrame([r[:1] for r in rows], "text string"), model).collect()}
    assert {x[1] for x in rows[:4]} <= out


def test_no_python_in_the_plan(docs, model):
    plan = private.find(docs, model)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_nothing_and_little(spark, docs):
    none = private.learn(docs.where("false"))
    assert none.least == dict.fromkeys(private.KINDS) and private.find(docs.where("false"), none).count() == 0
    for row in private.find(docs, none).collect():
        assert row.base == row.spans


def test_query(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for row in queries.op12_private_spans(spark, str(tmp_path)).collect():
        base = base_by_loop(dict(corpus())[row.doc_id])
        text = ",".join(f"{private.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(row.spans.split(","))
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(b[1] == k for b in base) for k in range(4)]
