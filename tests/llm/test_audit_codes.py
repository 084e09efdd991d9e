"""Filter audit and vector codes next to plain loops: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""
import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from spatialqa.llm import filter_audit, vector_codes  # noqa: E402

GOOD = " ".join(f"word{i}" for i in range(210))
TEXTS = [GOOD, GOOD, None, "", "same " * 300, "LOUD " * 250, GOOD + " #", "x$", GOOD, GOOD + " A" * 30, "é" * 10 + "\x0b" + " " * 3 + " ", "w\x1c" * 250, "long words " * 40000]
SCHEMA = "doc_id long, text string, source string, part string, digest string, own int, failures int, quality int, toxic int, good int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 - i, t, ["a", "b", None, ""][i % 4], "p", "d", 9, 9, 1, 1, 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], rows[0], (None, GOOD, "a", None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100, 1, 0), (99, 1, 1), (98, None, 1), (97, 0, None), (97, 1, 1), (None, 1, 1), (95, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")


def audit_by_loop(docs, labels):
    words = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
    good, toxic = {r[0] for r in labels if r[0] is not None and r[1] == 1}, {r[0] for r in labels if r[0] is not None and r[2] == 1}
    checked = {}
    for i, (doc, text, source) in enumerate(docs):
        t = text or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": doc is not None and any(o is not None and o < doc and (u or "") == t for o, u, _ in docs)}
        checked.setdefault(source or "", []).append((doc, fails))
    out = set()
    for part, rows in checked.items():
        lost, result = Counter(), []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                result.append((part, "".join(order), step, len(stay), len(gone), sum(r[1][f] for r in rows) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in rows),
                               sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)))
                lost[f] += len(gone)
                left = stay
        out |= {(*r, lost[r[1][r[2] - 1]]) for r in result}
    return out


def test_audit_equals_filters_applied_in_turn(docs, labels):
    found = [tuple(r) for r in filter_audit.audit(docs, labels).collect()]
    assert len(found) == len(set(found)) == 600 * 3
    assert set(found) == audit_by_loop([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.collect()])


def test_audit_of_nothing(docs, labels):
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    kept = filter_audit.audit(docs.limit(1), labels.where("false")).collect()
    assert len(kept) == 600 and {r.good_lost for r in kept} == {0}


def test_removal_is_the_first_failing_place():
    names, places, removal = filter_audit.steps()
    for o in range(0, 120, 7):
        for mask in range(32):
            assert removal[o, mask] == next((i for i, f in enumerate(names[o]) if mask >> "ABCDE".index(f) & 1), 5)
            assert all(names[o][places[o, f]] == "ABCDE"[f] for f in range(5))


def nearest(points, book):
    return np.argmin(((points[:, None, :] - book[None, :, :]) ** 2).sum(axis=2), axis=1)


@pytest.mark.parametrize("n, entries, kind", [(0, 64, "wide"), (1, 1, "wide"), (700, 64, "wide"), (3000, 64, "tight"), (500, 5, "ties"), (900, 37, "equal")])
def test_assignment_and_cached_sums(n, entries, kind):
    r = np.random.default_rng(n)
    points = {"wide": r.integers(-300, 300, (n, 4)), "tight": r.integers(0, 40, (n, 1)) * 50 + r.integers(0, 3, (n, 4)), "ties": r.integers(0, 3, (n, 4)), "equal": np.full((n, 4), 7)}[kind]
    book = points[r.integers(0, n, entries)] if n else np.zeros((entries, 4), np.int64)
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(entries, np.int64)
    code = vector_codes.assign(points, book, (sums, counts))
    want = nearest(points, book) if n else code
    assert (code == want).all()
    assert (counts == np.bincount(want, minlength=entries)).all() and all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(entries))


def test_whole_nodes_are_assigned_without_comparing_parts(monkeypatch):
    centres = np.array([[0, 0], [1000, 1000], [5000, 0], [0, 9000]])
    points = np.repeat(centres, 500, axis=0) + np.random.default_rng(1).integers(0, 9, (2000, 2))
    compared, plain = [], np.argmin
    monkeypatch.setattr(vector_codes.np, "argmin", lambda x, axis: compared.append(len(x)) or plain(x, axis=axis))
    assert (vector_codes.assign(points, centres) == np.repeat([0, 1, 2, 3], 500)).all()
    assert sum(compared) <= 3 * vector_codes.LEAF  # leaves that hold two clusters


def codes_by_loop(rows):
    kept = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for *_, v in kept), default=0)
    side = max(1, -(-width // 16))
    whole = lambda v: [int(np.floor(256 * max(-65536.0, min(65536.0, x)))) for x in v] + [0] * (16 * side - len(v))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    points = np.array([whole(v) for *_, v in kept], np.int64).reshape(len(kept), 16, side)
    books = points[:64].copy().transpose(1, 0, 2)
    for _ in range(2):
        for p in range(16):
            code = nearest(points[:, p], books[p])
            books[p] = [points[code == e, p].sum(axis=0) // (code == e).sum() if (code == e).any() else books[p, e] for e in range(len(books[p]))]
    out = []
    for i, (vec, label, _) in enumerate(kept):
        code = [int(nearest(points[i:i + 1, p], books[p])[0]) for p in range(16)]
        out.append((vec, label, "".join(f"{c:02x}" for c in code), int(sum(((points[i, p] - books[p, c]) ** 2).sum() for p, c in enumerate(code)))))
    total = Counter()
    for _, label, _, error in out:
        total[label] += error
    sha = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    return sorted(((v, c, e, total[label], sha) for v, label, c, e in out), key=repr)


def vectors(kind):
    r = random.Random(kind)
    rows = [(i * 7 % 301, r.choice([1, 2, None]), [r.uniform(-1, 1) for _ in range(48)]) for i in range(301)]
    if kind == "odd":
        rows += [(5, 1, rows[0][2]), (5, 1, rows[0][2]), (6, 1, None), (7, 2, [None] + [1.0] * 47), (8, 2, [float("nan")] * 48), (9, 2, [float("-inf")] * 48), (None, 2, rows[3][2]), (400, None, [1e300, -1e300]), (-3, None, []), (401, 3, [0.5] * 33)]
    return rows[:9] + rows[301:] if kind == "few" else rows


@pytest.mark.parametrize("kind", ["even", "odd", "few"])
def test_codes_equal_a_plain_iteration(spark, kind):
    rows = vectors(kind)
    frame = spark.createDataFrame([(*x, "old", 1, 2.0) for x in rows], "vec_id long, label int, embedding array<double>, code string, error int, v double").repartition(5)
    assert sorted((tuple(x) for x in vector_codes.compress(frame).collect()), key=repr) == codes_by_loop(rows)
    assert vector_codes.compress(frame.where("false")).count() == 0
