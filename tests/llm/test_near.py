"""Near duplicates at thresholds other than op9's, next to all pairs."""
import random

import pytest

import corpus_pipeline
from spatialqa.llm import hamming
from test_broadcasts import broadcasts


def similar(a, b):
    x, y = (set(hamming.shingles(t.encode()).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_chunks_miss_no_more_at_a_lower_similarity():
    assert (hamming.chunks_for(85), hamming.chunks_for(80)) == (13, 23)


def test_stage_links_from_080_and_op9_from_085(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    rows, shares = [], []
    for i in range(60):
        text = [rng.choice(words) for _ in range(300)]
        other = [*text[:300 - (cut := 20 + i)], *(rng.choice(words) for _ in range(cut))]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
        shares.append(similar(rows[-2][1], rows[-1][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(0.8 <= s < 0.85 for s in shares) > 5 and min(shares) < 0.8
    for percent in (80, 85):
        linked = {r.doc_id for r in hamming.near_duplicates(docs, percent).collect() if not r.kept}
        assert linked == {2 * i + 1 for i, s in enumerate(shares) if s >= percent / 100}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {2 * i for i in range(60)} | {2 * i + 1 for i, s in enumerate(shares) if s < 0.8}


def linked_by_loop(rows, percent):
    sets = {i: set(hamming.shingles(t.encode()).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and (p := root(i)) != (q := root(j)):
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def families(seed):
    """Groups of near copies around texts that are less alike, and bridges between members only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, base = [], [word() for _ in range(200)]
    for family in range(8):
        start = list(base)
        for i in range(rng.randint(0, 60)):
            start[i] = word()
        for _ in range(9):
            text = list(start)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(200)] = word()
            rows.append(" ".join(text))
        for cut in range(0, 60, 12):  # steps from one family towards the next
            rows.append(" ".join([*start[:cut], *base[cut:]]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent, seed", [(80, 1), (85, 2), (80, 3)])
def test_families_and_bridges(spark, percent, seed):
    rows = families(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in hamming.near_duplicates(frame, percent).collect()} == linked_by_loop(rows, percent)


@pytest.mark.parametrize("percent", [80])
def test_documents_that_share_a_part_make_no_pairs(spark, percent, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common = [word() for _ in range(142)]
    rows = [(i, " ".join([*common, *(word() for _ in range(162))])) for i in range(1500)]
    assert 0.28 < similar(rows[0][1], rows[1][1]) < 0.32
    seen, plain = [], hamming.compared
    monkeypatch.setattr(hamming, "compared", lambda pairs, *a: seen.append(pairs.count()) or plain(pairs, *a))
    assert all(r.kept for r in hamming.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect())
    assert sum(seen) == 0  # keys are shared, but no pair is within the distance


@pytest.mark.parametrize("percent", [80, 85])
def test_texts_around_a_passage_drop_out_without_pairs(spark, percent, monkeypatch):
    """Alike within the signature distance, but what is left of each is its own; a few are linked."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common = [word() for _ in range(104)]
    texts = [[*common, *(word() for _ in range(30))] for _ in range(400)]
    texts += [[*text[:-2], word(), word()] for text in texts[:20]]
    rows = [(i, " ".join(text)) for i, text in enumerate(texts)]
    assert 0.6 < similar(rows[0][1], rows[1][1]) < 0.7
    seen, plain = [], hamming.met_centres
    monkeypatch.setattr(hamming, "met_centres", lambda *a: (pairs := plain(*a), seen.append(pairs.count()))[0])
    found = {r.doc_id: r.component_id for r in hamming.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert found == linked_by_loop(rows, percent) and len(set(found.values())) == 400
    assert seen == [0]


def test_many_near_copies_meet_once(spark, monkeypatch):
    """Two large groups that are alike but not linked: one pair of centres, not all pairs of members."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    one = [word() for _ in range(400)]
    two = [*(word() for _ in range(60)), *one[60:]]
    rows = []
    for i in range(300):
        text = list((one, two)[i % 2])
        text[rng.randrange(400)] = word()
        rows.append((i, " ".join(text)))
    seen, plain = [], hamming.compared
    monkeypatch.setattr(hamming, "compared", lambda pairs, *a: seen.append(pairs.count()) or plain(pairs, *a))
    found = {r.doc_id: r.component_id for r in hamming.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert found == linked_by_loop(rows, 85) and sum(seen) <= hamming.ROUNDS * 300


def test_an_id_with_several_texts_links_by_each(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    one, two, three = ([word() for _ in range(120)] for _ in range(3))
    edit = lambda t, at: " ".join([*t[:at], "edited", *t[at + 1:]])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (1, edit(one, 7)), (9, edit(two, 30)), (8, edit(two, 90)), (3, " ".join(three)), (4, edit(three, 50))]
    found = {(r.doc_id, r.component_id) for r in hamming.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert found == {(5, 1), (1, 1), (9, 1), (8, 1), (3, 3), (4, 3)}


def join_rows(node) -> int:
    """Rows that the joins of an executed plan have made."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return join_rows(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return join_rows(node.plan())
    below = sum(join_rows(node.children().apply(i)) for i in range(node.children().size()))
    return below + (node.metrics().apply("numOutputRows").value() if "Join" in name else 0)


def test_members_of_many_centres_do_not_meet_for_each_pair_of_them(spark):
    """60 centres of a crowd whose 1,770 pairs may all have linked members: a row for each member, key and pair would be 35,400 rows before any is compared."""
    rng, centres = random.Random(4), 60
    open_ = [(key, c + 1000 * m, c, c, 0.1 * m, 100, 100, 1000) for c in range(centres) for m in range(2) for key in range(5)]
    open_ = spark.createDataFrame(open_, "key long, rep long, part long, centre long, away double, lo long, hi long, most long")
    reps = [(c + 1000 * m, [rng.randrange(1 << 60) for _ in range(hamming.CHUNKS)]) for c in range(centres) for m in range(2)]
    # Members of the first two centres are alike but for one symbol of the first chunk, so they meet by the key without it.
    reps[3] = (reps[3][0], [reps[1][1][0] ^ 1, *reps[1][1][1:]])
    reps = spark.createDataFrame(reps, "rep long, sig array<long>")
    rest = spark.createDataFrame([(a, b, 0.3) for a in range(centres) for b in range(a + 1, centres)], "a long, b long, far double")
    found = hamming.met_members(open_, rest, reps, hamming.PERCENT, hamming.CHUNKS)
    assert [tuple(r) for r in found.collect()] == [(1000, 1001)]
    assert join_rows(found._jdf.queryExecution().executedPlan()) < 5000


def test_centres_meet_by_their_first_key_alone(spark, monkeypatch):
    """They share dozens of keys; a row for each of them would grow with the square of a crowd dozens of times over."""
    rows, seen, plain = families(1), [], hamming.met_centres

    def counted(*a):
        pairs = plain(*a)
        seen.append((len(pairs.collect()), join_rows(pairs._jdf.queryExecution().executedPlan())))
        return pairs

    monkeypatch.setattr(hamming, "met_centres", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in hamming.near_duplicates(frame, 80).collect()} == linked_by_loop(rows, 80)
    (pairs, made), = seen
    assert 0 < pairs <= made < 2 * pairs


def test_tables_that_grow_with_documents_are_not_broadcast(spark, monkeypatch):
    """Files are packed and a document has dozens of keys: the planner would send all keys, sets of minima and members through the driver."""
    plans, plain = [], hamming.materialize
    monkeypatch.setattr(hamming, "materialize", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df))[1])
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[:300 - i] + [f"x{i}"] * 3)) for i in range(40)]
    out = hamming.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(i, 0) for i in range(40)}
    sent = [b for plan in plans for b in broadcasts(plan)]
    assert [b for b in sent if "Generate" in b or "sig#" in b or "MapInArrow" in b] == []
    assert sum("SortMergeJoin" in plan for plan in plans) >= 8
