"""Distributed operators against the sequential loops, on random data and on hot groups."""
import random

import pytest
import sequential as S
from pyspark.sql import functions as F

from spatialqa.operators import fusion as U
from spatialqa.operators.detections import assign_ids
from spatialqa.operators.evaluate import match_gt
from spatialqa.operators.layers import layer_order
from spatialqa.operators.nms import nms
from spatialqa.operators.ordered import _range_of, order_ranges, running, top_k
from spatialqa.operators.overlap import overlap_join
from spatialqa.operators.tiles import scan_plan


def boxes(n, seed, space, side, copies=0, scenes=1, categories=("a",)):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if copies and rows and r.random() < copies:
            old = r.choice(rows)
            rows.append((i, old[1], old[2], r.choice([old[3], 0.55, round(r.random(), 2)]), i, *old[5:]))
        else:
            rows.append((i, r.randrange(scenes), r.choice(categories), r.choice([0.5, 0.7, 0.9, round(r.random(), 2)]), i,
                         r.randrange(space), r.randrange(space), r.randrange(4, side), r.randrange(4, side)))
    return rows


SCHEMA = "det_id long, scene_id long, category string, confidence double, seq long, x long, y long, w long, h long"


@pytest.mark.parametrize("seed,space,side,width", [(1, 600, 120, 256), (2, 60, 40, 8), (3, 3000, 1500, 16)])
def test_nms_equals_loop(spark, seed, space, side, width):
    rows = boxes(700, seed, space, side, copies=0.3, scenes=2, categories=("a", "b"))
    got = {r.det_id for r in nms(spark.createDataFrame(rows, SCHEMA), 0.5, width=width).select("det_id").collect()}
    assert got == S.nms([(r[0], (r[1], r[2]), r[3], r[4], (r[5], r[6], r[5] + r[7], r[6] + r[8])) for r in rows], 0.5)


def test_overlap_join_with_giant_boxes_and_split_cells(spark):
    rows = boxes(300, 5, 2000, 300, copies=0.4) + [(1000, 0, "a", 0.9, 1000, 0, 0, 1_000_000, 1_000_000), (1001, 0, "a", 0.9, 1001, 500_000, 10, 400_000, 90)]
    df = spark.createDataFrame(rows, SCHEMA).select("det_id", "scene_id", *"xywh")
    pairs = overlap_join(df, df, ["scene_id"], F.col("det_id_a") < F.col("det_id_b"), hot=20)
    got = [(r.det_id_a, r.det_id_b) for r in pairs.collect()]
    box = lambda r: (r[5], r[6], r[5] + r[7], r[6] + r[8])
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and S.inter(box(a), box(b))}
    assert len(got) == len(set(got)) and set(got) == want


def detections(seed, n=350, space=500):
    r = random.Random(seed)
    windows = [(0, 0, 1000, 1000), (0, 0, 256, 256), (200, 0, 456, 256), (0, 200, 256, 456)]
    rows = []
    for i in range(n):
        if rows and i % 7 == 0:
            old = r.choice(rows)
            rows.append({**old, "id": i, "seq": i, "confidence": r.choice([0.55, old["confidence"]]), "parent": None})
            continue
        x, y = r.randrange(space), r.randrange(space)
        cut = i % 5 == 0
        edges = r.sample(["left", "top", "right", "bottom"], r.randrange(1, 3)) if cut else []
        parent = r.randrange(i) if i > 10 and i % 11 == 0 else None
        rows.append({"id": i, "seq": i, "key": (0, r.choice("ab")), "confidence": r.choice([0.5, 0.7, 0.9, 1.0, 0.995]), "box": (x, y, x + r.randrange(5, 90), y + r.randrange(5, 90)),
                     "window": r.choice(windows), "cut": cut, "edges": sorted(edges), "look": r.choice([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], []]), "parent": parent})
    return rows


FUSE_SCHEMA = ("det_id long, seq long, scene_id long, category string, confidence double, x long, y long, w long, h long, wx0 long, wy0 long, wx1 long, wy1 long, "
               "is_truncated boolean, truncated_edges array<string>, appearance array<double>, parent_id long")


def as_table(spark, rows):
    return spark.createDataFrame([(r["id"], r["seq"], r["key"][0], r["key"][1], r["confidence"], r["box"][0], r["box"][1], r["box"][2] - r["box"][0], r["box"][3] - r["box"][1],
                                   *r["window"], r["cut"], r["edges"], r["look"] or None, r["parent"]) for r in rows], FUSE_SCHEMA)


def check_fusion(spark, rows, tile_rows=U.TILE_ROWS):
    kept, lost, home = S.fuse(rows, U.RULES)
    entities, members = U.fuse(as_table(spark, rows), tile_rows=tile_rows)
    got = {(e.det_id, e.x, e.y, e.x + e.w, e.y + e.h, round(e.confidence, 9), e.is_truncated, tuple(e.truncated_edges), e.members) for e in entities.collect()}
    sizes = [sum(1 for h in home.values() if h == i) for i in range(len(kept))]
    want = {(k["id"], *k["box"], round(k["confidence"], 9), k["cut"], tuple(k["edges"]), sizes[i]) for i, k in enumerate(kept)}
    assert got == want
    rows_ = members.collect()
    assert {r.det_id: r.entity_id for r in rows_} == {i: kept[h]["id"] for i, h in home.items()}
    assert {(r.det_id, r.merged_into, r.reason) for r in rows_ if r.reason} == set(lost)


@pytest.mark.parametrize("seed", [11, 12])
def test_fusion_equals_loop(spark, seed):
    check_fusion(spark, detections(seed))


@pytest.mark.parametrize("seed, n, space, tile_rows", [(13, 260, 900, 40), (16, 300, 3000, 8), (17, 300, 500, 20), (18, 400, 6000, 2)])
def test_fusion_over_many_tiles(spark, seed, n, space, tile_rows, monkeypatch):
    rounds, plain = [], U._on_tiles
    monkeypatch.setattr(U, "_on_tiles", lambda rows, turn: rounds.append(turn) or plain(rows, turn))
    check_fusion(spark, detections(seed, n=n, space=space), tile_rows)
    assert len(rounds) > 1 or seed in (13, 17)


def test_one_crowded_scene_folds_over_its_tiles(spark):
    """Boxes in a chain, each touching the next ones: no tile holds the whole scene."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("det_id"), F.col("id").alias("seq"), F.lit(1).cast("long").alias("scene_id"), F.lit("a").alias("category"), (F.lit(0.3) + F.pmod(F.xxhash64("id"), F.lit(997)) / 2000).alias("confidence"),
                                 (F.pmod(F.col("id"), F.lit(200)) * 30).alias("x"), (F.floor(F.col("id") / 200) * 30).alias("y"), F.lit(40).alias("w"), F.lit(40).alias("h"), F.lit(0).alias("wx0"), F.lit(0).alias("wy0"), F.lit(9000).alias("wx1"), F.lit(9000).alias("wy1"),
                                 F.lit(False).alias("is_truncated"), F.array().cast("array<string>").alias("truncated_edges"))
    tiles = U._on_tiles(U._reaching(U._collapse(U._prepared(rows))[0], U._tile_sides(rows, 500)), 0)
    assert tiles.groupBy("tx", "ty").count().agg(F.max("count")).first()[0] < 1500
    entities, members = U.fuse(rows, tile_rows=500)
    whole, same = U.fuse(rows, tile_rows=n)
    assert entities.count() == whole.count() and members.count() == n
    assert members.exceptAll(same).count() == 0 and entities.exceptAll(whole).count() == 0


def test_exact_copies_collapse_in_fusion(spark):
    rows = detections(14, n=60)
    hot = {"key": (0, "hot"), "confidence": 0.625, "box": (10, 10, 60, 60), "window": (0, 0, 256, 256), "cut": False, "edges": [], "look": [1.0], "parent": None}
    rows += [{**hot, "id": 1000 + i, "seq": 1000 + i} for i in range(200)]
    check_fusion(spark, rows, 50)


@pytest.mark.parametrize("seed,edges", [(1, 25), (2, 60), (3, 5)])
def test_layer_order_equals_loop(spark, seed, edges):
    r = random.Random(seed)
    items = [(i, r.randrange(12)) for i in range(40)]
    links = [tuple(r.sample(range(40), 2)) for _ in range(edges)]
    if seed != 2:
        links = [(max(l), min(l)) if r.random() < 0.7 else l for l in links]
    df = spark.createDataFrame([(0, *i) for i in items] + [(1, *i) for i in items[:5]], "scene_id long, object_id long, z long")
    ed = spark.createDataFrame([(0, *l) for l in links], "scene_id long, front_id long, back_id long")
    out = layer_order(df, ed, ["z"], position=True).filter("scene_id = 0").orderBy("position").collect()
    assert [o.object_id for o in out] == S.layer_order(items, links)


def test_matching_equals_loop(spark):
    preds = boxes(250, 21, 300, 80, copies=0.4, categories=("a", "b"))
    truth = boxes(60, 22, 300, 80, categories=("a", "b"))
    p = spark.createDataFrame(preds, SCHEMA).withColumnRenamed("det_id", "pred_id")
    g = spark.createDataFrame(truth, SCHEMA).withColumnRenamed("det_id", "gt_id")
    found, outcome = match_gt(p, g, 0.3)
    box = lambda r: (r[5], r[6], r[5] + r[7], r[6] + r[8])
    want = S.match([(r[0], r[2], r[3], r[4], box(r)) for r in preds], [(r[0], r[2], box(r)) for r in truth], 0.3)
    hits = {r.pred_id: r.gt_id for r in found.collect()}
    assert hits == {k: v for k, v in want.items() if not isinstance(v, str)}
    assert {r.pred_id: r.outcome for r in outcome.collect()} == {k: v if isinstance(v, str) else "match" for k, v in want.items()}


def test_budget_equals_loop(spark):
    r = random.Random(4)
    rows = [(i, 0, r.choice(["global", "tile", "redetection", "gap_fill"])) for i in range(300)]
    out = scan_plan(spark.createDataFrame(rows, "seq long, scene_id long, source string"), max_calls=120, max_retry=40).orderBy("seq").collect()
    assert [o.status == "ok" for o in out] == S.budget([x[2] for x in rows], 120, 40)


def test_running_totals_in_blocks(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("seq"), (F.col("id") % 7).alias("v"))
    out = running(df, ["k"], "seq", {"s": ("sum", F.col("v")), "m": ("max", F.when(F.col("v") == 0, F.col("seq"))), "n": ("count", F.lit(1))}, exclusive=["m"], ends=order_ranges(df, "seq", 37)).orderBy("seq").collect()
    total, last = 0, None
    for i, row in enumerate(out):
        total += i % 7
        assert (row.s, row.m, row.n) == (total, last, i + 1)
        last = i if i % 7 == 0 else last


def test_running_totals_over_a_sparse_order(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * F.col("id") * 1_000_003).alias("seq"), F.lit(1).alias("v"))
    out = running(df, ["k"], "seq", {"n": ("sum", F.col("v"))}, ends=order_ranges(df, "seq", 50))
    assert df.groupBy(_range_of(F.col("seq"), order_ranges(df, "seq", 50))).count().agg(F.max("count")).first()[0] < 200
    assert [r.n for r in out.orderBy("seq").collect()] == list(range(1, 5001))


def test_places_in_the_lineage_are_unique(spark):
    rows = detections(15, n=60)
    hot = {"key": (0, "hot"), "confidence": 0.625, "box": (10, 10, 60, 60), "window": (0, 0, 256, 256), "cut": False, "edges": [], "look": [1.0], "parent": None}
    rows += [{**hot, "id": 1000 + i, "seq": 1000 + i, "confidence": c} for c, ids in ((0.625, range(50)), (0.5, range(50, 80))) for i in ids]
    entities, members = U.fuse(as_table(spark, rows))
    places = {}
    for m in members.collect():
        places.setdefault(m.entity_id, []).append(m.pos)
    sizes = {e.det_id: e.members for e in entities.collect()}
    assert all(sorted(p) == list(range(1, sizes[e] + 1)) for e, p in places.items()) and max(sizes.values()) >= 80


def test_copies_above_the_top_confidence_follow_the_loop(spark):
    row = {"key": (0, "hot"), "confidence": 0.995, "box": (10, 10, 60, 60), "window": (0, 0, 256, 256), "cut": False, "edges": [], "look": [1.0], "parent": None}
    check_fusion(spark, [{**row, "id": i, "seq": i} for i in range(5)])


def test_top_k_of_a_hot_key(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    assert sorted(r.v for r in top_k(df, ["k"], [-F.col("v")], 1200).filter("k = 0").collect()) == list(range(2400, 6000, 3))


def test_ids_fill_free_numbers(spark):
    new = spark.createDataFrame([(1, i, "stone lamp!") for i in range(6)], "scene_id long, seq long, category string")
    used = spark.createDataFrame([(1, "stone_lamp_001"), (1, "stone_lamp_003"), (1, "stone_lamp_004"), (1, "tree_002")], "scene_id long, object_id string")
    out = [r.object_id for r in assign_ids(new, used).orderBy("seq").collect()]
    assert out == [f"stone_lamp_{n:03d}" for n in (2, 5, 6, 7, 8, 9)]


def mixed_boxes(spark):
    """Small boxes in a lattice, a few middle ones, and one huge box, in one scene."""
    import random
    r = random.Random(11)
    rows = [(1, "c", i, 0.5 + r.random() / 2, 40 * (i % 60), 40 * (i // 60), r.randint(10, 50), r.randint(10, 50)) for i in range(1500)]
    rows += [(1, "c", 2000 + i, r.random(), r.randint(0, 2000), r.randint(0, 900), 300, 400) for i in range(12)]
    rows += [(1, "c", 3000, 0.01, 0, 0, 10 ** 6, 10 ** 6)]
    return rows, spark.createDataFrame(rows, "scene_id long, category string, det_id long, confidence double, x long, y long, w long, h long").withColumn("seq", F.col("det_id"))


def test_one_huge_box_adds_few_candidates(spark):
    from spatialqa.operators.overlap import _meeting, grid_for, on_cells
    rows, df = mixed_boxes(spark)

    def candidates(frame):
        grid = grid_for([frame])
        key = ["scene_id", "_lv", "_cx", "_cy", "_kind"]
        a, b = _meeting(on_cells(frame, *grid), 2).groupBy(*key).count(), _meeting(on_cells(frame, *grid), 1).groupBy(*key).agg(F.count("*").alias("n"))
        return a.join(b, key).agg(F.sum(F.col("count") * F.col("n"))).first()[0]

    assert candidates(df) - candidates(df.where("det_id <> 3000")) <= 6 * len(rows)


def test_nms_of_mixed_sizes_equals_the_loop(spark):
    from spatialqa.operators.nms import nms
    rows, df = mixed_boxes(spark)

    def share(p, q):
        w, h = min(p[4] + p[6], q[4] + q[6]) - max(p[4], q[4]), min(p[5] + p[7], q[5] + q[7]) - max(p[5], q[5])
        both = max(0, w) * max(0, h)
        return both / (p[6] * p[7] + q[6] * q[7] - both)

    kept = []
    for row in sorted(rows, key=lambda row: (-row[3], row[2])):
        if all(share(row, k) <= 0.1 for k in kept):
            kept.append(row)
    for width in (256, 8):
        assert {r.det_id for r in nms(df, 0.1, width=width).collect()} == {k[2] for k in kept}


def test_rounds_leave_only_what_the_result_reads(spark):
    import os
    from spatialqa.operators.runs import connected
    from spatialqa.session import discard, materialize, scratch_folder
    tables = lambda: set(os.listdir(scratch_folder(spark).removeprefix("file:")))
    before = tables()
    chain = spark.range(40).selectExpr("id")
    labels = connected(chain, spark.range(39).selectExpr("id as a", "id + 1 as b"))
    assert len(tables() - before) == 1 and {r.label for r in labels.collect()} == {0}
    kept = materialize(chain)
    discard(chain, chain.where("id > 1"))  # frames without files of their own
    assert kept.count() == 40
    discard(kept)
    assert len(tables() - before) == 1


def mask_rows(seed, n=40, space=60):
    """Masks of a few rectangles each, some of them chained, some alone, one without pixels."""
    r = random.Random(seed)
    objects, runs = [], []
    for i in range(n):
        x, y = r.randrange(space), r.randrange(space // 3)
        w, h = r.randrange(6, 20), r.randrange(3, 8)
        objects.append((0, "ab"[i % 5 == 0], i, i // 2, r.choice([.5, .7, .9]), x, y, w, h, i % 7 == 0))
        if i != 3:
            runs += [(i, yy, x + r.randrange(3), x + w) for yy in range(y, y + h)] + [(i, y + 1, x + 2, x + w - 1)]
    return objects, runs


@pytest.mark.parametrize("seed, space", [(1, 60), (2, 25), (3, 400)])
def test_mask_fusion_equals_loop(spark, seed, space):
    objects, runs = mask_rows(seed, space=space)
    pixels = {}
    for i, y, x0, x1 in runs:
        pixels.setdefault(i, set()).update((y, x) for x in range(x0, x1))
    kept, lost = [], set()
    for _, cat, i, seq, conf, x, y, w, h, again in sorted(objects, key=lambda o: (-o[4], o[3], o[2])):
        box, px = [x, y, x + w, y + h], set(pixels.get(i, ()))
        hit = next((k for k in kept if px and k["px"] and k["cat"] == cat and min(box[2], k["box"][2]) > max(box[0], k["box"][0]) and min(box[3], k["box"][3]) > max(box[1], k["box"][1])
                    and len(px & k["px"]) / len(px | k["px"]) >= .5), None)
        if hit is None:
            kept.append({"id": i, "cat": cat, "box": box, "px": px, "n": 1, "again": again})
            continue
        b = hit["box"]
        hit["box"], hit["px"], hit["n"], hit["again"] = [min(b[0], x), min(b[1], y), max(b[2], x + w), max(b[3], y + h)], hit["px"] | px, hit["n"] + 1, hit["again"] or again
        lost.add((i, hit["id"], hit["n"]))
    frame = spark.createDataFrame(objects, "scene_id long, category string, det_id long, seq long, confidence double, x long, y long, w long, h long, redetected boolean")
    got, gone, grown = U.fuse_masks(frame, spark.createDataFrame(runs, "det_id long, y long, x0 long, x1 long"))
    assert {(g.det_id, g.x, g.y, g.x + g.w, g.y + g.h, g.merged, g.redetected) for g in got.collect()} == {(k["id"], *k["box"], k["n"] > 1, k["again"]) for k in kept}
    assert {(g.det_id, g.parent_id, g.pos) for g in gone.collect()} == lost
    at = {}
    for g in grown.collect():
        new = {(g.y, x) for x in range(g.x0, g.x1)}
        assert not new & at.setdefault(g.det_id, set())
        at[g.det_id] |= new
    assert at == {k["id"]: k["px"] for k in kept if k["px"]}
    assert all(f.count() == 0 for f in U.fuse_masks(frame.where("false"), spark.createDataFrame([], "det_id long, y long, x0 long, x1 long")))


def test_a_stack_of_masks_makes_no_pairs(spark):
    objects = spark.range(300).select(F.lit(0).alias("scene_id"), F.lit("a").alias("category"), F.col("id").alias("det_id"))
    rows = spark.range(300).select(F.col("id").alias("det_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("y"), F.lit(0).alias("x0"), (F.col("id") + 1).alias("x1"))
    assert U.mask_links(objects, rows.select("det_id", F.col("y").cast("long"), F.col("x0").cast("long"), "x1")).count() < 300


def test_boxes_are_shuffled_once_to_meet(spark):
    """The few crowded cells are looked up, without a shuffle of every box to find them."""
    from spatialqa.operators.overlap import Grid
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if both tables were large
    try:
        _, df = mixed_boxes(spark)
        plan = overlap_join(df, df, ["scene_id"], F.col("det_id_a") < F.col("det_id_b"), grid=Grid(64, 2))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    outer = [line for line in plan.splitlines() if "LeftOuter" in line]
    assert len(outer) == 2 and all("BroadcastHashJoin" in line for line in outer)
