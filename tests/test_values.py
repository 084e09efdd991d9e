"""Small inputs with known results."""
import math

import pytest
from pyspark.sql import functions as F

from spatialqa.functions import quality as Q, taxonomy
from spatialqa.functions.boxes import Box, appearance_similarity, restore_box, truncated_edges
from spatialqa.operators import candidates as C, evaluate as E, fusion as U, ownership as O, pixels as P, reports as R, runs as M
from spatialqa.operators.detections import extend_layers, layer_plan, to_objects
from spatialqa.operators.gate import first_run_status, gate_status, regression_gate
from spatialqa.operators.planning import prompt_boxes, prompt_points
from spatialqa.operators.tiles import local_windows, scan_plan, tiles
from spatialqa.plans.detection import DetectionConfig, run_detection, unfinished_scenes


def square(spark, rows, extra=""):
    """rows: (scene_id, id, x, y, w, h) -> runs with mask_id."""
    return M.rect_runs(spark.createDataFrame(rows, "scene_id long, mask_id long, x long, y long, w long, h long"))


def test_taxonomy(spark):
    rows = [("stone lamp", "stone_lantern", "prop"), ("garden lantern", "stone_lantern", "prop"), ("石灯", "stone_lantern", "prop"), ("寺庙石灯", "stone_lantern", "prop"),
            ("war banner", "flag", "prop"), ("阵旗", "formation_flag", "cultivation_prop"), ("stone_pillar", "stone_pillar", "structure"),
            ("spirit stone.", "spirit_stone", "cultivation_prop"), ("Fog", "fog", "fx_environment"), ("platform", "platform", "terrain"), ("rock", "rock", "rock"), ("zzz", None, "other")]
    df = spark.createDataFrame([(r[0],) for r in rows], "label string")
    got = df.select("label", taxonomy.normalize_category(F.col("label")).alias("c")).withColumn("g", taxonomy.category_group(F.coalesce("c", F.lit("zzz")))).collect()
    assert [(r.label, r.c, r.g) for r in got] == rows
    tables = taxonomy.dims(spark)
    assert tables["dim_category"].count() == tables["dim_category"].select("category").distinct().count()
    assert tables["dim_alias"].filter("label = '石灯'").first().category == "stone_lantern"


def test_labels(spark):
    df = spark.createDataFrame([("a red stone lantern.",), ("flag and barrel",), ("the lantern",), ("gold",)], "t string")
    cats, phrases = ["stone_lantern", "flag", "barrel"], ["old stone lantern", "cloth flag", "wooden barrel"]
    got = [r[0] for r in df.select(taxonomy.match_prompt(F.col("t"), cats, phrases)).collect()]
    assert got == ["stone_lantern", "", "stone_lantern", ""]


def test_restored_boxes(spark):
    cases = [([.1, .2, .5, .8], (100, 200, 100, 50), True, (110, 210, 40, 30)), ([-1., 1.2, 20.2, 30.], (100, 200, 20, 30), False, (100, 201, 20, 29)),
             ([math.nan, 0., 1., 1.], (0, 0, 10, 10), False, None), ([0., 0., 1.5, 1.], (0, 0, 10, 10), True, None), ([5., 5., 5., 9.], (0, 0, 10, 10), False, None)]
    df = spark.createDataFrame([(c[0], *c[1], c[2]) for c in cases], "b array<double>, x long, y long, w long, h long, n boolean")
    got = [r[0] for r in df.select(restore_box(F.col("b"), Box.of(), F.col("n"))).collect()]
    assert [tuple(g) if g else None for g in got] == [c[3] for c in cases]


def test_tiles_cover_the_scene(spark):
    out = tiles(spark.createDataFrame([(1, 155, 103), (2, 12, 9)], "scene_id long, width long, height long"), 64, 0.25)
    seen = {(x, y) for r in out.filter("scene_id = 1").collect() for x in range(r.x, r.x + r.w) for y in range(r.y, r.y + r.h)}
    assert len(seen) == 155 * 103
    assert [(r.x, r.y, r.w, r.h, r.tile_id) for r in out.filter("scene_id = 2").collect()] == [(0, 0, 12, 9, "tile_00_00")]
    with pytest.raises(ValueError):
        tiles(out, 64, 1.0)


def detection(i, box, score, window=(0, 0, 64, 64), edges=()):
    return (i, i, 0, "tree", score, box[0], box[1], box[2] - box[0], box[3] - box[1], *window, bool(edges), list(edges), [1.0], None)


FUSE = ("det_id long, seq long, scene_id long, category string, confidence double, x long, y long, w long, h long, wx0 long, wy0 long, wx1 long, wy1 long, "
        "is_truncated boolean, truncated_edges array<string>, appearance array<double>, parent_id long")


def test_fusion_keeps_neighbours_and_small_objects(spark):
    rows = [detection(1, (30, 10, 50, 40), .31), detection(2, (31, 10, 51, 40), .42, (20, 0, 84, 64)), detection(3, (52, 10, 72, 40), .7), detection(4, (35, 15, 39, 19), .7)]
    entities, members = U.fuse(spark.createDataFrame(rows, FUSE))
    assert entities.count() == 3
    both = entities.filter("members = 2").first()
    assert both.det_id == 2 and both.confidence > .42
    assert members.filter("reason is not null").first().reason == "cross_tile_duplicate"


def test_fusion_counts_a_window_once(spark):
    rows = [detection(1, (30, 10, 50, 40), .31), detection(2, (30, 10, 50, 40), .42)]
    assert U.fuse(spark.createDataFrame(rows, FUSE))[0].first().confidence == .42


def test_fusion_joins_fragments(spark):
    rows = [detection(1, (40, 10, 64, 40), .7, (0, 0, 64, 64), ["right"]), detection(2, (48, 10, 110, 40), .7, (48, 0, 112, 64), ["left"])]
    out = U.fuse(spark.createDataFrame(rows, FUSE), U.FusionRules(iou=.2, overlap=.6))[0].collect()
    assert [(o.x, o.y, o.w, o.h, o.is_truncated) for o in out] == [(40, 10, 70, 30, True)]


def test_mask_fusion(spark):
    objects = spark.createDataFrame([(0, "tree", 1, 1, .8, 5, 5, 15, 15), (0, "tree", 2, 2, .7, 7, 5, 15, 15)], "scene_id long, category string, det_id long, seq long, confidence double, x long, y long, w long, h long")
    kept, lost, grown = U.fuse_masks(objects, M.rect_runs(objects.select("scene_id", "det_id", *"xywh")))
    assert kept.first().w == 17 and lost.first().reason == "mask_duplicate" and lost.first().parent_id == 1
    assert M.pixel_count(grown, ["det_id"]).first().pixels == 17 * 15


def test_scan_depth(spark):
    scene = spark.createDataFrame([(0, 10, 10)], "scene_id long, width long, height long")
    scans = spark.createDataFrame([(0, 0, 0, 5, 10, "ok"), (0, 5, 0, 5, 10, "failed")], "scene_id long, x long, y long, w long, h long, status string")
    row = R.scan_depth(scene, scans, scans, scans.limit(0)).first()
    assert (row.unscanned_pixels, row.scanned_without_candidates, row.max_tile_overlap) == (50, 50, 1)


def test_ground_truth_scores(spark):
    gt = spark.createDataFrame([(0, "a", "t", 0, 0, 10, 10), (0, "b", "t", 20, 0, 20, 10), (0, "c", "t", 60, 0, 10, 10)], "scene_id long, gt_id string, category string, x long, y long, w long, h long")
    boxes = [(0, 0, 10, 10), (0, 0, 10, 10), (20, 0, 9, 10), (31, 0, 9, 10), (80, 0, 10, 10)]
    pred = spark.createDataFrame([(0, i, "t", 1 - i / 10, i, *b) for i, b in enumerate(boxes)], "scene_id long, pred_id long, category string, confidence double, seq long, x long, y long, w long, h long")
    _, outcome = E.match_gt(pred, gt)
    row = E.detection_scores(gt, outcome, E.fragments(pred, gt)).first()
    assert (row.recall, row.precision, row.duplicate_rate, row.fragmentation_rate) == (1 / 3, 1 / 5, 1 / 5, 1 / 3)
    none = E.detection_scores(gt.limit(0), outcome.limit(0), E.fragments(pred, gt).limit(0), corpus=True).first()
    assert none.recall is None and none.precision is None


def test_mask_metrics(spark):
    full = square(spark, [(0, 1, 2, 2, 6, 6)]).withColumnRenamed("mask_id", "gt_id")
    half = square(spark, [(0, 1, 2, 5, 6, 3)]).withColumnRenamed("mask_id", "pred_id")
    pairs = spark.createDataFrame([(0, 1, 1)], "scene_id long, gt_id long, pred_id long")
    same = full.withColumnRenamed("gt_id", "pred_id")
    assert E.mask_quality(pairs, full, same).first().iou == 1 and E.boundary_f(pairs, full, same).first().boundary_fscore == 1
    part = E.mask_quality(pairs, full, half).first()
    assert (part.completeness, part.contamination) == (.5, 0)
    assert E.mask_quality(pairs, full, half.limit(0)).first().iou == 0


def test_gate(spark):
    base = dict(scene_id=1, recall=.8, precision=.9, duplicate_rate=.1, runtime=100., boundary_fscore=.8, annotation_digest="a", image_digest="i", inventory_kind="k", config="c",
                truncated=False, mock=False, annotation_status="reviewed", budget_exhausted=False, resource_failures=0)
    schema = ("scene_id long, recall double, precision double, duplicate_rate double, runtime double, boundary_fscore double, annotation_digest string, image_digest string, inventory_kind string, config string, "
              "truncated boolean, mock boolean, annotation_status string, budget_exhausted boolean, resource_failures int")
    frame = lambda **kw: spark.createDataFrame([tuple({**base, **kw}.values())], schema)
    checks = {r.check: r.status for r in regression_gate(frame(), frame(recall=.7, runtime=70.)).collect()}
    assert checks["recall"] == "FAIL" and checks["runtime"] == "PASS"
    assert gate_status(regression_gate(frame(), frame(truncated=None))).first().status == "WARN"
    assert gate_status(regression_gate(frame(), frame())).first().status == "PASS"
    assert gate_status(regression_gate(frame(), frame(image_digest="j"))).first().status == "FAIL"
    assert first_run_status(frame(resource_failures=2)).first().status == "FAIL"


def test_budget(spark):
    rows = [(i, 0, s) for i, s in enumerate(["global", "redetection", "redetection", "tile", "tile"])]
    out = scan_plan(spark.createDataFrame(rows, "seq long, scene_id long, source string"), max_calls=3, max_retry=1).orderBy("seq").collect()
    assert [o.status == "ok" for o in out] == [True, True, False, True, False]


def owner_scene(spark, rows, edges=()):
    schema = "scene_id long, object_id long, category string, element_type string, ownership_priority int, x long, y long, w long, h long, confidence double, seg_score double, status string, uncertain boolean"
    objects = spark.createDataFrame([(0, i, c, t, p, *b, .7, 0., "pass", False) for i, c, t, p, b in rows], schema)
    runs = M.rect_runs(objects.select("scene_id", "object_id", *"xywh"))
    eligible = M.rect_runs(spark.createDataFrame([(0, 0, 3, 50, 37)], "scene_id long, x long, y long, w long, h long"))
    ed = spark.createDataFrame([(0, *e) for e in edges], "scene_id long, front_id long, back_id long")
    return objects, eligible, *O.assign_owners(objects, runs, eligible, ed)


def test_ownership(spark):
    rows = [(1, "grass", "terrain", 10, (0, 0, 30, 40)), (2, "grass_ground", "terrain", 10, (20, 0, 30, 40)), (3, "tree", "instance", 30, (10, 12, 12, 20))]
    objects, eligible, owned, stacked, painted = owner_scene(spark, rows)
    summary = O.ownership_summary(owned, eligible).first()
    assert summary.unassigned_pixels == 0 and summary.overlap_pixels == 240
    layers = O.terrain_layers(painted, owned, stacked).collect()
    assert len(layers) == 1 and layers[0].owner == "terrain:grass" and layers[0].visible_pixels == 50 * 37 - 240
    assert [(c.winner, c.loser, c.pixels) for c in O.conflicts(stacked, painted).collect()] == [("object:3", "terrain:grass", 240)]
    assert O.owners(painted, owned).filter("owner = 'object:3'").first().visible_pixels == 240


def test_occlusion_edge(spark):
    box = (10, 12, 12, 20)
    _, _, _, stacked, painted = owner_scene(spark, [(1, "tree", "instance", 30, box), (2, "pillar", "instance", 60, box)], [(1, 2)])
    seen = {r.object_id: r.visible_pixels for r in O.record_pixels(stacked, painted).collect()}
    assert seen == {1: 240, 2: 0}


def test_residual(spark):
    _, eligible, owned, _, _ = owner_scene(spark, [(1, "tree", "instance", 30, (0, 3, 5, 5))])
    assert O.ownership_summary(owned, eligible).first().unassigned_ratio > .9
    assert O.ownership_summary(owned, eligible).first().visible_coverage_ratio == 1 and O.ownership_summary(owned, eligible, keep_residual=False).first().visible_coverage_ratio < .1
    assert M.pixel_count(O.residual_runs(owned, eligible), ["scene_id"]).first().pixels == 50 * 37 - 25


def test_coverage(spark):
    runs = square(spark, [(0, 1, 0, 0, 2, 5), (0, 2, 1, 0, 3, 5)])
    objects = spark.createDataFrame([(0, 1, "pass", True), (0, 2, "manual_review", True)], "scene_id long, mask_id long, status string, usable boolean")
    row = M.coverage(objects, runs, square(spark, [(0, 9, 0, 0, 10, 5)])).first()
    assert (row.accepted_coverage, row.candidate_coverage, row.eligible_pixels) == (.2, .4, 50)


def test_pixels(spark):
    scene = spark.createDataFrame([(0, 10, 10)], "scene_id long, width long, height long")
    frame = spark.range(100).select(F.lit(0).alias("scene_id"), (F.col("id") % 10).alias("x"), F.expr("id div 10").alias("y"), *(F.lit(v).alias(c) for c, v in zip("rgba", (10, 20, 30, 255))))
    gone = frame.withColumn("a", F.when((F.col("x") < 4) & (F.col("y") < 5), 0).otherwise(255))
    row = P.alpha_diff(frame, gone, scene).first()
    assert (row.missing_pixels, row.extra_pixels) == (20, 0)
    hidden = gone.withColumn("r", F.when(F.col("a") == 0, 200).otherwise(F.col("r")))
    assert P.alpha_diff(gone, hidden, scene).first().mean_pixel_difference == 0
    assert P.similarity(frame, frame, scene).first().similarity == 1


def test_candidates(spark):
    rows = [(1, 1, "segmentation", "ACCEPT", .8, 0), (1, 2, "generation", "ACCEPT", .96, 0), (1, 3, "inpaint", "ACCEPT", .85, 1), (1, 4, "generation", "REJECT", 1.0, 1),
            (2, 1, "segmentation", "RETRY", .4, 0), (2, 2, "generation", "REJECT", .9, 0)]
    out = {r.instance_id: r for r in C.select_candidates(spark.createDataFrame(rows, "instance_id long, seq long, type string, status string, overall double, attempt int")).collect()}
    assert out[1].qa_score == .96 and not out[1].needs_manual_review
    assert out[2].final_source == "segmentation" and out[2].needs_manual_review


def test_windows_and_prompts(spark):
    schema = "scene_id long, object_id long, x long, y long, w long, h long, element_type string, width long, height long"
    one = spark.createDataFrame([(0, 1, 200, 200, 20, 30, "instance", 1000, 1000), (0, 2, 10, 10, 900, 700, "instance", 1000, 1000)], schema)
    out = local_windows(one.filter("object_id = 1"), 512).first()
    assert (out.wx, out.wy, out.wx + out.ww, out.wy + out.wh) == (170, 170, 250, 260)
    big = local_windows(one.filter("object_id = 2"), 256).collect()
    seen = {(x, y) for r in big for x in range(r.wx, r.wx + r.ww, 5) for y in range(r.wy, r.wy + r.wh, 5) if r.ww <= 256 and r.wh <= 256}
    assert all((x, y) in seen or any(r.wx <= x < r.wx + r.ww and r.wy <= y < r.wy + r.wh for r in big) for x in range(10, 910, 50) for y in range(10, 710, 50))
    flags = spark.createDataFrame([(0, 1, 100, 80, 12, 24, "instance", 500, 500), (0, 2, 120, 80, 6, 20, "instance", 500, 500)], schema)
    window = spark.createDataFrame([(0, 1, 90, 60, 50, 60, 4)], "scene_id long, object_id long, wx long, wy long, ww long, wh long, scale int")
    box = prompt_boxes(flags, window).first()
    assert (box.bx0, box.by0, box.bx1, box.by1) == (40, 80, 88, 176)
    points = {(p.px / 4 + 90, p.py / 4 + 60, p.positive) for p in prompt_points(flags, window).collect()}
    assert (123.0, 90.0, False) in points and (106.0, 92.0, True) in points and len(points) == 6


def test_holes_and_components(spark):
    ring = M.run_difference(square(spark, [(0, 1, 2, 2, 7, 7)]), square(spark, [(0, 1, 4, 4, 2, 2)]).drop("mask_id"))
    ring = ring.unionByName(square(spark, [(0, 1, 12, 2, 1, 1)]))
    frame = spark.createDataFrame([(0, 1, 0, 0, 20, 12)], "scene_id long, mask_id long, x long, y long, w long, h long")
    assert sorted(r.pixels for r in M.mask_components(ring).collect()) == [1, 45]
    assert M.component_summary(M.mask_components(ring)).first().small_regions == 1
    assert [r.pixels for r in M.enclosed_holes(ring, frame).collect()] == [4]


def test_layers_and_records(spark):
    cats = spark.createDataFrame([(1, "fog", 0), (1, "tree", 1), (1, "qqq", 2), (1, "rock", 3)], "scene_id long, category string, seq long")
    plan = layer_plan(cats)
    assert [(r.layer, r.categories) for r in plan.orderBy("layer_order").collect()] == [("vegetation", ["tree"]), ("rock", ["rock"]), ("fx_environment", ["fog"]), ("other", ["qqq"])]
    more = extend_layers(plan, spark.createDataFrame([(1, "bush", 1), (1, "barrel", 2)], "scene_id long, category string, seq long"))
    assert [(r.layer, r.categories) for r in more.orderBy("layer_order").collect()][0] == ("vegetation", ["tree", "bush"]) and more.filter("layer = 'prop'").count() == 1
    row = to_objects(spark.createDataFrame([([("a", 1), ("b", 2)],)], "observations array<struct<id:string,n:int>>")).first()
    assert row.merged and row.source_candidates == ["a", "b"]


def test_detection_plan_end_to_end(spark):
    schema = ("scene_id long, det_id long, seq long, source string, label string, confidence double, bbox array<double>, bbox_format string, coordinate_space string, "
              "wx0 long, wy0 long, wx1 long, wy1 long, width long, height long, appearance array<double>, parent_id long")
    raw = [(0, 1, 1, "global", "stone lamp", .7, [25., 20., 32., 32.], None, None, 0, 0, 100, 100, 200, 100, [1.0], None),
           (0, 2, 2, "tile", "石灯", .6, [5., 20., 12., 32.], None, None, 20, 0, 120, 100, 200, 100, [1.0], None),
           (0, 3, 3, "tile", "tree", .9, [80., 10., 100., 60.], None, None, 0, 0, 100, 100, 200, 100, [1.0], None),
           (0, 4, 4, "tile", "nonsense", .9, [1., 1., 9., 9.], None, None, 0, 0, 100, 100, 200, 100, [1.0], None),
           (0, 5, 5, "tile", "tree", 1.4, [1., 1., 9., 9.], None, None, 0, 0, 100, 100, 200, 100, [1.0], None)]
    child = [(0, 6, 6, "redetection", "tree", .8, [20., 10., 50., 60.], None, None, 60, 0, 200, 100, 200, 100, [1.0], 3)]
    out = run_detection(spark.createDataFrame(raw, schema), ["tree"], F.lit(20000), spark.createDataFrame(child, schema), DetectionConfig())
    assert {r.reason for r in out["invalid"].collect()} == {"category_unknown", "invalid_confidence"}
    assert out["redetections"].first().status == "recovered"
    kept = {r.category: r for r in out["routed"].filter("is_kept").collect()}
    assert kept["stone_lantern"].members == 2 and kept["tree"].members == 2 and not kept["tree"].is_truncated


def test_parents_are_observed_again_by_confidence(spark):
    schema = ("scene_id long, det_id long, seq long, source string, label string, confidence double, bbox array<double>, bbox_format string, coordinate_space string, "
              "wx0 long, wy0 long, wx1 long, wy1 long, width long, height long, appearance array<double>, parent_id long")
    row = lambda i, score, parent: (0, i, i, "tile", "tree", score, [0., 20., 40., 60.], None, None, 200 * (i % 1000), 0, 200 * (i % 1000) + 100, 100, 40000, 100, [1.0], parent)
    scores = {i: .5 + (i * 37 % 151) / 400 for i in range(1, 151)}
    raw = spark.createDataFrame([row(i, s, None) for i, s in scores.items()], schema)
    out = run_detection(raw, ["tree"], F.lit(4_000_000), spark.createDataFrame([row(1001, .8, 1)], schema))
    left = {r.det_id for r in out["redetections"].collect() if r.status == "budget_exhausted"}
    assert left == set(sorted(scores, key=scores.get)[:50])


def test_unfinished_scenes(spark):
    rows = [(1, 1, .5, 3), (2, 1, .9, 3), (3, 1, .1, 0), (3, 2, .1, 0)]
    df = spark.createDataFrame(rows, "scene_id long, round long, coverage double, new_accepted long")
    assert [r.scene_id for r in unfinished_scenes(df).collect()] == [1]


def test_empty_category_list_means_the_annotated_ones(spark):
    from spatialqa.operators.evaluate import select_predictions
    preds = spark.createDataFrame([(1, 1, "tree", 0, 0, 4, 4), (1, 2, "rock", 0, 0, 4, 4), (2, 3, "rock", 0, 0, 4, 4)], "scene_id long, pred_id long, category string, x long, y long, w long, h long")
    notes = spark.createDataFrame([(1, 0, 0, 9, 9, []), (2, 0, 0, 9, 9, ["tree"])], "scene_id long, rx0 long, ry0 long, rx1 long, ry1 long, categories array<string>")
    gt = spark.createDataFrame([(1, "tree"), (2, "rock")], "scene_id long, category string")
    none = spark.createDataFrame([], "scene_id long, x long, y long, w long, h long")
    ids = lambda **more: {r.pred_id for r in select_predictions(preds, notes, none, **more)[0].collect()}
    assert ids() == {1, 2} and ids(gt=gt) == {1}


def test_a_candidates_scores_are_read_once(spark):
    """Each use of the overall score or the reasons once read the map anew, hundreds of times a row."""
    keys = [*Q.WEIGHTS, *Q.EXTRA_SCORES]
    good = {k: 0.9 for k in keys} | {"background_leak": 0.05}
    cases = [(good, "ACCEPT", "ACCEPT", 0), (good | {"color": 0.7}, "ACCEPT", "RETRY", 1), (good | {"shape": 0.3}, "ACCEPT", "REJECT", 1), (good | {"scale": 1.5}, "ACCEPT", "REJECT", 1),
             (good | {"scale": float("nan")}, "ACCEPT", "REJECT", 1), (good | {"scale": None}, "ACCEPT", "RETRY", 1), (good | {"background_leak": 0.2}, "ACCEPT", "RETRY", 1), (good, "REJECT", "REJECT", 0)]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i long, scores map<string,double>, verdict string")
    out = rows.select("i", Q.score_candidate(F.col("scores"), F.col("verdict"), F.lit(None).cast("array<string>")).alias("q"))
    assert [(r.q.status, len(r.q.reasons)) for r in out.orderBy("i").collect()] == [c[2:] for c in cases]
    assert out._jdf.queryExecution().analyzed().toString().count("try_element_at") <= len(keys)
