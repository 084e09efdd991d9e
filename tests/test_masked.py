"""Masks scored inside the region of interest and outside ignore regions, next to loops over pixels."""
import random

import pytest

from spatialqa.operators import evaluate as E, runs as M
from spatialqa.plans.evaluation import evaluate_masks

ROI, IGNORE = (5, 4, 140, 30), [(20, 10, 15, 9), (30, 15, 20, 40), (120, 0, 15, 12)]


def pixels(box):
    x, y, w, h = box
    return {(i, j) for i in range(x, x + w) for j in range(y, y + h)}


def fscore(a, b, tolerance=2):
    def edge(m):
        return {(i, j) for i, j in m if any((i + s, j + t) not in m for s in (-1, 0, 1) for t in (-1, 0, 1))}

    def share(p, q):
        return sum(any((i + s, j + t) in q for s in range(-tolerance, tolerance + 1) for t in range(-tolerance, tolerance + 1)) for i, j in p) / max(1, len(p))
    recall, precision = share(edge(a), edge(b)), share(edge(b), edge(a))
    return 2 * recall * precision / max(1e-12, recall + precision)


def test_masks_count_only_evaluated_pixels(spark):
    rng = random.Random(3)
    gt = [(0, 0, 4, 4), (22, 11, 5, 5), *((rng.randrange(130), rng.randrange(25), rng.randint(5, 60), rng.randint(4, 25)) for _ in range(10))]
    pred = [(x + rng.randint(0, 4), y + rng.randint(0, 3), w, h) for x, y, w, h in gt]
    open_ = pixels((ROI[0], ROI[1], ROI[2] - ROI[0], ROI[3] - ROI[1])) - set().union(*map(pixels, IGNORE))
    schema = "scene_id long, {} long, x long, y long, w long, h long"
    frame = lambda name, boxes: M.rect_runs(spark.createDataFrame([(0, i, *b) for i, b in enumerate(boxes)], schema.format(name)))
    gt_runs, pred_runs = frame("gt_id", gt), frame("pred_id", pred)
    roi = spark.createDataFrame([(0, *ROI)], "scene_id long, rx0 long, ry0 long, rx1 long, ry1 long")
    ignore = spark.createDataFrame([(0, *b) for b in IGNORE], "scene_id long, x long, y long, w long, h long")
    pairs = spark.createDataFrame([(0, i, i) for i in range(len(gt))], "scene_id long, gt_id long, pred_id long")
    quality, means = evaluate_masks(pairs, gt_runs, pred_runs, annotations=roi, ignore=ignore)
    rows = {r.gt_id: r for r in quality.collect()}
    assert len(rows) == len(gt)
    for i, row in rows.items():
        a, b = pixels(gt[i]) & open_, pixels(pred[i]) & open_
        assert row.iou == pytest.approx(len(a & b) / max(1, len(a | b))) and row.dice == pytest.approx(2 * len(a & b) / max(1, len(a) + len(b)))
        assert row.completeness == pytest.approx(len(a & b) / max(1, len(a))) and row.contamination == pytest.approx(len(b - a) / max(1, len(b)))
        assert row.boundary_fscore == pytest.approx(fscore(a, b))
    assert means.first().poor_masks == sum(r.iou < 0.5 for r in rows.values())
    direct = {r.gt_id: r.iou for r in E.mask_quality(pairs, gt_runs, pred_runs, roi, ignore).collect()}
    assert direct == {i: r.iou for i, r in rows.items()}
    edges = {r.gt_id: r.boundary_fscore for r in E.boundary_f(pairs, gt_runs, pred_runs, 2, roi, ignore).collect()}
    assert edges == pytest.approx({i: r.boundary_fscore for i, r in rows.items()})


def test_semantic_regions_count_only_evaluated_pixels(spark):
    roi = spark.createDataFrame([(0, *ROI)], "scene_id long, rx0 long, ry0 long, rx1 long, ry1 long")
    ignore = spark.createDataFrame([(0, *b) for b in IGNORE], "scene_id long, x long, y long, w long, h long")
    regions = spark.createDataFrame([(0, "r", "grass")], "scene_id long, gt_id string, category string")
    shape = "scene_id long, {} string, x long, y long, w long, h long"
    truth = M.rect_runs(spark.createDataFrame([(0, "r", 0, 0, 100, 40)], shape.format("gt_id")))
    masks = M.rect_runs(spark.createDataFrame([(0, "grass", 10, 2, 40, 30), (0, "grass", 30, 5, 100, 10)], shape.format("category")))
    row = E.mask_quality(*E.semantic_regions(regions, truth, masks, roi, ignore)).first()
    open_ = pixels((ROI[0], ROI[1], ROI[2] - ROI[0], ROI[3] - ROI[1])) - set().union(*map(pixels, IGNORE))
    a, b = pixels((0, 0, 100, 40)) & open_, (pixels((10, 2, 40, 30)) | pixels((30, 5, 100, 10))) & open_
    assert row.iou == pytest.approx(len(a & b) / len(a | b)) and row.completeness == pytest.approx(len(a & b) / len(a))
