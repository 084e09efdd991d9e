"""Manifests, annotations, sinks, the round stream and the scorer."""
import json

import pytest
from pyspark.sql import functions as F, types as T

from oracle import compare, duck
from spatialqa.functions.boxes import portable, portable_strict
from spatialqa.operators.planning import pending, request_key
from spatialqa.registry import ORACLES, QUERIES
from spatialqa.sources import manifest as A
from spatialqa.streaming.scorer import run_scorer, scorer_results

SMALL = "/root/testdata/sf0.001"


def manifest(version="1.1"):
    obj = {"id": "a", "category": "tree", "group": "vegetation", "confidence": .9, "bbox": {"x": 1, "y": 1, "w": 5, "h": 5}, "crop_bbox": {"x": -2, "y": 0, "w": 9, "h": 9},
           "status": "pass", "qa": {"status": "pass"}, "asset_path": "a.png", "mask_path": "m.png"}
    return {"schema_version": version, "mock": False, "scene": {"width": 10, "height": 10, "projection": "unknown"}, "objects": [obj, {**obj, "id": "b", "asset_path": None}], "environment_effects": []}


def read(spark, tmp_path, doc, **kw):
    folder = tmp_path / "courtyard"
    folder.mkdir(exist_ok=True)
    (folder / "scene.json").write_text(json.dumps(doc, indent=2))
    return A.read_manifests(spark, str(folder / "scene.json"), **kw)


def test_manifest_upgrade(spark, tmp_path):
    docs = read(spark, tmp_path, manifest())
    out = A.upgrade_manifest(docs).first()
    first, second = out.objects
    assert out.schema_version == "1.2" and out.scene_id == "courtyard" and out.pipeline_status == "completed"
    assert first.geometry.full_asset_bbox.x == -2 and first.geometry.visible_bbox.x == 1 and first.base_asset_status == "ready"
    assert second.base_asset_status == "rejected" and second.enhancement.status == "disabled"
    assert docs.first().schema_version == "1.1"


def test_unknown_version_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="unsupported manifest version 9"):
        A.upgrade_manifest(read(spark, tmp_path, manifest("9"))).collect()


def test_side_inventory_fills_old_manifests(spark, tmp_path):
    item = read(spark, tmp_path, manifest()).select("scene_id", F.col("objects").alias("instances"))
    assert len(read(spark, tmp_path, manifest(), instances=item).first().detection.instances) == 2


def test_annotations(spark, tmp_path):
    doc = {"scene_id": "s", "image": "i", "roi": [0, 0, 50, 50], "objects": [{"id": "a", "category": "tree", "bbox": [1, 2, 11, 22]}], "provenance": "p"}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    row = A.annotation_objects(A.read_annotations(spark, str(tmp_path / "a.json"))).first()
    assert (row.gt_id, row.kind, row.ignore, row.w, row.h) == ("a", "instance", False, 10, 20)


def test_annotations_become_evaluation_inputs(spark, tmp_path):
    item = lambda i, **kw: {"id": i, "category": "tree", "bbox": [1, 2, 11, 22], **kw}
    doc = {"scene_id": "s", "roi": [0, 0, 50, 50], "objects": [item("b"), item("a"), item("i", ignore=True, category="rock"), item("t", kind="terrain")], "ignore_regions": [[1, 1, 4, 5]]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    annotations, ignore, gt = A.annotation_inputs(A.read_annotations(spark, str(tmp_path / "a.json")))
    assert annotations.first().categories == ["tree", "rock"] and annotations.first().rx1 == 50
    assert {(r.x, r.y, r.w, r.h) for r in ignore.collect()} == {(1, 1, 3, 4), (1, 2, 10, 20)}
    assert [(r.gt_id, r.seq) for r in gt.orderBy("seq").collect()] == [("b", 0), ("a", 1)]


def test_equal_overlaps_go_to_the_first_annotated(spark):
    from spatialqa.operators.evaluate import match_gt
    preds = spark.createDataFrame([(1, "tree", 7, .9, 0, 0, 0, 10, 10)], "scene_id long, category string, pred_id long, confidence double, seq long, x long, y long, w long, h long")
    gt = spark.createDataFrame([(1, "tree", "g2", 0, 0, 0, 10, 10), (1, "tree", "g10", 1, 0, 0, 10, 10)], "scene_id long, category string, gt_id string, seq long, x long, y long, w long, h long")
    assert match_gt(preds, gt)[0].first().gt_id == "g2" and match_gt(preds, gt.drop("seq"))[0].first().gt_id == "g10"


def test_sinks_and_paths(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "/out/a/b.png"), (2, 1.0, "/elsewhere/c.png")], "id long, v double, asset_path string")
    A.write_tables({"x": df}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables" / "x")).count() == 2
    assert [(r.column, r.rows) for r in A.nan_violations(df).collect()] == [("v", 1)]
    assert [r[0] for r in df.orderBy("id").select(portable(F.col("asset_path"), "/out")).collect()] == ["a/b.png", "/elsewhere/c.png"]
    with pytest.raises(Exception, match="outside the output folder"):
        df.select(portable_strict(F.col("asset_path"), "/out")).collect()


def test_written_manifests_have_one_shape(spark, tmp_path):
    scenes = spark.createDataFrame([("s", 10, 10, "flat"), ("empty", 5, 5, "flat")], "scene_id string, width int, height int, projection string")
    rows = [("s", 40005, "b", "tree", "vegetation", "/out/b.png"), ("s", 5, "a", "tree", "vegetation", "/out/a.png"), ("s", 7, "f", "fog", "fx_environment", None), ("s", 9, "n", "tree", None, None)]
    objects = spark.createDataFrame(rows, "scene_id string, seq long, id string, category string, `group` string, asset_path string")
    A.write_manifests(scenes, objects, str(tmp_path / "m"), "/out")
    headers, lines = A.read_manifest_rows(spark, str(tmp_path / "m"))
    assert headers.count() == 2 and lines.count() == 4
    docs = {r.scene_id: r for r in A.manifest_documents(headers, lines).collect()}
    assert [o.id for o in docs["s"].objects] == ["a", "n", "b"] and [o.id for o in docs["s"].environment_effects] == ["f"]
    assert docs["s"].objects[0].asset_path == "a.png" and docs["empty"].objects is None and docs["s"].schema_version == "1.2"
    assert {r.object.base_asset_status for r in A.upgrade_rows(lines).filter("object.id = 'a'").collect()} != {None}


def test_request_key_ignores_parameter_order(spark):
    df = spark.createDataFrame([("x", 1)], "a string, b long")
    key = lambda p: request_key(p, pipeline_version="1", prompt_version="1", namespace=F.lit("n"), model=F.lit("m"))
    row = df.select(key({"a": F.col("a"), "b": F.col("b")}).alias("p"), key({"b": F.col("b"), "a": F.col("a")}).alias("q")).first()
    assert row.p == row.q
    keyed = df.withColumn("request_key", key({"a": F.col("a")}))
    assert pending(keyed, keyed).count() == 0


def test_scorer_isolates_failures(spark):
    plan = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "budget_exhausted")], "n long, status string")
    def score(row):
        if row["n"] == 2:
            raise RuntimeError("no memory")
        return [{"category": "tree"}]
    items, log = scorer_results(run_scorer(plan, score, T.StructType([T.StructField("category", T.StringType())])))
    assert [(r.n, r.category) for r in items.collect()] == [(1, "tree")]
    assert [(r.n, r.status, r.error, r.candidates) for r in log.orderBy("n").collect()] == [(1, "ok", None, 1), (2, "failed", "RuntimeError: no memory", 0), (3, "budget_exhausted", None, 0)]


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", ["round_progress", "monitored_rounds", "manifest_roundtrip", "scan_plan", "selected_candidates", "assigned_ids", "mask_stats", "regression_gate", "scene_summary"])
def test_queries_match_their_sql(spark, name):
    assert compare(spark, duck(SMALL), SMALL, name).startswith("ok")
