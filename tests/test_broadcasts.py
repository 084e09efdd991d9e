"""Rows that an explode makes are no broadcast, however few the planner takes them for."""
import pytest
from pyspark.sql import functions as F

from spatialqa.operators import fusion as U, ownership as O, pixels as P, planning as L, reports as R, runs as M
from spatialqa.registry import QUERIES
from spatialqa.sources.derived import mask_runs, tile_runs

DATA = "/root/testdata/sf0.001"


def broadcasts(plan: str) -> list[str]:
    """The part of a plan's text below each broadcast."""
    lines, out = plan.splitlines(), []
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


@pytest.mark.parametrize("name", ["mask_stats", "run_overlap", "covered_boxes", "drop_covered", "cutout", "semantic_regions", "completion_checks",
                                  "uncovered_cells", "union_coverage", "skipped_tiles", "diagnosed_masks", "appearance_histogram"])
def test_unfolded_rows_are_not_broadcast(spark, name):
    """The tables are so small that the planner would broadcast all of them."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan
    assert [b for b in broadcasts(plan) if "Generate" in b] == []


@pytest.mark.parametrize("name", ["run_overlap", "pixel_owners", "ownership_conflicts", "scene_summary"])
def test_rows_of_objects_are_not_broadcast(spark, name):
    """Files are packed, so a table of every object counts as small to the planner; only totals may be broadcast."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert [b for b in broadcasts(plan) if "Aggregate" not in b] == []


def test_shapes_are_dealt_before_they_become_runs(spark):
    """One split of a file with many shapes is no single task that unfolds them all."""
    shapes = spark.range(0, 50_000, 1, 1).selectExpr("id as det_id", "id div 400 as scene_id", "id % 300 as x", "id % 200 as y", "4L as w", "3L as h")
    runs = mask_runs(shapes).groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("det_id").alias("shapes")).collect()
    assert sum(r.shapes for r in runs) == 50_000
    assert len(runs) == 3 and max(r.shapes for r in runs) < 20_000


def test_shapes_that_lie_together_share_a_task(spark):
    """Their pixels are aggregated there before they are shuffled."""
    shapes = spark.range(0, 50_000, 1, 1).selectExpr("id as det_id", "id div 400 as scene_id", "id % 300 as x", "id % 200 as y", "4L as w", "3L as h")
    assert mask_runs(shapes).select("scene_id", F.spark_partition_id()).distinct().count() <= 125 + 2


@pytest.mark.parametrize("name", ["alpha_diff", "similarity"])
def test_pixels_unfold_once_and_hash(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Generate explode(sequence(x0") == 1


def test_runs_of_scans_are_spread_by_number(spark, monkeypatch):
    """Their packed bytes would be joined to few partitions: scanned, candidate and tile runs are spread by how many they are."""
    monkeypatch.setattr(R, "UNFOLDED_RUNS", 500, raising=False)
    plan = QUERIES["scan_depth"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    spread = [line for line in plan.splitlines() if "Exchange hashpartitioning(scene_id" in line and "REPARTITION_BY_NUM" in line]
    assert len(spread) >= 3


def test_rows_of_one_run_that_touch_are_one_node(spark, monkeypatch):
    """A fork and a single column: labels pass over chains, not over each of their rows."""
    fork = [(0, 0, y, 5, 7) for y in range(10)] + [(0, 0, 10, 3, 5), (0, 0, 10, 7, 9), (0, 0, 30, 0, 2)]
    column = [(0, 1, y, 0, 1) for y in range(50)]
    seen, plain = [], M.connected
    monkeypatch.setattr(M, "connected", lambda nodes, links: (seen.append(nodes.count()), plain(nodes, links))[1])
    rows = spark.createDataFrame(fork + column, "scene_id long, mask_id long, y long, x0 long, x1 long")
    found = {(r.mask_id, r.pixels, r.x0, r.x1, r.y0, r.y1) for r in M.mask_components(rows).collect()}
    assert found == {(0, 24, 3, 9, 0, 11), (0, 2, 0, 2, 30, 31), (1, 50, 0, 1, 0, 50)}
    assert seen == [5]  # the fork's stem and prongs, the piece apart, the column


def test_runs_are_dealt_once_to_be_united_and_linked(spark):
    """Rows of a scene stay where they lie for the unions and the sweep; only links are shuffled again, without a join."""
    rows = [(0, "a", m, y, 3 * m, 3 * m + 5) for m in range(4) for y in range(6)]
    runs = spark.createDataFrame(rows, "scene_id long, category string, det_id long, y long, x0 long, x1 long")
    links = U.mask_links(runs.select("scene_id", "category", "det_id").distinct(), runs)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange") == 2 and "Join" not in plan
    assert {frozenset(r) for r in links.collect()} == {frozenset(p) for p in ((0, 1), (1, 2), (2, 3))}


def test_pixels_of_accepted_assets_are_summed_before_names_join(spark):
    """One row an asset meets the names, not one a segment."""
    plan = QUERIES["accepted_ownership"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[paint_rank" in plan


def test_shapes_are_dealt_by_tile_and_their_runs_stay(spark):
    """Stacks and tops of runs need no shuffle but that of the shapes, and tiles hold the same pixels as whole runs."""
    shapes = spark.range(300).selectExpr("id as det_id", "id div 100 as scene_id", "id * 7 % 300 as x", "id * 5 % 200 as y", "40 + id % 9 as w", "30 + id % 7 as h", "id as paint_rank", "id as owner_no")
    tiles = tile_runs(shapes)
    top = O.top_segments(O.stack(tiles.drop("det_id"), shapes))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1
    assert tiles.filter("y div 32 <> _band or x0 div 128 <> _s or (x1 - 1) div 128 <> _s").isEmpty()
    pixels = lambda runs: runs.groupBy("det_id", "y").agg(F.sum(F.col("x1") - F.col("x0")), F.min("x0"), F.max("x1")).collect()
    assert set(pixels(tiles)) == set(pixels(mask_runs(shapes)))


def test_regions_meet_tiles_as_one_row(spark):
    """Runs in tiles are cut to regions where they lie: the join shuffles the regions alone."""
    shapes = spark.range(300).selectExpr("id as det_id", "id div 100 as scene_id", "id * 7 % 300 as x", "id * 5 % 200 as y", "40 + id % 9 as w", "30 + id % 7 as h")
    regions = spark.sql("select s.id as scene_id, y.id as y, r.x0, r.x1 from range(2) s, range(20, 90) y, values (30L, 140L), (150L, 151L), (200L, 290L) as r(x0, x1)")
    cut = M.clip_tiles(tile_runs(shapes), regions)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and not [line for line in plan.splitlines() if "Exchange hashpartitioning(scene_id" in line and "det_id" in line]
    plain = M.shared_pieces(mask_runs(shapes), regions)
    count = lambda runs: {tuple(r) for r in runs.groupBy("det_id", "y").agg(F.sum(F.col("x1") - F.col("x0"))).collect()}
    assert count(cut) == count(plain)


@pytest.mark.parametrize("name", ["composite", "cutout"])
def test_layers_meet_as_runs(spark, name):
    """No pixel is shuffled: blended ones unfold below their sums, those of a cutout never."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    below = plan.splitlines()
    pixels = [i for i, line in enumerate(below) if "Generate explode(sequence(x0" in line]
    assert len(pixels) == (1 if name == "composite" else 0)
    assert not [line for line in below if "Exchange" in line and " x#" in line]


def test_layers_as_runs_blend_as_pixels_do(spark):
    rows = [(0, y, x, x + 20, 40 * i % 256, 90 * i % 256, 7 * i % 256, a, i) for i, (x, a) in enumerate([(100, 255), (110, 128), (105, 0), (119, 60), (120, 255), (115, 9), (130, 200)]) for y in range(2 + i % 2)]
    layers = spark.createDataFrame(rows, "scene_id long, y long, x0 long, x1 long, r int, g int, b int, a int, n int")
    spots = lambda runs: runs.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    columns = ["scene_id", "x", "y", "r", "g", "b", "a"]
    plain = {tuple(r) for r in P.composite(spots(layers), [F.col("n")]).select(columns).collect()}
    assert {tuple(r) for r in spots(P.composite_runs(layers, [F.col("n")])).select(columns).collect()} == plain and len(plain) > 90


def test_masks_of_a_pair_are_scored_in_one_task(spark):
    """Boundaries are compared row by row where a pair lies: its runs are dealt once, by pair, and by nothing finer."""
    plan = QUERIES["boundary_fscore"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert not [line for line in exchanges if " y#" in line or "_s#" in line or "x0#" in line.split("REPARTITION")[0].replace("rangepartitioning", "")]
    assert "Exchange hashpartitioning(scene_id" in plan and sum("gt_id" in line and "pred_id" in line and "REPARTITION_BY_NUM" in line for line in exchanges) == 1


@pytest.mark.parametrize("name, runs_shuffled", [("completion_checks", 2), ("component_summary", 0)])
def test_masks_stay_whole_in_a_task(spark, monkeypatch, name, runs_shuffled):
    """Shapes are dealt by mask and unfold there, so unions and chains of runs need no shuffle of runs."""
    plans, plain = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df: (plans.append(df), plain(df))[1])
    out = QUERIES[name](spark, DATA)
    plan = (plans[0] if plans else out)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("REPARTITION_BY_NUM" in line for line in exchanges)
    keys = [line.split("hashpartitioning(")[1].split("), ")[0] for line in exchanges]
    unions = [k for k in keys if "x0#" in k]
    assert unions == [] and sum("y#" in k for k in keys) <= 2 * runs_shuffled


def test_only_ends_of_chains_are_written(spark, monkeypatch):
    written, plain = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df: (written.append(df.count()), plain(df))[1])
    rows = [(0, m, y, 3, 6) for m in range(4) for y in range(100)]
    found = M.mask_components(spark.createDataFrame(rows, "scene_id long, mask_id long, y long, x0 long, x1 long")).collect()
    assert sorted((r.mask_id, r.pixels, r.x0, r.x1, r.y0, r.y1) for r in found) == [(m, 300, 3, 6, 0, 100) for m in range(4)]
    assert written[0] == 8


def test_runs_of_samples_are_not_joined_with_their_sums(spark):
    """A mask's pixels come from a window where its runs lie, not from a second pass that a join shuffles."""
    runs = spark.range(0, 7321).selectExpr("0L as scene_id", "id div 10 as object_id", "id % 10 as y", "0L as x0", "5 + id % 2 as x1")
    objects = spark.sql("select 0L as scene_id, id as object_id, 'terrain' as element_type, 1 as ownership_priority from range(5)")
    targets = objects.selectExpr("scene_id", "object_id", "ownership_priority", "0L as wx", "0L as wy", "9L as ww", "9L as wh")
    plan = L.negative_samples(targets, objects, runs)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "sum(" in line]
