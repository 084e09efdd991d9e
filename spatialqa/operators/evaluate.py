"""Predictions against ground truth: selection, matching, scores and mask quality."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spatialqa.functions.boxes import Box, eval_iou, intersection
from spatialqa.operators.nms import independent_rows
from spatialqa.operators.ordered import first_per
from spatialqa.operators.overlap import Grid, overlap_join, suffixed
from spatialqa.operators.runs import _islands, pixel_count, rect_runs, run_difference, shared_pieces, union_runs
from spatialqa.session import discard, materialize, unfolded

#: Pairs of masks in a task that scores their boundaries.
PAIRS_IN_TASK = 5_000


def _one() -> Column:
    return F.lit(1).cast("bigint")


def prediction_inventory(detected: DataFrame, final: DataFrame, terrain: DataFrame | None = None) -> DataFrame:
    """Every detected instance with its final asset laid over it; the detector box stays.

    Final-only objects and terrain follow. All inputs share ``scene_id, object_id`` and a
    box; other columns of ``final`` win where present.
    """
    keys = ["scene_id", "object_id"]
    box = ["x", "y", "w", "h"]
    extra = [c for c in final.columns if c not in (*keys, *box)]
    named = final.select(*keys, *(F.col(c).alias(f"_f_{c}") for c in extra), F.lit(True).alias("_has"))
    joined = detected.join(named, keys, "left")
    value = lambda c: F.when(F.col("_has"), F.col(f"_f_{c}")).otherwise(F.col(c)) if c in detected.columns else F.col(f"_f_{c}")
    rest = [c for c in detected.columns if c not in (*keys, *box, *extra)]
    known = joined.select(*keys, *box, *rest, *(value(c).alias(c) for c in extra))
    out = known.unionByName(final.join(detected.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    return out if terrain is None else out.unionByName(terrain, allowMissingColumns=True)


def select_predictions(predictions: DataFrame, annotations: DataFrame, ignore: DataFrame, ident: str = "pred_id",
                       gt: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored, ignored) predictions.

    Category listed (an empty or null list means the categories that ``gt`` annotates in the
    scene, or any without ``gt``), not terrain, centre inside the half-open region; boxes are clipped to
    it. At least half inside one ignore region means ignored.
    ``annotations(scene_id, rx0, ry0, rx1, ry1, categories)``; ``ignore(scene_id, x, y, w, h)``.
    """
    joined = predictions.join(annotations.select("scene_id", "rx0", "ry0", "rx1", "ry1", "categories"), "scene_id")
    unlisted = F.coalesce(F.size("categories"), F.lit(0)) <= 0
    known = F.lit(True)
    if gt is not None:
        joined = joined.join(gt.select("scene_id", "category", F.lit(True).alias("_known")).distinct(), ["scene_id", "category"], "left")
        known = F.col("_known").isNotNull()
    wanted = F.when(unlisted, known).otherwise(F.array_contains("categories", F.col("category")))
    cx, cy = Box.of().centre
    kind = F.coalesce(F.col("kind"), F.lit("")) if "kind" in predictions.columns else F.lit("")
    inside = (cx >= F.col("rx0")) & (cx < F.col("rx1")) & (cy >= F.col("ry0")) & (cy < F.col("ry1"))
    listed = joined.filter(wanted & (kind != "terrain") & inside)
    clipped = Box.of().clip(F.col("rx0"), F.col("ry0"), F.col("rx1"), F.col("ry1"))
    rest = [c for c in predictions.columns if c not in ("x", "y", "w", "h")]
    listed = listed.select(*rest, *(v.cast("bigint").alias(n) for n, v in zip("xywh", clipped)))
    share = intersection(suffixed("a"), suffixed("b")) / F.greatest(_one(), suffixed("a").area)
    hidden = overlap_join(listed.select("scene_id", ident, *"xywh"), ignore.select("scene_id", *"xywh").distinct(), ["scene_id"], share >= 0.5)
    hidden = hidden.select("scene_id", F.col(f"{ident}_a").alias(ident)).distinct()
    return listed.join(hidden, ["scene_id", ident], "left_anti"), listed.join(hidden, ["scene_id", ident], "left_semi")


def match_gt(predictions: DataFrame, gt: DataFrame, threshold: float = 0.5, keys: list[str] = ["scene_id", "category"],
             ident: str = "pred_id", gt_ident: str = "gt_id", grid: Grid | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches with ``bbox_iou``, predictions with ``outcome``).

    In confidence order each prediction takes its best free object. All predictions are
    ranked alike, so this is the one stable matching, reached by rounds in which every
    prediction asks its best remaining object and each object refuses all but the best
    asker so far. Objects of equal IoU go by ``seq`` where ``gt`` has it, else by id. Outcomes: ``match``, ``duplicate`` (its best object is taken), ``false_positive``.
    """
    value = eval_iou(suffixed("a"), suffixed("b"))
    place = F.col("seq" if "seq" in gt.columns else gt_ident).alias("place")
    pairs = overlap_join(predictions.select(*keys, ident, "confidence", "seq", *"xywh"), gt.select(*keys, gt_ident, place, *"xywh"), keys, value >= threshold, grid=grid)
    p, g = F.col(f"{ident}_a"), F.col(f"{gt_ident}_b")
    edges = materialize(pairs.select(F.col(keys[0]), p.alias("p"), g.alias("g"), F.col("place_b").alias("place"), value.alias("bbox_iou"),
                                     F.struct((-F.col("confidence_a")).alias("c"), F.col("seq_a").alias("s")).alias("rank")))
    first, candidates = edges, edges.select(keys[0], "p").distinct()
    count = edges.count()
    while True:
        asked = first_per(edges, [keys[0], "p"], [-F.col("bbox_iou"), F.col("place"), F.col("g")])
        held = asked.groupBy(keys[0], "g").agg(F.min("rank").alias("_held"))
        left = materialize(edges.join(held, [keys[0], "g"], "left").filter(F.col("_held").isNull() | (F.col("rank") <= F.col("_held"))).drop("_held"))
        if edges is not first:  # the first edges say who has candidates
            discard(edges)
        edges, before, count = left, count, left.count()
        if count == before:
            break
    final = first_per(edges, [keys[0], "p"], [-F.col("bbox_iou"), F.col("place"), F.col("g")])
    matches = final.select(keys[0], F.col("p").alias(ident), F.col("g").alias(gt_ident), "bbox_iou")
    flags = (candidates.select(keys[0], F.col("p").alias(ident), F.lit(True).alias("_near"))
             .join(matches.select(keys[0], ident, F.lit(True).alias("_hit")), [keys[0], ident], "left"))
    outcome = F.when(F.col("_hit"), "match").when(F.col("_near"), "duplicate").otherwise("false_positive")
    return matches, predictions.join(flags, [keys[0], ident], "left").withColumn("outcome", outcome).drop("_near", "_hit")


def fragments(predictions: DataFrame, gt: DataFrame, keys: list[str] = ["scene_id", "category"], ident: str = "pred_id",
              gt_ident: str = "gt_id", min_area: float = 0.05, containment: float = 0.8, apart: float = 0.2,
              grid: Grid | None = None) -> DataFrame:
    """Distinct partial boxes of each object with at least two: ``scene_id, gt_id, pred_id``."""
    a, b = suffixed("a"), suffixed("b")
    share = a.area / b.area
    inside = intersection(a, b) / F.greatest(_one(), a.area)
    part = (share >= min_area) & (share < 0.8) & (inside >= containment)
    pairs = overlap_join(predictions.select(*keys, ident, "confidence", "seq", *"xywh"), gt.select(*keys, gt_ident, *"xywh"), keys, part, grid=grid)
    pieces = pairs.select(keys[0], F.col(f"{gt_ident}_b").alias(gt_ident), F.col(f"{ident}_a").alias(ident), F.col("confidence_a").alias("confidence"),
                          F.col("seq_a").alias("seq"), *(F.col(f"{k}_a").alias(k) for k in "xywh"))
    pieces = materialize(pieces.withColumn("_piece", F.concat_ws(":", gt_ident, ident)))
    order = [-F.col("confidence"), F.col("seq")]
    unique = first_per(pieces, [keys[0], gt_ident, *"xywh"], order)
    kept = independent_rows(unique, [keys[0], gt_ident], order, "_piece", lambda p, q: eval_iou(p, q) >= apart, grid=grid)
    distinct = pieces.join(kept, "_piece", "left_semi")
    several = distinct.groupBy(keys[0], gt_ident).count().filter("count >= 2")
    return distinct.join(several, [keys[0], gt_ident], "left_semi").select(keys[0], gt_ident, ident)


def detection_scores(gt: DataFrame, outcomes: DataFrame, fragmented: DataFrame, scene: str = "scene_id", corpus: bool = False) -> DataFrame:
    """Recall, precision, duplicate, fragmentation and miss rates per scene (or one corpus row)."""
    keys = [] if corpus else [scene]
    one = F.lit(1)
    g = gt.select(scene, F.lit(1).alias("gt"), *(F.lit(0).alias(c) for c in ("pred", "tp", "dup", "frag")))
    p = outcomes.select(scene, F.lit(0).alias("gt"), F.lit(1).alias("pred"), (F.col("outcome") == "match").cast("int").alias("tp"),
                        (F.col("outcome") == "duplicate").cast("int").alias("dup"), F.lit(0).alias("frag"))
    f = fragmented.select(scene, "gt_id").distinct().select(scene, *(F.lit(0).alias(c) for c in ("gt", "pred", "tp", "dup")), one.alias("frag"))
    names = {"gt": "gt_count", "pred": "prediction_count", "tp": "true_positive_count", "dup": "duplicate_count", "frag": "fragmented_gt_count"}
    out = g.unionByName(p).unionByName(f).groupBy(*keys).agg(*(F.sum(c).cast("bigint").alias(n) for c, n in names.items()))
    many = lambda c: F.greatest(_one(), F.col(c))
    return (out.withColumn("false_positive_count", F.col("prediction_count") - F.col("true_positive_count"))
            .withColumn("recall", F.try_divide("true_positive_count", "gt_count"))
            .withColumn("precision", F.coalesce(F.try_divide("true_positive_count", "prediction_count"), F.when(F.col("gt_count") > 0, 0.0)))
            .withColumn("duplicate_rate", F.col("duplicate_count") / many("prediction_count"))
            .withColumn("fragmentation_rate", F.col("fragmented_gt_count") / many("gt_count"))
            .withColumn("miss_rate", (F.col("gt_count") - F.col("true_positive_count")) / many("gt_count")))


def size_class(box: Box, scene_area: Column, small: float = 0.001, large: float = 0.05) -> Column:
    ratio = box.area / scene_area
    return F.when(ratio < small, "small").when(ratio >= large, "large").otherwise("medium")


SIZE_CLASSES = ("small", "medium", "large")


def scores_by_size(gt: DataFrame, matches: DataFrame, scene_area: Column, scene: str = "scene_id") -> DataFrame:
    """Recall per size class, per scene and over the corpus (null scene); a class without objects has 0 of 0 and a null recall."""
    hit = matches.select(scene, "gt_id", F.lit(1).alias("_hit"))
    marked = gt.withColumn("size_class", size_class(Box.of(), scene_area)).join(hit, [scene, "gt_id"], "left")
    rows = marked.select(scene, "size_class", F.lit(1).alias("_gt"), F.coalesce("_hit", F.lit(0)).alias("_hit"))
    empty = gt.select(scene).distinct().select(scene, F.explode(F.array(*map(F.lit, SIZE_CLASSES))).alias("size_class"), F.lit(0).alias("_gt"), F.lit(0).alias("_hit"))
    out = rows.unionByName(empty).groupingSets([[F.col(scene), F.col("size_class")], [F.col("size_class")]], F.col(scene), F.col("size_class")).agg(
        F.sum("_gt").cast("bigint").alias("gt"), F.sum("_hit").cast("bigint").alias("detected"))
    return out.withColumn("recall", F.try_divide("detected", "gt"))


def evaluated_runs(runs: DataFrame, roi: DataFrame | None = None, ignore: DataFrame | None = None) -> DataFrame:
    """Runs cut to the region of interest and to the pixels outside the ignore regions.

    ``roi(scene_id, rx0, ry0, rx1, ry1)`` has one half-open region a scene, as the annotations
    do; a scene without one has no evaluated pixel. ``ignore(scene_id, x, y, w, h)``.
    """
    out = runs
    if roi is not None:
        x0, x1 = F.greatest("x0", "rx0").cast("bigint"), F.least("x1", "rx1").cast("bigint")
        inside = (F.col("y") >= F.col("ry0")) & (F.col("y") < F.col("ry1")) & (x0 < x1)
        cut = out.join(roi.select("scene_id", "rx0", "ry0", "rx1", "ry1"), "scene_id").filter(inside)
        out = cut.withColumn("_x0", x0).withColumn("_x1", x1).drop("x0", "x1").withColumnsRenamed({"_x0": "x0", "_x1": "x1"}).select(*runs.columns)
    return unfolded(out) if ignore is None else run_difference(out, rect_runs(ignore.select("scene_id", *"xywh")))


def mask_quality(pairs: DataFrame, gt_runs: DataFrame, pred_runs: DataFrame, roi: DataFrame | None = None, ignore: DataFrame | None = None) -> DataFrame:
    """IoU, Dice, completeness and contamination per matched pair.

    ``pairs(scene_id, gt_id, pred_id)``; runs carry ``gt_id`` / ``pred_id``. A missing
    predicted mask counts as empty. Only evaluated pixels count (``evaluated_runs``).
    """
    gt_runs, pred_runs = evaluated_runs(gt_runs, roi, ignore), evaluated_runs(pred_runs, roi, ignore)
    n = pixel_count(gt_runs, ["scene_id", "gt_id"], "n")
    p = pixel_count(pred_runs, ["scene_id", "pred_id"], "p")
    width = F.least("_a1", "_b1") - F.greatest("_a0", "_b0")
    left = pairs.join(gt_runs.select("scene_id", "gt_id", "y", F.col("x0").alias("_a0"), F.col("x1").alias("_a1")), ["scene_id", "gt_id"])
    right = pred_runs.select("scene_id", "pred_id", "y", F.col("x0").alias("_b0"), F.col("x1").alias("_b1"))
    common = left.join(right, ["scene_id", "pred_id", "y"]).filter(width > 0).groupBy("scene_id", "gt_id", "pred_id").agg(F.sum(width).cast("bigint").alias("common"))
    out = (pairs.join(n, ["scene_id", "gt_id"], "left").join(p, ["scene_id", "pred_id"], "left")
           .join(common, ["scene_id", "gt_id", "pred_id"], "left").fillna(0, ["n", "p", "common"]))
    n, p, c = F.col("n"), F.col("p"), F.col("common")
    safe = lambda v: F.greatest(_one(), v)
    return (out.withColumn("iou", c / safe(n + p - c)).withColumn("dice", 2 * c / safe(n + p))
            .withColumn("completeness", c / safe(n)).withColumn("contamination", (p - c) / safe(p)).drop("n", "p", "common"))


def boundary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Mask pixels with a neighbour, in the 3x3 sense, outside the mask; all by runs."""
    solid = union_runs(runs, keys, maximal=True)
    shrunk = solid.select(*keys, "y", (F.col("x0") + 1).alias("x0"), (F.col("x1") - 1).alias("x1")).filter("x1 > x0")
    at = lambda dy: shrunk.withColumn("y", F.col("y") + dy)
    on = [*keys, "y"]
    core = shared_pieces(shared_pieces(at(0), at(1), on), at(-1), on)
    return run_difference(solid.select(*keys, "y", "x0", "x1"), core, on)


def grown(runs: DataFrame, keys: list[str], by: int) -> DataFrame:
    """Runs widened by a square of side ``2*by+1``, as disjoint runs."""
    spread = (
        runs.withColumn("_dy", F.explode(F.sequence(F.lit(-by), F.lit(by)))).withColumn("y", F.col("y") + F.col("_dy")).drop("_dy"))
    wide = spread.withColumn("x0", F.greatest(F.col("x0") - by, F.lit(0))).withColumn("x1", F.col("x1") + by)
    return union_runs(wide, keys)


def _shared(a: Column, b: Column) -> Column:
    """Intersections of two arrays of runs, each disjoint and sorted."""
    piece = lambda r, t: F.struct(F.greatest(r["x0"], t["x0"]).alias("x0"), F.least(r["x1"], t["x1"]).alias("x1"))
    return F.filter(F.flatten(F.transform(a, lambda r: F.transform(b, lambda t: piece(r, t)))), lambda r: r["x0"] < r["x1"])


def _without(a: Column, b: Column) -> Column:
    """What runs ``b``, disjoint, sorted and each inside one of ``a``, leave of ``a``."""
    def left(r: Column) -> Column:
        cuts = F.filter(b, lambda t: (t["x0"] >= r["x0"]) & (t["x1"] <= r["x1"]))
        starts, ends = F.concat(F.array(r["x0"]), F.transform(cuts, lambda t: t["x1"])), F.concat(F.transform(cuts, lambda t: t["x0"]), F.array(r["x1"]))
        return F.zip_with(starts, ends, lambda u, v: F.struct(u.alias("x0"), v.alias("x1")))
    return F.filter(F.flatten(F.transform(a, left)), lambda r: r["x0"] < r["x1"])


def _covered(a: Column, b: Column) -> Column:
    """Pixels of runs ``a`` that any of ``b``, which may overlap, covers."""
    zero = F.lit(0).cast("bigint")
    def pixels(r: Column) -> Column:
        start = F.struct(r["x0"].alias("reach"), zero.alias("n"))
        def step(s: Column, t: Column) -> Column:
            end = F.least(t["x1"], r["x1"])
            return F.struct(F.greatest(s["reach"], end).alias("reach"), (s["n"] + F.greatest(zero, end - F.greatest(t["x0"], s["reach"]))).alias("n"))
        return F.aggregate(b, start, step, lambda s: s["n"])
    return F.aggregate(a, zero, lambda n, r: n + pixels(r))


def _length(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda n, r: n + r["x1"] - r["x0"])


def boundary_f(pairs: DataFrame, gt_runs: DataFrame, pred_runs: DataFrame, tolerance: int = 2, roi: DataFrame | None = None,
               ignore: DataFrame | None = None) -> DataFrame:
    """Boundary F-score per matched pair with a square tolerance; boundaries are those of the masks cut by ``evaluated_runs``.

    Both masks of a pair are dealt to one task, once; a row of a mask is one array of its runs there, and sees the rows around
    it through windows. Runs that carry the ids of their pair already need no join with ``pairs``.
    """
    gt_runs, pred_runs = evaluated_runs(gt_runs, roi, ignore), evaluated_runs(pred_runs, roi, ignore)
    key = ["scene_id", "gt_id", "pred_id"]
    def side(runs: DataFrame, ident: str, number: int) -> DataFrame:
        met = runs if set(key) <= set(runs.columns) else pairs.select(*key).join(runs, ["scene_id", ident])
        return met.select(*key, F.lit(number).alias("_side"), "y", "x0", "x1")
    least = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = side(gt_runs, "gt_id", 0).unionByName(side(pred_runs, "pred_id", 1)).repartition(max(least, -(-pairs.count() // PAIRS_IN_TASK)), *key)
    rows = _islands(both, [*key, "_side", "y"]).groupBy(*key, "_side", "y").agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("_r"))
    none = F.array().cast("array<struct<x0:bigint,x1:bigint>>")
    along = Window.partitionBy(*key, "_side").orderBy("y")
    def beside(near, dy: int) -> Column:
        slim = F.filter(F.transform(near("_r", 1).over(along), lambda r: F.struct((r["x0"] + 1).alias("x0"), (r["x1"] - 1).alias("x1"))), lambda r: r["x0"] < r["x1"])
        return F.when(near("y", 1).over(along) == F.col("y") + dy, slim).otherwise(none)
    own = F.filter(F.transform("_r", lambda r: F.struct((r["x0"] + 1).alias("x0"), (r["x1"] - 1).alias("x1"))), lambda r: r["x0"] < r["x1"])
    slim = rows.withColumn("_own", own).withColumn("_up", beside(F.lag, -1)).withColumn("_down", beside(F.lead, 1))
    edges = slim.withColumn("_core", _shared(_shared(F.col("_own"), F.col("_up")), F.col("_down"))).withColumn("_edge", _without(F.col("_r"), F.col("_core")))
    lines = edges.groupBy(*key, "y").agg(*(F.coalesce(F.max(F.when(F.col("_side") == i, F.col("_edge"))), none).alias(n) for i, n in ((0, "_l"), (1, "_p"))))
    around = Window.partitionBy(*key).orderBy("y").rangeBetween(-tolerance, tolerance)
    def wide(name: str) -> Column:
        grow = lambda r: F.struct(F.greatest(r["x0"] - tolerance, F.lit(0).cast("bigint")).alias("x0"), (r["x1"] + tolerance).alias("x1"))
        return F.array_sort(F.transform(F.flatten(F.collect_list(name).over(around)), grow))
    seen = lines.withColumn("_wl", wide("_l")).withColumn("_wp", wide("_p"))
    sums = seen.groupBy(*key).agg(F.sum(_length(F.col("_l"))).alias("n_l"), F.sum(_length(F.col("_p"))).alias("n_r"),
                                  F.sum(_covered(F.col("_l"), F.col("_wp"))).alias("hit_l"), F.sum(_covered(F.col("_p"), F.col("_wl"))).alias("hit_r"))
    out = pairs.select(*key).join(sums, key, "left").fillna(0)
    recall, precision = F.col("hit_l") / F.greatest(_one(), F.col("n_l")), F.col("hit_r") / F.greatest(_one(), F.col("n_r"))
    return out.select(*key, (2 * recall * precision / F.greatest(F.lit(1e-12), recall + precision)).alias("boundary_fscore"))


def poor_masks(quality: DataFrame, poor: float = 0.5) -> DataFrame:
    """The pairs whose masks agree less than ``poor``, worst first within a scene by ``iou``; one row each."""
    ids = [c for c in ("scene_id", "gt_id", "pred_id") if c in quality.columns]
    return quality.filter(F.col("iou") < poor).select(*ids, "iou")


def quality_means(quality: DataFrame, keys: list[str] = ["scene_id"], poor: float = 0.5) -> DataFrame:
    names = [c for c in ("iou", "dice", "boundary_fscore", "completeness", "contamination") if c in quality.columns]
    return quality.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in names), F.count(F.lit(1)).alias("matches"),
                                      F.count_if(F.col("iou") < poor).alias("poor_masks"))


def semantic_regions(regions: DataFrame, region_runs: DataFrame, pred_runs: DataFrame, roi: DataFrame | None = None,
                     ignore: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs and runs to score each annotated region against the union of same-category masks.

    ``regions(scene_id, gt_id, category)``; ``pred_runs`` carry ``category``. Both are cut by
    ``evaluated_runs``. Feed the result to ``mask_quality`` / ``boundary_f``.
    """
    region_runs, pred_runs = evaluated_runs(region_runs, roi, ignore), evaluated_runs(pred_runs, roi, ignore)
    union = union_runs(pred_runs, ["scene_id", "category"])
    pred = union.join(regions.select("scene_id", "category", "gt_id"), ["scene_id", "category"]).select(
        "scene_id", F.col("gt_id").alias("pred_id"), "y", "x0", "x1")
    pairs = regions.select("scene_id", "gt_id", F.col("gt_id").alias("pred_id"))
    return pairs, region_runs.join(regions.select("scene_id", "gt_id"), ["scene_id", "gt_id"], "left_semi"), pred


def roi_completion(eligible: DataFrame, instances: DataFrame, terrain: DataFrame, residual: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Coverage inside the region by accepted instances and certain, passed terrain.

    All inputs are runs already cut to the region; ``eligible`` has ignore regions removed.
    The residual is part of the unassigned share, not an addition to it. Shares are of the pixels of ``total``, by default ``eligible``.
    """
    open_ = materialize(union_runs(eligible))
    inside = lambda df: shared_pieces(union_runs(df), open_).select("scene_id", "y", "x0", "x1")
    inst, ground, rest = inside(instances), inside(terrain), inside(residual)
    out = pixel_count(open_ if total is None else union_runs(total), ["scene_id"], "eligible")
    for df, name in ((union_runs(inst.unionByName(ground)), "both"), (inst, "inst"), (rest, "rest")):
        out = out.join(pixel_count(df, ["scene_id"], name), "scene_id", "left")
    out = out.fillna(0)
    n = F.greatest(_one(), F.col("eligible"))
    return out.select("scene_id", (F.col("both") / n).alias("semantic_coverage"), (1 - F.col("both") / n).alias("unassigned_ratio"),
                      (F.col("rest") / n).alias("residual_pixel_ratio"), (F.col("inst") / n).alias("instance_pixel_ratio"),
                      ((F.col("both") - F.col("inst")) / n).alias("background_pixel_ratio"))


def completion_metrics(eligible: DataFrame, instances: DataFrame, terrain: DataFrame, residual: DataFrame, objects: DataFrame,
                       fusion_counts: DataFrame | None = None, unassigned_limit: float = 0.01, total: DataFrame | None = None) -> DataFrame:
    """Coverage, delivery counts and pipeline status per scene.

    ``objects(scene_id, base_asset_status, review_required)``; ``fusion_counts(scene_id,
    observed, merged)`` gives the dedup ratio.
    """
    cover = roi_completion(eligible, instances, terrain, residual, total)
    status = F.col("base_asset_status")
    counts = objects.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("evaluated"), *(F.count_if(status == s).alias(s) for s in ("ready", "needs_review", "rejected")),
        F.count_if(F.col("review_required")).alias("delivery_review"))
    out = cover.join(counts, "scene_id", "left").fillna(0, ["evaluated", "ready", "needs_review", "rejected", "delivery_review"])
    if fusion_counts is not None:
        out = out.join(fusion_counts, "scene_id", "left").withColumn(
            "candidate_dedup_ratio", F.coalesce("merged", F.lit(0)) / F.greatest(_one(), F.coalesce("observed", F.lit(0)))).drop("merged", "observed")
    n = F.greatest(_one(), F.col("evaluated"))
    for name in ("ready", "needs_review", "rejected"):
        out = out.withColumn(f"{name}_ratio", F.col(name) / n)
    open_work = (F.col("delivery_review") > 0) | (F.col("needs_review") > 0) | (F.col("rejected") > 0)
    return out.withColumn("pipeline_status", F.when(F.col("semantic_coverage") < 1 - unassigned_limit, "partial")
                          .when(open_work, "completed_with_review").otherwise("completed"))
