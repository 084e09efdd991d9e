"""Observation checks, routing, archive matching and id assignment."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spatialqa.functions import taxonomy
from spatialqa.functions.boxes import Box, expand, iou, pair_geometry, restore_box, truncated_edges
from spatialqa.operators.nms import independent_rows
from spatialqa.operators.ordered import first_per, running, top_k
from spatialqa.operators.overlap import overlap_join, suffixed


def split_observations(raw: DataFrame, allowed: list[str], edge: int = 12) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) observations; the invalid ones keep a ``reason``.

    ``raw(label, confidence double, bbox array<double>, bbox_format, coordinate_space,
    wx0, wy0, wx1, wy1, width, height, ...)``. A null format means corners.
    """
    window = Box.corners(F.col("wx0"), F.col("wy0"), F.col("wx1"), F.col("wy1"))
    names = [taxonomy.canonical(c) for c in allowed]
    spelled = F.regexp_replace("label", " ", "_")
    category = F.coalesce(taxonomy.normalize_category(F.col("label")), F.when(spelled.isin(*names), spelled))
    score = F.col("confidence")
    bad_score = score.isNull() | F.isnan(score) | ~score.between(0.0, 1.0)
    at = lambda i: F.get("bbox", F.lit(i))
    form = F.coalesce("bbox_format", F.lit("xyxy"))
    space = F.coalesce("coordinate_space", F.lit("pixel"))
    corners = (F.when((form == "xywh") & (F.size("bbox") == 4), F.array(at(0), at(1), at(0) + at(2), at(1) + at(3)))
               .when(form == "xyxy", F.col("bbox")))
    usable = form.isin("xyxy", "xywh") & space.isin("pixel", "normalized")
    out = (raw.withColumn("category", category)
           .withColumn("_box", F.when(usable, restore_box(corners, window, space == "normalized"))))
    reason = (F.when(bad_score, "invalid_confidence").when(F.col("_box").isNull(), "invalid_bbox")
              .when(F.col("category").isNull(), "category_unknown"))
    box = Box(*(F.col(f"_box.{k}") for k in "xywh"))
    out = out.withColumn("reason", reason)
    edges = truncated_edges(box, window, F.col("width"), F.col("height"), edge)
    valid = (out.filter(F.col("reason").isNull()).select("*", *box.columns())
             .withColumn("grp", taxonomy.category_group(F.col("category")))
             .withColumn("subtype", F.when(F.col("category").contains("_"), F.col("category")))
             .withColumn("truncated_edges", edges).withColumn("is_truncated", F.size("truncated_edges") > 0)
             .drop("reason", "_box"))
    invalid = (out.filter(F.col("reason").isNotNull())
               .withColumn("category", F.coalesce("category", "label"))
               .withColumn("confidence", F.when(F.col("reason") != "invalid_confidence", score)).drop("_box"))
    return valid, invalid


def size_threshold(area: Column, scene_area: Column, small: float = 0.25, default: float = 0.4, large: float = 0.5,
                   small_ratio: float = 0.001, large_ratio: float = 0.05) -> Column:
    ratio = area / scene_area
    return F.when(ratio < small_ratio, small).when(ratio >= large_ratio, large).otherwise(default)


def route_candidates(df: DataFrame, scene_area: Column) -> DataFrame:
    """Adds ``is_kept, is_review, reject_reason, review_reason``.

    ``df`` carries a box, ``confidence``, ``category``, ``is_truncated`` and ``sources``
    (the distinct sources of its observations).
    """
    area = Box.of().area
    empty = area <= 0
    cut = ~empty & F.col("is_truncated")
    low = ~empty & ~cut & (F.col("confidence") < size_threshold(area, scene_area))
    protected = F.col("category").isin(*taxonomy.SMALL) & F.arrays_overlap("sources", F.array(F.lit("tile"), F.lit("redetection")))
    return (df.withColumn("reject_reason", F.when(empty, "invalid_bbox").when(low & ~protected, "low_confidence"))
            .withColumn("review_reason", F.when(cut, "unresolved_truncation").when(low & protected, "low_confidence_small_object"))
            .withColumn("is_review", F.col("review_reason").isNotNull())
            .withColumn("is_kept", F.col("reject_reason").isNull() & ~cut))


def small_object_report(kept: DataFrame, scene_area: Column, keys: list[str] = ["scene_id"], ratio: float = 0.001) -> DataFrame:
    """Retained small boxes and which passes saw them."""
    small = Box.of().area < scene_area * F.lit(ratio)
    seen = lambda s: F.array_contains("sources", s)
    return kept.filter(small).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("small_objects"), F.count_if(seen("global")).alias("by_global"),
        F.count_if(seen("tile")).alias("by_tile"), F.count_if(~seen("global")).alias("tile_only"))


def classify_elements(df: DataFrame, scene_area: Column, keys: list[str] = ["scene_id"]) -> DataFrame:
    """Element type, layer group, painting priority and uncertainty of each object."""
    out = (df.withColumn("_raw", F.col("category"))
           .withColumn("category", F.regexp_replace(F.lower(F.trim("category")), " ", "_")))
    category = F.col("category")
    # Named columns first, so that the long membership tests are evaluated once per row.
    out = (out.withColumn("grp", taxonomy.category_group(category)).withColumn("terrain_class", taxonomy.terrain_class(category))
           .withColumn("_hybrid", category.isin(*taxonomy.HYBRID)).withColumn("area_ratio", Box.of().area / scene_area))
    grp, area, terrain, hybrid = F.col("grp"), F.col("area_ratio"), F.col("terrain_class"), F.col("_hybrid")
    kind = (F.when(terrain.isNotNull(), "terrain").when(hybrid, "hybrid").when(grp == "fx_environment", "effect").otherwise("instance"))
    layer = (F.when(terrain.isNotNull(), "base_terrain").when(hybrid, "large_object").when(grp == "fx_environment", "foreground_effect")
             .when(category.isin(*taxonomy.CHARACTERS), "character").when(grp == "vegetation", "vegetation")
             .when(category.isin(*taxonomy.BUILDINGS), "building")
             .when((area < 0.01) | grp.isin("prop", "cultivation_prop", "graveyard"), "small_object").otherwise("large_object"))
    counts = out.groupBy(*keys, "_raw").agg(F.count(F.lit(1)).alias("repeats"))
    priority = F
    for name, value in taxonomy.PRIORITY.items():
        priority = priority.when(F.col("layer_group") == name, value)
    scored = F.col("classification_confidence") if "classification_confidence" in df.columns else F.lit(None).cast("double")
    unclear = (grp == "other") & terrain.isNull() & (F.col("layer_group") != "character") & ~(F.coalesce(scored, F.lit(0.0)) != 0.0)
    return (out.withColumn("element_type", kind).withColumn("layer_group", layer)
            .withColumn("uncertain", (F.col("element_type") == "hybrid") | unclear)
            .withColumn("requires_individual_export", F.col("element_type") != "terrain")
            .withColumn("requires_inpainting", F.col("element_type").isin("terrain", "hybrid"))
            .withColumn("hybrid_components", F.when(F.col("element_type") == "hybrid", F.array(
                F.concat(category, F.lit("_base")), F.concat(category, F.lit("_structure")))).otherwise(F.array().cast("array<string>")))
            .withColumn("ownership_priority", priority.otherwise(F.lit(None).cast("int")))
            .join(counts, [*keys, "_raw"]).drop("_raw", "_hybrid"))


def layer_plan(categories: DataFrame, keys: list[str] = ["scene_id"]) -> DataFrame:
    """Layers a scene uses, renumbered; ``categories(scene_id, category, seq)``.

    One row per (scene, category): vocabulary-sized groups, ordered lists inside.
    """
    once = first_per(categories, [*keys, "category"], [F.col("seq")])
    names = list(taxonomy.MEMBERS)
    index = F.coalesce(taxonomy.layer_of(F.col("category")), F.lit(len(names)))
    label = F.get(F.array(*map(F.lit, [*names, "other"])), F.col("_layer"))
    grouped = once.withColumn("_layer", index).groupBy(*keys, "_layer").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "category"))), lambda s: s["category"]).alias("categories"))
    place = Window.partitionBy(*keys).orderBy("_layer")
    return grouped.withColumn("layer", label).withColumn("layer_order", F.row_number().over(place) - 1).drop("_layer")


def extend_layers(plan: DataFrame, detected: DataFrame, keys: list[str] = ["scene_id"]) -> DataFrame:
    """Categories seen by the detector but absent from the plan join the layer named like their group."""
    listed = plan.select(*keys, F.explode("categories").alias("category"), "layer", "layer_order")
    known = listed.select(*keys, "category")
    fresh = first_per(detected.select(*keys, "category", "seq"), [*keys, "category"], [F.col("seq")]).join(known, [*keys, "category"], "left_anti")
    grown = fresh.withColumn("layer", taxonomy.category_group(F.col("category")))
    first = grown.groupBy(*keys, "layer").agg(F.min("seq").alias("_first"),
                                              F.transform(F.array_sort(F.collect_list(F.struct("seq", "category"))), lambda s: s["category"]).alias("_more"))
    joined = plan.join(first, [*keys, "layer"], "full_outer")
    place = Window.partitionBy(*keys).orderBy(F.coalesce("layer_order", F.lit(1 << 30)), "_first")
    return joined.select(*keys, "layer", (F.row_number().over(place) - 1).alias("layer_order"),
                         F.concat(F.coalesce("categories", F.array().cast("array<string>")),
                                  F.coalesce("_more", F.array().cast("array<string>"))).alias("categories"))


def archive_matches(new: DataFrame, archive: DataFrame, keys: list[str] = ["scene_id", "category"], threshold: float = 0.5,
                    ident: str = "det_id", old: str = "object_id") -> DataFrame:
    """Per new row with a match: ``any_passed`` and the id of the best match.

    ``archive(object_id, status, seq, box)``. Copies of a box collapse on both sides
    before the join: they match the same rows with the same overlap.
    """
    shape = [*keys, *"xywh"]
    olds = archive.groupBy(*shape).agg(F.max(F.col("status") == "pass").alias("passed"),
                                       F.min(F.struct("seq", old)).alias("first"))
    shapes = new.select(*shape).distinct()
    pairs = overlap_join(shapes, olds, keys, iou(suffixed("a"), suffixed("b")) > threshold)
    best = F.max_by("first_b", F.struct(iou(suffixed("a"), suffixed("b")).alias("i"), (-F.col("first_b.seq")).alias("s")))
    found = (pairs.groupBy(*keys, *(F.col(f"{k}_a").alias(k) for k in "xywh"))
             .agg(F.max("passed_b").alias("any_passed"), best.alias("_best")))
    return new.join(found, shape).select(*keys, ident, "any_passed", F.col(f"_best.{old}").alias("matched_id"))


def dedup_against_archive(new: DataFrame, archive: DataFrame, keys: list[str] = ["scene_id", "category"], threshold: float = 0.5,
                          ident: str = "det_id", old: str = "object_id") -> DataFrame:
    """Adds ``matched_id`` and ``reject_reason`` (``duplicate_archived`` / ``duplicate_assigned``)."""
    found = archive_matches(new, archive, keys, threshold, ident, old).select(ident, "any_passed", "matched_id")
    out = new.join(found, ident, "left")
    first = (out.filter(F.col("matched_id").isNotNull() & ~F.col("any_passed"))
             .groupBy(keys[0], "matched_id").agg(F.min("seq").alias("_first")))
    out = out.join(first, [keys[0], "matched_id"], "left")
    reason = (F.when(F.col("any_passed"), "duplicate_archived")
              .when(F.col("matched_id").isNotNull() & (F.col("seq") > F.col("_first")), "duplicate_assigned"))
    return out.withColumn("reject_reason", reason).drop("any_passed", "_first")


def cap_objects(df: DataFrame, existing: DataFrame, maximum: int, keys: list[str] = ["scene_id"]) -> DataFrame:
    """Admit rows in ``seq`` order until a scene holds ``maximum`` ids; only ``is_new`` rows count.

    ``existing(scene_id, existing)`` is the number of ids already used.
    """
    ranked = running(df, keys, "seq", {"_new": ("sum", F.col("is_new").cast("bigint"))})
    room = F.lit(maximum) - F.coalesce("existing", F.lit(0))
    over = F.col("is_new") & (F.col("_new") > room)
    return (ranked.join(existing, keys, "left")
            .withColumn("reject_reason", F.when(over, "max_objects")).drop("_new", "existing"))


def slug(category: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(category, "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(text == "", "object").otherwise(text)


def assign_ids(new: DataFrame, used: DataFrame, keys: list[str] = ["scene_id"]) -> DataFrame:
    """``object_id`` = slug and the n-th number free in the scene, n counting rows in ``seq`` order.

    A used number ``u`` that is the i-th of its slug leaves ``u - i`` free numbers below it,
    so the n-th free number is n plus the used ones with ``u - i < n``: one running sum over
    both tables, no list of numbers is ever built.
    """
    group = [*keys, "_slug"]
    fresh = running(new.withColumn("_slug", slug(F.col("category"))), group, "seq", {"_n": ("count", F.lit(1))})
    taken = (used.select(*keys, F.regexp_extract("object_id", r"^(.*)_(\d{3,})$", 1).alias("_slug"),
                         F.regexp_extract("object_id", r"^(.*)_(\d{3,})$", 2).alias("_digits"))
             .filter((F.col("_digits") != "") & ((F.length("_digits") == 3) | ~F.col("_digits").startswith("0")))
             .select(*keys, "_slug", F.col("_digits").cast("bigint").alias("_u")).filter("_u > 0").distinct())
    taken = running(taken, group, "_u", {"_i": ("count", F.lit(1))})
    # Even positions hold used numbers, odd ones rows, so a used number sorts just before its row.
    marks = taken.select(*group, (2 * (F.col("_u") - F.col("_i") + 1)).alias("_at"), F.lit(1).alias("_used"), F.lit(None).cast("bigint").alias("_n"))
    rows = fresh.select(*group, (2 * F.col("_n") + 1).alias("_at"), F.lit(0).alias("_used"), "_n")
    merged = running(marks.unionByName(rows), group, "_at", {"_skip": ("sum", F.col("_used"))})
    number = merged.filter(F.col("_n").isNotNull()).select(*group, "_n", (F.col("_n") + F.col("_skip")).alias("_number"))
    text = F.col("_number").cast("string")
    return (fresh.join(number, [*group, "_n"])
            .withColumn("object_id", F.concat("_slug", F.lit("_"), F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit("0"))))
            .drop("_slug", "_n", "_number"))


def match_redetections(children: DataFrame, parents: DataFrame, ident: str = "det_id", maximum: int = 100,
                       keys: list[str] = ["scene_id"], overlap: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(children with ``matched``/``reason``, parents with ``status``).

    Only the first ``maximum`` truncated parents of a scene are re-observed.
    """
    chosen = top_k(parents, keys, [F.col("seq")], maximum).select(*parents.columns, F.lit(True).alias("_within"))
    base = chosen.select(*keys, F.col(ident).alias("parent_id"), F.col("category").alias("_pc"), *(F.col(k).alias(f"_p{k}") for k in "xywh"))
    joined = children.join(base, [*keys, "parent_id"], "left")
    geo = pair_geometry(Box(*(F.col(f"_p{k}") for k in "xywh")), Box.of())
    hit = ((F.col("category") == F.col("_pc")) & (geo["overlap"] >= overlap) & (geo["distance"] <= 1.25) & (geo["ratio"] >= 0.1))
    kids = (joined.withColumn("matched", F.coalesce(hit, F.lit(False)))
            .withColumn("reason", F.when(~F.col("matched"), "redetection_unmatched")).drop("_pc", *(f"_p{k}" for k in "xywh")))
    good = kids.filter("matched").groupBy(*keys, F.col("parent_id").alias(ident)).agg(F.max(~F.col("is_truncated")).alias("_done"))
    tried = parents.join(chosen.select(*keys, ident, "_within"), [*keys, ident], "left").join(good, [*keys, ident], "left")
    status = (F.when(F.col("_within").isNull(), "budget_exhausted").when(F.col("_done"), "recovered").otherwise("unresolved"))
    return kids, tried.withColumn("status", status).drop("_within", "_done")


def accept_recovered(found: DataFrame, known: DataFrame, keys: list[str] = ["scene_id", "category"], minimum: float = 0.35,
                     threshold: float = 0.4, ident: str = "det_id") -> DataFrame:
    """Recovered boxes that are sure, complete and not a repeat of a known or earlier accepted box."""
    usable = found.filter((F.col("confidence") >= minimum) & ~F.col("is_truncated"))
    clash = iou(suffixed("a"), suffixed("b")) > threshold
    shapes = known.select(*keys, *"xywh").distinct()
    repeats = overlap_join(usable.select(*keys, ident, *"xywh"), shapes, keys, clash).select(F.col(f"{ident}_a").alias(ident)).distinct()
    fresh = usable.join(repeats, ident, "left_anti")
    unique = first_per(fresh.select(*keys, ident, "seq", *"xywh"), [*keys, *"xywh"], [F.col("seq")])
    kept = independent_rows(unique, keys, [F.col("seq")], ident, lambda a, b: iou(a, b) > threshold)
    return found.join(kept, ident, "left_semi")


def remaining_proposals(proposals: DataFrame, objects: DataFrame, threshold: float = 0.4, scene: str = "scene_id",
                        ident: str = "proposal_id") -> DataFrame:
    """Proposals no passed object of the same category explains."""
    named = proposals.withColumn("_category", F.regexp_replace(F.lower("category"), " ", "_"))
    passed = objects.filter(F.col("status") == "pass").select(scene, F.col("category").alias("_category"), *"xywh").distinct()
    hits = overlap_join(named.select(scene, "_category", ident, *"xywh"), passed, [scene, "_category"], iou(suffixed("a"), suffixed("b")) > threshold)
    return proposals.join(hits.select(F.col(f"{ident}_a").alias(ident)).distinct(), ident, "left_anti")


def region_key(category: Column, box: Box) -> Column:
    name = F.regexp_replace(F.lower(F.coalesce(category, F.lit(""))), " ", "_")
    return F.concat_ws("|", name, *(v.cast("string") for v in box))


def recovery_worklist(regions: DataFrame, attempts: DataFrame, cap: int = 12, retries: int = 2, scene: str = "scene_id") -> DataFrame:
    """First ``cap`` regions of a scene, one per region key, that still have attempts left.

    ``regions(scene_id, kind_order, seq, category, box)``; ``attempts(scene_id, region_key, action)``.
    """
    keyed = regions.withColumn("region_key", region_key(F.col("category"), Box.of()))
    listed = top_k(keyed, [scene], [F.col("kind_order"), F.col("seq")], cap)
    once = first_per(listed, [scene, "region_key"], [F.col("kind_order"), F.col("seq")])
    tried = attempts.filter(F.col("action") == "local_detection").groupBy(scene, "region_key").agg(F.count(F.lit(1)).alias("_n"))
    out = once.join(tried, [scene, "region_key"], "left").withColumn("attempt", F.coalesce("_n", F.lit(0))).drop("_n")
    return out.filter(F.col("attempt") < retries).select(*keyed.columns, "attempt")


def accept_fragment(children: DataFrame, parents: DataFrame, ident: str = "object_id", minimum: float = 0.35,
                    overlap: float = 0.7, similarity: float = 0.8) -> DataFrame:
    """Best complete re-observation of each fragment that scores higher with fewer failures.

    ``parents(object_id, category, box, appearance, score, failures)``; ``children`` add
    ``parent_id, seq, is_truncated, confidence``. Later equal scores do not replace.
    """
    from spatialqa.functions.boxes import appearance_similarity
    p = parents.select(F.col(ident).alias("parent_id"), *(F.col(c).alias(f"_p_{c}") for c in ["category", *"xywh", "appearance", "score", "failures"]))
    joined = children.join(p, "parent_id")
    geo = pair_geometry(Box.of(prefix="_p_"), Box.of())
    alike = appearance_similarity(F.col("_p_appearance"), F.col("appearance"))
    good = ((F.col("category") == F.col("_p_category")) & ~F.col("is_truncated") & (geo["overlap"] >= overlap)
            & (geo["distance"] <= 1.25) & (geo["ratio"] >= 0.1) & (alike >= similarity) & (F.col("confidence") >= minimum)
            & (F.col("score") > F.col("_p_score") + 1e-6) & (F.col("failures") < F.col("_p_failures")))
    return first_per(joined.filter(good).select(*children.columns), ["parent_id"], [-F.col("score"), F.col("seq")])


def object_limit(rows: DataFrame, keys: list[str] = ["scene_id"]) -> DataFrame:
    """How many objects the cap cut; ``rows`` carry ``reject_reason``."""
    dropped, kept = F.col("reject_reason") == "max_objects", F.col("reject_reason").isNull()
    return rows.groupBy(*keys).agg(F.count_if(dropped | kept).alias("objects_before_limit"), F.count_if(kept).alias("objects_after_limit"),
                                   (F.count_if(dropped) > 0).alias("truncated"))


def to_objects(candidates: DataFrame) -> DataFrame:
    """Candidate rows as scene objects: merged when more than one observation supports them."""
    return (candidates.withColumn("source_candidates", F.transform("observations", lambda o: o["id"]))
            .withColumn("merged", F.size("observations") > 1))
