"""Quality rules of objects, assets and generated candidates as expressions."""
from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Callable

from pyspark.sql import Column, functions as F

# Weights of a candidate's overall score.
WEIGHTS = {"shape": 0.20, "style": 0.20, "perspective": 0.15, "scale": 0.15, "color": 0.10, "edge": 0.10, "semantic": 0.10}
EXTRA_SCORES = ("lighting", "background_leak", "occlusion_reconstruction_quality")
FATAL = ("semantic", "shape", "style")


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def mask_score(confidence: Column, inside: Column, pixels: Column, box_area: Column, edge: Column, negatives: Column) -> Column:
    """Ranking score of a mask candidate; -1 when it is empty. ``negatives`` is the hit share of negative points."""
    one = F.lit(1).cast("bigint")
    ratio = inside / F.greatest(one, box_area)
    aligned = inside / F.greatest(one, pixels)
    leak = (pixels - inside) / F.greatest(one, pixels)
    value = 0.3 * confidence + 0.25 * F.least(ratio / 0.35, F.lit(1.0)) + 0.2 * aligned + 0.15 * edge - 0.35 * leak - 0.2 * negatives
    return F.when(pixels == 0, F.lit(-1.0)).otherwise(value)


def instance_failures(pixels: Column, box_area: Column, leak: Column, truncated: Column, uncertain: Column, element_type: Column,
                      low: float = 0.03, high: float = 1.5, max_leak: float = 0.35) -> Column:
    """Failure types of a segmented instance, in report order."""
    ratio = pixels / F.greatest(F.lit(1).cast("bigint"), box_area)
    return F.array_compact(F.array(
        F.when(pixels == 0, "BAD_MASK").when(ratio < low, "MASK_TOO_SMALL"), F.when(ratio > high, "MASK_TOO_LARGE"),
        F.when(leak > max_leak, "BACKGROUND_LEAK"), F.when(truncated, "CROSS_TILE_FRAGMENT"),
        F.when(uncertain & ~element_type.eqNullSafe(F.lit("hybrid")), "WRONG_CATEGORY")))


def base_status(error: Column, asset: Column, status: Column, qa_status: Column, flagged: Column, mask: Column,
                reevaluated: Column, previous: Column) -> Column:
    """``ready`` / ``needs_review`` / ``rejected``; a required-enhancement re-evaluation keeps the earlier value."""
    clean = status.eqNullSafe(F.lit("pass")) & qa_status.eqNullSafe(F.lit("pass")) & ~F.coalesce(flagged, F.lit(False)) & mask.isNotNull()
    return (F.when(F.coalesce(error, F.lit("")) != "", "rejected").when(F.coalesce(asset, F.lit("")) == "", "rejected")
            .when(F.coalesce(reevaluated, F.lit(False)), F.coalesce(previous, F.lit("needs_review")))
            .when(clean, "ready").otherwise("needs_review"))


def review(base: Column, required: Column, enhancement: Column, qa_reason: Column) -> Column:
    """Review struct: whether a person must look, and why."""
    failed = F.coalesce(required, F.lit(False)) & ~F.coalesce(enhancement, F.lit("")).isin("ready", "preview_only")
    return F.struct(((base != "ready") | failed).alias("required"),
                    F.when(failed, "required_enhancement").otherwise(F.coalesce(qa_reason, F.lit(""))).alias("reason"))


def repair_strategy(failures: Column, visible: Column, occluded: Column, inpaint: Column, truncated: Column, severe: float = 0.35) -> Column:
    share = occlusion_ratio(visible, occluded)
    has = lambda *names: F.arrays_overlap(F.coalesce(failures, _no_strings()), F.array(*map(F.lit, names)))
    return (F.when(has("BACKGROUND_LEAK", "BAD_MASK") | (share >= severe), "generation")
            .when(F.coalesce(inpaint, F.lit(False)) | F.coalesce(truncated, F.lit(False)) | (share > 0) | has("MASK_TOO_SMALL", "OCCLUSION"), "inpaint"))


def occlusion_ratio(visible: Column, occluded: Column) -> Column:
    seen, hidden = F.coalesce(visible, F.lit(0)), F.coalesce(occluded, F.lit(0))
    return hidden / F.greatest(F.lit(1).cast("bigint"), seen + hidden)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it; a plain expression is copied to each place."""
    return F.get(F.transform(F.array(value), body), 0)


def score_candidate(scores: Column, verdict: Column, reasons: Column, accept: float = 0.80, retry: float = 0.55) -> Column:
    """QA struct ``status, overall, reasons`` from a score map and the reviewer's verdict."""
    required = [*WEIGHTS, *EXTRA_SCORES]
    result = lambda s, o, r: F.struct(s.alias("status"), o.cast("double").alias("overall"), r.alias("reasons"))

    def read(m: Column) -> Column:
        invalid = F.exists(F.map_values(m), lambda v: F.isnan(v) | ~v.between(0.0, 1.0))
        return F.struct(invalid.alias("invalid"), *(F.try_element_at(m, F.lit(k)).alias(k) for k in required))

    def weighed(at: Column) -> Column:
        overall = sum((F.lit(w) * at[k] for k, w in WEIGHTS.items()), F.lit(0.0))
        weak = F.array_compact(F.array(*(F.when(at[k] < accept, F.lit(f"{k} mismatch")) for k in sorted(set(required) - {"background_leak"}))))
        fatal = reduce(or_, (at[k] < 0.35 for k in FATAL))
        missing = reduce(or_, (at[k].isNull() for k in required))
        return F.struct(at["invalid"].alias("invalid"), missing.alias("missing"), fatal.alias("fatal"), (at["background_leak"] > 0.08).alias("leak"),
                        overall.alias("overall"), weak.alias("weak"))

    def judged(w: Column) -> Column:
        status = (F.when(w["fatal"] | (verdict == "REJECT") | (w["overall"] < retry), "REJECT")
                  .when((verdict == "ACCEPT") & (w["overall"] >= accept) & (F.size(w["weak"]) == 0) & ~w["leak"], "ACCEPT").otherwise("RETRY"))
        why = F.concat(F.coalesce(reasons, _no_strings()), w["weak"], F.when(w["leak"], F.array(F.lit("edge background_leak"))).otherwise(_no_strings()))
        return (F.when(w["invalid"], result(F.lit("REJECT"), F.lit(0.0), F.array(F.lit("invalid QA scores"))))
                .when(w["missing"], result(F.lit("RETRY"), F.lit(0.0), F.array(F.lit("incomplete semantic/style/perspective QA"))))
                .otherwise(result(status, w["overall"], why)))

    return _bound(_bound(_bound(scores, read), weighed), judged)


def original_qa(status: Column, damaged: Column) -> Column:
    """QA of the untouched source segmentation."""
    passed = status == "pass"
    return F.struct(F.when(passed, "ACCEPT").otherwise("RETRY").alias("status"),
                    F.when(passed & F.coalesce(damaged, F.lit(False)), 0.65).when(passed, 0.80).otherwise(0.40).alias("overall"))


def upscale_factor(width: Column, height: Column) -> Column:
    return F.when(F.greatest(width, height) < 128, 4).otherwise(2)


def texture_scale(texture_width: Column, logical_width: Column) -> Column:
    return F.coalesce(texture_width, logical_width) / logical_width


def placement(x: Column, y: Column, w: Column, h: Column, pivot_x: Column, pivot_y: Column, asset_pivot_x: Column, asset_pivot_y: Column,
              z_order: Column, earlier: Column) -> Column:
    """Source placement from the crop box (or the box), pivot and an earlier placement.

    ``pivot_*`` is stored, ``asset_pivot_*`` measured on the asset; ``earlier`` is a struct
    ``center_x, center_y, anchor_x, anchor_y, scale, z_order, depth`` or null.
    """
    px = F.coalesce(pivot_x, asset_pivot_x, w / 2.0)
    py = F.coalesce(pivot_y, asset_pivot_y, h.cast("double"))
    anchor_x, anchor_y = x + px, y + py
    old = lambda name, fallback: F.coalesce(earlier.getField(name), fallback)
    own = F.when(pivot_x.isNotNull() | (F.coalesce(z_order, F.lit(0.0)) != 0.0), z_order).otherwise(anchor_y)
    return F.struct(old("center_x", x + w / 2.0).alias("center_x"), old("center_y", y + h / 2.0).alias("center_y"),
                    old("anchor_x", anchor_x).alias("anchor_x"), old("anchor_y", anchor_y).alias("anchor_y"),
                    old("scale", F.lit(1.0)).alias("scale"), old("z_order", own).alias("z_order"), old("depth", anchor_y).alias("depth"),
                    px.alias("pivot_x"), py.alias("pivot_y"))


def enhancement_status(enabled: Column, completion_open: Column, has_asset: Column, available: Column, outcome: Column, verdict: Column) -> Column:
    """Status of optional enhancement.

    ``outcome``: what the restorer reported (``preview_only``, ``pending_review``,
    ``unavailable``, ``failed``); ``verdict``: what the reviewer said of a pending one.
    """
    return (F.when(~enabled, "disabled").when(F.coalesce(completion_open, F.lit(False)) | ~has_asset | ~available, "skipped")
            .when(outcome == "pending_review", F.when(verdict.isNull(), "pending_review").when(verdict == "ACCEPT", "ready").otherwise("failed"))
            .otherwise(F.coalesce(outcome, F.lit("failed"))))
