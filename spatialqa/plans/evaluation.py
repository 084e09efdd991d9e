"""Ground-truth evaluation of all scenes in one job."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spatialqa.operators import evaluate as E
from spatialqa.operators.overlap import grid_for
from spatialqa.session import materialize


@dataclass(frozen=True)
class EvaluationConfig:
    iou_threshold: float = 0.5
    fragment_containment: float = 0.8
    fragment_min_area: float = 0.05
    small_area_ratio: float = 0.001
    large_area_ratio: float = 0.05
    boundary_tolerance: int = 2
    poor_mask_iou: float = 0.5

    def __post_init__(self) -> None:
        shares = (self.iou_threshold, self.fragment_containment, self.fragment_min_area, self.small_area_ratio, self.large_area_ratio)
        if not all(0 < v <= 1 for v in shares) or self.boundary_tolerance < 0 or not 0 <= self.poor_mask_iou <= 1:
            raise ValueError("evaluation thresholds must be shares between 0 and 1")
        if self.small_area_ratio >= self.large_area_ratio:
            raise ValueError("small objects must be smaller than large ones")


def evaluate_scenes(predictions: DataFrame, annotations: DataFrame, ignore: DataFrame, gt: DataFrame, scene_area: Column,
                    config: EvaluationConfig = EvaluationConfig()) -> dict[str, DataFrame]:
    """All detection tables of an evaluation.

    Keys: ``predictions`` (with outcome), ``ignored``, ``matches``, ``missed``, ``fragments``,
    ``scores`` per scene, ``corpus``, ``by_size``. The selected predictions are written once
    and shared by matching and fragmentation.
    """
    scored, ignored = E.select_predictions(predictions, annotations, ignore, gt=gt)
    scored, gt = materialize(scored), materialize(gt)
    grid = grid_for([scored, gt])
    matches, outcomes = E.match_gt(scored, gt, config.iou_threshold, grid=grid)
    outcomes = materialize(outcomes)
    pieces = materialize(E.fragments(scored, gt, min_area=config.fragment_min_area, containment=config.fragment_containment, grid=grid))
    return {
        "predictions": outcomes, "ignored": ignored, "matches": matches, "fragments": pieces,
        "missed": gt.join(matches.select("scene_id", "gt_id"), ["scene_id", "gt_id"], "left_anti"),
        "scores": E.detection_scores(gt, outcomes, pieces), "corpus": E.detection_scores(gt, outcomes, pieces, corpus=True),
        "by_size": E.scores_by_size(gt, matches, scene_area),
    }


def evaluate_masks(matches: DataFrame, gt_runs: DataFrame, pred_runs: DataFrame, config: EvaluationConfig = EvaluationConfig(),
                   annotations: DataFrame | None = None, ignore: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(quality per matched pair with an annotated mask, means per scene).

    ``annotations`` (with the region of interest) and ``ignore`` are those of
    ``evaluate_scenes``; only pixels inside the one and outside the other are scored.
    """
    pairs = matches.select("scene_id", "gt_id", "pred_id").join(gt_runs.select("scene_id", "gt_id").distinct(), ["scene_id", "gt_id"], "left_semi")
    if annotations is not None or ignore is not None:
        gt_runs, pred_runs = (materialize(E.evaluated_runs(r, annotations, ignore)) for r in (gt_runs, pred_runs))
    quality = E.mask_quality(pairs, gt_runs, pred_runs).join(
        E.boundary_f(pairs, gt_runs, pred_runs, config.boundary_tolerance), ["scene_id", "gt_id", "pred_id"])
    return quality, E.quality_means(quality, poor=config.poor_mask_iou)
