"""From raw observations to routed candidates, for all scenes at once."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from spatialqa.operators import detections as D, fusion as U
from spatialqa.operators.rounds import decide_rounds, round_progress
from spatialqa.session import materialize


@dataclass(frozen=True)
class TilingConfig:
    size: int = 1024
    overlap: float = 0.25
    scales: tuple[int, ...] = (1024, 1536)
    minimum: int = 64

    def __post_init__(self) -> None:
        if not 0 < self.overlap < 1 or self.size < self.minimum or any(s < self.minimum for s in self.scales):
            raise ValueError("tiles need an overlap between 0 and 1 and sizes of at least the minimum")


@dataclass(frozen=True)
class BudgetConfig:
    global_passes: int = 1
    tile_passes: int = 2
    categories_per_pass: int = 6
    calls: int = 2000
    retries: int = 100
    groups_per_tile: int = 4


@dataclass(frozen=True)
class DetectionConfig:
    edge: int = 12
    padding: int = 192
    redetections: int = 100
    rules: U.FusionRules = field(default_factory=U.FusionRules)


def _with_edges(entities: DataFrame, detections: DataFrame, members: DataFrame) -> DataFrame:
    """Entities with the distinct sources of their observations (at most the pass kinds)."""
    seen = members.join(detections.select("det_id", "source"), "det_id").groupBy("entity_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return entities.join(seen.withColumnRenamed("entity_id", "det_id"), "det_id", "left")


def run_detection(raw: DataFrame, allowed: list[str], scene_area: Column, children: DataFrame | None = None,
                  config: DetectionConfig = DetectionConfig()) -> dict[str, DataFrame]:
    """Validated, fused, re-observed and routed candidates.

    ``raw`` as for ``split_observations`` plus ``scene_id, det_id, seq, source, appearance``;
    ``children`` are re-observations of truncated entities (same columns plus ``parent_id``).
    The second fusion runs only when a child matched its parent. Parents are re-observed in
    the order in which the fold first kept them: complete rows first, then by confidence.
    """
    valid, invalid = D.split_observations(raw, allowed, config.edge)
    valid = materialize(valid)
    entities, members = U.fuse(valid, config.rules)
    observed, log = valid, None
    if children is not None:
        kids, bad = D.split_observations(children, allowed, config.edge)
        place = valid.select(F.col("det_id").alias("slot_id"), F.struct("is_truncated", (-F.col("confidence")).alias("less"), "seq").alias("seq"))
        cut = entities.filter("is_truncated").join(place, "slot_id")
        kids, log = D.match_redetections(kids, cut, maximum=config.redetections, overlap=config.rules.overlap)
        kids = materialize(kids)
        good = kids.filter("matched").drop("matched", "reason")
        invalid = invalid.unionByName(bad, allowMissingColumns=True).unionByName(kids.filter(~F.col("matched")).drop("matched"), allowMissingColumns=True)
        if not good.isEmpty():
            observed = valid.unionByName(good, allowMissingColumns=True)
            entities, members = U.fuse(observed, config.rules)
    routed = D.route_candidates(_with_edges(entities, observed, members), scene_area)
    return {"valid": valid, "invalid": invalid, "entities": entities, "members": members, "routed": routed,
            **({"redetections": log} if log is not None else {})}


def unfinished_scenes(rounds: DataFrame, **limits) -> DataFrame:
    """Scenes whose last round says go on: the driver loop over rounds keeps only these."""
    decided = decide_rounds(round_progress(rounds), **limits)
    last = decided.groupBy("scene_id").agg(F.max_by("continue_detection", "round").alias("more"))
    return last.filter("more").select("scene_id")
