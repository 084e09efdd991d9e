"""Round monitor: the rules of ``operators.rounds`` on a stream of finished rounds."""
from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spatialqa.operators.rounds import MAX_OBJECTS, MAX_ROUNDS, MIN_GAIN, PATIENCE, TARGET

OUTPUT = "scene_id long, round long, coverage double, gain double, no_progress long, stop_reason string, continue_detection boolean"
STATE = "coverage double, streak long, objects long"


def monitor_rounds(rounds: DataFrame, *, min_gain: float = MIN_GAIN, patience: int = PATIENCE, max_rounds: int = MAX_ROUNDS,
                   target: float = TARGET, max_objects: int | None = MAX_OBJECTS) -> DataFrame:
    """Per finished round: gain, stall length, stop reason. State per scene is three numbers.

    The objects of a scene are those its rounds have accepted so far; None sets no limit to them.

    ``rounds(scene_id, round, coverage, new_accepted)``; rounds of a scene arrive in order
    across micro-batches and are sorted within one.
    """
    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        coverage, streak, objects = state.get if state.exists else (0.0, 0, 0)
        batch = pd.concat(list(frames)).sort_values("round")
        out = []
        for row in batch.itertuples():
            gain = row.coverage - coverage
            streak = streak + 1 if row.new_accepted == 0 or gain < min_gain else 0
            coverage = row.coverage
            objects += 0 if pd.isna(row.new_accepted) else int(row.new_accepted)
            crowded = max_objects is not None and objects >= max_objects
            reason = "max_rounds" if row.round >= max_rounds else "max_objects" if crowded else "no_progress" if streak >= patience else ""
            more = coverage < target and not reason
            out.append((key[0], row.round, coverage, gain, streak, reason or ("" if more else "reviewer_stop"), more))
        state.update((float(coverage), int(streak), int(objects)))
        yield pd.DataFrame(out, columns=["scene_id", "round", "coverage", "gain", "no_progress", "stop_reason", "continue_detection"])

    columns = rounds.selectExpr("cast(scene_id as long) scene_id", "cast(round as long) round", "cast(coverage as double) coverage", "cast(new_accepted as long) new_accepted")
    return columns.groupBy("scene_id").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
