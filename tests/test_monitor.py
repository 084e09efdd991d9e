"""The round monitor next to the batch rules, over several micro-batches."""
import pytest
from pyspark.sql import functions as F

from spatialqa.operators.rounds import decide_rounds, round_progress
from spatialqa.streaming.rounds import monitor_rounds

ROUNDS = {  # new objects and coverage of each round of a scene
    0: [(150, .2), (149, .3), (1, .4), (0, .4)], 1: [(300, .2), (0, .2), (0, .2)], 2: [(5, .1), (0, .1), (0, .1), (400, .3)],
    3: [(100, .5), (100, .9), (99, .91)], 4: [(10, .1)] * 2 + [(280, .2)] + [(0, .2)] * 6}


@pytest.mark.parametrize("limit", [300, 12, None])
def test_monitor_stops_as_the_batch_rules_do(spark, tmp_path, limit):
    rows = [(s, i + 1, c, n) for s, rounds in ROUNDS.items() for i, (n, c) in enumerate(rounds)]
    frame = spark.createDataFrame(rows, "scene_id long, round long, coverage double, new_accepted long")
    for lo in (0, 2, 4):
        frame.where(f"round > {lo} and round <= {lo + 2 if lo < 4 else 99}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = monitor_rounds(source, max_rounds=8, max_objects=limit)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    total = {(s, i + 1): sum(n for n, _ in rounds[:i + 1]) for s, rounds in ROUNDS.items() for i in range(len(rounds))}
    counted = spark.createDataFrame([(*k, v) for k, v in total.items()], "scene_id long, round long, objects long")
    want = decide_rounds(round_progress(frame).join(counted, ["scene_id", "round"]), F.col("objects"), max_rounds=8, max_objects=limit)
    names = ["scene_id", "round", "no_progress", "stop_reason", "continue_detection"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*names).collect())
    assert got == sorted(tuple(r) for r in want.select(*names).collect())
    assert any(r[3] == "max_objects" for r in got) == (limit is not None)
