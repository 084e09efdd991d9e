"""Queries against their SQL on a scene whose boxes reach below it, which no table up to sf0.1 holds."""
import duckdb

from spatialqa.registry import ORACLES, QUERIES


def test_prompt_points_of_a_box_below_the_scene(spark, tmp_path):
    rows = [(i, ("view", "signup", "click", "error", "buy")[i % 5]) for i in range(149600, 150000)]
    folder = tmp_path / "data"
    spark.createDataFrame(rows, "event_id long, event_type string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    base = duckdb.connect()
    base.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    want = base.sql(ORACLES["prompt_points"]).fetchall()
    found = QUERIES["prompt_points"](spark, str(folder)).collect()
    assert sorted(map(tuple, found)) == sorted(want)
