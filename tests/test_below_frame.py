"""Two shapes of six million reach one row below the frame; the SQL counts their pixels there."""
import duckdb
import pytest

import oracle

#: A scene with both, its ids as they are at 60 times sf0.1.
SCENE = 8734


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("below")
    kinds = "case i % 5 when 0 then 'view' when 1 then 'signup' when 2 then 'click' when 3 then 'error' else 'buy' end"
    duckdb.execute(f"copy (select i as event_id, {kinds} as event_type from range({SCENE * 400}, {SCENE * 400 + 400}) t(i)) to '{out}/events.parquet' (format parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["union_coverage", "ownership_summary", "roi_completion", "completion_metrics"])
def test_pixels_below_the_frame_count_as_in_the_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    assert oracle.compare(spark, con, folder, name).startswith("ok")
