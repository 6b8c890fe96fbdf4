"""Work that has to grow with the rows and to be dealt out: cases of the findings of round 3."""

import pytest
from pyspark.sql import functions as F

from trackloom.functions.geo import haversine
from trackloom.operators import match, validate
from trackloom.plans import queries
from trackloom.plans.queries import QUERIES

from .conftest import SMALL


@pytest.mark.parametrize("name", ["geo_ground_estimate", "limit_targets", "win_fill_ids", "json_validate_state", "json_validate_target", "json_validate_radar", "geo_exif", "geo_exif_plain", "geo_exif_read", "geo_restore_candidate"])
def test_dear_rows_of_a_small_file_are_dealt_out(spark, name):
    assert QUERIES[name](spark, SMALL).rdd.getNumPartitions() >= 64


def test_references_and_points_of_one_place_count_once(spark, monkeypatch):
    """Lists grow with different places, not with the rows of a place; of equal ones the first reference is matched, and no point is lost."""
    refs = spark.range(4000).selectExpr("id AS ref_idx", "35e0 + id % 2 / 1e4 AS lat", "136e0 AS lon")
    points = spark.range(3000).selectExpr("id", "CASE WHEN id < 2999 THEN 35e0 + id % 2 / 1e4 END AS lat", "136e0 AS lon")

    def too_many(*_):
        raise AssertionError("4,000 references of two places aren't a dense cell")

    monkeypatch.setattr(match, "nearest_in_parts", too_many)
    found = match.match_references(points, refs, 500.0, distance=haversine).selectExpr("id", "match.ref_idx AS r").collect()
    assert sorted(found) == [(k, k % 2) if k < 2999 else (k, None) for k in range(3000)]


@pytest.mark.parametrize("name", ["agg_has_any", "set_union_layers", "pred_scope", "pred_selected", "agg_model_names", "sink_dirty_only"])
def test_lists_of_tables_pass_no_driver(spark, name):
    assert "Broadcast" not in QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_ids_and_numbers_of_valid_targets(spark):
    """The lean forms agree with the whole operator, also for missing, broken and null targets and beyond the limit."""
    item = lambda yaw, own: f'{{"target_yaw_to_camera_heading": {yaw}, "id": {own}, "x_ratio": "x"}}'
    texts = ['{"targets": [' + ", ".join([item('"10"', "null"), item('"x"', "4"), "null", item('"-5"', "7"), *[item('"1"', '"0"')] * 120]) + "]}", '{"targets": []}', "{}", "broken"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(validate.parse_document(F.col("t"))["targets"].alias("x"))
    found = rows.select(validate.targets(F.col("x"))["id"].alias("whole"), validate.target_ids(F.col("x")).alias("ids"), F.size(validate.valid_targets(F.col("x"))).alias("n")).collect()
    assert [r.whole for r in found] == [r.ids for r in found] and [r.n for r in found] == [98, 0, 0, 0]
    assert found[0].ids == [1, 7, *range(3, 99)]


def test_sums_of_places_beyond_a_bigint_are_whole(spark, monkeypatch):
    rows = spark.range(6).selectExpr("'v' AS video", "id % 2 AS frame", "CASE WHEN id % 2 = 0 THEN 4611686018427387904 ELSE id END AS pos")
    monkeypatch.setattr(queries, "fitting", lambda *_: rows)
    assert sorted((r.frame, r.n, int(r.sum_pos)) for r in QUERIES["pred_projection_match"](spark, SMALL).collect()) == [(0, 3, 3 * 2**62), (1, 3, 9)]
    monkeypatch.setattr(queries, "fitting", lambda *_: rows.where("frame = 1"))
    assert dict(QUERIES["pred_projection_match"](spark, SMALL).dtypes)["sum_pos"] == "bigint"
