"""Queries of tracking and motion take all of their tables."""

from reeltable.jobs import registry, tracking_queries
from reeltable.sources.views import view
from tests.compare import DATA


def test_trackers_take_all_regions(spark):
    all_regions = view(spark, DATA, "detections")
    assert all_regions.where("roi_id > 4").count() > 0
    assert tracking_queries.moving(spark, DATA).count() == all_regions.count()


def test_motion_takes_all_frames(spark):
    data = "/root/testdata/sf0.01"
    got = registry.QUERIES["motion_mask_rois"](spark, data).agg({"pts": "max"}).first()[0]
    last = view(spark, data, "frames").agg({"frame_num": "max"}).first()[0]
    assert last > 200
    assert got >= (last - 1) * 33333333
