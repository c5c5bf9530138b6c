"""The mining stream assigns every event, as the batch does, whatever the session's zone."""

import os

import pytest

from timberline.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_every_event_is_assigned(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # Templates are the same for each whole-word cluster when it is trained and at the end.
        want = sorted((r.event_id, r.template_id_final) for r in QUERIES["drain_assignments"](spark, SF).collect())
        got = sorted((r.event_id, r.template_id_at_train) for r in QUERIES["stream_drain"](spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want
