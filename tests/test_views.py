"""Whole reports from one panel."""

import datetime as dt

from daypanel.plans import panels, views
from daypanel.session import stage
from workload import panels as P

SF = "/root/testdata/sf0.001"


def test_country_report(spark, tmp_path):
    panel = stage(P.country_enriched(spark, SF), "panel")
    got = views.publish(views.country_views(panel, P.AS_OF, P.MANUAL, ("C3",), P.OUTLIERS), str(tmp_path / "report"))
    assert len(got) == 14
    assert spark.table("current").count() >= 10
    last = {r["region"]: r["date"] for r in spark.table("trajectory").groupBy("region").agg({"date": "max"}).toDF("region", "date").collect()}
    assert {r["region"]: r["date"] for r in spark.table("trajectory_last").collect()} == last
    assert spark.table("freshness").first()["updated"] == dt.date(2024, 1, 30)
    scenario = spark.table("scenario_active")
    assert scenario.where("status = 'Prognose'").count() == panel.select("region").distinct().count() * 3 * 50


def test_district_and_snapshot_reports(spark):
    panel = stage(P.district_enriched(spark, SF), "districts")
    for df in views.district_views(panel).values():
        assert df.count() > 0
    rows = stage(panels.clean_snapshots(P.district_snapshots(spark, SF), P.DISTRICT), "snapshots")
    for df in views.publish(views.snapshot_views(rows, P.DISTRICT, P.LAST_7, P.INCIDENCE, dt.date(2024, 1, 30))).values():
        assert df.count() > 0

