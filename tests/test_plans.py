"""Physical plans: shuffles, sorts, pushdown, no Python workers."""

import re

import pytest
from pyspark.sql import functions as F

from daypanel.operators import select, stats
from daypanel.operators.metrics import enrich_panel
from workload import panels as P
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(pattern: str, text: str) -> int:
    return len(re.findall(pattern, text))


@pytest.fixture(scope="module")
def long(spark):
    df = spark.createDataFrame([("R", None, 1.0, 0.0, 0.0)], "region string, date date, conf double, dea double, rec double")
    return df


def test_enrichment_has_two_shuffles_one_sort(long):
    text = plan(enrich_panel(long))
    assert count(r"Exchange hashpartitioning", text) == 2
    assert count(r"\bSort \[", text) == 1
    assert count(r"\bWindow \[", text) == 2
    assert "partial_sum" in text


def test_last_rows_are_limited_before_the_shuffle(long):
    for df in (select.top_n_per(long, "region", 3, "date"), select.last_rows(long, "region", 10, "date")):
        text = plan(df)
        assert count("WindowGroupLimit", text) == 2
        assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_trend_shuffles_once(long):
    assert count("Exchange hashpartitioning", plan(stats.trend_class(long, "region", "date", "conf"))) == 1


def test_top_k_takes_the_threshold_per_task(long):
    text = plan(select.top_k_ties(long, 10, "conf"))
    assert "TakeOrderedAndProject" in text and "Window" not in text and "SinglePartition" not in text.split("Subquery")[0]


def test_null_safe_join_is_an_equi_join(spark):
    from daypanel.operators.joins import join_null_safe

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a = spark.range(5).selectExpr("cast(id as string) k", "id")
        text = plan(join_null_safe(a, a.withColumnRenamed("id", "x"), ["k"]))
        assert "SortMergeJoin" in text and "NestedLoop" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_panels_with_a_small_file_are_not_broadcast(spark):
    from daypanel.operators.joins import join_natural, join_suffixed
    from daypanel.plans.panels import COUNTRY_KEY, join_measures
    from daypanel.session import stage

    # Each series is flat, so the file holds a few bits a row.
    user, day = F.expr("id div 500"), F.expr("date_add(date'2020-01-01', cast(id % 500 as int))")
    flat = spark.range(100_000, numPartitions=2).select(
        F.when(user > 9, F.concat(F.lit("P"), user)).alias("Province/State"), F.concat(F.lit("C"), user % 10).alias("Country/Region"),
        F.lit(1.0).alias("Lat"), F.lit(2.0).alias("Long"), day.alias("date"), F.lit(7.0).alias("conf"),
    )
    conf = stage(flat, "flat")
    dea, rec = [conf.where(F.col("Country/Region") != gone).withColumnRenamed("conf", x) for x, gone in (("dea", "C1"), ("rec", "C2"))]
    got = join_measures(conf, dea, rec)
    counts = [F.count(x) for x in ("conf", "dea", "rec")]
    assert got.agg(F.count(F.lit(1)), *counts).first() == (100_000, 100_000, 90_000, 90_000)
    natural = join_measures(conf, dea, rec, natural=True)
    assert natural.agg(F.count(F.lit(1)), *counts).first() == (100_000, 100_000, 90_000, 90_000)
    both = join_suffixed(conf, conf, COUNTRY_KEY, ("_1", "_2"))
    for joined, n in ((got, 2), (natural, 2), (both, 1), (join_natural(conf, rec), 1)):
        text = plan(joined)
        assert count(r"\bSortMergeJoin ", text) == n and "Broadcast" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(P.country_enriched(spark, SF).select("region", "conf"))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {"ts:timestamp_ntz", "ts:timestamp_ntz,user_id:bigint"}


UNSTAGED = ("enrich_country", "enrich_district", "trend_class", "running_sum_strict", "sum_strict_country", "topn_per_region", "ratio_by_band", "ratio_two_dims")


@pytest.mark.parametrize("name", UNSTAGED + ("html_tables_pages", "loess_rate", "scenario_recurrent", "report_totals", "ordinal_before_filter"))
def test_no_pair_joins_and_python_only_for_pages(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert ("Python" in text or "UDTF" in text) == (name == "html_tables_pages")


def test_country_panel_joins_wide_and_unpivots_once(spark):
    from daypanel.plans.panels import join_wide

    ids = "`Province/State` string, `Country/Region` string, Lat double, Long double, `1/22/20` string, `1/23/20` string"
    wide = [spark.createDataFrame([(None, "X", 1.0, 2.0, str(i), str(i))], ids) for i in range(3)]
    lines = plan(join_wide(*wide)).split("\n")
    generate = [i for i, x in enumerate(lines) if "Generate" in x]
    joins = [i for i, x in enumerate(lines) if "Join" in x]
    assert len(generate) == 1 and len(joins) == 2 and generate[0] < min(joins)
