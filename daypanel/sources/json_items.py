"""Nested page-view responses: one JSON document per title with an ``items`` array."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from daypanel.functions.dates import date_yyyymmdd

# Fixed value: the fields read from a response.
ITEMS = "items array<struct<article string, timestamp string, views bigint>>"


def read_items(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per item: the other columns of the response, article, day, views.

    No responses, or responses without items, give an empty frame with the same columns.
    """
    keep = [c for c in responses.columns if c != body]
    items = responses.select(*keep, F.inline(F.from_json(F.col(body), ITEMS)["items"]))
    return items.select(*keep, "article", date_yyyymmdd("timestamp").alias("day"), "views")


def titles_frame(spark: SparkSession, titles: Iterable[str], lang: str = "de") -> DataFrame:
    return spark.createDataFrame([(lang, t) for t in titles], "lang string, title string")


def items_by_title(responses: DataFrame, titles: DataFrame) -> DataFrame:
    """Items of the landed responses (lang, title, body) whose language and title are listed."""
    return read_items(responses.join(titles, ["lang", "title"], "left_semi"))
