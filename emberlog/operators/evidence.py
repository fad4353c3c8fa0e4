"""What explains a window: triggers, primary and secondary clusters, confidence."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns, text
from ..functions.timeutil import Window as Span
from .cluster import in_window


def trigger_candidates(entries: DataFrame, window: Span, lookback: timedelta = timedelta(minutes=10), scope: str | None = None, job_id: str | None = None, top: int | None = 3) -> DataFrame:
    """The earliest trigger messages from shortly before a window to its end.

    (message, timestamp, service): one row for each distinct beginning (100 characters, then
    stripped), of it the earliest (ties by message, service). All matching entries take part.
    The pattern is a predicate of the scan; beginnings meet in a combined minimum.
    """
    t = in_window(entries, Span(window.start - lookback, window.end), scope, job_id=job_id)
    message = F.coalesce(F.nullif("normalized_message", F.lit("")), F.get_json_object("raw_message", "$.message"), "raw_message")
    found = t.select(F.substring(message, 1, 500).alias("message"), message.alias("_m"), "timestamp", "service").where(text.is_trigger(F.col("_m")))
    key = F.trim(F.substring("message", 1, 100))
    first = found.groupBy(key.alias("_k")).agg(F.min(F.struct("timestamp", "message", "service")).alias("_f")).select("_f.message", "_f.timestamp", "_f.service")
    return first if top is None else first.orderBy("timestamp", "message").limit(top)


def significant(clusters: DataFrame) -> DataFrame:
    """Of a ranked, capped list the clusters with a level that can be a cause; all, if there is none such."""
    hit = F.arrays_overlap(F.map_keys("levels"), F.array(*[F.lit(x) for x in patterns.SIGNIFICANT]))
    some = F.max("_hit").over(Window.partitionBy())
    return clusters.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_any", some).where("_hit or not _any").drop("_hit", "_any")


def roles(clusters: DataFrame, secondary: int = 4) -> DataFrame:
    """Of ranked clusters: the primary one (role 0) and the largest others (roles 1, 2, ...).

    The input is a ranked, capped list, so one window over all of it is small.
    """
    s = significant(clusters)
    by_rank = Window.orderBy(F.desc("importance_score"), F.desc("count"), "fingerprint")
    s = s.withColumn("_r", F.row_number().over(by_rank))
    by_count = Window.partitionBy(F.col("_r") > 1).orderBy(F.desc("count"), "_r")
    s = s.withColumn("role", F.when(F.col("_r") == 1, 0).otherwise(F.row_number().over(by_count)))
    return s.where(F.col("role") <= secondary).drop("_r")


def services_affected(clusters: DataFrame) -> DataFrame:
    return clusters.select(F.explode(F.map_keys("services")).alias("service")).distinct()


def confidence_points(count: Column, baseline: Column, ratio: Column, trigger: Column, secondary: Column, services: Column) -> Column:
    by_count = F.when(count >= 50, 2).when(count >= 10, 1).otherwise(0)
    by_change = F.when(baseline > 0, F.when(ratio > 10, 2).when(ratio > 3, 1).otherwise(0)).otherwise(0)
    return by_count + by_change + F.when(trigger, 2).otherwise(0) + F.when(secondary, 1).otherwise(0) + F.when(services > 1, 1).otherwise(0)


def confidence_label(points: Column, trigger: Column, primary: Column) -> Column:
    return F.when(~primary, F.lit("low")).when((points >= 5) & trigger, F.lit("high")).when(points >= 4, F.lit("medium-high")).when(points >= 2, F.lit("medium")).otherwise(F.lit("low"))


def confidence_score(label: Column) -> Column:
    return F.when(label == "high", 0.9).when(label == "medium-high", 0.72).when(label == "medium", 0.5).when(label == "low", 0.25).otherwise(0.0)
