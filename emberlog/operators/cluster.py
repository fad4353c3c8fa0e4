"""Clusters of log entries by fingerprint, ranked against a baseline."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.timeutil import Window, baseline_window


def in_window(entries: DataFrame, window: Window, scope: str | None = None, service: str | None = None, environment: str | None = None, job_id: str | None = None) -> DataFrame:
    """Entries of a closed window, with the optional filters. All reach the scan as predicates."""
    t = entries.where(F.col("timestamp").between(F.lit(window.start), F.lit(window.end)))
    for column, value in (("scope", scope), ("service", service), ("environment", environment), ("ingestion_job_id", job_id)):
        if value is not None:
            t = t.where(F.col(column) == value)
    return t


def histogram(entries: DataFrame, column: str) -> DataFrame:
    """(fingerprint, column, n): how often each filled value occurs in a cluster."""
    return entries.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy("fingerprint", column).agg(F.count("*").alias("n"))


def change_ratio(count: Column, baseline: Column) -> Column:
    return (count + 1).cast("double") / (baseline + 1)


def importance(severity: Column, count: Column, ratio: Column, services: Column, trigger: Column) -> Column:
    """Severity, volume, change, spread and closeness to a trigger, the middle three on a log scale."""
    return severity + F.log(count + 1) + F.log(ratio + 1) + 0.5 * F.log(services + 1) + F.when(trigger, 2.0).otherwise(0.0)


def severity(levels: Column) -> Column:
    """Mean weight of a level histogram; 1 if it is empty."""
    total = F.aggregate(F.map_values(levels), F.lit(0).cast("bigint"), lambda a, x: a + x)
    weighed = F.aggregate(F.map_entries(levels), F.lit(0.0), lambda a, e: a + text.severity_weight(e["key"]) * e["value"])
    return F.when(total > 0, weighed / total).otherwise(F.lit(1.0))


def baseline_counts(entries: DataFrame, window: Window, length: timedelta, scope: str | None = None, service: str | None = None, environment: str | None = None) -> DataFrame:
    """(fingerprint, baseline_count) of the time before a window."""
    t = in_window(entries, baseline_window(window, length), scope, service, environment)
    return t.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("baseline_count"))


def rank(clusters: DataFrame, top: int | None) -> DataFrame:
    ordered = clusters.orderBy(F.desc("importance_score"), F.desc("count"), "fingerprint")
    return ordered if top is None else ordered.limit(top)


def clusters(
    entries: DataFrame,
    window: Window,
    baseline: timedelta = timedelta(hours=24),
    scope: str | None = None,
    service: str | None = None,
    environment: str | None = None,
    job_id: str | None = None,
    top: int | None = 50,
    sample_ids: int = 100,
) -> DataFrame:
    """Clusters of a window with histograms, baseline and importance, most important first.

    One scan and one shuffle of the entries serve everything: they are pre-aggregated by
    (fingerprint, service, level, message, hash bucket of the id), with counts inside the
    window and inside the baseline, so that a fingerprint that holds most entries costs no task
    more than its distinct values. What follows works on those few rows: each is laid out as a
    part of the total, of a message, a service, a level and a bucket, and added up by them.
    The message of a cluster is its most frequent one, ties to the smallest. Given a job, the
    baseline is empty. `log_entry_ids` holds a sample of up to `sample_ids`, one a bucket.
    """
    span = window if job_id is not None else Window(baseline_window(window, baseline).start, window.end)
    t = in_window(entries, span, scope, service, environment, job_id).where("fingerprint is not null")
    at = F.col("timestamp")
    inside = at.between(F.lit(window.start), F.lit(window.end))
    before = F.lit(False) if job_id is not None else at <= F.lit(window.start)
    bucket = F.pmod(F.xxhash64("id"), F.lit(sample_ids)).cast("string")
    fine = t.groupBy("fingerprint", "service", "level", F.coalesce("normalized_message", F.lit("")).alias("message"), bucket.alias("bucket")).agg(
        F.count_if(inside).alias("n"), F.count_if(before).alias("b"), F.min(F.when(inside, at)).alias("first"), F.max(F.when(inside, at)).alias("last"), F.min(F.when(inside, F.col("id"))).alias("id")
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in (("total", F.lit("")), ("message", F.col("message")), ("service", F.col("service")), ("level", F.col("level")), ("bucket", F.col("bucket")))])
    parts = fine.select("fingerprint", "n", "b", "first", "last", "id", F.inline(kinds)).where("kind = 'total' or n > 0")
    parts = parts.where("kind in ('total', 'message') or coalesce(key, '') <> ''").groupBy("fingerprint", "kind", "key")
    parts = parts.agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("id").alias("id"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    n = F.col("n")
    histogram_of = lambda kind: F.map_from_entries(F.sort_array(F.collect_list(of(kind, F.struct("key", "n")))))
    t = parts.groupBy("fingerprint").agg(
        F.min(of("message", F.struct((-n).alias("_m"), "key")))["key"].alias("representative_message"),
        F.max(of("total", n)).alias("count"),
        histogram_of("service").alias("services"),
        histogram_of("level").alias("levels"),
        F.min(of("total", F.col("first"))).alias("first_seen"),
        F.max(of("total", F.col("last"))).alias("last_seen"),
        F.max(of("total", F.col("b"))).alias("baseline_count"),
        F.sort_array(F.collect_list(of("bucket", F.col("id")))).alias("log_entry_ids"),
    )
    t = t.where("count > 0").withColumn("is_trigger", F.lit(False)).withColumn("change_ratio", change_ratio(F.col("count"), F.col("baseline_count")))
    t = t.withColumn("importance_score", importance(severity(F.col("levels")), F.col("count"), F.col("change_ratio"), F.size("services"), F.col("is_trigger")))
    columns = ["fingerprint", "representative_message", "count", "services", "levels", "first_seen", "last_seen", "baseline_count", "change_ratio", "importance_score", "is_trigger", "log_entry_ids", F.array().cast("array<string>").alias("merged_fingerprints")]
    return rank(t.select(columns), top)


def cluster_rows(ranked: DataFrame, run_id: str, members: int = 100) -> tuple[DataFrame, DataFrame]:
    """Tables of a stored run: its clusters, and up to `members` entries of each."""
    c = ranked.withColumn("run_id", F.lit(run_id)).withColumn("representative_message", F.substring("representative_message", 1, 2048))
    m = c.select("run_id", "fingerprint", F.explode(F.slice("log_entry_ids", 1, members)).alias("log_entry_id"))
    return c.drop("log_entry_ids"), m
