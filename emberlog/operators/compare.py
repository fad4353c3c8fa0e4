"""The difference between the clusters and triggers of two windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def collapse_noise(clusters: DataFrame) -> DataFrame:
    """Clusters (fingerprint, representative_message, count, services) with those of webhook
    retries, and those of growing queues, joined to one each."""
    group = F.when(text.is_retry(F.col("representative_message")), F.lit("retries")).when(text.is_queue_growth(F.col("representative_message")), F.lit("queue_growth"))
    total = F.struct(F.lit(None).cast("string").alias("k"), F.col("count").alias("n"), F.lit(1).alias("one"))
    each = F.transform(F.map_entries("services"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("n"), F.lit(0).alias("one")))
    t = clusters.select("fingerprint", "representative_message", group.alias("_g"), "count", "services")
    t = t.select(F.coalesce(F.concat(F.lit("__collapsed_"), "_g", F.lit("__")), "fingerprint").alias("fingerprint"), "_g", "representative_message", F.inline(F.concat(F.array(total), F.coalesce(each, F.array().cast("array<struct<k:string,n:bigint,one:int>>")))))
    t = t.groupBy("fingerprint", "_g", "k").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.min("representative_message").alias("m"))
    t = t.groupBy("fingerprint", "_g").agg(F.max(F.when(F.col("k").isNull(), F.col("n"))).alias("count"), F.max("one").alias("_n"), F.min("m").alias("m"), F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "n"))))).alias("services"))
    label = F.when(F.col("_g") == "retries", F.format_string("Webhook retries (%d distinct events, %d total)", "_n", "count")).when(F.col("_g").isNotNull(), F.lit("Webhook queue growing")).otherwise(F.col("m"))
    return t.select("fingerprint", label.alias("representative_message"), "count", "services")


def direction(a: Column, b: Column, factor: float = 1.5) -> Column:
    ratio = a / F.greatest(b, F.lit(1))
    return F.when(a.isNull(), F.lit("disappeared")).when(b.isNull(), F.lit("new")).when(ratio >= factor, F.lit("increased")).when(ratio <= 1 / factor, F.lit("decreased")).otherwise(F.lit("stable"))


def cluster_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two cluster lists: fingerprint, message, services, counts, direction, delta."""
    left = a.select("fingerprint", F.col("representative_message").alias("ma"), F.array_sort(F.map_keys("services")).alias("sa"), F.col("count").alias("count_a"))
    right = b.select("fingerprint", F.col("representative_message").alias("mb"), F.array_sort(F.map_keys("services")).alias("sb"), F.col("count").alias("count_b"))
    t = left.join(right, "fingerprint", "full")
    return t.select("fingerprint", F.coalesce("ma", "mb").alias("message"), F.coalesce("sa", "sb").alias("services"), "count_a", "count_b", direction(F.col("count_a"), F.col("count_b")).alias("direction"), (F.coalesce("count_a", F.lit(0)) - F.coalesce("count_b", F.lit(0))).alias("delta"))


def ordered_diff(diff: DataFrame) -> DataFrame:
    """By bucket; new ones by their count, gone ones by theirs, others by how much they moved."""
    bucket = F.array_position(F.array(*[F.lit(x) for x in ("new", "increased", "decreased", "disappeared", "stable")]), F.col("direction"))
    weight = F.when(F.col("direction") == "new", F.col("count_a")).when(F.col("direction") == "disappeared", F.col("count_b")).otherwise(F.abs("delta"))
    return diff.orderBy(bucket, F.desc(weight), "fingerprint")


def trigger_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Triggers (message, service) of either window without an equal key in the other."""
    key = text.trigger_key(F.col("message"))
    ka, kb = a.withColumn("_k", key), b.withColumn("_k", key)
    only = lambda x, y, side: x.join(y.select("_k"), "_k", "left_anti").select("message", "service", F.lit(side).alias("only_in"))
    return only(ka, kb, "a").unionByName(only(kb, ka, "b"))


def has_changes(diff: DataFrame, triggers: DataFrame) -> DataFrame:
    """One row: whether anything but stability was found; triggers that ended do not count."""
    c = diff.agg(F.coalesce(F.max(F.col("direction") != "stable"), F.lit(False)).alias("c"))
    t = triggers.agg(F.coalesce(F.max(F.col("only_in") == "a"), F.lit(False)).alias("t"))
    return c.join(F.broadcast(t)).select((F.col("c") | F.col("t")).alias("has_changes"))
