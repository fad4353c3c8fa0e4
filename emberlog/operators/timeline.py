"""A window as an ordered list of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def timeline(triggers: DataFrame, roles: DataFrame) -> DataFrame:
    """Events by position: triggers, then the primary error, then its effects and symptoms.

    triggers(message, timestamp, service); roles: clusters with role 0 (primary) and above.
    Effects do not start before the primary error; clusters of retries become one effect.
    Both inputs are short lists.
    """
    none = F.lit(None).cast("int")
    pre = triggers.where("timestamp is not null").select(
        F.lit(0).alias("bucket"), "timestamp", text.timeline_trigger_class(F.col("message")).alias("category"), text.truncate_words(F.col("message"), 100).alias("description"),
        F.lit(None).cast("bigint").alias("count"), F.when(F.col("service").isNotNull(), F.array("service")).otherwise(F.array().cast("array<string>")).alias("services"), none.alias("duration_minutes"),
    )
    everything = Window.partitionBy()
    led = roles.withColumn("_start", F.max(F.when(F.col("role") == 0, F.col("first_seen"))).over(everything)).withColumn("_primary", F.max(F.when(F.col("role") == 0, F.col("fingerprint"))).over(everything))
    retry = (F.col("role") > 0) & text.is_retry(F.col("representative_message"))
    led = led.where("first_seen is not null").withColumn("_retry", retry)
    # one row for each role, and one for all retries together
    grouped = led.groupBy(F.when(F.col("_retry"), -1).otherwise(F.col("role")).alias("_g")).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("count").alias("count"), F.min("representative_message").alias("message"), F.min("fingerprint").alias("fingerprint"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys("services"))))).alias("services"), F.max("_start").alias("_start"), F.max("_primary").alias("_primary"),
    )
    primary, retries = F.col("_g") == 0, F.col("_g") == -1
    effect = text.timeline_effect_class(F.col("message"), F.col("fingerprint") == F.col("_primary"))
    found = grouped.select(
        F.when(primary, 1).otherwise(2).alias("bucket"),
        F.when(primary, F.col("first_seen")).otherwise(F.greatest("first_seen", "_start")).alias("timestamp"),  # greatest skips a null
        F.when(primary, F.lit("error")).when(retries, F.lit("effect")).otherwise(effect).alias("category"),
        F.when(retries, F.format_string("Webhook retries (%d retry events)", "count")).otherwise(text.truncate_words(F.col("message"), 100)).alias("description"),
        "count",
        "services",
        F.when(~retries, text.whole_minutes(F.col("first_seen"), F.col("last_seen"))).alias("duration_minutes"),
    )
    every = pre.unionByName(found)
    kind = F.when(F.col("category") == "error", 0).when(F.col("category") == "symptom", 2).otherwise(1)
    order = Window.orderBy("bucket", "timestamp", F.when(F.col("bucket") == 2, kind).otherwise(0), F.when(F.col("bucket") == 2, text.effect_severity(F.col("description"))).otherwise(0), "description")
    return every.withColumn("position", F.row_number().over(order)).drop("bucket")


def with_gaps(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Add gap_before: over `seconds` since the event before."""
    order = Window.orderBy("position")
    late = F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(order)) > seconds * 1_000_000
    return events.withColumn("gap_before", F.coalesce(late, F.lit(False)))
