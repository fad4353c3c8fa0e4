"""Tables beside the log entries: sources, jobs, keys, stored runs, cached explanations, vectors."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.timeutil import Window
from .ingest import upsert_latest

# Sources and jobs


def add_sources(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sources(id, name, type) with those of wanted(name, type) whose name is not there yet, each
    once (the smallest type); the id of a new one follows from its name."""
    fresh = wanted.where("name is not null").groupBy("name").agg(F.min("type").alias("type")).join(sources.select("name"), "name", "left_anti")
    return sources.unionByName(fresh.select(F.sha2("name", 256).alias("id"), "name", "type"))


def completed(jobs: DataFrame, scope: str) -> DataFrame:
    return jobs.where((F.col("status") == "completed") & (F.col("scope") == scope))


def list_jobs(jobs: DataFrame, sources: DataFrame, scope: str, limit: int = 25) -> DataFrame:
    """Completed jobs of a scope with the names of their sources, the newest first."""
    if not 1 <= limit <= 500:
        raise ValueError("limit is 1 to 500")
    named = completed(jobs, scope).join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    return named.orderBy(F.desc("finished_at"), "id").limit(limit).select("id", "source_name", "parsed_count", "finished_at")


def latest_job(jobs: DataFrame, scope: str) -> DataFrame:
    return completed(jobs, scope).orderBy(F.desc("finished_at"), "id").limit(1)


def job_detail(jobs: DataFrame, job_id: str, scope: str) -> DataFrame:
    return jobs.where((F.col("id") == job_id) & (F.col("scope") == scope))


def job_counts(jobs: DataFrame) -> DataFrame:
    """One row: jobs that wait, and continuous ones that run or pause."""
    tail = F.col("mode") == "tail"
    return jobs.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(tail & (F.col("status") == "running")).alias("running"), F.count_if(tail & (F.col("status") == "paused")).alias("paused"))


def store_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def scopes_to_purge(listed: DataFrame) -> DataFrame:
    """Filled scopes, each once, in order."""
    return listed.where(F.coalesce("scope", F.lit("")) != "").select("scope").distinct().orderBy("scope")


def purge_due(last: datetime | None, active: bool, now: datetime, seconds: int) -> bool:
    """Whether a purge should start: none runs, and the last is `seconds` ago (0: never)."""
    return not active and seconds > 0 and (last is None or (now - last).total_seconds() >= seconds)


# Keys that make a request count once


def live_keys(keys: DataFrame, now: datetime) -> DataFrame:
    return keys.where(F.col("expires_at") > F.lit(now))


def claim_keys(keys: DataFrame, requests: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Requests(key, job_id, expires_at) against stored keys of the same columns.

    Returns the keys afterwards, and (key, job_id, replayed) of each request's key: a live key
    keeps its job and answers again; of several new requests with one key the smallest job wins;
    keys that have expired are replaced.
    """
    live = live_keys(keys, now)
    fresh = requests.groupBy("key").agg(F.min(F.struct("job_id", "expires_at")).alias("_r")).select("key", "_r.job_id", "_r.expires_at")
    added = fresh.join(live.select("key"), "key", "left_anti")
    after = live.unionByName(added.select(keys.columns)).unionByName(keys.join(live.select("key").union(added.select("key")), "key", "left_anti").select(keys.columns))
    old = live.select("key", F.col("job_id").alias("_old"))
    return after, fresh.join(old, "key", "left").select("key", F.coalesce("_old", "job_id").alias("job_id"), F.col("_old").isNotNull().alias("replayed"))


# Stored runs and cached explanations


def run_header(spark, run_id: str, window: Window, scope: str, service: str | None = None, environment: str | None = None, algorithm: str = "fingerprint") -> DataFrame:
    schema = "id string, window_start timestamp, window_end timestamp, service_filter string, environment_filter string, algorithm string, status string, scope string"
    return spark.createDataFrame([(run_id, window.start, window.end, service, environment, algorithm, "completed", scope)], schema)


def cache_key(window: Window, scope: str, service: str | None = None, environment: str | None = None, job_id: str | None = None, overrides: dict | None = None) -> str:
    """SHA-256 of what an explanation depends on, as canonical JSON."""
    parts = {"ws": window.start.isoformat(), "we": window.end.isoformat(), "svc": service, "env": environment, "ijid": job_id, "scope": scope, "ov": overrides}
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def cached_explanation(explanations: DataFrame, key: str) -> DataFrame:
    """The newest explanation stored under a key, if it has a result."""
    newest = explanations.where(F.col("prompt_hash") == key).orderBy(F.desc("created_at")).limit(1)
    return newest.where("result_json is not null")


def majority_scope_by_window(explanations: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, scope): the scope that most entries have in an explanation's window, ties to the smaller.

    explanations(id, window_start, window_end, service_filter, environment_filter); windows are
    closed and null filters take all. Explanations of the same window and filters are counted once.
    A window is laid out by the days that it touches, so that the range join is an equal join on
    days. It takes its whole hours from sums by hour, the whole minutes of hours that it cuts from
    sums by minute, and only minutes that it cuts are compared entry by entry.
    """
    fields = ["window_start", "window_end", "service_filter", "environment_filter"]
    e = explanations.select("id", *fields).where("window_start <= window_end")
    windows = e.select(*fields).distinct()
    part = lambda unit, c: F.date_trunc(unit, c)
    inside = lambda unit: (F.col(unit) >= F.col("window_start")) & (F.col(unit) + F.expr(f"interval 1 {unit}") <= F.col("window_end") + F.expr("interval 1 microsecond"))
    cut = lambda unit: windows.select("*", F.explode(F.array_distinct(F.array(part(unit, "window_start"), part(unit, "window_end")))).alias(unit)).where(~inside(unit))
    fits = (F.col("service_filter").isNull() | (F.col("service") == F.col("service_filter"))) & (F.col("environment_filter").isNull() | (F.col("environment") == F.col("environment_filter")))
    at = entries.where("timestamp is not null").select("scope", "service", "environment", "timestamp", part("minute", "timestamp").alias("minute"))
    minutes = at.groupBy("scope", "service", "environment", "minute").agg(F.count("*").alias("n")).withColumn("hour", part("hour", "minute"))
    hours = minutes.groupBy("scope", "service", "environment", "hour").agg(F.sum("n").alias("n")).withColumn("day", F.to_date("hour"))
    spans = windows.withColumn("day", F.explode(F.sequence(F.to_date("window_start"), F.to_date("window_end"))))
    found = [
        spans.join(hours, "day").where(inside("hour") & fits).select(*fields, "scope", "n"),
        cut("hour").join(minutes, "hour").where(inside("minute") & fits).select(*fields, "scope", "n"),
        cut("minute").join(at, "minute").where(fits & F.col("timestamp").between(F.col("window_start"), F.col("window_end"))).select(*fields, "scope", F.lit(1).cast("bigint").alias("n")),
    ]
    counted = reduce(DataFrame.unionByName, found).groupBy(*fields, "scope").agg(F.sum("n").alias("n")).alias("w")
    same = reduce(lambda x, y: x & y, [F.col(f"e.{c}").eqNullSafe(F.col(f"w.{c}")) for c in fields])
    # one shuffle by id serves both sums
    each = e.alias("e").join(counted, same).select("id", "scope", "n").repartition("id").groupBy("id", "scope").agg(F.sum("n").alias("n"))
    return each.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "scope")).alias("_b")).select("id", F.col("_b.scope").alias("scope"))


# Vectors


def log_vectors(entries: DataFrame, embed, dim: int, model: str) -> DataFrame:
    """(log_entry_id, scope where entries have one, embedding, model_name) of entries with an id and a template that is not blank.

    `embed` adds `embedding` to a DataFrame with `template`; vectors of another length are left
    out, and without a provider there are none.
    """
    own = [c for c in ("scope",) if c in entries.columns]
    t = entries.where("id is not null").select(F.col("id").alias("log_entry_id"), *own, F.coalesce(F.nullif("normalized_message", F.lit("")), "raw_message").alias("template"))
    return usable_vectors(t.where(F.trim("template") != ""), embed, dim).select("log_entry_id", *own, "embedding", F.lit(model).alias("model_name"))


def usable_vectors(rows: DataFrame, embed, dim: int) -> DataFrame:
    if embed is None:
        return rows.limit(0).withColumn("embedding", F.lit(None).cast("array<float>"))
    return embed(rows).where(F.size("embedding") == dim)


def cluster_vectors(stored: DataFrame, clusters: DataFrame, scope: str, embed, dim: int, now: datetime) -> DataFrame:
    """The stored vectors of cluster templates after those of ranked clusters were written.

    Clusters need a fingerprint and a message that is not blank. A new row replaces that of its
    scope and fingerprint, but for created_at.
    """
    t = clusters.select(F.lit(scope).alias("scope"), "fingerprint", F.col("representative_message").alias("template"), "first_seen", "last_seen", "count")
    t = t.where((F.coalesce("fingerprint", F.lit("")) != "") & (F.trim("template") != ""))
    rows = usable_vectors(t, embed, dim).withColumn("updated_at", F.lit(now)).withColumn("created_at", F.lit(now))
    return upsert_latest(stored, rows.select(stored.columns), ["scope", "fingerprint"])


# Results as they are returned


def cluster_rows_out(ranked: DataFrame, rounded=lambda c: F.bround(c, 2)) -> DataFrame:
    """Ranked clusters for a reader: services as a list, ratios and scores to two digits.

    `rounded` rounds them otherwise; a second rounding of the result would go up where the first did.
    """
    figures = [rounded(F.col(c)).alias(c) for c in ("change_ratio", "importance_score")]
    return ranked.select("fingerprint", F.col("representative_message").alias("message"), "count", F.map_keys("services").alias("services"), "levels", "first_seen", "last_seen", "baseline_count", *figures, "is_trigger", "merged_fingerprints")


def trigger_out(triggers: DataFrame, primary_first_seen: Column) -> DataFrame:
    """Triggers with their family, and `precedes_primary_spike` where they come no later than it."""
    before = F.when(F.col("timestamp") <= primary_first_seen, F.lit("precedes_primary_spike"))
    return triggers.select("message", "service", "timestamp", text.trigger_type(F.col("message")).alias("type"), before.alias("correlation"))


def evidence_out(items: list) -> list[dict]:
    """Evidence as items of a kind; plain sentences are of the kind log."""
    return [{"kind": str(x.get("kind") or "log"), "detail": str(x["detail"]), "ref": x.get("ref"), "source_ref": x.get("source_ref")} if isinstance(x, dict) and x.get("detail") is not None else {"kind": "log", "detail": str(x), "ref": None, "source_ref": None} for x in items or []]
