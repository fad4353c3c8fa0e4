"""From parsed lines to stored log entries, each stored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import DEFAULT_SCOPE
from ..sources.store import Conflict, Rewrite, Store, Version
from .parse import parse_lines

#: Columns that make an entry the same as one that is stored; only if all are filled.
KEY = ["scope", "source_ref", "original_line_hash", "timestamp"]
#: The table of entries in a store, and what it is partitioned by.
ENTRIES, BY = "log_entries", ("scope", "event_date")
#: The table of templates: (scope, fingerprint, template), each once, or again where two writers were at work.
TEMPLATES = "templates"


def to_entries(lines: DataFrame, scope: str = DEFAULT_SCOPE, job_id: str | None = None, source_id: str | None = None, adapter: str = "file", created_at: Column | None = None, fmt: Column | None = None) -> DataFrame:
    """Raw lines as log entries; blank lines and lines with a parse error are left out.

    The fingerprint is that of the whole message; stored texts are cut to 4096 and 2048
    characters. The id follows from the dedup key alone, and for lines without time from the job,
    too; not from where Spark has put a line, so reruns agree on any cluster. Equal lines without
    time have one id until `new_entries` numbers them.
    """
    p = F.col("parsed")
    t = parse_lines(lines, fmt).where(p.isNotNull() & p["parse_error"].isNull())
    t = t.withColumn("_norm", text.normalize(p["message"])).withColumn("_hash", text.line_hash(F.col("text"))).withColumn("_ts", F.coalesce(p["timestamp"], "received_at"))
    lit = lambda v: F.lit(v).cast("string")
    extra = F.map_concat(F.coalesce(F.map_filter(F.col("extra"), lambda k, _: ~F.coalesce(F.map_contains_key(p["extra"], k), F.lit(False))), F.create_map().cast("map<string,string>")), F.coalesce(p["extra"], F.create_map().cast("map<string,string>")))
    return t.select(
        F.sha2(F.concat_ws("|", F.lit(scope), "source_ref", "_hash", F.coalesce(F.unix_micros("_ts").cast("string"), F.lit(f"#{job_id or ''}"))), 256).alias("id"),
        lit(source_id).alias("source_id"),
        lit(job_id).alias("ingestion_job_id"),
        F.col("_ts").alias("timestamp"),
        p["service"].alias("service"),
        F.coalesce(p["environment"], "default_environment").alias("environment"),
        p["level"].alias("level"),
        p["trace_id"].alias("trace_id"),
        p["request_id"].alias("request_id"),
        F.coalesce(p["host"], "default_host").alias("host"),
        F.substring(p["raw_line"], 1, 4096).alias("raw_message"),
        F.nullif(F.substring("_norm", 1, 2048), F.lit("")).alias("normalized_message"),
        text.fingerprint(F.col("_norm")).alias("fingerprint"),
        p["parser_type"].alias("parser_type"),
        F.when(F.size(extra) > 0, F.to_json(extra)).alias("extra_json"),
        F.lit(adapter).alias("source_adapter"),
        F.col("source_ref"),
        F.col("_hash").alias("original_line_hash"),
        F.lit(scope).alias("scope"),
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
    )


def new_entries(batch: DataFrame, store: DataFrame | None) -> DataFrame:
    """Of a batch, what the store does not hold yet.

    Entries are the same if scope, source_ref, line hash and time are equal and filled; of equal
    ones in the batch the one of smallest id stays. Entries without time (or another of these)
    are never the same and all stay; those of one id are alike and get numbers in it. All are
    grouped once, with partial results where they are, so that a frequent line is no more than any.
    """
    filled = F.lit(True)
    for k in KEY:
        filled = filled & F.col(k).isNotNull()
    rest = [c for c in batch.columns if c not in KEY and c != "id"]
    grouped = batch.groupBy(*KEY, F.when(~filled, F.col("id")).alias("_loose")).agg(F.min(F.struct("id", *rest)).alias("_e"), F.count("*").alias("_n"))
    if store is not None:
        # rows without all of the key equal none
        grouped = grouped.join(store.where(filled).select(*KEY), KEY, "left_anti")
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_loose").isNull(), 1).otherwise(F.col("_n")).cast("int")))
    t = grouped.select(*KEY, "_e", copies.alias("_i"))
    number = F.when(F.col("_i") == 1, F.col("_e.id")).otherwise(F.sha2(F.concat_ws("#", F.col("_e.id"), F.col("_i")), 256))
    return t.select([F.col(c) if c in KEY else number.alias("id") if c == "id" else F.col(f"_e.{c}").alias(c) for c in batch.columns])


def append_entries(batch: DataFrame, path: str, token: tuple[str, int] | None = None, job_id: str | None = None, cursors: dict | None = None, compare: bool = True, vectors: Callable[[DataFrame], DataFrame] | None = None, tries: int = 5) -> dict[str, int]:
    """Write what is new to the store at `path` in one version, and count: parsed, inserted, skipped.

    Two jobs: the batch is parsed once and kept for the days that it touches, then written;
    rows are counted from what was written. Of the store only these days (and entries
    without a day) are compared; nothing is without `compare`, for a source whose repeats are gone. With a token (name, number), such as of a stream's batch, a batch
    whose number is not above the last one of that name adds nothing: its rows are in the store
    already, those without time included. The job's counts and cursors are committed with the rows, and
    so are the templates that are new (table `templates`) and what `vectors` makes of the new entries
    (table `log_embeddings`; registry.log_vectors with its provider).
    """
    store, none = Store(batch.sparkSession, path), {"parsed": 0, "inserted": 0, "skipped": 0}
    done = lambda v: token is not None and token[1] <= v.note("tokens", token[0], -1)
    if done(store.version()):
        return none
    if token:  # a line without time is another one in each batch
        loose = F.col("timestamp").isNull()
        batch = batch.withColumn("id", F.when(loose, F.sha2(F.concat_ws("#", "id", F.lit(token[1])), 256)).otherwise(F.col("id")))
    batch = batch.withColumn("event_date", F.to_date("timestamp")).persist()
    try:
        days = {r[0]: r[1] for r in batch.groupBy(F.col("event_date").cast("string")).count().collect()}
        parsed = sum(days.values())
        for _ in range(tries):
            version = store.version()
            of_days = lambda v: [p for p in v.pieces(ENTRIES) if compare and p["at"]["event_date"] and p["at"]["event_date"] in days]
            touched = of_days(version)
            fresh = new_entries(batch, store.read(ENTRIES, version, touched) if touched else None)
            told: list[dict] = []

            def note(v: Version, n: int, known: list = touched, told: list = told) -> Version | None:
                if done(v):
                    told.append(none)
                    return None
                if {p["path"] for p in of_days(v)} != {p["path"] for p in known}:
                    return None  # another writer has changed these days: compare again
                told.clear()
                told.append({"parsed": parsed, "inserted": n, "skipped": parsed - n})
                if token:
                    v.notes.setdefault("tokens", {})[token[0]] = token[1]
                if job_id:
                    job = v.notes.setdefault("jobs", {}).setdefault(job_id, {})
                    for k, x in told[0].items():
                        job[k] = job.get(k, 0) + x
                    if cursors is not None:
                        job["cursors"] = {**job.get("cursors", {}), **cursors}
                return v

            known = store.read(TEMPLATES, version)

            def also(written: DataFrame, known: DataFrame | None = known) -> list[tuple[str, DataFrame, tuple[str, ...]]]:
                found = written.groupBy("scope", "fingerprint").agg(F.min("normalized_message").alias("template"))
                out = [(TEMPLATES, found if known is None else found.join(known, ["scope", "fingerprint"], "left_anti"), ("scope",))]
                return out if vectors is None else [*out, ("log_embeddings", vectors(written), ("scope",))]

            store.append(ENTRIES, fresh, BY, F.col("created_at"), note, also)
            if told:
                return told[0]
        raise Conflict("other writers have added to these days each time")
    finally:
        batch.unpersist()


def upsert_latest(current: DataFrame, updates: DataFrame, key: list[str], updated: str = "updated_at", keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows by key, the newest of each; columns in `keep` (times) have the least value of all."""
    both = current.unionByName(updates)
    rest = [c for c in both.columns if c not in key]
    aggs = [(F.min(c) if c in keep else F.max_by(c, updated)).alias(c) for c in rest]
    return both.groupBy(*key).agg(*aggs).select(both.columns)


def upsert_store(store: Store, name: str, updates: DataFrame, key: list[str], by: tuple[str, ...] = ("scope",), updated: str = "updated_at", keep: tuple[str, ...] = ("created_at",), age: Column | None = None) -> None:
    """upsert_latest on a stored table: only partitions that the updates touch are written anew.

    `by` partitions the table and is part of the key; there is one touched partition a scope.
    """
    found = updates.select(*[F.col(c).cast("string") for c in by]).distinct().collect()
    touched = {tuple(r) for r in found}
    here = lambda p: tuple(p["at"][c] for c in by) in touched
    if not touched:
        return
    store.update(lambda v: None if name in v.tables else v.with_table(name, updates.schema.json(), list(by)))

    def change(v: Version) -> dict[str, Rewrite]:
        gone = [p for p in v.pieces(name) if here(p)]
        return {name: Rewrite(gone, upsert_latest(store.read(name, v, gone).select(updates.columns), updates, key, updated, keep), age, here)}

    store.rewrite(change)
