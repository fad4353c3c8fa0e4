"""Ways of logs into the store, and explanations that are kept."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import Window, parse_duration
from ..operators import cluster, ingest, registry
from ..schema import DEFAULT_SCOPE
from ..sources import connectors, lines
from ..sources.store import Store
from ..streaming.tail import with_line_fields
from .verbs import Analyzer


def found_paths(spark: SparkSession, paths: list[str], recursive: bool = False) -> list[str]:
    """The paths at which there are files, each once, in order, as the file system names them.

    What is read with another listed folder anyway is left out: its files, and with `recursive`
    all below it.
    """
    folders: set[str] = set()

    def where(path: str) -> str | None:
        try:
            spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        name = fs.makeQualified(p).toString().rstrip("/")
        if fs.exists(p) and fs.getFileStatus(p).isDirectory():
            folders.add(name)
        return name

    found = list(dict.fromkeys(w for p in paths if (w := where(p.rstrip("/") or "/"))))
    within = lambda p, q: p != q and p.startswith(f"{q}/") and (recursive or p not in folders and p.rpartition("/")[0] == q)
    return [p for p in found if not any(within(p, q) for q in folders)]


def ingest_files(spark: SparkSession, paths: list[str], store: str, fmt: str = "auto", recursive: bool = False, scope: str = DEFAULT_SCOPE, job_id: str | None = None, service: str | None = None) -> dict[str, int]:
    """Files into the store; the format of a file is decided once for all of its lines."""
    paths = found_paths(spark, paths, recursive)
    if not paths:
        return {"parsed": 0, "inserted": 0, "skipped": 0}
    raw = lines.file_format(lines.read_lines(spark, paths, recursive, default_service=service), fmt)
    return ingest.append_entries(ingest.to_entries(raw, scope, job_id, fmt=F.col("fmt")), store)


def ingest_push(spark: SparkSession, body: str, store: str, source_ref: str = "push", scope: str = DEFAULT_SCOPE, job_id: str | None = None, max_lines: int = 5000) -> dict[str, int]:
    """Pushed NDJSON into the store; each line is read by its own looks."""
    raw = lines.push_payload(spark, body, max_lines).withColumn("source_ref", F.lit(source_ref))
    return ingest.append_entries(ingest.to_entries(raw, scope, job_id, adapter="push"), store)


def ingest_source(spark: SparkSession, kind: str, options: dict, store: str, job_id: str, scope: str = DEFAULT_SCOPE, chunk: str = "1h") -> dict[str, int]:
    """A window of a log service into the store, chunk by chunk; a job that broke off goes on behind its last chunk.

    Each chunk's rows, the job's counters and the time up to which it is read (`cursors`) are one
    version of the store, so no chunk is read twice or lost. Returns the job's counters.
    """
    start, end = (datetime.fromisoformat(options[k]) for k in ("start", "end"))
    length, kept = parse_duration(chunk), Store(spark, store)
    job = kept.version().note("jobs", job_id, {})
    at = max(start, datetime.fromisoformat(job["cursors"]["at"])) if job.get("cursors") else start
    while at < end or (at == start == end and not job):
        stop = min(end, at + length)
        # both edges of a window are read; the store holds off what stands on the edge of two
        rows = with_line_fields(connectors.read(spark, kind, options | {"start": at.isoformat(), "end": stop.isoformat()}))
        number = int((stop - start).total_seconds() * 1_000_000)
        ingest.append_entries(ingest.to_entries(rows, scope, job_id, adapter=kind), store, token=(f"{job_id}@{start.isoformat()}", number), job_id=job_id, cursors={"at": stop.isoformat()})
        at, job = stop, {"done": True}
    return {k: kept.version().note("jobs", job_id, {}).get(k, 0) for k in ("parsed", "inserted", "skipped")}


def store_run(analyzer: Analyzer, window: Window, run_id: str, service: str | None = None, environment: str | None = None, top: int = 50) -> dict[str, DataFrame]:
    """Tables of a run: its header, its clusters and up to 100 members of each."""
    found = analyzer.clusters(window, service, environment, top=top)
    clusters, members = cluster.cluster_rows(found, run_id)
    return {"cluster_runs": registry.run_header(found.sparkSession, run_id, window, analyzer.scope, service, environment), "clusters": clusters, "cluster_members": members}


def explain_cached(analyzer: Analyzer, explanations: DataFrame, window: Window, now: datetime, service: str | None = None, environment: str | None = None, job_id: str | None = None, overrides: dict | None = None, refresh: bool = False) -> tuple[dict, DataFrame, bool]:
    """An explanation, the stored ones after it, and whether it was stored already.

    explanations(prompt_hash, scope, result_json, created_at).
    """
    key = registry.cache_key(window, analyzer.scope, service, environment, job_id, overrides)
    kept = None if refresh else registry.cached_explanation(explanations, key).first()
    if kept:
        return json.loads(kept.result_json), explanations, True
    packet = json.loads(json.dumps(analyzer.explain(window, service, environment, job_id), default=lambda x: x.isoformat() if isinstance(x, datetime) else [x.start.isoformat(), x.end.isoformat()]))
    row = explanations.sparkSession.createDataFrame([(key, analyzer.scope, json.dumps(packet, sort_keys=True), now)], "prompt_hash string, scope string, result_json string, created_at timestamp")
    return packet, explanations.unionByName(row.select(explanations.columns)), False
