"""Continuous ingest: micro-batches of raw lines into the store, each line once."""

from __future__ import annotations

import json
import logging
import re
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions import patterns
from ..functions.timeutil import parse_duration
from ..operators.ingest import KEY, append_entries, to_entries
from ..schema import DEFAULT_SCOPE
from ..sources import connectors
from ..sources.store import Store, Version


def with_line_fields(lines: DataFrame) -> DataFrame:
    """Fill up columns of raw lines that a source lacks."""
    kinds = {"source_ref": "string", "ordinal": "bigint", "received_at": "timestamp", "default_service": "string", "default_environment": "string", "default_host": "string", "extra": "map<string,string>"}
    for name, kind in kinds.items():
        if name not in lines.columns:
            lines = lines.withColumn(name, F.lit(None).cast(kind))
    return lines


def read_file_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of files as they come into a folder."""
    raw = spark.readStream.option("maxFilesPerTrigger", str(files_per_trigger)).text(path)
    return with_line_fields(raw.select(F.make_valid_utf8("value").alias("text"), F.col("_metadata.file_path").alias("source_ref")))


def start_ingest(lines: DataFrame, store: str, checkpoint: str, scope: str = DEFAULT_SCOPE, job_id: str | None = None, interval: str | None = "30 seconds", on_batch=None, lateness: str | None = None, alone: bool = False, fragments: str | None = None) -> StreamingQuery:
    """Parse and append each micro-batch, once.

    The store keeps the number of the stream's last batch with that batch's rows: one that comes
    again after a failure adds nothing, lines without time included. Without an interval it takes
    what there is and ends, which is how an interrupted job goes on from its checkpoint. `on_batch`
    gets the batch number and counts. With `lateness`, repeats that arrive within it go in the
    stream's own state; a stream that is `alone` in writing its sources need not be compared with
    the store then. With `fragments`, lines of container logs are put together first, which wait so
    long for what follows; Spark allows one such state a stream, so not with `lateness`.
    """
    if fragments and lateness:
        raise ValueError("fragments or lateness, not both")
    name, lines = f"{job_id or ''}@{checkpoint}", with_line_fields(lines)
    entries = to_entries(join_fragments(lines, fragments) if fragments else lines, scope, job_id, adapter="tail")
    if lateness:
        entries = dedup_in_stream(entries, lateness)

    def write(batch: DataFrame, number: int) -> None:
        counts = append_entries(batch, store, token=(name, number), job_id=job_id, compare=not (lateness and alone))
        if on_batch:
            on_batch(number, counts)

    w = entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def dedup_in_stream(entries: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Of the same entries (see `new_entries`) that arrive within `lateness` of each other, the first.

    State holds a digest for each entry of that span. Entries without all of the key are never the
    same; each has a key of its own. What repeats later, the store holds off.
    """
    whole = F.lit(True)
    for k in KEY:
        whole = whole & F.col(k).isNotNull()
    key = F.when(whole, F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in KEY]), 256)).otherwise(F.expr("uuid()"))
    seen = entries.withColumn("_arrived", F.current_timestamp()).withColumn("_key", key)
    return seen.withWatermark("_arrived", lateness).dropDuplicatesWithinWatermark(["_key"]).drop("_arrived", "_key")


def join_fragments(lines: DataFrame, wait: str = "10m") -> DataFrame:
    """reassemble_cri for a stream: a fragment at the end of a micro-batch waits for what follows.

    State is one open line a source_ref (a container's file or stream), whose batches come in
    order; within a batch `ordinal` orders lines, and those without one stand first. A line that
    nothing has followed comes out as it stands, as complete, once lines of any source have
    arrived `wait` later: time goes on with arrivals, so that a stream that ends, ends. A task holds
    the texts of a source's micro-batch, so its size bounds the memory (`maxFilesPerTrigger`).
    """
    rest = [f for f in lines.schema.fields if f.name not in ("source_ref", "ordinal", "text")]
    ms = int(parse_duration(wait).total_seconds() * 1000)
    packed = lines.select("source_ref", "ordinal", "text", F.to_json(F.struct(*[f.name for f in rest])).alias("rest"), F.current_timestamp().alias("arrived")).withWatermark("arrived", f"{ms} milliseconds")
    match = re.compile(patterns.CRI_LINE).match

    def complete(held: dict) -> tuple:
        return held["ordinal"], f"{held['stamp']} {held['stream']} F {''.join(held['parts'])}", held["rest"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, held, now = [], json.loads(state.get[0]) if state.exists else None, 0

        def frame() -> pd.DataFrame:
            # column by column, of known types: pandas would look at each value of a list of rows
            ordinal, text, rest = map(list, zip(*out, strict=True))
            out.clear()
            return pd.DataFrame({"source_ref": pd.Series([key[0]] * len(text), dtype=object), "ordinal": pd.array(ordinal, dtype="Int64"), "text": pd.Series(text, dtype=object), "rest": pd.Series(rest, dtype=object)})

        if state.hasTimedOut:
            out.append(complete(held))
            held = None
        else:
            # columns, and equal fields once: a group holds little more than its texts
            ordinals, texts, more, seen = [], [], [], {}
            for b in batches:
                ordinals.append(b["ordinal"].astype("Int64"))
                texts += b["text"].tolist()
                more += [seen.setdefault(r, r) for r in b["rest"].tolist()]
                now = max(now, int(b["arrived"].max().value // 1_000_000))
            ordinals = pd.concat(ordinals, ignore_index=True)
            none = ordinals.isna().to_numpy()
            numbers = ordinals.fillna(0).to_numpy(dtype="int64")
            order = np.lexsort((numbers, ~none))
            for i, number, unnumbered in zip(order.tolist(), numbers[order].tolist(), none[order].tolist(), strict=True):
                text, ordinal = texts[i], None if unnumbered else number
                texts[i] = None
                stamp, stream, tag, part = found.groups() if (found := match(text or "")) else (None, None, None, None)
                if held is not None and stream != held["stream"]:
                    out.append(complete(held))
                    held = None
                if stream is None:
                    out.append((ordinal, text, more[i]))
                elif held is not None:
                    held["parts"].append(part)
                    if tag == "F":
                        out.append(complete(held))
                        held = None
                elif tag == "F":
                    # most lines are whole as they come
                    out.append((ordinal, f"{stamp} {stream} F {part}", more[i]))
                else:
                    held = {"ordinal": ordinal, "stamp": stamp, "stream": stream, "parts": [part], "rest": more[i]}
                if len(out) >= 10_000:
                    yield frame()
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(now, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield frame()

    joined = packed.groupBy("source_ref").applyInPandasWithState(step, "source_ref string, ordinal long, text string, rest string", "held string", "append", GroupStateTimeout.EventTimeTimeout)
    # most lines, such as those of files, have nothing to read back
    back = F.when(F.col("rest") != "{}", F.from_json("rest", StructType(rest)))
    return joined.withColumn("_r", back).select([F.col(c) if c in ("source_ref", "ordinal", "text") else F.col(f"_r.{c}").alias(c) for c in lines.columns])


def windowed_counts(entries: DataFrame, size: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Entries of each cluster by tumbling window, as a stream."""
    return entries.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", size), "fingerprint").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "fingerprint", "n")


@dataclass(frozen=True)
class TailJob:
    """State of a continuous job, as its supervisor keeps it."""

    status: str = "running"
    last_polled_at: datetime | None = None
    consecutive_errors: int = 0
    parsed: int = 0
    inserted: int = 0
    skipped: int = 0

    def due(self, now: datetime, interval: timedelta = timedelta(seconds=30)) -> bool:
        return self.status == "running" and (self.last_polled_at is None or self.last_polled_at <= now - interval)

    def apply(self, action: str) -> TailJob:
        """pause, resume or stop; stopped is final, and what is so already stays."""
        target = {"pause": "paused", "resume": "running", "stop": "stopped"}.get(action)
        if target is None:
            raise ValueError(f"unknown action {action!r}")
        if self.status == "stopped" and target != "stopped":
            raise ValueError("a stopped job cannot go on")
        return replace(self, status=target, consecutive_errors=0 if action == "resume" else self.consecutive_errors)

    def succeeded(self, now: datetime) -> TailJob:
        return replace(self, last_polled_at=now, consecutive_errors=0)

    def failed(self, now: datetime, limit: int = 5) -> TailJob:
        """Count an error; at the limit the job pauses itself."""
        n = self.consecutive_errors + 1
        return replace(self, last_polled_at=now, consecutive_errors=n, status="paused" if n >= limit else self.status)


class Supervisor(StreamingQueryListener):
    """Keeps tail jobs going: starts what is due, counts failures of their queries, pauses at the limit.

    A job's state is a note of the store (kind `tails`); its counters are those that its batches
    have committed with their rows (kind `jobs`). `start(job_id)` of a job gives a query that takes
    what there is and ends. Spark's events tell how it went: an end by an exception adds an error,
    any other end resets their count.
    """

    def __init__(self, store: Store, limit: int = 5, interval: timedelta = timedelta(seconds=30), clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.store, self.limit, self.interval, self.clock = store, limit, interval, clock
        self.starts: dict[str, Callable[[str], StreamingQuery]] = {}
        self.running: dict[str, str] = {}
        self.lock = threading.Lock()  # a query may end before it is known as a job's
        store.spark.streams.addListener(self)

    def job(self, job_id: str) -> TailJob:
        """A job's state as the store has it."""
        v = self.store.version()
        kept, counts = v.note("tails", job_id), v.note("jobs", job_id, {})
        if kept is None:
            raise KeyError(job_id)
        at = kept["last_polled_at"]
        return TailJob(kept["status"], datetime.fromisoformat(at) if at else None, kept["consecutive_errors"], *[counts.get(k, 0) for k in ("parsed", "inserted", "skipped")])

    def _change(self, job_id: str, change: Callable[[TailJob], TailJob]) -> TailJob:
        out = []

        def apply(v: Version) -> Version:
            kept = v.note("tails", job_id) or {"status": "running", "last_polled_at": None, "consecutive_errors": 0}
            at = kept["last_polled_at"]
            job = change(TailJob(kept["status"], datetime.fromisoformat(at) if at else None, kept["consecutive_errors"]))
            out[:] = [job]
            v.notes.setdefault("tails", {})[job_id] = {"status": job.status, "last_polled_at": job.last_polled_at.isoformat() if job.last_polled_at else None, "consecutive_errors": job.consecutive_errors}
            return v

        self.store.update(apply)
        return out[0]

    def add(self, job_id: str, start: Callable[[str], StreamingQuery]) -> None:
        """Take up a job, as it was if the store knows it."""
        self.starts[job_id] = start
        if self.store.version().note("tails", job_id) is None:
            self._change(job_id, lambda job: job)

    def add_source(self, job_id: str, kind: str, options: dict, checkpoint: str, **ingest) -> None:
        """Take up a job that follows a log service; its source stays in the store, for `restore`.

        Options are kept as they are, so they hold no keys: a client takes those from elsewhere.
        """

        def keep(v: Version) -> Version:
            v.notes.setdefault("tail_sources", {})[job_id] = {"kind": kind, "options": options, "checkpoint": checkpoint, "ingest": ingest}
            return v

        self.store.update(keep)
        self.restore(job_id)

    def restore(self, *job_ids: str) -> None:
        """Take up the jobs whose sources the store has: those named, or all, as they were."""
        for job_id, source in self.store.version().notes.get("tail_sources", {}).items():
            if not job_ids or job_id in job_ids:

                def start(job_id: str, source: dict = source) -> StreamingQuery:
                    connectors.register(self.store.spark, [source["kind"]])
                    lines = self.store.spark.readStream.format(source["kind"]).options(**source["options"]).load()
                    # a service without an end is read up to now, and the query ends
                    return start_ingest(lines, self.store.root, source["checkpoint"], job_id=job_id, interval=None, **source["ingest"])

                self.add(job_id, start)

    def apply(self, job_id: str, action: str) -> TailJob:
        """pause, resume or stop; a running query of a job that is no longer to run ends."""
        job = self._change(job_id, lambda job: job.apply(action))
        if job.status != "running":
            for q in self.store.spark.streams.active:
                if self.running.get(str(q.runId)) == job_id:
                    q.stop()
        return job

    def tick(self) -> list[StreamingQuery]:
        """Start a query for each job that is due and has none."""
        now, busy, out = self.clock(), set(self.running.values()), []
        for job_id, start in self.starts.items():
            if job_id not in busy and self.job(job_id).due(now, self.interval):
                try:
                    with self.lock:
                        q = start(job_id)
                        self.running[str(q.runId)] = job_id
                except Exception:  # a source that can't even be opened counts as one that fails while it is read
                    logging.getLogger(__name__).exception("tail job %s", job_id)
                    self._change(job_id, lambda job: job.failed(now, self.limit))
                    continue
                out.append(q)
        return out

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            job_id = self.running.get(str(event.runId))
        if job_id is not None:
            now = self.clock()
            self._change(job_id, (lambda job: job.failed(now, self.limit)) if event.exception else (lambda job: job.succeeded(now)))
            del self.running[str(event.runId)]
