"""Log services as Spark data sources. Clients are injected, so that nothing here needs a network.

    spark.dataSource.register(Datadog)
    spark.read.format("datadog").options(client="package.module:make_client", start=..., end=...).load()

`client` names a function that the executors import; it gets the options and returns an
object with the one method that a source calls. A partition is a slice of the time of one stream
(`slice_seconds`, 300), so that a busy stream is read by many tasks. Conditions on received_at
narrow the time that is asked for, those on source_ref choose the streams, and what a text must
contain goes into Loki's query (Spark pushes them with spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import importlib
import json
import math
import re
import time
import warnings
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains

SCHEMA = "text string, source_ref string, received_at timestamp, default_service string, default_environment string, default_host string"

# Sites that the Datadog source may call.
DATADOG_SITES = ["datadoghq.com", "us3.datadoghq.com", "us5.datadoghq.com", "datadoghq.eu", "ap1.datadoghq.com", "ap2.datadoghq.com", "uk1.datadoghq.com", "ddog-gov.com", "us1.ddog-gov.com", "us2.ddog-gov.com"]
# Labels of a stream that hold a field.
LOKI_LABELS = {"service": ["app", "service", "job"], "environment": ["namespace", "env", "environment"], "host": ["pod", "instance", "host", "node"]}
# Attributes of an event that hold an identifier.
DATADOG_TRACE = ["trace_id", "traceId", "dd.trace_id", "dd.traceId"]
DATADOG_REQUEST = ["request_id", "requestId", "req_id", "correlation_id", "correlationId", "http.request_id", "http.requestId"]


class Unavailable(RuntimeError):
    """A source that cannot be read, or options that make no sense."""


def make_client(options: dict):
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


def retried(call, *args, attempts: int = 3, wait: float = 2.0, **kwargs):
    """Call again after throttling and errors of the other side (their status is 429 or 5xx, or none)."""
    for i in range(attempts):
        try:
            return call(*args, **kwargs)
        except Exception as e:
            status = getattr(e, "status", None)
            passing = isinstance(e, (ConnectionError, TimeoutError)) or (status is not None and (status == 429 or status >= 500))
            if not passing:
                raise
            if i + 1 == attempts:
                raise Unavailable(str(e)) from e
            time.sleep(min(10.0, wait * 2**i))


def _utc(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, tz=timezone.utc)


def _text(value) -> str | None:
    return (str(value).strip() or None) if value is not None else None


class CloudWatchPages:
    """One stream for each log group."""

    def streams(self, options: dict) -> list[str]:
        groups = [g.strip() for g in (options.get("log_groups") or options.get("log_group") or "").split(",") if g.strip()]
        if not groups:
            raise Unavailable("log_group or log_groups is needed")
        return groups

    def page(self, client, stream: str, start: datetime, end: datetime, token: str | None, options: dict):
        """Rows of one page and the token of the next; the same token again means the end."""
        more = {"filterPattern": options["filter_pattern"]} if options.get("filter_pattern") else {}
        got = retried(client.filter_log_events, logGroupName=stream, startTime=int(start.timestamp() * 1000), endTime=int(end.timestamp() * 1000), limit=10_000, **more, **({"nextToken": token} if token else {}))
        rows = [(e.get("message", ""), stream, _utc(e["timestamp"] / 1000) if e.get("timestamp") is not None else None, None, None, None) for e in got.get("events", [])]
        following = got.get("nextToken")
        return rows, None if following == token else following


def datadog_site(site: str | None) -> str:
    """The host of a site that may be called: by name, as an app. or api. host, or as an https URL.

    Anything else is refused, so that keys go nowhere else.
    """
    given = (site or "").strip()
    if not given:
        return DATADOG_SITES[0]
    scheme, separator, rest = given.rpartition("://")
    if separator:
        host = urlsplit(given).hostname or "" if scheme == "https" else ""
    else:
        host = "" if "/" in rest or "@" in rest else rest
    host = re.sub(r"^(app|api)\.", "", host.lower().rstrip("."))
    if host not in DATADOG_SITES:
        raise Unavailable(f"unknown site {given!r}")
    return host


class DatadogPages:
    """One stream for each index, or one for all."""

    def streams(self, options: dict) -> list[str]:
        datadog_site(options.get("site"))
        return [i.strip() for i in (options.get("index") or "*").split(",") if i.strip()]

    def page(self, client, stream: str, start: datetime, end: datetime, token: str | None, options: dict):
        body = {"filter": {"query": options.get("query") or "*", "indexes": [stream], "from": start.isoformat(), "to": end.isoformat()}, "sort": "timestamp", "page": {"limit": min(1000, int(options.get("page_size", 1000)))}}
        if token:
            body["page"]["cursor"] = token
        got = retried(client.search, body)
        rows = []
        for event in got.get("data") or []:
            line = event_fields(event)
            rows.append((json.dumps(line, ensure_ascii=False, default=str), stream, event_time(event), None, None, None))
        return rows, ((got.get("meta") or {}).get("page") or {}).get("after")


def _dotted(data: dict, keys: list[str]):
    """The value of the first key that is there, as it stands or as a path of dots."""
    for key in keys:
        if key in data:
            return data[key]
        at, path = data, key.split(".")
        while path and isinstance(at, dict) and path[0] in at:
            at = at[path.pop(0)]
        if not path:
            return at
    return None


def event_fields(event: dict) -> dict:
    """An event's envelope as a line with the usual keys."""
    attrs = event.get("attributes") if isinstance(event.get("attributes"), dict) else {}
    nested = attrs.get("attributes") if isinstance(attrs.get("attributes"), dict) else {}
    tags = [t for t in attrs.get("tags") or [] if isinstance(t, str)] if isinstance(attrs.get("tags"), list) else []
    tag = lambda name: next((t[len(name) + 1 :] for t in tags if t.startswith(f"{name}:") and t[len(name) + 1 :]), None)
    line = {to: attrs[key] for to, key in (("timestamp", "timestamp"), ("message", "message"), ("level", "status"), ("service", "service"), ("host", "host")) if attrs.get(key) is not None}
    line["env"] = _text(attrs.get("env")) or tag("env") or tag("environment") or _text(_dotted(nested, ["env", "environment"]))
    for name, keys in (("trace_id", DATADOG_TRACE), ("request_id", DATADOG_REQUEST)):
        line[name] = _text(_dotted(nested, keys) or _dotted(attrs, keys))
    return {k: v for k, v in line.items() if v is not None}


def event_time(event: dict) -> datetime | None:
    value = (event.get("attributes") or {}).get("timestamp")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _utc(value / 1000 if value > 1e12 else value)
    try:
        at = pd.to_datetime(str(value), utc=True) if value is not None else None
    except (ValueError, OverflowError):
        return None
    return at.to_pydatetime() if at is not None and not pd.isna(at) else None


class LokiPages:
    """One stream for each query."""

    def streams(self, options: dict) -> list[str]:
        if not options.get("query"):
            raise Unavailable("query is needed")
        return [options["query"]]

    def page(self, client, stream: str, start: datetime, end: datetime, token: str | None, options: dict):
        limit = min(5000, int(options.get("limit", 5000)))
        begin = int(token) if token else int(start.timestamp()) * 1_000_000_000 + start.microsecond * 1000
        stop = int(end.timestamp()) * 1_000_000_000 + end.microsecond * 1000
        data = retried(client.query_range, query=stream, start=begin, end=stop, limit=limit, direction="forward").get("data") or {}
        if data.get("resultType") != "streams":
            raise Unavailable("the query does not return log lines")
        rows, last, n = [], None, 0
        for s in data.get("result") or []:
            labels = s.get("stream") or {}
            field = lambda name, labels=labels: next((x for k in LOKI_LABELS[name] if (x := _text(labels.get(k)))), None)
            ref = "{" + ", ".join(f'{k}="{v}"' for k, v in sorted(labels.items())) + "}"
            for ns, line in s.get("values") or []:
                n, last = n + 1, max(last or 0, int(ns))
                rows.append((line, ref, _utc(int(ns) / 1e9), field("service"), field("environment"), field("host")))
        full = n >= limit and last is not None and last + 1 > begin and last + 1 <= stop
        return rows, str(last + 1) if full else None


PAGES = {"cloudwatch": CloudWatchPages, "datadog": DatadogPages, "loki": LokiPages}


def read_stream(kind: str, client, stream: str, start: datetime, end: datetime, options: dict) -> Iterator[tuple]:
    """All rows of a stream's window, page by page.

    Only where the caller sets `max_rows` the window ends early, and a warning says so.
    """
    pages, token, left = PAGES[kind](), None, int(options.get("max_rows", 1 << 62))
    while True:
        rows, token = pages.page(client, stream, start, end, token, options)
        yield from rows[:left]
        left -= len(rows)
        if left < 0 or (left == 0 and token):
            warnings.warn(f"{stream}: more rows than max_rows in the window", stacklevel=2)
        if left <= 0 or not token:
            return


class _Slice(InputPartition):
    """A stream's rows from `start` on and before `end`, or up to it where it is the last."""

    def __init__(self, stream: str, start: datetime, end: datetime, last: bool):
        self.stream, self.start, self.end, self.last = stream, start, end, last


def slices(streams: list[str], start: datetime, end: datetime, seconds: float, closed: bool = True) -> list[_Slice]:
    """Disjoint slices of a window for each stream; a window that ends where it starts is one."""
    n = max(1, math.ceil((end - start).total_seconds() / seconds))
    edges = [start + timedelta(seconds=seconds * i) for i in range(n)] + [end]
    return [_Slice(s, a, b, closed and b == end) for s in streams for a, b in zip(edges, edges[1:], strict=False)]


def read_slice(kind: str, client, part: _Slice, options: dict) -> Iterator[tuple]:
    """The rows of a slice; services whose windows are closed give rows of the next slice, too, which are left there."""
    for row in read_stream(kind, client, part.stream, part.start, part.end, options):
        if row[2] is None or part.start <= row[2] and (row[2] < part.end or part.last and row[2] == part.end):
            yield row


class Reader(DataSourceReader):
    """Streams and slices of a batch read; filters go to the service as far as it can tell exactly."""

    def __init__(self, kind: str, options: dict):
        self.kind, self.options = kind, options
        self.start, self.end = (datetime.fromisoformat(options[k]) for k in ("start", "end"))
        self.only: set[str] | None = None
        self.asked: list[str] = []

    def pushFilters(self, filters):
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name == "received_at" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                at = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.start = max(self.start, at)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.end = min(self.end, at)
                self.asked.append(f"received_at {type(f).__name__} {at.isoformat()}")
                yield f  # the edge itself, and rows without a time, are Spark's to judge
            elif name == "source_ref" and self.kind != "loki" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
                self.asked.append(f"source_ref in {sorted(map(str, wanted))}")
            elif name == "text" and self.kind == "loki" and isinstance(f, StringContains):
                quoted = json.dumps(f.value, ensure_ascii=False)
                self.options = self.options | {"query": f"{self.options['query']} |= {quoted}"}
                self.asked.append(f"text contains {quoted}")
            else:
                yield f

    def partitions(self):
        streams = [s for s in PAGES[self.kind]().streams(self.options) if self.only is None or s in self.only]
        if self.start > self.end:
            return []
        return slices(streams, self.start, self.end, float(self.options.get("slice_seconds", 300)))

    def read(self, partition):
        # where nothing is to be read Spark asks for one partition without a name
        return read_slice(self.kind, make_client(self.options), partition, self.options) if partition else iter([])


class TailReader(DataSourceStreamReader):
    """Follows streams: an offset is the time up to which they are read, `lag_seconds` (0) before now.

    A batch is the window between two offsets. Its slices are read in tasks, all pages of a slice in
    one, so page tokens live and end there; a batch that comes again reads the same windows.
    """

    def __init__(self, kind: str, options: dict, clock=None):
        self.kind, self.options = kind, options
        self.clock = clock or (lambda: datetime.now(timezone.utc))

    def initialOffset(self) -> dict:
        return {"at": self.options["start"]}

    def latestOffset(self) -> dict:
        now = datetime.fromisoformat(self.options["now"]) if "now" in self.options else self.clock()
        at = now - timedelta(seconds=float(self.options.get("lag_seconds", 0)))
        return {"at": max(at, datetime.fromisoformat(self.options["start"])).isoformat()}

    def partitions(self, start: dict, end: dict):
        begin, stop = datetime.fromisoformat(start["at"]), datetime.fromisoformat(end["at"])
        if begin >= stop:
            return []
        return slices(PAGES[self.kind]().streams(self.options), begin, stop, float(self.options.get("slice_seconds", 300)), closed=False)

    def read(self, partition):
        # where nothing is to be read Spark asks for one partition without a name
        return read_slice(self.kind, make_client(self.options), partition, self.options) if partition else iter([])


class _Source(DataSource):
    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.name(), dict(self.options))

    def streamReader(self, schema):
        return TailReader(self.name(), dict(self.options))


class CloudWatch(_Source):
    @classmethod
    def name(cls):
        return "cloudwatch"


class Datadog(_Source):
    @classmethod
    def name(cls):
        return "datadog"


class Loki(_Source):
    @classmethod
    def name(cls):
        return "loki"


SOURCES = {"cloudwatch": CloudWatch, "datadog": Datadog, "loki": Loki}


#: Sources that Spark reads itself, and the functions of sources.lines that do it.
FILES = {"file": "read_lines", "k8s": "read_k8s_export", "kubernetes": "read_k8s_export"}


def register(spark, names=tuple(SOURCES)) -> None:
    """Make remote sources known to spark.read.format; files need no registration."""
    for n in names:
        if n in FILES:
            continue
        if n not in SOURCES:
            raise Unavailable(f"unknown source {n!r}; known: {', '.join(sorted([*SOURCES, *FILES]))}")
        spark.dataSource.register(SOURCES[n])


def file_options(options: dict | None, paths: list[str] | None = None, recursive: bool = False) -> dict:
    """What a file source reads: paths and recursion of its options before those that are given beside them."""
    out = dict(options or {})
    if paths and not out.get("paths") and not out.get("path"):
        out["paths"] = list(paths)
    if recursive:
        out.setdefault("recursive", True)
    named = out.pop("path", None)
    given = out.get("paths") or named or []
    out["paths"] = [given] if isinstance(given, str) else list(given)
    return out


def read(spark, kind: str, options: dict | None = None, paths: list[str] | None = None, recursive: bool = False, **more):
    """Raw lines of any source by its name: files by paths, remote ones by their options."""
    if kind in FILES:
        from . import lines

        return getattr(lines, FILES[kind])(spark, **file_options(options, paths, recursive), **more)
    register(spark, [kind])
    return spark.read.format(kind).options(**(options or {})).load()
