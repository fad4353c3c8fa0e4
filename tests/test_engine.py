import json
import tarfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.functions import embed
from emberlog.functions.timeutil import Window
from emberlog.operators import cluster, ingest, parse, semantic
from emberlog.plans.verbs import Analyzer, Options
from emberlog.sources import connectors, lines
from emberlog.sources.store import Store
from emberlog.streaming import tail

UTC = timezone.utc
T0 = datetime(2026, 3, 12, 22, tzinfo=UTC)
RAW = "text string, default_service string"


JSON = [
    ('{"ts":"2026-03-12T22:01:10Z","severity":"WARNING","app":"api","msg":"hello","x":{"y":1}}', (datetime(2026, 3, 12, 22, 1, 10), "warn", "api", "hello", None, None)),
    ('{"Timestamp":1773352870000,"message":"m","kubernetes":{"pod_name":"p","namespace_name":"n","labels":{"app":"web"}}}', (datetime(2026, 3, 12, 22, 1, 10), None, "web", "m", "p", None)),
    ("{broken}", (None, None, None, None, None, "not a JSON object")),
]
TEXT = [
    ("2026-03-12T22:01:10Z ERROR billing payment failed", (datetime(2026, 3, 12, 22, 1, 10), "error", "billing", "payment failed", None, None)),
    ("2026-03-12 22:01:10 warn api slow", (datetime(2026, 3, 12, 22, 1, 10), "warn", "api", "slow", None, None)),
    ("ERROR failed to connect to database", (None, "error", "dflt", "ERROR failed to connect to database", None, None)),
    ("[2026-03-12 22:01:10] [INFO] cache warm", (datetime(2026, 3, 12, 22, 1, 10), "info", "dflt", "cache warm", None, None)),
    ("2026-03-12T22:01:10.5Z stderr F ERROR web boom now", (datetime(2026, 3, 12, 22, 1, 10, 500000), "error", "web", "boom now", None, None)),
    ("[ns/pod-1/web] 2026-03-12T22:01:10Z ERROR connection timeout", (datetime(2026, 3, 12, 22, 1, 10), "error", "web", "connection timeout", "pod-1", None)),
    ("just words", (None, None, "dflt", "just words", None, None)),
]


def test_lines_of_all_shapes(spark):
    rows = [(t, "dflt" if (t, w) in TEXT else None) for t, w in JSON + TEXT] + [("   ", None)]
    got = {r.text: r.parsed for r in parse.parse_lines(spark.createDataFrame(rows, RAW)).collect()}
    for t, want in JSON + TEXT:
        r = got[t]
        assert (r.timestamp, r.level, r.service, r.message, r.host, r.parse_error) == want, t
    assert got["   "] is None


def write_incident(folder):
    out = [{"timestamp": (T0 + timedelta(seconds=i)).isoformat(), "level": "error", "service": "api", "message": f"POST /api/checkout 500 after {i}ms"} for i in range(40)]
    out += [{"timestamp": (T0 - timedelta(minutes=2)).isoformat(), "level": "info", "service": "billing", "message": "Deploy completed for billing v2.4.1"}]
    out += [{"timestamp": (T0 + timedelta(minutes=1, seconds=i)).isoformat(), "level": "warn", "service": "api", "message": f"latency={900 + i}ms high"} for i in range(25)]
    (folder / "api-2026-03-12.log").write_text("\n".join(json.dumps(x) for x in out) + "\n\nbroken {\n")


def test_incident_end_to_end(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write_incident(logs)
    store = str(tmp_path / "store")
    raw = lines.read_lines(spark, str(logs))
    entries = ingest.to_entries(raw, job_id="j1")
    assert ingest.append_entries(entries, store) == {"parsed": 67, "inserted": 67, "skipped": 0}
    again = ingest.append_entries(entries, store)
    assert again["skipped"] == 66 and again["inserted"] == 1  # the line without time is never the same
    e = Store(spark, store).read("log_entries")
    w = Window(T0 - timedelta(minutes=5), T0 + timedelta(minutes=30))
    a = Analyzer(e)
    p = a.explain(w)
    assert p["primary"]["count"] == 40 and p["secondary"][0]["count"] == 25 and p["confidence"] == "high" and p["triggers"][0]["service"] == "billing"
    assert "First error spike occurred 2m after deploy completed" in p["summary"]
    assert [r.category for r in a.timeline(w).orderBy("position").collect()] == ["deploy", "error", "effect"]
    diff, triggers = a.compare(w, Window(w.start - timedelta(days=1), w.end - timedelta(days=1)))
    assert {r.direction for r in diff.collect()} == {"new"} and triggers.count() == 1
    answer = a.ask("which checkout requests failed?", w)
    assert answer["mode"] == "keyword" and answer["total_matches"] == 40
    assert a.ask("any zebra anywhere", w)["mode"] == "fallback"
    hits, mode = a.similar(w)
    assert mode == "fingerprint" and hits.count() == 0


def test_semantic_merge(spark):
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.96, 0.28]), ("c", [0.85, 0.53]), ("d", [0.0, 1.0])], "fingerprint string, embedding array<float>")
    assert {(r.a, r.b) for r in semantic.merge_edges(vec).collect()} == {("a", "b"), ("b", "c")}
    at = [T0 + timedelta(minutes=i) for i in range(4)]
    e = spark.createDataFrame([(f"{f}{i}", at[k], s, lv, f, f"message {f}", "default") for k, (f, s, lv, n) in enumerate((("a", "api", "error", 10), ("b", "billing", "warn", 20), ("c", "api", "error", 1), ("d", "api", "info", 5))) for i in range(n)], "id string, timestamp timestamp, service string, level string, fingerprint string, normalized_message string, scope string")
    ranked = cluster.clusters(e, Window(T0, T0 + timedelta(hours=1)))
    merged = {r.fingerprint: r for r in semantic.merge_clusters(ranked, vec).collect()}
    # b: 3 + ln 21 + ln 22 + ... is over a: 4 + ln 11 + ln 12 + ...
    assert set(merged) == {"b", "d"}
    m = merged["b"]
    assert (m["count"], m.services, m.levels, sorted(m.merged_fingerprints)) == (31, {"api": 11, "billing": 20}, {"error": 11, "warn": 20}, ["a", "c"])
    assert Analyzer(e, options=Options(merge_threshold=0.5), embed=embed.embed).clusters(Window(T0, T0 + timedelta(hours=1))).count() <= 4


def test_options():
    o = Options().override({"max_clusters": 5, "baseline": None}, {"max_clusters": 7})
    assert o.max_clusters == 7 and o.baseline == timedelta(hours=24)
    with pytest.raises(ValueError):
        Options(max_clusters=0)


def test_cri_and_archives(spark, tmp_path):
    pod = tmp_path / "pods" / "ns_pod-1_0a1b2c" / "web"
    pod.mkdir(parents=True)
    (pod / "0.log").write_text("2026-03-12T22:00:00Z stdout P half \n2026-03-12T22:00:01Z stdout F done\n2026-03-12T22:00:02Z stderr P lone\nplain\n")
    with tarfile.open(tmp_path / "pods" / "more.tar.gz", "w:gz") as tar:
        tar.add(pod / "0.log", "pods/ns_pod-2_0a1b2c/db/0.log")
    rows = sorted(lines.read_k8s_export(spark, str(tmp_path / "pods")).collect(), key=lambda r: (r.source_ref, r.ordinal))
    assert [(r.source_ref, r.text) for r in rows][:3] == [("ns/pod-1/web", "2026-03-12T22:00:00Z stdout F half done"), ("ns/pod-1/web", "2026-03-12T22:00:02Z stderr F lone"), ("ns/pod-1/web", "plain")]
    assert {(r.default_host, r.default_service) for r in rows} == {("pod-1", "web"), ("pod-2", "db")} and len(rows) == 6


def test_push(spark):
    got = [r.text for r in lines.push_payload(spark, '"a b"\n\n{"raw":"x","k":1}\n{"message":"m"}\n plain \n').orderBy("ordinal").collect()]
    assert got[0] == "a b" and json.loads(got[1])["message"] == "x" and got[2:] == ['{"message":"m"}', "plain"]
    for bad in ("", "x\n" * 3):
        with pytest.raises(ValueError):
            lines.push_payload(spark, bad, max_lines=2)


class Busy(Exception):
    status = 429


class FakeCloudWatch:
    def __init__(self, options=None):
        self.calls = 0

    def filter_log_events(self, nextToken=None, **kwargs):
        self.calls += 1
        if self.calls == 1:
            raise Busy
        n = int(nextToken or 0)
        return {"events": [{"timestamp": 1773352870000 + n, "message": f"line {n}"}], "nextToken": str(n + 1) if n < 2 else str(n)}


class FakeLoki:
    def query_range(self, start, end, limit, **kwargs):
        values = [[str(ns), f"l{ns}"] for ns in range(start, min(end, start + limit))]
        return {"data": {"resultType": "streams", "result": [{"stream": {"app": "web", "pod": "p"}, "values": values}]}}


def test_connectors(spark, monkeypatch):
    monkeypatch.setattr(connectors.time, "sleep", lambda s: None)
    got = list(connectors.read_stream("cloudwatch", FakeCloudWatch(), "g", T0, T0, {}))
    assert [r[0] for r in got] == ["line 0", "line 1", "line 2"]
    end = T0 + timedelta(microseconds=1)
    got = list(connectors.read_stream("loki", FakeLoki(), "q", T0, end, {"query": "q", "limit": "300"}))
    assert len(got) == 1000 and got[0][1:] == ('{app="web", pod="p"}', T0, "web", None, "p")
    line = connectors.event_fields({"attributes": {"message": "m", "status": "error", "tags": ["env:prod"], "attributes": {"dd": {"trace_id": 7}}}})
    assert line == {"message": "m", "level": "error", "env": "prod", "trace_id": "7"}
    with pytest.raises(connectors.Unavailable):
        connectors.DatadogPages().streams({"site": "evil.example"})
    with pytest.raises(connectors.Unavailable):
        connectors.register(spark, ["nope"])


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write_incident(src)
    seen = []
    args = (str(tmp_path / "store"), str(tmp_path / "cp"))
    tail.start_ingest(tail.read_file_stream(spark, str(src)), *args, interval=None, on_batch=lambda n, c: seen.append(c)).awaitTermination()
    tail.start_ingest(tail.read_file_stream(spark, str(src)), *args, interval=None).awaitTermination()
    assert seen == [{"parsed": 67, "inserted": 67, "skipped": 0}] and Store(spark, args[0]).read("log_entries").count() == 67


def test_tail_job():
    j = tail.TailJob()
    assert j.due(T0) and not j.apply("pause").due(T0)
    j = j.succeeded(T0)
    assert not j.due(T0 + timedelta(seconds=29)) and j.due(T0 + timedelta(seconds=30))
    for _ in range(5):
        j = j.failed(T0)
    assert j.status == "paused" and j.apply("resume").status == "running"
    with pytest.raises(ValueError):
        j.apply("stop").apply("resume")


def test_registered_queries_match_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40


def test_functions_of_time_columns(spark):
    assert spark.range(1).select(parse.timestamp_in(F.lit("at 1773352870 x"))).first()[0] == datetime(2026, 3, 12, 22, 1, 10)
