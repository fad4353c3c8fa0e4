"""Expectations that were worked out by hand, not by this code."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.functions import embed, text
from emberlog.functions.timeutil import Window
from emberlog.operators import cluster, ingest, parse, registry, retention, retrieval, semantic
from emberlog.plans import render, writes
from emberlog.plans.verbs import Analyzer, Options
from emberlog.sources import connectors, lines
from emberlog.sources.store import Store
from emberlog.streaming import tail

UTC = timezone.utc
T0 = datetime(2026, 3, 16, 15, 18, tzinfo=UTC)
W = Window(datetime(2026, 3, 16, 15, 8, tzinfo=UTC), datetime(2026, 3, 16, 16, 10, tzinfo=UTC))


def incident(spark):
    """39 errors, 25 slow and 80 usual requests, and ten lines of a deployment."""
    out = [(T0 + timedelta(seconds=i), "error", "api", "POST /api/checkout 500 Internal Server Error — upstream billing error") for i in range(39)]
    out += [(T0 + timedelta(seconds=60 + i), "warn", "api", f"POST /api/checkout 200 OK latency={900 + i}ms (high latency detected)") for i in range(25)]
    out += [(T0 + timedelta(seconds=i), "info", "api", f"POST /api/checkout 200 OK latency={20 + i}ms") for i in range(80)]
    out += [(datetime(2026, 3, 16, 15, 15, 31, tzinfo=UTC), "info", "deploy", "Deploy completed for billing-worker version v2.4.1"), (datetime(2026, 3, 16, 15, 15, 32, tzinfo=UTC), "info", "deploy", "Application started")]
    rows = [(str(i), *x, "default", "j") for i, x in enumerate(out)]
    e = spark.createDataFrame(rows, "id string, timestamp timestamp, level string, service string, raw_message string, scope string, ingestion_job_id string").withColumn("environment", F.lit("prod"))
    return e.withColumn("normalized_message", text.normalize(F.col("raw_message"))).withColumn("fingerprint", text.fingerprint(F.col("normalized_message")))


def test_incident(spark):
    e = incident(spark)
    got = {r.fingerprint: r for r in cluster.clusters(e, W, top=13).collect()}
    for fingerprint, count, level, score in (("1fe3193e4ed5aa1a", 39, "error", 11.749025), ("4e69742323f49932", 25, "warn", 9.900507), ("fedd2265dc776c29", 80, "info", 10.147742)):
        r = got[fingerprint]
        assert (r["count"], r.levels) == (count, {level: count}) and abs(r.importance_score - score) < 1e-6
    p = Analyzer(e).explain(W)
    assert p["primary"]["fingerprint"] == "1fe3193e4ed5aa1a" and [c["count"] for c in p["secondary"]] == [25] and len(p["triggers"]) == 2
    assert (p["points"], p["confidence"], p["confidence_score"]) == (5, "high", 0.9)
    assert p["evidence"][:3] == ["39 similar failures in api", "Not observed in prior 24h baseline", "First error spike occurred 2m after deploy completed for billing-worker version v2.4.1"]
    report = render.report(p, render.reproduce_command(["x", "explain"], {"since": "1h", "no-llm": True, "service": None}))
    assert report.startswith("# Incident report\n\nPOST /api/checkout 500 Internal Server Error — upstream billing error\n\n- **Window:** 2026-03-16T15:08:00+00:00 → 2026-03-16T16:10:00+00:00 (1h 2m)\n- **Services:** api, deploy\n- **Total logs:** 146\n")
    assert "- **Fingerprint:** `1fe3193e4ed5aa1a`\n- **Count:** 39\n" in report and "```bash\nx explain --since 1h --no-llm\n```" in report
    events = [r.asDict() for r in Analyzer(e).timeline(W).orderBy("position").collect()]
    shown = render.timeline_text(events, W).splitlines()
    assert shown[1] == "Incident timeline  2026-03-16 15:08 – 2026-03-16 16:10 UTC" and shown[3] == "  15:15:31  deploy     Deploy completed for billing-worker version v2.4.1 · deploy"
    assert "  15:18:00  error ↑    POST /api/checkout 500 Internal Server Error — upstream billing error" in shown and " " * 13 + "39 events · api" in shown


def test_nothing_found(spark):
    e = incident(spark)
    early = Window(W.start - timedelta(days=9), W.start - timedelta(days=8))
    p = Analyzer(e).explain(early)
    assert p["confidence"] == "low" and "Insufficient evidence to identify a likely issue" in p["summary"] and "- 0 total logs matched filters" in p["summary"]
    a = Analyzer(e).ask("why did billing fail", now=W.start - timedelta(days=5))
    assert a["answer"] == "No log activity found in the requested window. Try a wider time range with --since." and a["evidence"] == ["No logs found in window"]
    assert Analyzer(e).ask("why did billing fail", now=W.end)["total_matches"] == 39  # of the last 24 hours
    assert render.similar_text([], "fingerprint") == "No similar incidents found (fingerprint match)."
    one = {"fingerprint": "ab", "scope": "s", "similarity": 0.876}
    assert render.similar_text([one, one, one], "semantic") == "Saw fingerprint ab in s (similarity 0.88) and 2 more."
    assert render.timeline_text([], early).splitlines()[-1] == "  No significant events found in this window."
    assert render.compare_text(W, early, [], []).splitlines()[-1] == "  No significant changes between windows."
    diff = [{"direction": "increased", "message": "m", "count_a": 39, "count_b": 3}, {"direction": "new", "message": "n", "count_a": 5, "count_b": None}]
    shown = render.compare_text(W, early, diff, [{"only_in": "b", "message": "t", "service": "s"}])
    assert f"  + {'n':<74} 5 events" in shown and f"  ↑ {'m':<74} 3 → 39" in shown and "  -⚡ t · s" in shown


def test_words_are_sought_in_templates_only(spark):
    t = spark.createDataFrame([("1", T0, "<path> failed", "billing in the raw line"), ("2", T0, "billing failed", "x")], "id string, timestamp timestamp, normalized_message string, raw_message string")
    assert [r.id for r in retrieval.keyword_search(t, ["billing"]).collect()] == ["2"]


@pytest.mark.parametrize(("message", "key"), [("Deploy completed v2.4.1", "deploy completed"), ("deploy completed v2.4.1-rc1", "deploy completed"), ("deploy finished api-v2", "deploy finished api-"), ("v2 is out", "v2 is out"), ("Deploy v2.3 ", "deploy")])
def test_trigger_keys(spark, message, key):
    assert spark.createDataFrame([(message,)], "m string").select(text.trigger_key(F.col("m"))).first()[0] == key


def test_merged_clusters_can_become_triggers(spark):
    rows = [(f, f"Deploy completed for release {f}", 20, {"api": 20}, {"info": 20}, T0, T0, 0, 21.0, 6.0, False, [f], []) for f in ("a", "b")]
    rows += [("c", "Deploy completed alone", 1, {"api": 1}, {"info": 1}, T0, T0, 0, 2.0, 3.0, False, ["c"], [])]
    ranked = spark.createDataFrame(rows, "fingerprint string, representative_message string, count bigint, services map<string,bigint>, levels map<string,bigint>, first_seen timestamp, last_seen timestamp, baseline_count bigint, change_ratio double, importance_score double, is_trigger boolean, log_entry_ids array<string>, merged_fingerprints array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.999, 0.001]), ("c", [0.0, 1.0])], "fingerprint string, embedding array<float>")
    got = {r.fingerprint: r for r in semantic.merge_clusters(ranked, vectors).collect()}
    import math

    assert got["a"].is_trigger and abs(got["a"].importance_score - (1 + math.log(41) + math.log(42) + 0.5 * math.log(2) + 2)) < 1e-9
    assert not got["c"].is_trigger and got["c"].importance_score == 3.0


def test_a_failing_provider_leaves_clusters(spark):
    def fails(_):
        raise RuntimeError("no provider")

    assert Analyzer(incident(spark), options=Options(merge_threshold=0.9), embed=fails).clusters(W).count() == 5


def test_pushed_lines(spark):
    given = ['{"raw":"x","k":1,"n":{"a":2}}', '{"message":null,"raw":"y"}', '{"message": "m", "t": true}', "{'msg':'single'}", '{"msg":"tail"} trailing}', "[1, 2]", '"a \\"b\\""', '{"text":null,"msg":"z"}', '"broken', "12"]
    got = [r.text for r in lines.push_payload(spark, "\n".join(given)).orderBy("ordinal").collect()]
    assert got == ['{"raw":"x","k":1,"n":{"a":2},"message":"x"}', '{"message":null,"raw":"y"}', '{"message":"m","t":true}', "{'msg':'single'}", '{"msg":"tail"} trailing}', "[1, 2]", 'a "b"', '{"text":null,"msg":"z","message":"z"}', '"broken', "12"]


def test_only_objects_count_as_json(spark):
    given = ["{'msg':'single'}", '{"msg":"tail"} trailing}', '{"msg":"ok"}', '{"a":1},{"b":2}', '{"msg":"nan","x":NaN}']
    t = parse.with_parsed_json(spark.createDataFrame([(x, None) for x in given], "text string, default_service string"))
    assert [r.parsed.parse_error is None for r in t.collect()] == [False, False, True, False, False]


@pytest.mark.parametrize("value", ["Thu, 12 Mar 2026 22:01:10 +0000", "12 Mar 2026 22:01:10 GMT", "2026/03/12 22:01:10", "Mar 12, 2026 22:01:10", "03/12/2026 10:01:10 PM", "20260312T220110Z", "Thu Mar 12 22:01:10 2026", "2026-03-12T22:01:10Z", "1773352870", "1773352870000", "Fri, 13 Mar 2026 00:01:10 +0200"])
def test_times_of_fields(spark, value):
    got = spark.createDataFrame([(value,)], "v string").select(F.unix_seconds(parse.timestamp_field(F.col("v")))).first()[0]
    assert got == 1773352870


def test_datadog_sites_and_identifiers(monkeypatch):
    for given in (None, "", "datadoghq.com", "app.datadoghq.eu", "API.us3.datadoghq.com.", "https://api.datadoghq.com/path", "uk1.datadoghq.com", "us1.ddog-gov.com", "us2.ddog-gov.com"):
        assert connectors.datadog_site(given) in connectors.DATADOG_SITES
    for given in ("http://datadoghq.com", "evil.com", "datadoghq.com/x", "me@datadoghq.com", "https://datadoghq.com.evil.com", "https://evil.com/datadoghq.com"):
        with pytest.raises(connectors.Unavailable):
            connectors.datadog_site(given)
    event = {"attributes": {"message": "m", "attributes": {"dd": {"traceId": 7}, "correlationId": " c "}}}
    assert connectors.event_fields(event) == {"message": "m", "trace_id": "7", "request_id": "c"}
    assert connectors.event_time({"attributes": {"timestamp": "Thu, 12 Mar 2026 22:01:10 +0000"}}) == datetime(2026, 3, 12, 22, 1, 10, tzinfo=UTC)

    class Client:
        def search(self, body):
            at = int(body["page"].get("cursor", 0))
            return {"data": [{"attributes": {"message": f"m{at}"}}] * 1000, "meta": {"page": {"after": str(at + 1) if at < 11 else None}}}

    rows = list(connectors.read_stream("datadog", Client(), "*", T0, T0, {}))
    assert len(rows) == 12_000  # the whole window
    with pytest.warns(UserWarning, match="more rows"):
        assert len(list(connectors.read_stream("datadog", Client(), "*", T0, T0, {"max_rows": "1500"}))) == 1500


def test_visible_scopes(spark):
    t = spark.createDataFrame([(s, f) for s in ("mine", "yours", "third") for f in ("a", "b")], "scope string, fingerprint string")
    seen = lambda *v: sorted(tuple(r) for r in retrieval.visible(t, retrieval.Visibility(*v), "mine", ["a"]).collect())
    assert seen(True, None) == [("third", "a"), ("third", "b"), ("yours", "a"), ("yours", "b")]
    assert seen(True, "yours") == [("yours", "a"), ("yours", "b")] and seen(True, "mine") == []
    assert seen(False, None) == [("mine", "b")] == seen(False, "mine") and seen(False, "third") == [("third", "b")]


def test_intervals_of_any_number(spark):
    now = datetime(2026, 3, 16, tzinfo=UTC)
    texts = ["30m", " 24h ", "7d", "2 weeks", "2weeks", "1.5h", "0", "", "OFF", "never", "0d", "x", "5 d", "-3d", "3y", None]
    over = spark.createDataFrame([(f"s{i}", x, None) for i, x in enumerate(texts)], "scope string, raw_interval string, summary_interval string")
    got = {r.scope: r for r in retention.policies(over, over, "1d", "off", now).collect()}
    for i, x in enumerate(texts):
        try:
            want = retention.cutoff("1d" if x is None else x, now)
        except ValueError:
            want = None
        assert got[f"s{i}"].raw_cutoff == (want.replace(tzinfo=None) if want else None), x


def test_repeated_batches_insert_nothing_twice(spark, tmp_path):
    rows = [(json.dumps({"message": f"no time {i % 3}"}), f"f{i % 2}", i) for i in range(6)] + [(json.dumps({"message": "t", "ts": "2026-03-12T22:01:10Z"}), "f", 9)]
    batch = tail.with_line_fields(spark.createDataFrame(rows, "text string, source_ref string, ordinal bigint"))
    store = str(tmp_path / "store")
    entries = ingest.to_entries(batch, created_at=F.lit(T0))
    assert ingest.append_entries(entries, store, token=("s", 0)) == {"parsed": 7, "inserted": 7, "skipped": 0}
    assert ingest.append_entries(entries, store, token=("s", 0)) == {"parsed": 0, "inserted": 0, "skipped": 0}
    assert ingest.append_entries(entries, store)["inserted"] == 6  # a file that is read again: lines without time are new
    assert {r.default_service for r in lines.read_lines(spark, __file__).select("default_service").distinct().collect()} == {"test_expectations"}


def test_files_are_read_in_one_format_each(spark, tmp_path):
    (tmp_path / "api.log").write_text('\n{"message":"first","ts":"2026-03-12T22:01:10Z"}\nnot json\n')
    (tmp_path / "web.log").write_text('plain first\n{"message":"an object in a text file"}\n')
    (tmp_path / "x.jsonl").write_text("no object\n")
    store = str(tmp_path / "store")
    where = [str(tmp_path / n) for n in ("api.log", "web.log", "x.jsonl", "gone.log", "api.log")]
    assert writes.ingest_files(spark, where, store) == {"parsed": 3, "inserted": 3, "skipped": 0}
    got = {(r.service, r.parser_type, r.raw_message) for r in Store(spark, store).read("log_entries").collect()}
    assert got == {("api", "json", '{"message":"first","ts":"2026-03-12T22:01:10Z"}'), ("web", "text", "plain first"), ("web", "text", '{"message":"an object in a text file"}')}
    assert writes.ingest_files(spark, [str(tmp_path / "none")], store)["parsed"] == 0
    assert writes.ingest_push(spark, '{"raw":"pushed","ts":"2026-03-12T22:01:10Z"}\nplain\n', store) == {"parsed": 2, "inserted": 2, "skipped": 0}


def test_stored_runs_and_explanations(spark):
    a = Analyzer(incident(spark))
    tables = writes.store_run(a, W, "r1")
    assert tables["cluster_runs"].first().status == "completed" and tables["clusters"].count() == 5
    assert tables["cluster_members"].groupBy("fingerprint").count().agg(F.max("count")).first()[0] <= 100
    none = spark.createDataFrame([], "prompt_hash string, scope string, result_json string, created_at timestamp")
    packet, kept, hit = writes.explain_cached(a, none, W, T0)
    again, after, second = writes.explain_cached(a, kept, W, T0)
    assert (hit, second, again, after.count()) == (False, True, packet, 1) and packet["confidence"] == "high"
    assert not writes.explain_cached(a, kept, W, T0, service="api")[2] and not writes.explain_cached(a, kept, W, T0, refresh=True)[2]
    assert registry.purge_due(None, False, T0, 60) and not registry.purge_due(None, True, T0, 60) and not registry.purge_due(T0, False, T0 + timedelta(seconds=59), 60) and not registry.purge_due(None, False, T0, 0)
    assert registry.evidence_out(["x", {"detail": "d", "kind": "k", "ref": "r"}])[1] == {"kind": "k", "detail": "d", "ref": "r", "source_ref": None}


def test_vectors_of_entries(spark):
    e = spark.createDataFrame([("1", "a b", "r"), ("2", " ", " "), ("3", None, "raw"), (None, "x", "x")], "id string, normalized_message string, raw_message string")
    got = registry.log_vectors(e, embed.embed, 64, "hash")
    assert sorted(r.log_entry_id for r in got.collect()) == ["1", "3"] and got.first().model_name == "hash"
    assert registry.log_vectors(e, embed.embed, 1536, "hash").count() == registry.log_vectors(e, None, 64, "hash").count() == 0
    stored = spark.createDataFrame([("s", "f", "old", [1.0], T0, T0, 1, T0, T0)], "scope string, fingerprint string, template string, embedding array<float>, first_seen timestamp, last_seen timestamp, count bigint, updated_at timestamp, created_at timestamp")
    ranked = spark.createDataFrame([("f", "new", T0, T0, 5), ("g", " ", T0, T0, 5), ("", "x", T0, T0, 5)], "fingerprint string, representative_message string, first_seen timestamp, last_seen timestamp, count bigint")
    rows = registry.cluster_vectors(stored, ranked, "s", embed.embed, 64, T0 + timedelta(days=1)).collect()
    assert [(r.fingerprint, r.template, r["count"], len(r.embedding), r.created_at) for r in rows] == [("f", "new", 5, 64, T0.replace(tzinfo=None))]
