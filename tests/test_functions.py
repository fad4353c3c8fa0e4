from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.functions import text, timeutil
from emberlog.operators import retention, retrieval
from emberlog.plans import render

UTC = timezone.utc
NOW = datetime(2026, 3, 12, 22, tzinfo=UTC)


@pytest.mark.parametrize(
    ("message", "want"),
    [
        ("User 123456 failed login", "User <id> failed login"),
        ("User 123456789 failed login", "User <hex> failed login"),
        ("order id #42 took 1.5 s from 10.1.2.3:8080", "order <id> took <duration> from <ip>"),
        ("see https://x.io/a?b=1&c=2 now", "see https://x.io/a?<params> now"),
        ("request_id=abc-1  done\t", "request_id=<*> done"),
        ("evt_123456 kept", "evt_123456 kept"),
        ("at 2026-03-12T22:00:00Z in /var/log/app/x/y.log", "at <timestamp> in <path>"),
        ("mail a.b@c.org port :8443", "mail <email> port :<port>"),
        ("550e8400-e29b-41d4-a716-446655440000", "<uuid>"),
        ("count 12345 and 200", "count <num> and 200"),
        ("٣٤٥٦٧ x", "<num> x"),
        ("", ""),
    ],
)
def test_normalize(spark, message, want):
    assert spark.createDataFrame([(message,)], "m string").select(text.normalize(F.col("m"))).first()[0] == want


def test_scalars(spark):
    df = spark.createDataFrame([("Deploy completed v2.4.1", "CRIT "), ("pod restarted", ""), ("nothing", "odd"), (None, None)], "m string, l string")
    rows = df.select(text.is_trigger(F.col("m")), text.trigger_type(F.col("m")), text.trigger_key(F.col("m")), text.canonical_level(F.col("l")), text.truncate_words(F.col("m"), 8)).collect()
    assert [tuple(r) for r in rows] == [(True, "deploy", "deploy completed", "fatal", "Deploy…"), (True, "pod", "pod restarted", "info", "pod rest…"), (False, None, "nothing", "odd", "nothing"), (False, None, None, "info", "")]
    assert df.select(text.fingerprint(F.lit(""))).first()[0] == "empty"


def test_windows():
    w = timeutil.resolve_window(NOW, "30m")
    assert (w.start, w.end) == (NOW - timedelta(minutes=30), NOW)
    assert timeutil.baseline_window(w, timedelta(hours=24)).end == w.start
    a, b = timeutil.compare_windows(NOW, "1h", "1d")
    assert a.start - b.start == timedelta(days=1)
    assert timeutil.resolve_window(NOW, from_time="2026-03-12T20:00:00").end == NOW
    for bad in ({"to_time": NOW}, {"from_time": NOW, "to_time": NOW}, {"since": "soon"}):
        with pytest.raises(ValueError):
            timeutil.resolve_window(NOW, **bad)
    assert timeutil.parse_duration("1.5h") == timedelta(minutes=90) and timeutil.parse_duration("2 weeks") == timedelta(days=14)


def test_question():
    assert retrieval.keywords("Why did the checkout-api fail on Monday?") == ["checkout-api", "monday"]
    assert retrieval.level_hint("failures in billing") == "error" and retrieval.level_hint("slow pages") == "warn" and retrieval.level_hint("hm") is None


def test_visibility():
    v = retrieval.resolve_visibility
    assert v(False, "s", None).cross_scope and not v(False, "s", False).cross_scope and v(True, "s", None, "admin").cross_scope
    assert not v(True, "s", None, "query", True).cross_scope and v(True, "s", True, "query", True).cross_scope and v(True, "s", True, "query") == retrieval.Visibility(False, "s")


def test_retention_intervals():
    assert retention.parse_interval("30d") == timedelta(days=30)
    assert all(retention.parse_interval(x) is None for x in (None, "", "0", "off", " Never ", "false", "0d"))
    for bad in ("3 d", "soon"):
        with pytest.raises(ValueError):
            retention.parse_interval(bad)


def test_render():
    c = {"count": 39, "services": {"api": 39}, "representative_message": "POST /api/checkout 500", "baseline_count": 0, "change_ratio": 40.0, "first_seen": NOW}
    t = [{"message": "Deploy completed for billing", "timestamp": NOW - timedelta(minutes=3), "service": "billing"}]
    items = render.evidence_items(c, [dict(c, representative_message="42 events pending", count=1)], t, 100)
    assert items == ["39 similar failures in api", "Not observed in prior 24h baseline", "First error spike occurred 3m after deploy completed for billing", "Endpoint '/api/checkout' appears in the primary error cluster", "Webhook queue grew to 42 pending items (observed in 1 log event)"]
    assert render.evidence_items(None, [], [], 7) == ["Total logs in window: 7", "No significant error clusters detected"]
    assert render.answer("q", [], 0) == "No relevant log patterns found for: q"
    assert render.human_duration(timedelta(hours=25, minutes=1)) == "1d 1h 1m"
