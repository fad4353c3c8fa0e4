import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.operators import ingest, registry, retention
from emberlog.sources.store import Conflict, Store
from emberlog.streaming import tail

UTC = timezone.utc
T0 = datetime(2026, 3, 12, 22, tzinfo=UTC)
BY = ("scope",)


def rows(spark, *values):
    return spark.createDataFrame([(i, scope, T0 - timedelta(days=d)) for i, scope, d in values], "id string, scope string, created_at timestamp")


def ids(store, name="log_entries", version=None):
    return sorted(r.id for r in store.read(name, version).collect())


def test_versions_and_odd_partitions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("log_entries") is None and store.version().number == 0
    assert store.append("log_entries", rows(spark, ("a", "x y/z=1%:", 0), ("b", "7", 0), ("c", None, 0)), BY, F.col("created_at")) == 3
    old = store.version()
    assert store.append("log_entries", rows(spark, ("d", "7", 1)), BY, F.col("created_at")) == 1
    assert ids(store) == ["a", "b", "c", "d"] and ids(store, version=old) == ["a", "b", "c"]
    assert {(r.id, r.scope) for r in store.read("log_entries").collect()} == {("a", "x y/z=1%:"), ("b", "7"), ("c", None), ("d", "7")}
    assert store.append("log_entries", rows(spark), BY) == 0 and ids(store) == ["a", "b", "c", "d"]


def test_a_writer_that_dies_before_its_version_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.append("log_entries", rows(spark, ("a", "s", 0), ("b", "s", 9)), BY, F.col("created_at"))

    def die(*_):
        raise KeyboardInterrupt

    over = spark.createDataFrame([], "scope string, raw_interval string, summary_interval string")
    with monkeypatch.context() as m:
        m.setattr(Store, "_create", die)
        with pytest.raises(KeyboardInterrupt):
            store.append("log_entries", rows(spark, ("c", "s", 0)), BY)
        with pytest.raises(KeyboardInterrupt):
            retention.purge_store(store, over, "5d", None, T0)
    assert ids(store) == ["a", "b"] and store.version().number == 1
    assert store.vacuum(datetime.now(UTC) - timedelta(hours=1)) == 0  # what is young may belong to a writer at work
    assert store.vacuum(datetime.now(UTC) + timedelta(hours=1)) == 2 and ids(store) == ["a", "b"]


def test_two_writers_at_once_both_count(spark, tmp_path):
    store, met = Store(spark, str(tmp_path)), []

    def note(v, n):  # another writer comes between this one's reading and its version
        if not met:
            met.append(store.put("settings", {"k": 1}))
        return v

    store.append("log_entries", rows(spark, ("a", "s", 0)), BY, note=note)
    assert store.version().number == 2 and store.version().note("settings", "k") == 1 and ids(store) == ["a"]


def test_claims_race(spark, tmp_path):
    store, out, start = Store(spark, str(tmp_path)), [], threading.Barrier(6)

    def claim(i):
        start.wait()
        out.append(Store(spark, str(tmp_path)).claim("key", f"job-{i}", T0, 60))

    threads = [threading.Thread(target=claim, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len({job for job, _ in out}) == 1 and sorted(again for _, again in out) == [False] + [True] * 5
    assert store.claim("key", "late", T0 + timedelta(seconds=59), 60)[1] and store.claim("key", "late", T0 + timedelta(seconds=60), 60) == ("late", False)
    assert store.version().notes["claims"].keys() == {"key"}


def test_purge_in_one_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("log_entries", rows(spark, ("old", "a", 20), ("older", "a", 30)), BY, F.col("created_at"))
    store.append("log_entries", rows(spark, ("mixed-old", "a", 12), ("mixed-new", "a", 1), ("kept", "b", 99), ("no age", "a", 0)).withColumn("created_at", F.when(F.col("id") != "no age", F.col("created_at"))), BY, F.col("created_at"))
    members = spark.createDataFrame([("old", "a"), ("mixed-new", "a"), ("kept", "b"), ("mixed-old", "a")], "log_entry_id string, scope string")
    store.append("cluster_members", members, BY)
    over = spark.createDataFrame([("b", "off", None)], "scope string, raw_interval string, summary_interval string")
    before = store.version()
    assert retention.purge_if_due(store, over, "10d", "off", T0, 3600) == {("a", "log_entries"): 3, ("a", "cluster_members"): 2}
    assert ids(store) == ["kept", "mixed-new", "no age"] and len(ids(store, version=before)) == 6
    assert sorted(r.log_entry_id for r in store.read("cluster_members").collect()) == ["kept", "mixed-new"]
    assert store.version().number == before.number + 1
    assert retention.purge_if_due(store, over, "10d", "off", T0 + timedelta(minutes=59), 3600) is None
    assert retention.purge_if_due(store, over, "10d", "off", T0 + timedelta(hours=1), 3600) == {}
    assert store.version().note("settings", "last_purge_at") == (T0 + timedelta(hours=1)).isoformat()


def test_upsert_writes_touched_partitions_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    at = lambda d: T0 + timedelta(days=d)
    kind = "fingerprint string, scope string, v int, created_at timestamp, updated_at timestamp"
    frame = lambda *r: spark.createDataFrame(list(r), kind)
    ingest.upsert_store(store, "vectors", frame(("f", "a", 1, at(0), at(0)), ("g", "b", 1, at(0), at(0))), ["scope", "fingerprint"])
    first = {p["at"]["scope"]: p["path"] for p in store.version().pieces("vectors")}
    ingest.upsert_store(store, "vectors", frame(("f", "a", 2, at(1), at(1)), ("h", "a", 3, at(1), at(1)), ("f", "a", 0, at(-1), at(-1))), ["scope", "fingerprint"])
    got = sorted((r.scope, r.fingerprint, r.v, r.created_at) for r in store.read("vectors").collect())
    plain = lambda d: at(d).replace(tzinfo=None)
    assert got == [("a", "f", 2, plain(-1)), ("a", "h", 3, plain(1)), ("b", "g", 1, plain(0))]
    now = {p["at"]["scope"]: p["path"] for p in store.version().pieces("vectors")}
    assert now["b"] == first["b"] and now["a"] != first["a"]


def test_old_versions_go(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(15):
        store.put("settings", {"k": i})
    store.vacuum(datetime.now(UTC) - timedelta(hours=1))
    assert len(store._names("_log")) >= 15
    store.vacuum(datetime.now(UTC) + timedelta(hours=1))
    assert sorted(n for n in store._names("_log") if n.endswith(".json") and n[0] != ".") == [f"{i:010d}.json" for i in range(6, 16)]
    assert store.version().note("settings", "k") == 14


def test_small_pieces_are_written_together(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(4):
        store.append("log_entries", rows(spark, (f"a{i}", "a", i), *([(f"b{i}", "b", i)] if i < 2 else [])), BY, F.col("created_at"))
    before = ids(store)
    assert store.compact("log_entries", F.col("created_at"), most=2) == 4 and store.compact("log_entries", F.col("created_at"), most=2) == 0
    pieces = store.version().pieces("log_entries")
    assert ids(store) == before and sorted(p["at"]["scope"] for p in pieces) == ["a", "b", "b"]
    over = spark.createDataFrame([], "scope string, raw_interval string, summary_interval string")
    assert retention.purge_store(store, over, "36h", None, T0) == {("a", "log_entries"): 2}


def test_rewrites_meet(spark, tmp_path, monkeypatch):
    """An upsert whose partition another one changes meanwhile starts over and loses nothing."""
    store, kind = Store(spark, str(tmp_path)), "fingerprint string, scope string, created_at timestamp, updated_at timestamp"
    up = lambda f: ingest.upsert_store(store, "vectors", spark.createDataFrame([(f, "a", T0, T0)], kind), ["scope", "fingerprint"])
    up("one")
    write, met = Store.write, []

    def meanwhile(self, *a, **k):
        out = write(self, *a, **k)
        if not met:
            met.append(1)
            up("two")
        return out

    monkeypatch.setattr(Store, "write", meanwhile)
    up("three")
    assert sorted(r.fingerprint for r in store.read("vectors").collect()) == ["one", "three", "two"]
    monkeypatch.setattr(Store, "_create", lambda *_: False)
    with pytest.raises(Conflict):
        store.put("settings", {})


def test_entries_of_two_writers_are_compared_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    lines = tail.with_line_fields(spark.createDataFrame([("2026-03-12T22:01:10Z ERROR api down", "f"), ("no time", "f"), ("no time", "f")], "text string, source_ref string"))
    entries = ingest.to_entries(lines, created_at=F.lit(T0))
    write, met = Store.write, []

    def meanwhile(self, *a, **k):
        out = write(self, *a, **k)
        if not met:
            met.append(1)
            assert ingest.append_entries(entries, path)["inserted"] == 3
        return out

    monkeypatch.setattr(Store, "write", meanwhile)
    assert ingest.append_entries(entries, path, token=("s", 0), job_id="j", cursors={"g": "7"}) == {"parsed": 3, "inserted": 2, "skipped": 1}
    found = Store(spark, path).read("log_entries").collect()
    assert len(found) == 5 == len({r.id for r in found})
    assert Store(spark, path).version().note("jobs", "j") == {"parsed": 3, "inserted": 2, "skipped": 1, "cursors": {"g": "7"}}


def test_ids_do_not_follow_from_partitions(spark):
    text = [(f"plain {i % 4}", f"f{i % 2}") for i in range(40)] + [(f"2026-03-12T22:01:{i}Z INFO web up", "f") for i in range(10, 30)]
    lines = tail.with_line_fields(spark.createDataFrame(text, "text string, source_ref string"))
    got = [sorted((r.id, r.original_line_hash) for r in ingest.new_entries(ingest.to_entries(lines.repartition(n), created_at=F.lit(T0)), None).collect()) for n in (1, 7, 64)]
    assert got[0] == got[1] == got[2] and len(set(got[0])) == 60
    assert not registry.purge_due(None, True, T0, 1)
