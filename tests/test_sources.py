import io
import json
import tarfile
import time
import tracemalloc
from datetime import datetime, timedelta, timezone

import pytest

from emberlog.operators import ingest
from emberlog.plans import writes
from emberlog.session import ship
from emberlog.sources import connectors, lines
from emberlog.sources.store import Store
from emberlog.streaming import tail

UTC = timezone.utc
T0 = datetime(2026, 3, 12, 22, tzinfo=UTC)

#: A service that the workers import: an event each ten seconds in each of its streams, ten to a page.
CLIENT = """
import json, os
from datetime import datetime, timedelta, timezone
T0 = datetime(2026, 3, 12, 22, tzinfo=timezone.utc)
def note(options, what):
    with open(os.path.join(options["calls"], f"{os.getpid()}.txt"), "a") as f:
        f.write(json.dumps(what) + chr(10))
class Client:
    def __init__(self, options):
        self.options = options
    def between(self, start, end, at):
        found = [t for t in (T0 + timedelta(seconds=10 * i) for i in range(360)) if start <= t <= end]
        return found[at:at + 10], (at + 10 if at + 10 < len(found) else None)
    def filter_log_events(self, logGroupName, startTime, endTime, limit, nextToken=None):
        note(self.options, [logGroupName, startTime, endTime])
        day = lambda ms: datetime.fromtimestamp(ms / 1000, tz=timezone.utc)
        some, following = self.between(day(startTime), day(endTime), int(nextToken or 0))
        return {"events": [{"timestamp": int(t.timestamp() * 1000), "message": f"{logGroupName} {t.isoformat()}"} for t in some], **({"nextToken": str(following)} if following else {})}
    def search(self, body):
        f = body["filter"]
        note(self.options, [f["indexes"][0], f["from"], f["to"]])
        some, following = self.between(datetime.fromisoformat(f["from"]), datetime.fromisoformat(f["to"]), int(body["page"].get("cursor", 0)))
        return {"data": [{"attributes": {"timestamp": t.isoformat(), "message": "m"}} for t in some], "meta": {"page": {"after": str(following) if following else None}}}
    def query_range(self, query, start, end, limit, direction):
        note(self.options, [query, start, end])
        some, _ = self.between(datetime.fromtimestamp(start / 1e9, tz=timezone.utc), datetime.fromtimestamp(end / 1e9, tz=timezone.utc), 0)
        hits = [t for t in some if "|=" not in query or t.second == 20]
        return {"data": {"resultType": "streams", "result": [{"stream": {"app": "web"}, "values": [[str(int(t.timestamp()) * 10**9), f"second {t.second}"] for t in hits]}]}}
def make(options):
    return Client(options)
"""


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("service")
    (folder / "fakeservice.py").write_text(CLIENT)
    spark.sparkContext.addPyFile(str(folder / "fakeservice.py"))
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    connectors.register(spark)

    def options(**more):
        calls = tmp_path_factory.mktemp("calls")
        return {"client": "fakeservice:make", "start": T0.isoformat(), "end": (T0 + timedelta(hours=1)).isoformat(), "calls": str(calls)} | more

    yield options
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def calls(options):
    from pathlib import Path

    return [json.loads(x) for p in Path(options["calls"]).iterdir() for x in p.read_text().splitlines()]


@pytest.mark.parametrize(("kind", "streams"), [("cloudwatch", {"log_groups": "a,b"}), ("datadog", {"index": "a,b"})])
def test_slices_and_pushed_conditions(spark, service, kind, streams):
    o = service(**streams, slice_seconds="600")
    df = spark.read.format(kind).options(**o).load()
    assert df.rdd.getNumPartitions() == 12
    rows = df.collect()
    assert len(rows) == 720 == len({(r.source_ref, r.received_at) for r in rows})
    o = service(**streams, slice_seconds="600")
    some = spark.read.format(kind).options(**o).load().where("source_ref = 'a' and received_at >= '2026-03-12 22:10:05' and received_at < '2026-03-12 22:30:00'")
    assert some.rdd.getNumPartitions() == 2
    got = sorted(r.received_at for r in some.collect())
    assert len(got) == 119 and got[0] == datetime(2026, 3, 12, 22, 10, 10) and got[-1] == datetime(2026, 3, 12, 22, 29, 50)
    assert {c[0] for c in calls(o)} == {"a"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan or "BatchScan" in plan
    assert spark.read.format(kind).options(**o).load().where("source_ref = 'a' and source_ref in ('b', 'c')").count() == 0


def test_text_goes_into_the_query(spark, service):
    o = service(query='{app="web"}', slice_seconds="3600", limit="5000")
    got = spark.read.format("loki").options(**o).load().where("contains(text, 'second 20')").collect()
    assert got and {r.text for r in got} == {"second 20"}
    assert {c[0] for c in calls(o)} == {'{app="web"} |= "second 20"'}


def test_stream_windows_are_read_in_tasks(spark, service, tmp_path):
    o = service(log_groups="a,b", slice_seconds="300")
    out = str(tmp_path / "out")
    for minutes in (20, 20, 60):  # the second finds nothing new
        now = (T0 + timedelta(minutes=minutes, seconds=1)).isoformat()
        df = spark.readStream.format("cloudwatch").options(**o, now=now).load()
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 720 == len({(r.source_ref, r.received_at) for r in rows})


def test_a_batch_goes_on_behind_its_last_chunk(spark, service, tmp_path, monkeypatch):
    o, store = service(log_groups="a,b"), str(tmp_path / "store")
    append, n = ingest.append_entries, []

    def breaks(*a, **k):
        n.append(1)
        if len(n) == 3:
            raise ConnectionError("gone")
        return append(*a, **k)

    monkeypatch.setattr(ingest, "append_entries", breaks)
    with pytest.raises(ConnectionError):
        writes.ingest_source(spark, "cloudwatch", o, store, "j", chunk="20m")
    at = Store(spark, store).version().note("jobs", "j")["cursors"]["at"]
    assert at == (T0 + timedelta(minutes=40)).isoformat()
    o["calls"] = service()["calls"]
    got = writes.ingest_source(spark, "cloudwatch", o, store, "j", chunk="20m")
    assert got["inserted"] == 720 == Store(spark, store).read("log_entries").count()
    assert all(c[1] >= int((T0 + timedelta(minutes=40)).timestamp() * 1000) for c in calls(o))
    assert writes.ingest_source(spark, "cloudwatch", o, store, "j", chunk="20m") == got


def test_tails_of_services_are_taken_up_again(spark, service, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for minutes, want in ((10, 60), (30, 180)):
        o = service(log_groups="a", now=(T0 + timedelta(minutes=minutes)).isoformat())
        watch = tail.Supervisor(store, interval=timedelta(0), clock=lambda m=minutes: T0 + timedelta(minutes=m))
        try:
            if minutes == 10:
                watch.add_source("j", "cloudwatch", o, str(tmp_path / "state"), scope="team")
            else:  # another process: the store tells what runs; only its clock is another
                store.update(lambda v, o=o: v.notes["tail_sources"]["j"]["options"].update(o) or v)
                watch.restore()
            (q,) = watch.tick()
            assert q.awaitTermination(120)
            until = time.time() + 60
            while watch.running and time.time() < until:
                time.sleep(0.1)
            assert watch.job("j").inserted == want and watch.job("j").consecutive_errors == 0
        finally:
            spark.streams.removeListener(watch)
    assert {r.scope for r in store.read("log_entries").collect()} == {"team"}


def test_slices_of_a_window():
    parts = connectors.slices(["s"], T0, T0 + timedelta(seconds=25), 10)
    assert [(p.start - T0).total_seconds() for p in parts] == [0, 10, 20] and [p.last for p in parts] == [False, False, True]
    assert len(connectors.slices(["s"], T0, T0, 10)) == 1
    r = connectors.TailReader("cloudwatch", {"start": T0.isoformat(), "log_group": "g", "lag_seconds": "5"}, clock=lambda: T0 + timedelta(seconds=3))
    assert r.latestOffset() == r.initialOffset() and r.partitions(r.initialOffset(), r.latestOffset()) == []


class Endless(io.RawIOBase):
    """So many bytes of log lines, made as they are read."""

    def __init__(self, size):
        self.left = size

    def readable(self):
        return True

    def readinto(self, b):
        n = min(len(b), self.left)
        b[:n] = (b"x" * 99 + b"\n") * (n // 100) + b"y" * (n % 100)
        self.left -= n
        return n


def test_members_are_read_forward(spark, tmp_path):
    path, size = tmp_path / "export.tar.gz", 200 << 20
    with tarfile.open(path, "w:gz", compresslevel=1) as tar:
        for name, n in (("var/log/pods/ns_pod-1_0a1b/web/0.log", size), ("notes.md", 10)):
            info = tarfile.TarInfo(name)
            info.size = n
            tar.addfile(info, io.BufferedReader(Endless(n), 100_000))
    tracemalloc.start()
    began, n, last = time.time(), 0, -1
    for b in lines.archive_lines(str(path), rows=65_536):
        n, last = n + b.num_rows, b.column(2)[-1].as_py()
        if time.time() - began > 60:
            break
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 100_000 and last == n - 1 and peak < 60 << 20


def test_archives_lines_keep_path_and_place(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    with tarfile.open(folder / "export.tar", "w") as tar:
        data = "one\r\ntwo\x0bhalf\n\nlast \u00e9".encode()
        info = tarfile.TarInfo("var/log/pods/ns_pod-1_0a1b/web/0.log")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    rows = sorted((r.ordinal, r.text, r.default_service, r.default_environment) for r in lines.read_k8s_export(spark, str(folder)).collect())
    assert rows == [(0, "one", "web", "ns"), (1, "two\x0bhalf", "web", "ns"), (2, "", "web", "ns"), (3, "last \u00e9", "web", "ns")]


def test_paths_of_options_come_first(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n")
    assert connectors.file_options({"path": "p"}, ["q"], True) == {"paths": ["p"], "recursive": True}
    assert connectors.file_options({"recursive": False}, ["q"], True) == {"paths": ["q"], "recursive": False}
    assert connectors.file_options(None) == {"paths": []}
    for kind in ("file", "k8s"):
        assert [r.text for r in connectors.read(spark, kind, {"paths": [str(tmp_path)]}, ["elsewhere"]).collect()] == ["one"]
