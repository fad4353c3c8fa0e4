import json
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.sources import lines as sources
from emberlog.sources.store import Store
from emberlog.streaming import tail

UTC = timezone.utc
T0 = datetime(2026, 3, 12, 22, tzinfo=UTC)
STAMP = "2026-03-12T22:01:10Z"


def container_lines():
    out = []
    for f in ("a", "b"):
        for i, (stream, tag) in enumerate([("stdout", "F"), ("stdout", "P"), ("stdout", "P"), ("stdout", "F"), ("stderr", "P"), ("stdout", "P"), ("stdout", "F"), ("stderr", "P"), ("stderr", "P")]):
            out.append((f"{STAMP} {stream} {tag} {f}{i} ", f, i))
        out.append(("no container line", f, 9))
    return out


@pytest.mark.parametrize("cut", range(1, 10, 2))
def test_fragments_wait_between_batches(spark, tmp_path, cut):
    df = tail.with_line_fields(spark.createDataFrame(container_lines(), "text string, source_ref string, ordinal bigint"))
    want = sorted((r.source_ref, r.ordinal, r.text) for r in sources.reassemble_cri(df).collect())
    for part in (df.where(F.col("ordinal") < cut), df.where(F.col("ordinal") >= cut)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tail.join_fragments(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.source_ref, r.ordinal, r.text) for r in got) == want


def test_repeats_go_in_the_state_and_batches_count_once(spark, tmp_path):
    text = [(f"{STAMP} ERROR api down {i}", "f") for i in range(5)] + [("no time", "f")] * 2
    df = spark.createDataFrame(text, "text string, source_ref string")
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    for _ in range(2):  # the second finds nothing new
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        assert tail.start_ingest(stream, store, str(tmp_path / "state"), job_id="j", interval=None, lateness="1 hour", alone=True).awaitTermination(120)
    found = Store(spark, store).read("log_entries").collect()
    assert len(found) == 9 == len({r.id for r in found}) and sum(r.timestamp is None for r in found) == 4
    assert Store(spark, store).version().note("jobs", "j") == {"parsed": 9, "inserted": 9, "skipped": 0}


def test_supervised_tail_pauses_and_goes_on(spark, tmp_path):
    """A source that fails pauses its job at the limit; after a resume it goes on where it was."""
    src, path, now = tmp_path / "in", str(tmp_path / "store"), [T0]
    src.mkdir()
    (src / "a.log").write_text("".join(json.dumps({"ts": STAMP, "message": f"m {i}"}) + "\n" for i in range(7)))
    broken = tmp_path / "broken"

    def start(job_id):
        lines = tail.read_file_stream(spark, str(src))
        if broken.exists():
            lines = lines.withColumn("text", F.when(F.raise_error(F.lit("source is down")).isNull(), F.col("text")))
        return tail.start_ingest(lines, path, str(tmp_path / "state"), job_id=job_id, interval=None)

    watch = tail.Supervisor(Store(spark, path), limit=3, interval=timedelta(seconds=30), clock=lambda: now[0])

    def round_of(expected=1):
        started = watch.tick()
        assert len(started) == expected
        for q in started:
            try:
                q.awaitTermination(120)
            except Exception as e:
                assert "source is down" in str(e)
        until = time.time() + 60
        while watch.running and time.time() < until:
            time.sleep(0.1)
        assert not watch.running
        now[0] += timedelta(seconds=30)
        return watch.job("j")

    try:
        watch.add("j", start)
        job = round_of()
        assert (job.status, job.consecutive_errors, job.parsed, job.inserted) == ("running", 0, 7, 7)
        assert job.last_polled_at == T0 and round_of().parsed == 7
        (src / "b.log").write_text(json.dumps({"ts": STAMP, "message": "late"}) + "\n")
        broken.touch()
        assert [round_of().consecutive_errors for _ in range(3)] == [1, 2, 3]
        assert watch.job("j").status == "paused" and watch.tick() == []
        broken.unlink()
        assert watch.apply("j", "resume").consecutive_errors == 0
        job = round_of()
        assert (job.status, job.consecutive_errors, job.parsed, job.inserted) == ("running", 0, 8, 8)
        assert Store(spark, path).read("log_entries").count() == 8
        watch.apply("j", "stop")
        assert watch.tick() == []
        with pytest.raises(ValueError):
            watch.apply("j", "resume")
    finally:
        spark.streams.removeListener(watch)


@pytest.mark.parametrize("size", [1, 64, 200, 4096])
def test_fragments_join_in_and_over_splits(spark, tmp_path, size):
    """Files cut into splits anywhere give what one window over each file gives."""
    folder = tmp_path / "var/log/pods"
    for f in ("a", "b"):
        path = folder / f"ns_pod-{f}_0a1b" / "web"
        path.mkdir(parents=True)
        (path / "0.log").write_text("".join(t + "\n" for t, ref, _ in container_lines() * 3 if ref == f))
    df = tail.with_line_fields(spark.createDataFrame([(t, ref, i) for i, (t, ref, _) in enumerate(container_lines() * 3)], "text string, source_ref string, ordinal bigint"))
    want = sorted((f"ns/pod-{r.source_ref}/web", r.text) for r in sources.reassemble_cri(df).collect())
    # splits of so many lines, as a scan would number them
    cut = df.select("text", "source_ref", (F.shiftleft(F.floor(F.col("ordinal") / size).cast("long"), 33) + F.col("ordinal")).alias("ordinal")).coalesce(1).sortWithinPartitions("source_ref", "ordinal")
    rows = sources.join_within_splits(cut)
    both = rows.where("not edge").drop("edge").unionByName(sources.reassemble_cri(rows.where("edge").drop("edge")))
    assert sorted((f"ns/pod-{r.source_ref}/web", r.text) for r in both.collect()) == want
    got = sources.read_k8s_export(spark, str(folder)).collect()
    assert sorted((r.source_ref, r.text) for r in got) == want and {r.default_service for r in got} == {"web"}
