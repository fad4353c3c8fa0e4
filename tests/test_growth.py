"""Work that must not grow faster than the tables."""

from datetime import datetime, timedelta, timezone

import duckdb
import numpy as np
from pyspark.sql import functions as F

from emberlog import queries
from emberlog.llm.common import connected_components
from emberlog.operators import graph, registry, semantic
from emberlog.sources.store import Store

T0 = datetime(2024, 5, 1, 10)


def _joined(frame) -> int:
    """The most rows that a join of an executed plan has put out."""
    most, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        if "Join" in kind:
            most = max(most, p.metrics().apply("numOutputRows").value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_explanations_of_one_window_are_counted_once(spark):
    entries = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "other").otherwise("default").alias("scope"), F.concat(F.lit("s"), F.col("id") % 2).alias("service"), F.when(F.col("id") % 5 > 0, "prod").alias("environment"),
        (F.lit(T0) + F.make_interval(secs=F.col("id") * 7)).alias("timestamp"),
    )
    cuts = [(timedelta(0), timedelta(0)), (timedelta(seconds=7), timedelta(seconds=20)), (timedelta(minutes=3, seconds=1), timedelta(hours=2, minutes=59)), (timedelta(hours=1), timedelta(hours=3) - timedelta(microseconds=1)), (-timedelta(days=1), timedelta(days=2))]
    rows = [(f"{i}-{k}", T0 + a, T0 + b, s, e) for k in range(100) for i, (a, b, s, e) in enumerate((a, b, s, e) for a, b in cuts for s in (None, "s0", "s1") for e in (None, "prod"))]
    x = spark.createDataFrame(rows, "id string, window_start timestamp, window_end timestamp, service_filter string, environment_filter string")
    found = registry.majority_scope_by_window(x, entries)
    got = {r.id: r.scope for r in found.collect()}
    lines, want = entries.collect(), {}
    for i, start, end, s, e in rows[: len(rows) // 100]:
        n = {}
        for r in lines:
            if start <= r.timestamp <= end and s in (None, r.service) and e in (None, r.environment):
                n[r.scope] = n.get(r.scope, 0) + 1
        if n:
            want[i.partition("-")[0]] = min(n, key=lambda k: (-n[k], k))
    assert got == {f"{i}-{k}": s for i, s in want.items() for k in range(100)}
    assert _joined(found) <= 2 * len(rows)  # not each explanation with each entry


def test_vectors_of_many_dimensions_meet_in_blocks(spark, monkeypatch):
    """Evenly spread vectors share their cells, so a join by cells met most pairs; products of blocks need no join."""
    monkeypatch.setattr(semantic, "BLOCK", 100, raising=False)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 64))
    x[600:] = x[:300] + 0.8 * rng.normal(size=(300, 64))
    odd = [("inf", [float("inf")] + [0.0] * 63), ("zero", [0.0] * 64), (None, x[0].tolist()), ("empty", []), ("k001", x[0].tolist())]
    found = semantic.merge_edges(spark.createDataFrame([(f"k{i:03}", v.tolist()) for i, v in enumerate(x)] + odd, "fingerprint string, embedding array<double>").repartition(3), 0.45)
    keys, all_x = [f"k{i:03}" for i in range(900)] + ["k001"], np.vstack([x, x[:1]])
    unit = all_x / np.linalg.norm(all_x, axis=1)[:, None]
    cos = unit @ unit.T
    want = sorted((keys[i], keys[j], round(cos[i, j], 9)) for i in range(901) for j in range(901) if keys[i] < keys[j] and cos[i, j] >= 0.45)
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in found.collect()) == want and len(want) > 250
    assert _joined(found) == 0


def test_responses_are_rounded_once(spark, tmp_path):
    """A ratio of 9.645 is 9.6 and not 9.65 first and then 9.7."""
    path = str(tmp_path / "events.parquet")
    spark.range(1000 + 9644).selectExpr("id AS event_id", "TIMESTAMP '2024-01-09 05:00:00' + make_interval(0, 0, 0, IF(id < 999, 0, 2)) AS ts", "5L AS user_id", "'view' AS event_type", "1.0D AS value", "'' AS props").write.parquet(path)
    got = queries.cluster_response(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    assert [tuple(r) for r in got] == [tuple(float(v) if i > 3 else v for i, v in enumerate(r)) for r in con.execute(queries.ORACLE_SQL["cluster_response"]).fetchall()]
    assert got[0].change_ratio == 9.6


SF = "/root/testdata/sf0.001"


def test_merging_reads_the_log_once(spark):
    plan = queries.merge_clusters(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan  # clusters are stored before they are named several times


def test_stream_slices_stay_small(spark, tmp_path, monkeypatch):
    """A micro-batch has a bounded number of lines, however long the table is; none is lost."""
    monkeypatch.setattr(queries, "SLICE", 700, raising=False)
    sizes = []
    replay = queries._replay
    monkeypatch.setattr(queries, "_replay", lambda spark, folder, slices, start: (sizes.extend(s.count() for s in slices), replay(spark, folder, slices, start)))
    (tmp_path / "t").mkdir()
    spark.range(5000).selectExpr("IF(id < 4000, id, id * 1000) AS event_id", "id % 7 AS user_id", "element_at(array('view', 'click', 'error', 'purchase'), CAST(id * 7 % 11 % 4 AS INT) + 1) AS event_type", "CAST(NULL AS TIMESTAMP) AS ts", "1.0D AS value", "'' AS props").write.parquet(str(tmp_path / "t" / "events.parquet"))
    got = sorted(tuple(r) for r in queries.stream_cri_reassembly(spark, str(tmp_path / "t")).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/t/events.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.ORACLE_SQL["stream_cri_reassembly"]).fetchall())
    assert sum(sizes[:-1]) == 5000 and max(sizes) <= 720


def _sorts_files(frame) -> bool:
    """Whether an executed plan sorts rows as it reads them from files, before anything has made them fewer."""
    todo = [(frame._jdf.queryExecution().executedPlan(), False)]
    while todo:
        p, sort = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append((p.executedPlan(), False))
        elif kind.endswith("QueryStageExec"):
            todo.append((p.plan(), False))
        if sort and kind == "FileSourceScanExec":
            return True
        sort = not kind.endswith("HashAggregateExec") and (sort or kind == "SortExec")
        children = p.children()
        todo += [(children.apply(i), sort) for i in range(children.size())]
    return False


def test_stored_rows_are_counted_without_sorting_them(spark, tmp_path, monkeypatch):
    """One task may read all rows of a scope; to count them it needn't hold them. Many files are one piece."""
    rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, "a").alias("scope"), F.col("id"), F.when(F.col("id") % 20 > 0, F.lit(T0) + F.make_interval(secs=F.col("id"))).alias("at"))
    seen, kind = [], type(rows)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (collect(self), seen.append(self))[0])
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 30)
    try:
        pieces = Store(spark, str(tmp_path)).write(rows, ("scope",), F.col("at"))[1]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    low = int(T0.replace(tzinfo=timezone.utc).timestamp())
    found = {p["at"]["scope"]: (p["rows"], p["low"], p["high"]) for p in pieces}
    assert len(pieces) == 2 and found == {"a": (900, (low + 1) * 1_000_000, (low + 999) * 1_000_000), None: (100, (low + 10) * 1_000_000, None)}
    assert len(list((tmp_path / "data").rglob("*.parquet"))) > 20
    assert len(seen) == 1 and not _sorts_files(seen[0])


def test_estimates_of_components_do_not_multiply(spark):
    """Each round of checkpoints multiplied the planner's size of the table with itself, until the number filled the driver."""
    rng = np.random.default_rng(11)
    ids = [f"{i:02}" for i in rng.permutation(60)]
    links = list(zip(ids[:40], ids[1:40])) + [(ids[40], x) for x in ids[41:55]] + [(ids[0], ids[0]), (ids[3], ids[2])]
    groups = [ids[:40], ids[40:55]]
    want = {x: min(g) for g in groups for x in g}
    edges = spark.createDataFrame(links, "a string, b string")
    parts = graph.min_label_components(spark.createDataFrame([(x,) for x in ids], "node string"), edges)
    assert parts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 100  # the nodes count as 2^63 bytes
    assert sorted(map(tuple, parts.collect())) == sorted((x, want.get(x, x)) for x in ids)
    roots = connected_components(edges)
    assert roots._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 30
    assert {r.node: r.root for r in roots.collect()} == want
