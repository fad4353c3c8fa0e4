"""What the plans of the queries hold, how often, and what failures of others do."""

import pytest
from pyspark.sql import functions as F

from emberlog import queries
from emberlog.functions import embed
from emberlog.operators import retrieval
from emberlog.plans import writes
from emberlog.plans.verbs import Analyzer, Options

SF = "/root/testdata/sf0.001"
RULES = 20


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["ask_keyword", "ask_clusters", "clusters_topk", "timeline_order"])
def test_each_scan_is_normalised_once(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert text.count("regexp_replace") <= RULES * text.count("Relation"), name


def test_plain_logs_are_not_normalised(spark):
    for name in ("trigger_flag", "window_count", "retention_counts"):
        assert plan(queries.QUERIES[name](spark, SF)).count("regexp_replace") < 5, name


def test_policies_are_found_once(spark):
    assert plan(queries.retention_counts(spark, SF)).count("Relation") <= 12


def test_words_are_sought_in_templates_only(spark):
    text = queries.ask_templates(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    sought = [x for x in text.splitlines() if "like" in x.lower() or "contains" in x.lower()]
    assert sought and all("normalized_message" not in x.split("Filter")[-1] for x in sought)


def test_vectors_come_with_the_batch(spark, tmp_path):
    from functools import partial

    from emberlog.operators import ingest, registry
    from emberlog.sources.store import Store
    from emberlog.streaming import tail

    lines = tail.with_line_fields(spark.createDataFrame([("2026-03-12T22:01:10Z ERROR api down 17", "f"), ("2026-03-12T22:01:11Z ERROR api down 18", "f")], "text string, source_ref string"))
    path, vectors = str(tmp_path / "s"), partial(registry.log_vectors, embed=embed.embed, dim=64, model="m")
    entries = ingest.to_entries(lines)
    for _ in range(2):
        ingest.append_entries(entries, path, vectors=vectors)
    store = Store(spark, path)
    assert {r.log_entry_id for r in store.read("log_embeddings").collect()} == {r.id for r in store.read("log_entries").collect()}
    assert store.read("log_embeddings").count() == 2 and store.read("templates").count() == store.read("log_entries").select("fingerprint").distinct().count()
    hits, mode = retrieval.retrieve(store.read("log_entries"), "api down", store.read("log_embeddings").select(F.col("log_entry_id").alias("id"), "embedding"), embed.embed_text)
    assert mode in ("semantic", "keyword") and hits.count() == 2


def test_paths_are_read_once(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    for p in ("d/a.log", "d/sub/b.log"):
        (tmp_path / p).write_text("one line\n")
    d, a, sub, b = (str(tmp_path / p) for p in ("d", "d/a.log", "d/sub", "d/sub/b.log"))
    store = lambda: str(tmp_path / f"store{len(list(tmp_path.iterdir()))}")
    for paths, recursive, n in (([d, a], False, 1), ([a, f"{d}/", d], False, 1), ([d, b], False, 2), ([d, sub], False, 2), ([b, d, a, sub], True, 2), ([a, f"file:{a}", f"{d}/sub/../a.log"], False, 1)):
        assert writes.ingest_files(spark, paths, store(), recursive=recursive)["parsed"] == n, (paths, recursive)


def test_only_the_provider_may_fail(spark):
    e = queries.logs(spark, SF)
    down = Analyzer(e, options=Options(merge_threshold=0.9), embed=lambda rows: (_ for _ in ()).throw(ConnectionError("down")))
    assert down.clusters(queries.A).count() > 0 and down.merge_mode == "fingerprint"
    up = Analyzer(e, options=Options(merge_threshold=0.9), embed=embed.embed)
    assert up.clusters(queries.A).count() > 0 and up.merge_mode == "semantic"
    broken = Analyzer(e.withColumn("scope", F.raise_error(F.lit("table is broken")).cast("string")), options=Options(merge_threshold=0.9), embed=embed.embed)
    with pytest.raises(Exception, match="table is broken"):
        broken.clusters(queries.A)
    with pytest.raises(Exception, match="table is broken"):
        bad = e.select("id", F.raise_error(F.lit("table is broken")).cast("array<float>").alias("embedding"))
        retrieval.retrieve(e, "why", bad, lambda q: [1.0, 0.0])


def test_verbs_give_texts(spark):
    a = Analyzer(queries.logs(spark, SF).persist())
    told = a.report(queries.A, command="again")
    assert told.startswith("# Incident report") and "```bash" in told
    p = a.explain(queries.A)
    assert p["short_summary"] and p["short_summary"] in p["summary"].replace("Primary issue: ", "")
    assert "Incident timeline" in a.timeline_text(queries.A) and a.timeline_text(queries.A).count("\n") > 5
    assert "Errors that" in a.compare_text(queries.A, queries.B) or "No significant" in a.compare_text(queries.A, queries.B)
    assert a.similar_text(queries.A).startswith("Saw fingerprint")
    a.entries.unpersist()
