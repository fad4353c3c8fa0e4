"""Bounds that hold whatever the rows are: blank rows, long texts, crowded nodes, equal digests, lazy results."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from emberlog.llm import mixing, nearcopies, queries, simhash, urlfilter
from emberlog.session import scratch

SF = "/root/testdata/sf0.001"


def test_a_lazy_result_outlives_the_pipeline(spark):
    lazy = queries.op7_simhash_near_dedup(spark, SF)
    with scratch(spark) as made:
        n = queries.op4_source_mixing(spark, SF).count()
    assert n and len(made) >= 2
    corpus_pipeline.run(spark, SF)
    assert lazy.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_blank_rows_stand_in_no_shard(spark):
    rows = [(i, "w%d w" % i if i < 10 else [None, "", "  "][i % 3], "a") for i in range(3000)] + [(5000 + i, "x y z", None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, shard=4).collect()
    assert len(got) == len(rows) and all(r.taken == 0 and r.target is not None for r in got if r.size == 0)
    assert {(r.source, r.source_size) for r in got} == {("a", 20), (None, 90)}
    for source in ("a", None):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 4 and all(r.taken <= 2 * r.size for r in mine)


def test_long_sets_make_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    texts = [" ".join([*base, f"tail{i}"]) for i in range(24)] + ["another text of its own"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    links = nearcopies._links
    monkeypatch.setattr(nearcopies, "BYTES", 16_000)
    kept = sorted(r.doc_id for r in nearcopies.keep_representatives(docs).collect())
    assert kept == [0, 24] and links and not seen


def test_crowded_nodes_are_cut_to_the_last_bit(spark):
    fps = spark.range(64).select(F.col("id").alias("fp"))
    nodes = simhash.cut(fps, bucket=1)
    assert max(d for d, _ in nodes) == 64
    got = sorted((r.a, r.b) for r in simhash.near_links(fps, 1, bucket=1).collect())
    root = {i: i for i in range(64)}
    for a, b in got:
        root[max(a, b)] = min(root[a], root[b])
    assert len(got) >= 63


def test_one_row_of_an_id_stays_whatever_the_order(spark):
    rows = [(1, "b", "x"), (1, "a", "z"), (1, "a", "y"), (2, None, "q"), (2, "c", "p"), (None, "t", "u")]
    for seed in range(3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, more string").orderBy(F.rand(seed)).repartition(3)
        named = docs.select("doc_id").where("doc_id is not null")
        assert sorted((tuple(r) for r in simhash.representatives(docs, named).collect()), key=str) == sorted([(1, "a", "y"), (2, None, "q"), (None, "t", "u")], key=str)


def test_hosts_of_equal_digests_are_both_tried(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "_digest", lambda k: 7)
    rules = [("block", "a.org/x"), ("allow", "b.org/long/path"), ("block", "c.org/")]
    name, bounds = urlfilter.build_index(spark, rules)
    index = urlfilter.open_index(name)
    assert len(index.hosts) == 1 and sorted(index.lengths.tolist()) == [0, 1, 9]
