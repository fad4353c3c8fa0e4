from pyspark.sql import functions as F

import corpus_pipeline
from emberlog.llm import nearcopies, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, out[-1], SF).persist()
        if i + 1 < len(corpus_pipeline.STAGES):
            assert got.columns == columns, name
        out.append(got)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in out]
    # each stage against the operator applied to its own input
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(out[0], labels.select("doc_id", F.col("toxic").alias("label")))
    assert ids[1] == {r.doc_id for r in out[0].collect() if model.score(r.text) < 0.5}
    model = quality.train(out[1], labels.select("doc_id", F.col("quality").alias("label")))
    assert ids[2] == {r.doc_id for r in out[1].collect() if model.score(r.text) >= corpus_pipeline.QUALITY}
    fps = [(r.doc_id, simhash.fingerprint(r.text, 5), set(nearcopies.shingles(r.text).tolist())) for r in out[2].collect()]
    root = [d for d, _, _ in fps]
    group = {d: d for d in root}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    for d, f, x in fps:
        for e, g, y in fps:
            if e < d and ((f ^ g).bit_count() <= 2 or (x & y and len(x & y) >= 0.8 * len(x | y) - 1e-9)):
                a, b = sorted((find(d), find(e)))
                group[b] = a
    assert ids[3] == {find(d) for d in root} and out[3].count() == len(ids[3])
    size = lambda d: d.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(size(out[4]) - 1.5 * size(out[3])) <= 0.02 * size(out[3])
    assert out[5].agg(F.sum("length")).first()[0] == size(out[4])
    assert len(ids[1]) < len(ids[0]) and len(ids[2]) < len(ids[1]) and len(ids[3]) < len(ids[2])


ODD = [(None, "a text without an id", None, None, None), (9000, None, "en", "web", None), (9001, "", None, None, 0), (9002, "word " * 30_000, "en", None, 150_000), (9003, "the same few words", "en", "web", 18), (9003, "the same few words", "en", "web", 18)]


def through(spark, docs):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        out.append((name, docs.columns, docs.collect()))
    return out


def test_odd_rows_pass_all_stages(spark):
    """Nulls, empty and long texts, repeated rows and columns of clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).unionByName(spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long"))
    for name in ("_row", "score", "node", "label", "size", "bin_id"):
        docs = docs.withColumn(name, F.lit(name))
    got = through(spark, docs)
    for name, columns, rows in got[:-1]:
        assert columns == docs.columns and all(r.score == "score" and r._row == "_row" for r in rows), name
    kept = [r for r in got[2][2] if r.doc_id is not None]
    assert len({r.doc_id for r in kept}) == len(kept)
    assert {r.doc_id for r in got[2][2]} <= {r.doc_id for r in got[1][2]}


def test_empty_documents_pass_all_stages(spark):
    assert [len(rows) for _, _, rows in through(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0))] == [0] * 5
