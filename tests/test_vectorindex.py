from datetime import datetime, timezone

import numpy as np
from pyspark.sql import functions as F

from emberlog.operators import retrieval, vectorindex
from emberlog.sources.store import Store

T0 = datetime(2026, 3, 12, tzinfo=timezone.utc)
SF = "/root/testdata/sf0.1"


def rows_of(spark, df):
    at = F.lit(T0)
    return df.select(F.lit("s").alias("scope"), F.col("vec_id").cast("string").alias("fingerprint"), F.lit("t").alias("template"), "embedding", at.alias("first_seen"), at.alias("last_seen"), F.lit(1).cast("bigint").alias("count"), at.alias("updated_at"), at.alias("created_at"))


def test_probes_find_most_and_read_few_cells(spark, tmp_path):
    """Vectors of the table, and for 100 of them one at a cosine of just 0.8."""
    store, df = Store(spark, str(tmp_path)), spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rng, asked = np.random.default_rng(2), df.where("vec_id % 20 = 0").orderBy("vec_id").limit(100).collect()
    q = np.array([r.embedding for r in asked])
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    r = rng.normal(size=q.shape)
    r -= (r * q).sum(axis=1, keepdims=True) * q
    near = 0.8 * q + 0.6 * r / np.linalg.norm(r, axis=1, keepdims=True)
    planted = spark.createDataFrame([(10**6 + a.vec_id, v.tolist()) for a, v in zip(asked, near)], df.schema)
    vectorindex.put_vectors(store, rows_of(spark, df.unionByName(planted)))
    one = lambda a: spark.createDataFrame([(a.embedding,)], "embedding array<double>")
    cells = {r.fingerprint: r.cell for r in store.read("cluster_embeddings").collect()}
    hit, read = 0, []
    for a in asked[::2]:
        few = vectorindex.near_vectors(store, one(a))
        there = {p.split("cell=")[1].split("/")[0] for p in few.inputFiles()}
        read.append(len(there))
        hit += str(cells[str(10**6 + a.vec_id)]) in there
    assert hit >= 0.95 * 50 and max(read) <= 7 < len(set(cells.values()))
    assert vectorindex.near_vectors(store, one(asked[0]), exact=True).count() == len(cells)


def test_vectors_move_between_cells(spark, tmp_path):
    store, rng = Store(spark, str(tmp_path)), np.random.default_rng(0)
    base = np.concatenate([np.array([10.0, 0, 0]) + rng.normal(size=(40, 3)), np.array([0, 10.0, 0]) + rng.normal(size=(40, 3))])
    frame = lambda rows: rows_of(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    vectorindex.put_vectors(store, frame([(i, v.tolist()) for i, v in enumerate(base)] + [(900, [0.0, 0.0, 0.0]), (901, [float("nan"), 1.0, 1.0]), (902, [1.0])]), cells=2)
    first = {r.fingerprint: r.cell for r in store.read("cluster_embeddings").collect()}
    assert first["0"] != first["79"] and first["900"] == first["901"] == first["902"] == -1
    vectorindex.put_vectors(store, frame([(0, base[79].tolist())]).withColumn("updated_at", F.expr("updated_at + interval 1 day")))
    then = store.read("cluster_embeddings").collect()
    assert len(then) == 83 and {r.fingerprint: r.cell for r in then}["0"] == first["79"]
    q = frame([(0, base[79].tolist())]).select("fingerprint", "embedding")
    found = retrieval.similar_semantic(q, vectorindex.near_vectors(store, q, 1), retrieval.Visibility(False, "s"), "s", 0.9)
    assert "79" in {r.fingerprint for r in found.collect()}
    empty = Store(spark, str(tmp_path / "empty"))
    vectorindex.put_vectors(empty, frame([(1, None)]))
    assert vectorindex.near_vectors(empty, q, 1).count() == 1
