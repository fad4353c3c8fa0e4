from pyspark.sql import functions as F

from emberlog import queries
from emberlog.plans import verbs


def test_all_clusters_reach_the_merge(spark, monkeypatch):
    seen = []
    found = spark.range(1005).select(F.col("id").cast("string").alias("fingerprint"), F.lit("m").alias("representative_message"))
    monkeypatch.setattr(verbs.cluster, "clusters", lambda *a: found if a[-1] is None else found.limit(a[-1]))
    monkeypatch.setattr(verbs.cluster, "rank", lambda f, top: f.limit(top))

    def merge(ranked, vectors, threshold, least, top):
        seen.append((ranked.count(), vectors.count(), top))
        return ranked.limit(top)

    monkeypatch.setattr(verbs.semantic, "merge_clusters", merge)
    options = verbs.Options(merge_threshold=0.9)
    verbs.Analyzer(found, options=options, embed=lambda t: t.withColumn("embedding", F.array(F.lit(1.0)))).clusters(queries.A, top=7)
    assert seen == [(1005, 1005, 7)]
