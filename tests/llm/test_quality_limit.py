import math

import corpus_pipeline
from emberlog.llm import quality


def test_stage_drops_what_the_classifier_rejects(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "_labels", lambda *a: None)
    for score, kept in ((0.1, 0), (0.3, 0), (0.49, 0), (0.51, 1), (0.9, 1)):
        model = quality.Model(b"", b"", (0.0, math.log(score / (1 - score))))
        monkeypatch.setattr(quality, "train", lambda *a, model=model: model)
        assert corpus_pipeline.keep_good(spark, docs, "").count() == kept, score
