"""Quality classifier: compressed sizes with dictionaries of good and of bad text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import zcodec
from .common import fit_logistic, one_per_bucket, remainder

#: Bounds of what training takes of each label: documents, bytes of each in the dictionary (more,
#: up to LONGEST characters, where documents are few), bytes of the dictionary, and documents
#: whose difference calibrates the score.
SAMPLE, PIECE, LONGEST, DICTIONARY, CALIBRATE = 1200, 400, 8000, 1 << 18, 3000
LEVEL, BLOCK = 3, 2048
#: Parts of the labelled ids; each is calibrated with dictionaries of the others.
FOLDS = 5
#: How far good and bad documents weigh the same when the score is calibrated (0: each document the
#: same, 1: each label). Bad documents are few; in between, both kinds of error are rare.
EVEN = 0.5
#: Added to a text's length, so that the coder's few bytes a block weigh little on short texts.
PAD = 50


class Model:
    """Dictionaries and the two weights of the calibration."""

    def __init__(self, bad: bytes, good: bytes, weights: tuple[float, float], level: int = LEVEL, block: int = BLOCK):
        self.bad, self.good, self.weights, self.level, self.block = bad, good, weights, level, block

    def difference(self, text: str | None) -> float:
        """Bytes that the good dictionary saves over the bad one, for each byte of text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        bad, good = zcodec.sizes(data, [self.bad, self.good], self.level, self.block)
        return (bad - good) / (len(data) + PAD)

    def score(self, text: str | None) -> float:
        z = self.weights[0] * 100 * self.difference(text) + self.weights[1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _map(docs: DataFrame, model: Model, what: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        f = getattr(shared.value, what)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, piece: int = PIECE, size: int = DICTIONARY, calibrate: int = CALIBRATE) -> Model:
    """Learn from docs(doc_id, text) and labels(doc_id, label), label 1 good and 0 bad.

    Dictionaries hold middle pieces of at most `sample` texts of a label. For the calibration,
    at most `calibrate` whole texts of a label are judged on the executors, each by
    dictionaries without its fold of the ids; the model gets those of all folds. Null labels,
    ids and texts teach nothing; an id labelled both ways counts as bad. Without labels of
    both kinds every score is 0.5.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    known = known.withColumn("part", F.col("label") * FOLDS + F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)))
    texts = docs.where("text is not null").select("doc_id", "text")
    parts = zcodec.pieces(texts, zcodec.sample_ids(known, "part", -(-sample // FOLDS)), "part", LONGEST)

    def build(label: int, without: int = -1) -> bytes:
        lists = [parts.get(label * FOLDS + f, []) for f in range(FOLDS) if f != without]
        # pieces of the folds alternate, so that all reach the dictionary
        return zcodec.dictionary([x[i] for i in range(max(map(len, lists))) for x in lists if i < len(x)], size, piece)

    bad, good = build(0), build(1)
    if not bad or not good:
        return Model(b"", b"", (0.0, 0.0))
    trials = [Model(build(0, f), build(1, f), (0.0, 0.0)) for f in range(FOLDS)]
    shared = docs.sparkSession.sparkContext.broadcast(trials)
    chosen = one_per_bucket(known, ["label"], "doc_id", calibrate).select("doc_id", "label")

    def run(batches):
        for b in batches:
            d = [shared.value[k % FOLDS].difference(t.as_py()) for t, k in zip(b.column(0), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.float64()), pa.array([k // FOLDS for k in b.column(1).to_pylist()], pa.int32())], names=["score", "label"])

    judged = texts.join(F.broadcast(chosen.join(known.select("doc_id", "part"), "doc_id")), "doc_id")
    # one text for an id, however many rows repeat it, so that the sample stays bounded
    judged = judged.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("part").cast("int").alias("part")).select("text", "part")
    got = sorted((r.score, r.label) for r in judged.mapInArrow(run, "score double, label int").collect())
    x, y = np.array([[100 * s] for s, _ in got]).reshape(-1, 1), np.array([k for _, k in got], float)
    w = fit_logistic(x, y, np.array([1.0, 0.0]), strength=1e-3, even=EVEN)
    return Model(bad, good, (max(0.0, float(w[0])), float(w[1])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text of docs(doc_id, text); null counts as empty.

    Repeated rows keep a row each, with equal scores; very long texts are read block by block;
    extra columns are ignored; an empty table gives an empty result.
    """
    return _map(docs, model, "score")


def judge(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Train on the labels outside the held-out fold and score all documents.

    Returns doc_id, held_out (false without an id), score, predicted (1 from 0.5 on, so a tie is
    good), a row for each row of docs; for odd rows see score and train.
    """
    fold = remainder(F.col("doc_id"), folds)
    model = train(docs, labels.where(fold != held))
    got = score(docs, model)
    return got.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores `threshold` or more, with all their columns.

    Nulls, empty and long texts and repeated rows are scored as by score; columns of any name go
    along; an empty table stays empty. The texts are judged where they are, so no join moves them.
    """
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            m = shared.value
            text = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array([m.score(t.as_py()) >= threshold for t in text], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
