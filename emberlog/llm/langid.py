"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import math

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import zcodec
from .common import remainder

_NOT_LETTERS = regex.compile(r"\P{L}+")
UNKNOWN = "und"
#: Bounds of what training takes from each language: sampled documents, bytes of each in the
#: dictionary (more, up to LONGEST characters, where documents are few), bytes of the dictionary.
SAMPLE, PIECE, LONGEST, DICTIONARY = 600, 500, 4000, 1 << 17
LEVEL, BLOCK = 3, 1024


def letters(text: str) -> str:
    """Lower-cased letters; all else becomes single spaces."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def train(docs: DataFrame, sample: int = SAMPLE, piece: int = PIECE, size: int = DICTIONARY) -> dict[str, bytes]:
    """A raw-content dictionary of each value of lang in docs(doc_id, text, lang).

    Takes middle pieces of at most `sample` documents of a language, chosen by hash of doc_id. Null langs, texts and ids teach nothing.
    """
    known = docs.where("lang is not null and text is not null")
    parts = zcodec.pieces(known.select("doc_id", "text"), zcodec.sample_ids(known.select("doc_id", "lang"), "lang", sample), "lang", LONGEST)
    return {k: zcodec.dictionary([letters(p) for p in v], size, piece) for k, v in sorted(parts.items())}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], reject: float = 0.02, level: int = LEVEL, block: int = BLOCK) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text of docs(doc_id, text).

    The language whose dictionary makes the letters of a text smallest; ties go to the first
    in code-point order. Texts that are null or have no letter are `und` with score 0. The
    score rises from 0.5 with the margin to the second best, relative to it; `rejected`
    marks margins under `reject`, for callers who would rather not know than guess. Without
    any dictionary all is `und`. Extra columns are ignored, repeated rows keep a row each.
    """
    names = sorted(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast([dictionaries[n] for n in names])

    def judge(text: str | None) -> tuple[str, float, bool]:
        data = letters(text or "").encode("utf-8", "surrogatepass")
        if not data or not names:
            return UNKNOWN, 0.0, True
        got = zcodec.sizes(data, shared.value, level, block)
        order = sorted(range(len(got)), key=lambda i: (got[i], i))
        if len(order) == 1:
            return names[0], 1.0, False
        margin = (got[order[1]] - got[order[0]]) / max(1, got[order[1]])
        return names[order[0]], 1 / (1 + math.exp(-min(50 * margin, 30))), margin < reject

    def run(batches):
        for b in batches:
            out = [judge(t.as_py()) for t in b.column(1)]
            cols = [b.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, folds: int = 3, held: int = 1, **kwargs) -> DataFrame:
    """Train on all documents but the held-out fold (crc32 of the id as text) and judge all."""
    fold = remainder(F.col("doc_id"), folds)
    found = predict(docs, train(docs.where(fold != held)), **kwargs)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
