"""A vector for a text without any model: hashed words and letter triples. For tests and as a stand-in."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed_text(text: str | None, dim: int = 64) -> list[float]:
    out = np.zeros(dim)
    low = (text or "").lower()
    for token in re.findall(r"\w+", low) + [low[i : i + 3] for i in range(max(0, len(low) - 2))]:
        h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        out[h % dim] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(out)
    return (out / n if n else out).tolist()


def embed(rows: DataFrame, column: str = "template", dim: int = 64) -> DataFrame:
    """Add the column embedding."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embed_text(t, dim))

    return rows.withColumn("embedding", run(F.col(column)))
