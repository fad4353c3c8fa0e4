"""What a session shares with its executors: this package, and a folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Workers import this package also where it is not on their path; once for a session."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-emberlog-code-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)


def shipped(f):
    """f(spark, ...) with the package sent first."""

    @wraps(f)
    def run(spark, *args, **kwargs):
        ship(spark)
        return f(spark, *args, **kwargs)

    return run


#: Folders made since each `scratch` that is open here began.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only a local session that names no such folder gets a temporary one; a cluster must name it,
    since a folder of the driver's machine would be no place that executors could read.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-emberlog-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/emberlog-{uuid.uuid4().hex}"
    for made in _MADE.get():
        made.append(folder)
    return folder


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it again."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """What operators called inside have stored on the way goes at the end, and nothing else.

    For results that are written or collected inside: one that is still lazy then has lost its
    tables. Results of other calls keep theirs.
    """
    made: list[str] = []
    token = _MADE.set((*_MADE.get(), made))
    try:
        yield made
    finally:
        _MADE.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in made:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
