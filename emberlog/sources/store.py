"""Stored tables: Parquet files that Spark writes, and a log of versions that says which of them count.

A version is one JSON document: the pieces of each table (a batch's files of one partition, with
rows and range of age) and notes (claims, cursors, counters, settings). A change writes its files
first and then the next version, which only one writer can: readers see the old version or the new
one, a writer that comes second starts over from the newest, and files that no version names are
remains of a change that failed, removed by `vacuum`.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer was first too often."""


@dataclass
class Version:
    """What counts: pieces and schemas of tables by name, and notes by kind and key."""

    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    notes: dict[str, dict] = field(default_factory=dict)

    def pieces(self, name: str) -> list[dict]:
        return self.tables.get(name, {}).get("pieces", [])

    def note(self, kind: str, key: str, default=None):
        return self.notes.get(kind, {}).get(key, default)

    def with_table(self, name: str, schema: str, by: list[str]) -> Version:
        self.tables.setdefault(name, {"schema": schema, "by": by, "pieces": []})
        return self

    def copy(self) -> Version:
        return Version(self.number, json.loads(json.dumps(self.tables)), json.loads(json.dumps(self.notes)))


@dataclass
class Rewrite:
    """Pieces that go, the rows that come for them (None: none), their age, and which pieces must be just these."""

    gone: list[dict]
    rows: DataFrame | None = None
    age: Column | None = None
    alone: Callable[[dict], bool] | None = None


class Store:
    """Tables below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files of the log

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _read(self, name: str) -> str:
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Write a file that nobody else has written; False if somebody has. Whole or not at all."""
        part, fs = self._path(f"_log/.{uuid.uuid4().hex}")
        stream = fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        path, _ = self._path(name)
        try:
            if fs.getUri().getScheme() == "file":  # where a rename would replace the file
                here = lambda p: urlparse(p.toUri().toString()).path
                try:
                    os.link(unquote(here(part)), unquote(here(path)))
                except FileExistsError:
                    return False
                return True
            return bool(fs.rename(part, path))
        finally:
            fs.delete(part, False)

    # versions

    def version(self) -> Version:
        numbers = [int(n.removesuffix(".json")) for n in self._names("_log") if n.endswith(".json") and not n.startswith(".")]
        return Version(**json.loads(self._read(f"_log/{max(numbers):010d}.json"))) if numbers else Version()

    def update(self, change: Callable[[Version], Version | None], tries: int = 20) -> Version:
        """Make `change` of the newest version the next one; None leaves all as it is.

        It is called again if another writer came first, with what that one has made.
        """
        for _ in range(tries):
            now = self.version()
            then = change(now.copy())
            if then is None:
                return now
            then.number = now.number + 1
            if self._create(f"_log/{then.number:010d}.json", json.dumps({"number": then.number, "tables": then.tables, "notes": then.notes})):
                return then
        raise Conflict(f"{tries} other versions came first")

    # rows

    def write(self, rows: DataFrame, by: Iterable[str], age: Column | None = None) -> tuple[str, list[dict]]:
        """Files of a new batch, which no version names yet: the rows' schema and the pieces.

        Rows of a partition come together before they are written, in as many files as they need, and
        not in one for each task that had some.
        """
        by, batch = list(by), uuid.uuid4().hex
        rows.hint("rebalance", *by).write.partitionBy(*by).parquet(f"{self.root}/data/batch={batch}")
        t = self.spark.read.schema(rows.schema).option("basePath", f"{self.root}/data").parquet(f"{self.root}/data/batch={batch}")
        micros = F.unix_micros((age if age is not None else F.lit(None)).cast("timestamp"))
        # by file first, which Spark counts by hash: the least of texts would sort all rows
        files = t.groupBy(*[F.col(c).cast("string").alias(c) for c in by], F.col("_metadata.file_path").alias("file")).agg(
            F.count("*").alias("rows"), F.min(micros).alias("low"), F.max(micros).alias("high"), F.count(micros).alias("aged")
        )
        # a row for each partition of this batch
        found = files.groupBy(*by).agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("aged").alias("aged"), F.min("file").alias("file"))
        pieces = []
        for r in found.collect():
            folder = unquote(r.file).rpartition("/")[0]
            known = r.aged == r.rows  # a row without an age never expires
            pieces.append({"path": folder[folder.rindex("/data/") + 6 :], "rows": r.rows, "low": r.low, "high": r.high if known else None, "at": {c: r[c] for c in by}})
        return rows.schema.json(), pieces

    def read(self, name: str, version: Version | None = None, pieces: list[dict] | None = None) -> DataFrame | None:
        """A table as of a version (the newest), or some of its pieces; None if it was never written."""
        version = version or self.version()
        if name not in version.tables:
            return None
        return self._rows(version.tables[name]["schema"], version.pieces(name) if pieces is None else pieces)

    def _rows(self, schema_json: str, pieces: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(schema_json))
        if not pieces:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/data")
        return reader.parquet(*[f"{self.root}/data/{p['path']}" for p in pieces]).select(schema.names)

    def append(self, name: str, rows: DataFrame, by: Iterable[str], age: Column | None = None, note: Callable[[Version, int], Version | None] | None = None, also: Callable[[DataFrame], list[tuple[str, DataFrame, tuple[str, ...]]]] | None = None) -> int:
        """Add rows in one version, and return their number.

        `note` is given the version before the rows are added, and their number; it may change the
        version's notes along with them, and withdraws the rows by None. `also` is given the rows as
        they were written, and names rows of other tables that come with them: (table, rows, by).
        """
        by = list(by)
        schema, pieces = self.write(rows, by, age)
        n = sum(p["rows"] for p in pieces)
        more = [(t, *self.write(r, b), list(b)) for t, r, b in also(self._rows(schema, pieces))] if also and n else []
        added = []

        def change(v: Version) -> Version | None:
            added[:] = [n]
            if note and note(v, n) is None:
                added[:] = [0]
                return None
            for table, kind, parts, columns in [(name, schema, pieces, by), *more]:
                v.with_table(table, kind, columns).tables[table]["pieces"] += parts
            return v

        self.update(change)
        return added[0]

    def rewrite(self, change: Callable[[Version], dict[str, Rewrite] | None], note: Callable[[Version], None] | None = None, tries: int = 5) -> dict[str, tuple[list[dict], list[dict]]]:
        """Put other rows in the place of pieces of one or more tables, in one version.

        `change` gets the version and tells what is rewritten. If another writer was first and has
        touched these pieces, it is asked again; what that one has added elsewhere stays. Returns,
        for each table, the pieces that went and those that came.
        """
        for _ in range(tries):
            seen = self.version()
            wanted = change(seen)
            if wanted is None:
                return {}
            made = {name: self.write(w.rows, seen.tables[name]["by"], w.age)[1] if w.rows is not None else [] for name, w in wanted.items()}
            lost: list[str] = []

            def swap(v: Version, wanted: dict = wanted, made: dict = made, lost: list = lost) -> Version | None:
                for name, w in wanted.items():
                    gone, there = {p["path"] for p in w.gone}, {p["path"] for p in v.pieces(name)}
                    if not gone <= there or w.alone is not None and {p["path"] for p in v.pieces(name) if w.alone(p)} != gone:
                        lost.append(name)
                        return None
                    v.tables[name]["pieces"] = [p for p in v.pieces(name) if p["path"] not in gone] + made[name]
                if note:
                    note(v)
                return v

            self.update(swap)
            if not lost:
                return {name: (w.gone, made[name]) for name, w in wanted.items()}
        raise Conflict("the pieces to rewrite changed each time")

    def compact(self, name: str, age: Column | None = None, most: int = 8) -> int:
        """Write partitions of over `most` pieces anew, as few files of even size; returns how many pieces went.

        Small batches leave a piece in each partition that they touch. Rows that are added meanwhile
        stay pieces of their own. `age` is that of the rows, as when they were added.
        """

        def change(v: Version) -> dict[str, Rewrite] | None:
            by: dict[str, list[dict]] = {}
            for p in v.pieces(name):
                by.setdefault(json.dumps(p["at"], sort_keys=True), []).append(p)
            gone = [p for ps in by.values() if len(ps) > most for p in ps]
            return {name: Rewrite(gone, self.read(name, v, gone), age)} if gone else None

        return len(self.rewrite(change).get(name, ([], []))[0])

    def vacuum(self, older: datetime) -> int:
        """Remove the files of batches that the newest version doesn't name and that were made before `older`,
        and the documents of versions before that, but for the newest ten; returns how many batches went."""
        named = {p["path"].partition("/")[0] for t in self.version().tables.values() for p in t["pieces"]}
        limit, gone = older.timestamp() * 1000, 0
        for name in self._names("data"):
            path, fs = self._path(f"data/{name}")
            if name not in named and fs.getFileStatus(path).getModificationTime() < limit:
                gone += bool(fs.delete(path, True))
        for name in sorted(n for n in self._names("_log") if n.endswith(".json") and not n.startswith("."))[:-10]:
            path, fs = self._path(f"_log/{name}")
            if fs.getFileStatus(path).getModificationTime() < limit:
                fs.delete(path, False)
        return gone

    # notes

    def put(self, kind: str, values: dict) -> Version:
        """Set notes of a kind, such as settings."""

        def change(v: Version) -> Version:
            v.notes.setdefault(kind, {}).update(values)
            return v

        return self.update(change)

    def claim(self, key: str, job_id: str, now: datetime, seconds: int) -> tuple[str, bool]:
        """The job that holds a key, and whether it held it before: a live key answers again.

        Of two claims at once one makes the next version and the other finds its key. Keys that
        have expired go with the next claim.
        """
        at = now.astimezone(timezone.utc).timestamp()
        out: list[tuple[str, bool]] = []

        def change(v: Version) -> Version | None:
            live = {k: c for k, c in v.notes.get("claims", {}).items() if c["expires"] > at}
            out[:] = [(live[key]["job"], True)] if key in live else [(job_id, False)]
            if key in live:
                return None
            v.notes["claims"] = live | {key: {"job": job_id, "expires": at + seconds}}
            return v

        self.update(change)
        return out[0]
