"""Raw lines from files: plain and compressed text, and exports of container logs."""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns
from ..operators.parse import compact_json, is_json_object, json_members, json_object, last_members, once, readable_strings, repeats_keys, strip

#: Two layouts of kubelet paths: /pods/<ns>_<pod>_<uid>/<container>/ and containers/<pod>_<ns>_<container>-<id>.log
_POD_DIR = r"/?([^/_]+)_([^/_]+)_([0-9a-fA-F-]+)/([^/]+)/[^/]+$"
_CONTAINER_FILE = r"([^/_]+)_([^/_]+)_([^/]+)-([0-9a-f]{8,64})\.log[^/]*$"


def service_from_path(path: Column) -> Column:
    """Service by file name: without the last extension, a date with separators and all behind it,
    and digits and dashes at the end."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    name = F.regexp_replace(name, r"[-_]?\d{4}[-_]\d{2}[-_]\d{2}.*$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(name, r"[-_]?\d+$", ""), r"^[-_]+|[-_]+$", ""), F.lit(""))


def read_lines(spark: SparkSession, paths: list[str] | str, recursive: bool = False, glob: str | None = None, default_service: str | None = None) -> DataFrame:
    """Lines of text files (.gz, .bz2 and the like are unpacked by Spark) with path and place.

    Invalid bytes become U+FFFD. `ordinal` orders the lines of a file: its splits by their
    start, the lines of a split as they are read.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(paths).select(F.make_valid_utf8("value").alias("text"), F.col("_metadata.file_path").alias("source_ref"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    fallback = F.lit(default_service).cast("string") if default_service else service_from_path(F.col("source_ref"))
    return raw.select(
        "text",
        "source_ref",
        # splits start at least 2^17 bytes apart, and the ids of a task's rows are below 2^33
        (F.shiftleft(F.shiftright("_block", 17), 33) + F.col("_id") % F.lit(1 << 33)).cast("bigint").alias("ordinal"),
        F.lit(None).cast("timestamp").alias("received_at"),
        fallback.alias("default_service"),
        F.lit(None).cast("string").alias("default_environment"),
        F.lit(None).cast("string").alias("default_host"),
        F.lit(None).cast("map<string,string>").alias("extra"),
    )


def file_format(lines: DataFrame, hint: str = "auto") -> DataFrame:
    """Add fmt, one decision a file: hint, else extension, else the first line that is not blank."""
    if hint in ("json", "text"):
        return lines.withColumn("fmt", F.lit(hint))
    by_name = F.col("source_ref").rlike(r"(?i)\.(json|jsonl|ndjson)(\.gz)?$")
    filled = lines.where(strip(F.col("text")) != "")
    s = strip(F.col("text"))
    first = filled.groupBy("source_ref").agg(F.min_by(s.startswith("{") & s.endswith("}"), "ordinal").alias("_object"))
    return lines.join(first, "source_ref", "left").withColumn("fmt", F.when(by_name | F.coalesce("_object", F.lit(False)), "json").otherwise("text")).drop("_object")


def reassemble_cri(lines: DataFrame) -> DataFrame:
    """Join the fragments (tag P) of container log lines with what follows up to the next F.

    A line goes on its group if the one before is a fragment of the same stream. The joined
    line keeps the time of its first fragment and reads as complete; other lines stay. The
    window is one file, which the container runtime rotates at a bounded size.
    """
    order = Window.partitionBy("source_ref").orderBy("ordinal")
    line, shape = F.col("text"), "(?Ud)" + patterns.CRI_LINE
    cri = F.coalesce(line.rlike(shape), F.lit(False))
    g = lambda i: F.when(cri, F.regexp_extract(line, shape, i))
    t = lines.withColumn("_ts", g(1)).withColumn("_stream", g(2)).withColumn("_tag", g(3)).withColumn("_msg", g(4))
    goes_on = (F.lag("_tag").over(order) == "P") & (F.lag("_stream").over(order) == F.col("_stream"))
    t = t.withColumn("_group", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "ordinal").alias(c)
    parts = F.sort_array(F.collect_list(F.struct("ordinal", "_msg")))
    rest = [c for c in lines.columns if c not in ("source_ref", "ordinal", "text")]
    joined = t.groupBy("source_ref", "_group").agg(F.min("ordinal").alias("ordinal"), first("text"), first("_ts"), first("_stream"), F.array_join(F.transform(parts, lambda p: p["_msg"]), "").alias("_all"), *[first(c) for c in rest])
    whole = F.when(F.col("_ts").isNotNull(), F.concat_ws(" ", "_ts", "_stream", F.lit("F"), "_all")).otherwise(F.col("text"))
    return joined.withColumn("text", whole).select(lines.columns)


def join_within_splits(lines: DataFrame) -> DataFrame:
    """reassemble_cri where the lines are read, for rows that stand as a scan gave them.

    lines(text, source_ref, ordinal) come in order, split by split (the high bits of `ordinal`), so
    fragments join in passing. What may go on in another split has `edge`: the first line or group
    of a split, and a fragment that is open at its end, which stays one. All else is complete.
    """
    line = re.compile(patterns.CRI_LINE)

    def joined(held: dict, tag: str, edge: bool) -> tuple:
        return f"{held['stamp']} {held['stream']} {tag} {''.join(held['parts'])}", held["ref"], held["ordinal"], edge

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, first = None, None, True
        for batch in batches:
            out = []
            for text, ref, ordinal in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (ref, ordinal >> 33) != at:
                    out += [joined(held, "P", True)] if held else []
                    at, held, first = (ref, ordinal >> 33), None, True
                found = line.match(text or "")
                if held and not (found and found[2] == held["stream"]):
                    out.append(joined(held, "F", held["first"]))
                    held = None
                if not found:
                    out.append((text, ref, ordinal, first))
                else:
                    held = held or {"stamp": found[1], "stream": found[2], "parts": [], "ref": ref, "ordinal": ordinal, "first": first}
                    held["parts"].append(found[4])
                    if found[3] == "F":
                        out.append(joined(held, "F", held["first"]))
                        held = None
                first = False
            yield _edged(out)
        if held:
            yield _edged([joined(held, "P", True)])

    return lines.select("text", "source_ref", "ordinal").mapInArrow(step, "text string, source_ref string, ordinal long, edge boolean")


def _edged(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("text", pa.string()), ("source_ref", pa.string()), ("ordinal", pa.int64()), ("edge", pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], schema=pa.schema(kinds))


def k8s_identity(path: Column) -> Column:
    """Struct of namespace, pod, container and uid from a kubelet path; nulls where it is none."""
    pods, files = path.rlike(_POD_DIR), path.rlike(_CONTAINER_FILE)
    part = lambda i, j: F.when(pods, F.regexp_extract(path, _POD_DIR, i)).when(files, F.regexp_extract(path, _CONTAINER_FILE, j))
    return F.struct(part(1, 2).alias("namespace"), part(2, 1).alias("pod"), part(4, 3).alias("container"), F.when(pods, F.regexp_extract(path, _POD_DIR, 3)).alias("uid"))


def archive_lines(path: str, rows: int = 4096, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """In a task: the lines of the log files in a tar archive, in batches of bounded rows and bytes."""
    scheme, rest = ("", path) if ":/" not in path else path.split(":", 1)
    uri = f"{scheme}:{quote(rest if rest.startswith('//') else '//' + rest, safe='/@:')}"
    source, at = fs.FileSystem.from_uri(uri) if scheme else (fs.LocalFileSystem(), path)
    # as they are, whatever their extension: tarfile unpacks them while it reads
    with source.open_input_stream(at, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
        for m in tar:
            if not m.isfile() or not (m.name.endswith((".log", ".txt", ".json")) or ".log." in m.name):
                continue
            text, first, held = [], 0, 0
            for line in tar.extractfile(m):
                text.append(line.decode("utf-8", "replace").rstrip("\n\r"))
                held += len(line)
                if len(text) == rows or held >= size:
                    yield _member_lines(text, f"{path}!/{m.name}", first)
                    text, first, held = [], first + len(text), 0
            if text:
                yield _member_lines(text, f"{path}!/{m.name}", first)


def _member_lines(text: list[str], name: str, first: int) -> pa.RecordBatch:
    n = len(text)
    return pa.RecordBatch.from_pydict({"text": text, "source_ref": [name] * n, "ordinal": range(first, first + n)}, pa.schema([("text", pa.string()), ("source_ref", pa.string()), ("ordinal", pa.int64())]))


def read_k8s_export(spark: SparkSession, paths: list[str] | str, recursive: bool = True) -> DataFrame:
    """Lines of exported container logs: plain and .gz files, and members of tar archives.

    Fields missing in a line come from the path (namespace, pod, container). Archives are opened
    one to a task and read forward, line by line; no archive or member is held whole. They are
    opened by pyarrow, so they must lie where it reads: local, HDFS, S3 or GCS paths.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    archives = r"(?i)\.(tar|tgz|tar\.gz|tar\.bz2|tar\.xz)$"
    plain = read_lines(spark, paths, recursive).where(~F.col("source_ref").rlike(archives))

    def members(rows):
        for batch in rows:
            for path in batch.column(0).to_pylist():
                yield from archive_lines(path)

    found = reader.format("binaryFile").load(paths).where(F.col("path").rlike(archives)).select("path")
    packed = found.mapInArrow(members, "text string, source_ref string, ordinal long")
    # fragments join where they are read; only what lies at the edges of splits is shuffled
    rows = join_within_splits(plain).unionByName(join_within_splits(packed))
    every = rows.where("not edge").drop("edge").unionByName(reassemble_cri(rows.where("edge").drop("edge")))
    k = k8s_identity(F.col("source_ref"))
    ref = F.nullif(F.concat_ws("/", k["namespace"], k["pod"], k["container"]), F.lit(""))
    every = every.withColumn("_k", k).withColumn("default_service", F.when(F.contains("source_ref", F.lit("!/")), F.lit(None)).otherwise(service_from_path(F.col("source_ref")))).withColumn("received_at", F.lit(None).cast("timestamp"))
    extra = F.when(k["pod"].isNotNull(), F.map_filter(F.create_map(F.lit("pod_uid"), k["uid"], F.lit("container"), k["container"]), lambda _, v: v.isNotNull()))
    return every.select("text", F.coalesce(ref, "source_ref").alias("source_ref"), "ordinal", "received_at", F.coalesce(k["container"], "default_service").alias("default_service"), k["namespace"].alias("default_environment"), k["pod"].alias("default_host"), extra.alias("extra"))


def parse_push(lines: DataFrame) -> DataFrame:
    """Pushed NDJSON to raw lines: blank ones go, JSON strings become their text, objects are written
    without spaces; one that lacks a message gets the value of raw, text or msg, whichever is the
    first that is not null. All else stays as it is. Members keep their order, of equal keys the
    last one stands in the place of the first; numbers stay as they are written."""
    t = once(lines.withColumn("_s", strip(F.col("text"))).where("_s <> ''"), "_object", F.col("_s").startswith("{") & is_json_object(F.col("_s")))
    s, keys = F.col("_s"), F.json_object_keys("_s")
    t = once(t, "_whole", F.when(F.col("_object"), F.when(repeats_keys(s), F.concat(F.lit("{"), F.array_join(last_members(s), ","), F.lit("}"))).otherwise(compact_json(s))))
    whole = F.col("_whole")
    # escapes that need not be are read: the text as it is
    escaped = whole.rlike(r"\\[u/]")
    t = once(t, "_whole", F.when(escaped, readable_strings(whole)).otherwise(whole))
    members = json_members(whole)
    named = lambda k: F.try_element_at(F.filter(members, lambda m: F.startswith(m, F.lit(f'"{k}":')) & (m != f'"{k}":null')), F.lit(-1))
    value = F.coalesce(*[F.substr(named(k), F.lit(len(k) + 4)) for k in ("raw", "text", "msg")])
    lacks = F.col("_object") & ~F.array_contains(keys, "message") & F.arrays_overlap(keys, F.array(F.lit("raw"), F.lit("text"), F.lit("msg")))
    t = once(t, "_value", F.when(lacks, value))
    entire = F.when(F.col("_value").isNull(), whole).otherwise(F.concat(F.substr(whole, F.lit(1), F.length(whole) - 1), F.lit(',"message":'), F.col("_value"), F.lit("}")))
    string = F.when(s.startswith('"'), json_object(F.concat(F.lit('{"x":'), s, F.lit("}")))["x"])
    text = F.when(F.col("_object"), entire).otherwise(F.coalesce(string, s))
    return t.withColumn("text", text).select(lines.columns)


def push_payload(spark: SparkSession, body: str, max_lines: int = 5000) -> DataFrame:
    """A pushed body as raw lines; empty bodies and those over the cap are refused."""
    lines = [x for x in body.splitlines() if x.strip()]
    if not lines:
        raise ValueError("empty payload")
    if len(lines) > max_lines:
        raise ValueError(f"over {max_lines} lines")
    schema = "text string, source_ref string, ordinal bigint, received_at timestamp, default_service string, default_environment string, default_host string, extra map<string,string>"
    return parse_push(spark.createDataFrame([(x, "push", i, None, None, None, None, None) for i, x in enumerate(lines)], schema))
