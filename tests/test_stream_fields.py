"""Fields of lines on their way through a stream's open fragments."""

from datetime import datetime

from pyspark.sql import functions as F

from emberlog.streaming import tail

STAMP = "2026-03-12T22:01:10Z"
AT = datetime(2026, 3, 12, 22, 1, 10)


def test_only_lines_with_fields_are_read_back(spark, tmp_path):
    """Lines without further fields, as files have them, were read as JSON each; lines with fields keep them, odd ones, too."""
    rows = [
        ("a", 1, f"{STAMP} stdout P x", "s", AT, {"k": "v"}), ("a", 2, f"{STAMP} stdout F y", None, None, None),  # one line with the fields of its first part
        ("a", 3, f"{STAMP} stdout F z", None, None, None), ("a", 3, f"{STAMP} stdout F z", None, None, None), ("a", 4, None, "", None, {}), ("a", 5, "", "{}", None, None),
        ("a", None, "no place", None, AT, None), (None, 1, f"{STAMP}  stderr\tF  w", None, None, None), (None, 2, f"{STAMP} stderr P open", "t", None, {"k": None}),
    ]
    df = tail.with_line_fields(spark.createDataFrame(rows, "source_ref string, ordinal bigint, text string, default_service string, received_at timestamp, extra map<string,string>"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    joined = tail.join_fragments(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = joined.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.read.schema(df.schema).parquet(str(tmp_path / "out")).select("source_ref", "ordinal", "text", "default_service", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "extra").collect()
    at = f"{AT:%Y-%m-%d %H:%M:%S}"
    assert sorted(map(tuple, got), key=str) == sorted([
        ("a", 1, f"{STAMP} stdout F xy", "s", at, {"k": "v"}), ("a", 3, f"{STAMP} stdout F z", None, None, None), ("a", 3, f"{STAMP} stdout F z", None, None, None), ("a", 4, None, "", None, {}),
        ("a", 5, "", "{}", None, None), ("a", None, "no place", None, at, None), (None, 1, f"{STAMP} stderr F w", None, None, None),
    ], key=str)
    assert "CASE WHEN NOT (rest" in joined._jdf.queryExecution().analyzed().toString()
