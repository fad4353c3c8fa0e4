import duckdb
from pyspark.sql import functions as F

from emberlog import queries

SF = "/root/testdata/sf0.001"


def test_all_windows_are_counted(spark):
    got = sorted((r.start, r.end, r.fingerprint, r.n) for r in queries.stream_windowed_counts(spark, SF).collect())
    assert sum(r[3] for r in got) == spark.read.parquet(f"{SF}/events.parquet").where(F.col("ts").isNotNull()).count()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert got == sorted(con.execute(queries.ORACLE_SQL["stream_windowed_counts"]).fetchall())
