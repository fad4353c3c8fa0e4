"""Which rows have outlived their scope's retention, and the tables without them."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import UNITS, parse_duration
from ..sources.store import Rewrite, Store, Version
from .registry import purge_due

_LENGTH = r"^(\d+(?:\.\d+)?)([a-zA-Z]+)$"
#: Words that switch a tier off.
NEVER = ("", "0", "off", "none", "never", "false")


def parse_interval(value: str | None) -> timedelta | None:
    """A retention time; None if the tier never expires. Blanks inside are an error."""
    clean = (value or "").strip()
    if clean.lower() in NEVER:
        return None
    if any(c.isspace() for c in clean):
        raise ValueError(f"invalid retention interval: {value!r}")
    length = parse_duration(clean)
    return length if length > timedelta(0) else None


def cutoff(interval: str | None, now: datetime) -> datetime | None:
    length = parse_interval(interval)
    return None if length is None else now - length


def interval_seconds(text: Column) -> tuple[Column, Column]:
    """parse_interval for a column: seconds (null: never expires), and whether the text is invalid."""
    clean = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    off = F.lower(clean).isin(list(NEVER))
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    seconds = F.regexp_extract(clean, _LENGTH, 1).try_cast("double") * units[F.lower(F.regexp_extract(clean, _LENGTH, 2))]
    return F.when(~off & (seconds > 0), seconds), text.isNotNull() & ~off & seconds.isNull()


def policies(scopes: DataFrame, overrides: DataFrame, raw: str | None, summary: str | None, now: datetime) -> DataFrame:
    """(scope, raw_cutoff, summary_cutoff) of each scope; null cutoffs never expire.

    overrides(scope, raw_interval, summary_interval): null takes the default, an empty text
    switches off. A scope with an invalid interval is skipped: nothing of it expires.
    """
    t = scopes.select("scope").distinct().join(overrides, "scope", "left")
    for tier, default in (("raw", raw), ("summary", summary)):
        column = f"{tier}_interval"
        seconds, bad = interval_seconds(F.coalesce(F.col(column), F.lit(default).cast("string")))
        at = F.timestamp_micros(F.unix_micros(F.lit(now)) - F.round(seconds * 1_000_000).cast("bigint"))
        t = t.withColumn(f"{tier}_cutoff", at).withColumn(f"_bad_{tier}", F.coalesce(bad, F.lit(False)))
    skip = F.col("_bad_raw") | F.col("_bad_summary")
    return t.select("scope", F.when(~skip, F.col("raw_cutoff")).alias("raw_cutoff"), F.when(~skip, F.col("summary_cutoff")).alias("summary_cutoff"))


def expired(rows: DataFrame, policy: DataFrame, age: Column, tier: str) -> DataFrame:
    """Rows whose age is before the cutoff of their scope; the policies are small."""
    return rows.join(policy.select("scope", F.col(f"{tier}_cutoff").alias("_cut")), "scope").where(age < F.col("_cut")).select(rows.columns)


#: Age of each kind of row, and the tier that it belongs to.
AGES = {
    "log_entries": ("raw", lambda: F.col("created_at")),
    "cluster_embeddings": ("summary", lambda: F.coalesce("last_seen", "updated_at", "created_at")),
    "cluster_runs": ("summary", lambda: F.coalesce("window_end", "created_at")),
    "explanations": ("summary", lambda: F.col("created_at")),
}


def children_of(rows: DataFrame, gone: DataFrame, foreign: str) -> DataFrame:
    """Rows that fall with expired parents."""
    return rows.join(gone.select(F.col("id").alias(foreign)), foreign, "left_semi")


def counts(tables: dict[str, DataFrame], policy: DataFrame) -> DataFrame:
    """(scope, table, n): how many rows each tier would lose; cascades count as tables of their own.

    tables: log_entries and any of log_embeddings, cluster_members, cluster_embeddings,
    cluster_runs, clusters, explanations.
    """
    out = []
    for name, (tier, age) in AGES.items():
        if name not in tables:
            continue
        gone = expired(tables[name], policy, age(), tier)
        out.append(gone.groupBy("scope").agg(F.count("*").alias("n")).select("scope", F.lit(name).alias("table"), "n"))
        cascades = {"log_entries": (("log_embeddings", "log_entry_id"), ("cluster_members", "log_entry_id")), "cluster_runs": (("clusters", "run_id"),)}.get(name, ())
        for child, foreign in cascades:
            if child in tables:
                c = tables[child].drop("scope").join(gone.select(F.col("id").alias(foreign), "scope"), foreign)
                out.append(c.groupBy("scope").agg(F.count("*").alias("n")).select("scope", F.lit(child).alias("table"), "n"))
    return reduce(DataFrame.unionByName, out)


def purge(tables: dict[str, DataFrame], policy: DataFrame) -> dict[str, DataFrame]:
    """All tables without what has expired; rows of parents that go, go with them."""
    kept = dict(tables)
    gone: dict[str, DataFrame] = {}
    for name, (tier, age) in AGES.items():
        if name in tables:
            gone[name] = expired(tables[name], policy, age(), tier)
            t = tables[name].join(policy.select("scope", F.col(f"{tier}_cutoff").alias("_cut")), "scope", "left")
            kept[name] = t.where(F.coalesce(age() >= F.col("_cut"), F.lit(True))).select(tables[name].columns)
    for child, parent, foreign in CHILDREN:
        if child in tables and parent in gone:
            kept[child] = tables[child].join(gone[parent].select(F.col("id").alias(foreign)), foreign, "left_anti").select(tables[child].columns)
    return kept


#: Rows that fall with a parent: table, parent, and the column that names it.
CHILDREN = (("log_embeddings", "log_entries", "log_entry_id"), ("cluster_members", "log_entries", "log_entry_id"), ("clusters", "cluster_runs", "run_id"))


def purge_store(store: Store, overrides: DataFrame, raw: str | None, summary: str | None, now: datetime) -> dict[tuple[str, str], int]:
    """Take what has expired out of a store, with what falls with it, in one version: {(scope, table): rows}.

    Pieces all of whose rows are old go without being read, younger ones stay as they are, and only
    those of mixed age are written anew. The time is kept with the version (`last_purge_at`). Tables
    are partitioned by scope, children too; a reader sees all of it or nothing.
    """
    spark = store.spark

    def change(v: Version) -> dict[str, Rewrite] | None:
        scopes = sorted({p["at"]["scope"] for name in AGES for p in v.pieces(name) if p["at"]["scope"] is not None})
        policy = policies(spark.createDataFrame([(s,) for s in scopes], "scope string"), overrides, raw, summary, now)
        limits = {r.scope: r for r in policy.select("scope", *[F.unix_micros(f"{t}_cutoff").alias(t) for t in ("raw", "summary")]).collect()}
        out: dict[str, Rewrite] = {}
        ids: dict[str, tuple[DataFrame, set]] = {}
        for name, (tier, age) in AGES.items():
            old, mixed = [], []
            for p in v.pieces(name):
                cut = limits[p["at"]["scope"]][tier] if p["at"]["scope"] in limits else None
                if cut is not None and p["low"] is not None and p["low"] < cut:
                    (old if p["high"] is not None and p["high"] < cut else mixed).append(p)
            if not old and not mixed:
                continue
            t = store.read(name, v, mixed)
            late = t.join(F.broadcast(policy.select("scope", F.col(f"{tier}_cutoff").alias("_cut"))), "scope", "left").withColumn("_gone", F.coalesce(age() < F.col("_cut"), F.lit(False)))
            out[name] = Rewrite(old + mixed, late.where("not _gone").select(t.columns) if mixed else None, age())
            if "id" in t.columns:
                ids[name] = store.read(name, v, old).select("id").unionByName(late.where("_gone").select("id")), {p["at"]["scope"] for p in old + mixed}
        for child, parent, foreign in CHILDREN:
            if parent in ids:
                gone, of = ids[parent]
                pieces = [p for p in v.pieces(child) if p["at"]["scope"] in of]
                if pieces:
                    t = store.read(child, v, pieces)
                    out[child] = Rewrite(pieces, t.join(gone.select(F.col("id").alias(foreign)), foreign, "left_anti").select(t.columns))
        return out or None

    def stamp(v: Version) -> None:
        v.notes.setdefault("settings", {})["last_purge_at"] = now.isoformat()

    counts: dict[tuple[str, str], int] = {}
    done = store.rewrite(change, stamp)
    if not done:
        store.put("settings", {"last_purge_at": now.isoformat()})
    for name, sides in done.items():
        for sign, pieces in zip((1, -1), sides, strict=True):
            for p in pieces:
                k = p["at"]["scope"], name
                counts[k] = counts.get(k, 0) + sign * p["rows"]
    return {k: n for k, n in counts.items() if n}


def purge_if_due(store: Store, overrides: DataFrame, raw: str | None, summary: str | None, now: datetime, seconds: int) -> dict[tuple[str, str], int] | None:
    """Purge if the last one is `seconds` ago, by the stamp that the store keeps; None if it isn't.

    Files that no version has named for a day go with it.
    """
    last = store.version().note("settings", "last_purge_at")
    if not purge_due(datetime.fromisoformat(last) if last else None, False, now, seconds):
        return None
    found = purge_store(store, overrides, raw, summary, now)
    store.vacuum(now - timedelta(days=1))
    return found


def scopes_of(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [t.select("scope") for t in tables]).distinct()


def majority_scope(clusters: DataFrame, members: DataFrame, entries: DataFrame) -> DataFrame:
    """(run_id, scope): of each run the scope that most member entries have, ties to the smaller."""
    t = clusters.join(members, "cluster_id").join(entries.select(F.col("id").alias("log_entry_id"), "scope"), "log_entry_id")
    g = t.groupBy("run_id", "scope").agg(F.count("*").alias("n"))
    return g.groupBy("run_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "scope")).alias("_b")).select("run_id", F.col("_b.scope").alias("scope"))
