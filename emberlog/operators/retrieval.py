"""Finding log lines for a question, and past clusters like given ones."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.timeutil import Window as Span
from .cluster import in_window
from .semantic import cosine, dot, with_unit


def keywords(question: str) -> list[str]:
    found = re.findall(r"\b[a-zA-Z][a-zA-Z0-9_\-]*\b", question.lower())
    return [w for w in found if len(w) > 2 and w not in patterns.STOP_WORDS]


def level_hint(question: str) -> str | None:
    """The first level one of whose words occurs in the question, also inside a word."""
    low = question.lower()
    return next((level for level, words in patterns.LEVEL_HINTS.items() if any(w in low for w in words)), None)


def _candidates(entries: DataFrame, window: Span | None, service: str | None, level: str | None, job_id: str | None, scope: str | None) -> DataFrame:
    t = entries
    if window:
        t = in_window(t, window, scope, service, job_id=job_id)
    else:
        for column, value in (("scope", scope), ("service", service), ("ingestion_job_id", job_id)):
            if value is not None:
                t = t.where(F.col(column) == value)
    return t if level is None else t.where(F.col("level") == level)


def _newest(t: DataFrame, limit: int) -> DataFrame:
    return t.orderBy(F.desc_nulls_first("timestamp"), "id").limit(limit)


def keyword_search(entries: DataFrame, words: list[str], window: Span | None = None, service: str | None = None, level: str | None = None, job_id: str | None = None, scope: str | None = None, limit: int = 500, templates: DataFrame | None = None) -> DataFrame:
    """The newest entries whose template holds any of the first six words, in any case.

    In a word, `_` stands for any character and `%` for any characters. Without words all match.
    With templates(fingerprint, template), as a store keeps them, words are sought in each template
    once, and lines are found by their fingerprint.
    """
    t = _candidates(entries, window, service, level, job_id, scope)
    hit: Column | None = None
    for w in words[:6]:
        one = F.col("normalized_message" if templates is None else "template").ilike(f"%{w}%")
        hit = one if hit is None else hit | one
    if hit is None:
        return _newest(t, limit)
    return _newest(t.where(hit) if templates is None else t.join(templates.where(hit).select("fingerprint").distinct(), "fingerprint", "left_semi").select(t.columns), limit)


def fallback_search(entries: DataFrame, window: Span | None = None, service: str | None = None, job_id: str | None = None, scope: str | None = None, limit: int = 500) -> DataFrame:
    """The newest entries of a level that can be a cause."""
    return _newest(_candidates(entries, window, service, None, job_id, scope).where(F.col("level").isin(patterns.SIGNIFICANT)), limit)


def semantic_search(entries: DataFrame, vectors: DataFrame, query: list[float], min_similarity: float = 0.75, top: int = 100, **filters) -> DataFrame:
    """Entries nearest to one vector by cosine; vectors(id, embedding). Ties to the smaller id."""
    t = _candidates(entries, filters.get("window"), filters.get("service"), filters.get("level"), filters.get("job_id"), filters.get("scope"))
    v = vectors.where(F.size("embedding") == len(query)).select("id", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])).alias("similarity")).where(F.col("similarity") >= min_similarity)
    return t.join(v, "id").orderBy(F.desc("similarity"), "id").limit(top)


def group_hits(hits: DataFrame, top: int = 8) -> DataFrame:
    """Hits by fingerprint (else template, else line): count, services, times, and level and
    message of the newest; the largest groups first."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    t = hits.withColumn("key", F.coalesce(filled("fingerprint"), filled("normalized_message"), filled("raw_message")))
    newest = F.max(F.struct("timestamp", (F.hex("id")).alias("i"), "level", F.coalesce(filled("normalized_message"), "raw_message").alias("m")))
    g = t.groupBy("key").agg(F.count("*").alias("count"), F.array_sort(F.collect_set(filled("service"))).alias("services"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), newest.alias("_n"))
    return g.select("key", F.col("_n.m").alias("message"), F.col("_n.level").alias("level"), "count", "services", "first_seen", "last_seen").orderBy(F.desc("count"), "key").limit(top)


def retrieve(entries: DataFrame, question: str, vectors: DataFrame | None = None, embed=None, templates: DataFrame | None = None, **filters) -> tuple[DataFrame, str]:
    """Entries that answer a question, and how they were found: semantic, keyword or fallback.

    `embed` maps a text to a vector; without it, or if it fails or finds nothing, keywords
    follow, then entries of levels that can be a cause.
    """
    level = level_hint(question)
    if embed is not None and vectors is not None:
        try:
            query = embed(question)
        except Exception as e:  # any failure of the provider falls through to keywords, none of the tables
            logging.getLogger(__name__).warning("keywords in place of vectors: %s", e)
            query = None
        hits = semantic_search(entries, vectors, query, level=level, **filters) if query else None
        if hits is not None and not hits.isEmpty():
            return hits, "semantic"
    hits = keyword_search(entries, keywords(question), level=level, templates=templates, **filters)
    if not hits.isEmpty():
        return hits, "keyword"
    return fallback_search(entries, **filters), "fallback"


@dataclass(frozen=True)
class Visibility:
    """Whether other scopes are searched, and which scope else."""

    cross_scope: bool
    scope: str | None


def resolve_visibility(auth: bool, scope: str, requested: bool | None, role: str = "", may_override: bool = False) -> Visibility:
    """Without authentication and for admins other scopes are searched unless declined; for
    queries that may override their scope only on request; for all others never."""
    if not auth or role == "admin":
        cross = requested is None or requested
    else:
        cross = may_override and bool(requested)
    return Visibility(cross, None if cross else scope)


def visible(rows: DataFrame, v: Visibility, query_scope: str, fingerprints: list[str]) -> DataFrame:
    """Across scopes: all but the query's, or the visible one if that is another. Else: the visible
    scope, or the query's, without its own fingerprints."""
    if v.cross_scope:
        other = rows.where(F.col("scope") != query_scope)
        return other if v.scope is None else other.where(F.col("scope") == v.scope)
    own = rows.where(F.col("scope") == (v.scope or query_scope))
    return own.where(~F.col("fingerprint").isin(fingerprints)) if fingerprints else own


def similar_semantic(queries: DataFrame, stored: DataFrame, v: Visibility, query_scope: str, min_similarity: float = 0.8, top: int = 10) -> DataFrame:
    """Stored clusters nearest to any of a few queries by cosine.

    queries(fingerprint, embedding), at most some tens; stored(scope, fingerprint, template,
    embedding, first_seen, last_seen, count). The queries go to all tasks and the stored table
    is passed once; of each query the best `top` count, of each cluster its best query.
    """
    asked = [(r.fingerprint, [float(x) for x in r.embedding]) for r in queries.limit(101).collect()]
    if len(asked) > 100:
        raise ValueError("over 100 query clusters")
    t = with_unit(visible(stored, v, query_scope, [f for f, _ in asked]), "embedding")
    q = with_unit(queries, "embedding", "_qu").select(F.col("fingerprint").alias("_q"), "_qu")
    near = t.join(F.broadcast(q), F.size("_unit") == F.size("_qu")).withColumn("similarity", dot(F.col("_unit"), F.col("_qu"))).where(F.col("similarity") >= min_similarity)
    best = Window.partitionBy("_q").orderBy(F.desc("similarity"), "scope", "fingerprint")
    kept = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top)
    merged = kept.groupBy("scope", "fingerprint").agg(F.max("similarity").alias("similarity"), F.min("template").alias("template"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("count").alias("count"))
    return merged.orderBy(F.desc("similarity"), "scope", "fingerprint").limit(top)


def similar_fingerprint(fingerprints: list[str], entries: DataFrame, stored: DataFrame | None, v: Visibility, query_scope: str, top: int = 10) -> DataFrame:
    """Clusters of the same fingerprints elsewhere: stored ones, or counted from the entries."""
    out = ["scope", "fingerprint", "template", "first_seen", "last_seen", "count"]
    if stored is not None:
        hits = visible(stored, v, query_scope, fingerprints).where(F.col("fingerprint").isin(fingerprints))
        if not hits.isEmpty():
            return hits.select(*out, F.lit(1.0).alias("similarity")).orderBy("scope", "fingerprint").limit(top)
    t = visible(entries, v, query_scope, fingerprints).where(F.col("fingerprint").isin(fingerprints))
    g = t.groupBy("scope", "fingerprint").agg(F.min("normalized_message").alias("template"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("count"))
    return g.select(*out, F.lit(1.0).alias("similarity")).orderBy("scope", "fingerprint").limit(top)
