"""The six analyses over a table of log entries. Each builds lazy plans and collects short lists only."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.timeutil import Window
from ..operators import cluster, compare, evidence, retrieval, semantic
from ..operators import timeline as timelines
from . import render


@dataclass(frozen=True)
class Options:
    """Settings of a request; each can be overridden by the caller's key and then by the request."""

    baseline: timedelta = timedelta(hours=24)
    max_clusters: int = 10
    max_evidence: int = 8
    merge_threshold: float | None = None
    merge_min_count: int = 1
    ask_top: int = 100
    ask_similarity: float = 0.75
    similar_similarity: float = 0.8

    def __post_init__(self):
        if not 1 <= self.max_clusters <= 100 or not 1 <= self.max_evidence <= 50:
            raise ValueError("max_clusters is 1 to 100, max_evidence 1 to 50")

    def override(self, *layers: dict) -> Options:
        out = self
        for layer in layers:
            out = replace(out, **{k: v for k, v in layer.items() if v is not None})
        return out


class Analyzer:
    """Analyses of one scope. `embed` maps a DataFrame with `template` to one with `embedding`."""

    def __init__(self, entries: DataFrame, scope: str = "default", options: Options | None = None, embed=None, embed_text=None, cluster_embeddings: DataFrame | None = None, log_embeddings: DataFrame | None = None, templates: DataFrame | None = None):
        self.entries, self.scope, self.options = entries, scope, options or Options()
        self.templates = templates
        #: How the last clusters were merged: by fingerprint alone, or by vectors, too.
        self.merge_mode = "fingerprint"
        self.embed, self.embed_text, self.cluster_embeddings, self.log_embeddings = embed, embed_text, cluster_embeddings, log_embeddings

    def clusters(self, window: Window, service: str | None = None, environment: str | None = None, job_id: str | None = None, top: int | None = None) -> DataFrame:
        o = self.options
        top = top or o.max_clusters
        merging = o.merge_threshold is not None and self.embed is not None
        found = cluster.clusters(self.entries, window, o.baseline, self.scope, service, environment, job_id, None if merging else top)
        if not merging:
            return found
        found = found.persist()
        try:
            try:
                vectors = self.embed(found.select("fingerprint", F.col("representative_message").alias("template"))).select("fingerprint", "embedding").persist()
                vectors.count()  # here and nowhere else the provider works
            except Exception as e:  # clusters come also where the provider fails; other failures are no one's to hide
                logging.getLogger(__name__).warning("clusters stay unmerged: %s", e)
                self.merge_mode = "fingerprint"
                ranked = cluster.rank(found, top)
                return ranked.sparkSession.createDataFrame(ranked.collect(), ranked.schema)
            try:
                self.merge_mode = "semantic"
                merged = semantic.merge_clusters(found, vectors, o.merge_threshold, o.merge_min_count, top)
                return found.sparkSession.createDataFrame(merged.collect(), merged.schema)  # at most `top` rows
            finally:
                vectors.unpersist()
        finally:
            found.unpersist()

    def explain(self, window: Window, service: str | None = None, environment: str | None = None, job_id: str | None = None) -> dict:
        """The evidence packet with confidence and texts."""
        found = self.clusters(window, service, environment, job_id).persist()
        roles = [r.asDict() for r in evidence.roles(found).orderBy("role").collect()]
        triggers = [r.asDict() for r in evidence.trigger_candidates(self.entries, window, scope=self.scope, job_id=job_id).orderBy("timestamp", "message").collect()]
        services = sorted(r.service for r in evidence.services_affected(found).collect())
        found.unpersist()
        total = cluster.in_window(self.entries, window, self.scope, service, job_id=job_id).count()
        primary, secondary = (roles[0], roles[1:]) if roles else (None, [])
        packet = {"window": window, "total_logs": total, "primary": primary, "secondary": secondary, "triggers": triggers, "services_affected": services}
        packet["points"], packet["confidence"], packet["confidence_score"] = self._confidence(packet)
        packet["evidence"] = render.evidence_items(primary, secondary, triggers, total, self.options.max_evidence)
        packet["summary"] = render.summary(packet) if primary else render.insufficient(window, total)
        packet["short_summary"], packet["mode"] = render.short_summary(packet["summary"]), "rules"
        return packet

    # the same as texts: each ends in a short list that the driver holds

    def report(self, window: Window, command: str | None = None, service: str | None = None, environment: str | None = None, job_id: str | None = None) -> str:
        """The explanation as Markdown."""
        return render.report(self.explain(window, service, environment, job_id), command, environment)

    def timeline_text(self, window: Window, **filters) -> str:
        events = self.timeline(window, **filters).orderBy("position").collect()
        return render.timeline_text([e.asDict() for e in events], window)

    def compare_text(self, a: Window, b: Window, **filters) -> str:
        diff, triggers = self.compare(a, b, **filters)
        return render.compare_text(a, b, [d.asDict() for d in diff.collect()], [t.asDict() for t in triggers.orderBy("only_in", "message").collect()])

    def similar_text(self, window: Window | None = None, **more) -> str:
        hits, mode = self.similar(window, **more)
        return render.similar_text([h.asDict() for h in hits.collect()], mode)

    def _confidence(self, p: dict) -> tuple[int, str, float]:
        """Points, label and score, by the column expressions of evidence over one row."""
        c, spark = p["primary"], self.entries.sparkSession
        facts = (c["count"], c["baseline_count"], float(c["change_ratio"])) if c else (0, 0, 0.0)
        row = spark.createDataFrame([(*facts, bool(p["triggers"]), bool(p["secondary"]), len(p["services_affected"]), c is not None)], "n long, b long, r double, t boolean, s boolean, k long, c boolean")
        points = F.when(F.col("c"), evidence.confidence_points(F.col("n"), F.col("b"), F.col("r"), F.col("t"), F.col("s"), F.col("k"))).otherwise(0)
        row = row.withColumn("points", points).withColumn("label", evidence.confidence_label(F.col("points"), F.col("t"), F.col("c")))
        return tuple(row.select("points", "label", evidence.confidence_score(F.col("label"))).first())

    def timeline(self, window: Window, service: str | None = None, environment: str | None = None, job_id: str | None = None) -> DataFrame:
        found = self.clusters(window, service, environment, job_id)
        triggers = evidence.trigger_candidates(self.entries, window, scope=self.scope, job_id=job_id)
        return timelines.with_gaps(timelines.timeline(triggers, evidence.roles(found)))

    def compare(self, a: Window, b: Window, service: str | None = None, environment: str | None = None, job_id: str | None = None, top: int = 50) -> tuple[DataFrame, DataFrame]:
        """Differences of clusters and of triggers. The cluster lists are capped first, as a reader sees them."""
        lists = [compare.collapse_noise(self.clusters(w, service, environment, job_id, top)) for w in (a, b)]
        triggers = [evidence.trigger_candidates(self.entries, w, scope=self.scope, job_id=job_id) for w in (a, b)]
        return compare.ordered_diff(compare.cluster_diff(*lists)), compare.trigger_diff(*triggers)

    def ask(self, question: str, window: Window | None = None, service: str | None = None, job_id: str | None = None, now: datetime | None = None, top: int = 8) -> dict:
        """What the log lines that fit a question have in common; without a window, of the last 24 hours."""
        window = window or now_window(now or datetime.now(timezone.utc), timedelta(hours=24))
        hits, mode = retrieval.retrieve(self.entries, question, self.log_embeddings, self.embed_text, self.templates, window=window, service=service, job_id=job_id, scope=self.scope)
        hits = hits.persist()
        groups, total = [r.asDict() for r in retrieval.group_hits(hits, top).collect()], hits.count()
        hits.unpersist()
        return {"question": question, "window": window, "mode": mode, "clusters": groups, "total_matches": total, "evidence": render.answer_evidence(groups)[: self.options.max_evidence], "answer": render.answer(question, groups, total) if total else patterns.NO_ANSWER}

    def similar(self, window: Window | None = None, fingerprints: list[str] | None = None, top: int = 10, visibility: retrieval.Visibility | None = None) -> tuple[DataFrame, str]:
        """Clusters of other scopes (or times) like those of a window, or of given fingerprints."""
        v = visibility or retrieval.Visibility(True, None)
        if fingerprints is None:
            queries = self.clusters(window, top=5).select("fingerprint", F.col("representative_message").alias("template"))
            fingerprints = [r.fingerprint for r in queries.collect()]
        else:
            fingerprints = list(dict.fromkeys(f.strip() for f in fingerprints if f and f.strip()))
            queries = self.entries.sparkSession.createDataFrame([(f, f) for f in fingerprints], "fingerprint string, template string")
        if self.embed is not None and self.cluster_embeddings is not None and fingerprints:
            hits = retrieval.similar_semantic(self.embed(queries), self.cluster_embeddings, v, self.scope, self.options.similar_similarity, top)
            if not hits.isEmpty():
                return hits.withColumn("similarity", F.round("similarity", 4)), "semantic"
        return retrieval.similar_fingerprint(fingerprints, self.entries, self.cluster_embeddings, v, self.scope, top), "fingerprint"


def now_window(now: datetime, length: timedelta) -> Window:
    return Window(now - length, now)
