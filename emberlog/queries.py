"""Registered queries of the log engine over the driver's tables, with their DuckDB equivalents.

`events` reads as a log: each event becomes an entry with service, level, scope and a message
whose varying parts normalise away. Times are returned as microseconds, maps and arrays as text.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import patterns, text
from .functions.timeutil import Window
from .operators import cluster, compare, evidence, ingest, parse, registry, retention, retrieval, semantic, vectorindex
from .operators import timeline as timelines
from .plans.verbs import Analyzer
from .session import shared_dir
from .sources import lines as sources
from .sources.store import Store
from .streaming import tail

UTC = timezone.utc
A = Window(datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 20, tzinfo=UTC))
B = Window(datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 9, tzinfo=UTC))
NOW = datetime(2024, 1, 31, tzinfo=UTC)
DAY = timedelta(days=1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MESSAGE = """CASE event_type
  WHEN 'error' THEN concat('POST /api/checkout 500 upstream error ', user_id % 7, ' for user ', user_id, ' after ', CAST(floor(value) AS BIGINT), 'ms')
  WHEN 'purchase' THEN concat('Webhook retry scheduled for evt_', 100000 + user_id % 10, ' order ', event_id)
  WHEN 'signup' THEN concat('Deploy completed for release v', user_id % 3, ' on host 10.0.', user_id % 4, '.7:8080')
  WHEN 'click' THEN concat('queue depth growing: ', CAST(floor(value) AS BIGINT), 's pending in shard ', user_id % 4)
  ELSE concat('GET /items/', user_id % 20, ' 200 OK latency=', CAST(floor(value) AS BIGINT), 'ms request_id=', event_id) END"""
LEVEL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END"
SCOPE = "CASE WHEN user_id % 10 = 0 THEN 'other' ELSE 'default' END"


def plain_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log entries without template and fingerprint, for what needs neither."""
    e = table(spark, sf_dir, "events").selectExpr("CAST(event_id AS STRING) AS id", "CAST(ts AS TIMESTAMP) AS timestamp", "concat('svc-', user_id % 5) AS service", f"{LEVEL} AS level", f"{SCOPE} AS scope", f"{MESSAGE} AS raw_message", "concat('job-', event_id % 4) AS ingestion_job_id")
    return e.withColumn("environment", F.lit("prod"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log entries; each message is normalised once, however often a plan names it."""
    e = parse.once(plain_logs(spark, sf_dir), "normalized_message", text.normalize(F.col("raw_message")))
    return e.withColumn("fingerprint", text.fingerprint(F.col("normalized_message")))


def _sql_normal(column: str) -> str:
    out = column
    for p, r in patterns.NORMALIZATION:
        out = f"regexp_replace({out}, '{p}', '{r.replace('$1', chr(92) + '1')}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'), ' ')"


def _sql_fp(column: str) -> str:
    return f"CASE WHEN {column} = '' THEN 'empty' ELSE substr(sha256({column}), 1, 16) END"


LOGS = f"""logs0 AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(ts AS TIMESTAMP) AS timestamp, concat('svc-', user_id % 5) AS service, {LEVEL} AS level, {SCOPE} AS scope,
  {MESSAGE} AS raw_message, concat('job-', event_id % 4) AS ingestion_job_id FROM events),
logs1 AS (SELECT *, {_sql_normal("raw_message")} AS normalized_message FROM logs0),
logs AS (SELECT *, {_sql_fp("normalized_message")} AS fingerprint FROM logs1)"""


def _between(w: Window, column: str = "timestamp") -> str:
    return f"{column} BETWEEN TIMESTAMP '{w.start:%Y-%m-%d %H:%M:%S}' AND TIMESTAMP '{w.end:%Y-%m-%d %H:%M:%S}'"


def _any(ps: list[str]) -> str:
    return "(?i)" + "|".join(ps)


def _clusters_sql(name: str, w: Window, where: str = "scope = 'default'") -> str:
    """CTEs that end in `name`: all clusters of a window with their scores."""
    base = Window(w.start - DAY, w.start)
    weight = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in patterns.SEVERITY.items()) + " ELSE 1.0 END"
    return f"""{name}_in AS (SELECT * FROM logs WHERE {_between(w)} AND {where}),
{name}_m AS (SELECT fingerprint, normalized_message AS m, count(*) AS n FROM {name}_in GROUP BY 1, 2),
{name}_top AS (SELECT fingerprint, m FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY n DESC, m) AS r FROM {name}_m) WHERE r = 1),
{name}_b AS (SELECT fingerprint, count(*) AS b FROM logs WHERE {_between(base)} AND {where} GROUP BY 1),
{name}_g AS (SELECT fingerprint, count(*) AS c, count(DISTINCT service) AS s, avg({weight}) AS sev, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  list_sort(list(DISTINCT service)) AS services, list(DISTINCT level) AS levels FROM {name}_in GROUP BY 1),
{name} AS (SELECT g.*, t.m AS message, coalesce(b, 0) AS baseline_count, (c + 1.0) / (coalesce(b, 0) + 1.0) AS change_ratio,
  sev + ln(c + 1) + ln((c + 1.0) / (coalesce(b, 0) + 1.0) + 1) + 0.5 * ln(s + 1) AS score
  FROM {name}_g g JOIN {name}_top t USING (fingerprint) LEFT JOIN {name}_b b USING (fingerprint))"""


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function below, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _micros(c: str, name: str | None = None):
    return F.unix_micros(c).alias(name or c)


# Scalar functions


@query(f"SELECT doc_id, {_sql_normal('text')} AS normalized FROM documents")
def normalize_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, {_sql_fp('n')} AS fingerprint FROM (SELECT doc_id, {_sql_normal('text')} AS n FROM documents)")
def fingerprint_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(text.normalize(F.col("text"))).alias("fingerprint"))


@query("SELECT doc_id, sha256(text) AS line_hash FROM documents")
def line_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.line_hash(F.col("text")).alias("line_hash"))


_RAW_LEVEL = "CASE event_type WHEN 'error' THEN ' CRIT ' WHEN 'purchase' THEN 'Warning' WHEN 'click' THEN 'Informational' WHEN 'signup' THEN '' ELSE 'Custom' END"


@query(f"""SELECT event_id, CASE WHEN l = '' THEN 'info' ELSE coalesce(map_extract(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in patterns.LEVELS.items())}}}, trim(lower(l)))[1], trim(lower(l))) END AS level
FROM (SELECT event_id, {_RAW_LEVEL} AS l FROM events)""")
def level_canonical(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.canonical_level(F.expr(_RAW_LEVEL)).alias("level"))


@query(f"WITH {LOGS} SELECT id, regexp_matches(raw_message, '{_any(patterns.TRIGGERS)}') AS is_trigger FROM logs")
def trigger_flag(spark, sf_dir):
    return plain_logs(spark, sf_dir).select("id", text.is_trigger(F.col("raw_message")).alias("is_trigger"))


@query(f"""WITH {LOGS} SELECT id, CASE {" ".join(f"WHEN regexp_matches(raw_message, '(?i){p}') THEN '{t}'" for p, t in patterns.TRIGGER_TYPES)} END AS trigger_type FROM logs""")
def trigger_type(spark, sf_dir):
    return plain_logs(spark, sf_dir).select("id", text.trigger_type(F.col("raw_message")).alias("trigger_type"))


@query(f"""WITH {LOGS} SELECT id, regexp_matches(raw_message, '(?i)retry') AND regexp_matches(raw_message, '(?i)evt_') AS is_retry,
regexp_matches(raw_message, '(?i)queue.{{0,30}}(growing|pending|backlog)') OR regexp_matches(raw_message, '(?i)(pending|backlog).{{0,30}}queue') AS is_queue,
trim(regexp_replace(trim(lower(raw_message)), '{patterns.VERSION}', '')) AS trigger_key, greatest(1, CAST(ceil(length(raw_message) / 4.0) AS INTEGER)) AS tokens,
CASE WHEN regexp_matches(lower(raw_message), 'deploy|release|rollout|pushed|promote') THEN 'deploy' WHEN regexp_matches(lower(raw_message), 'started|starting|boot|launch|listening|port') THEN 'startup' ELSE 'trigger' END AS trigger_class,
CASE WHEN regexp_matches(lower(raw_message), '500|error|fail') THEN 0 WHEN regexp_matches(lower(raw_message), 'latency|slow|timeout') THEN 1 ELSE 2 END AS severity FROM logs""")
def message_classes(spark, sf_dir):
    m = F.col("raw_message")
    return plain_logs(spark, sf_dir).select("id", text.is_retry(m).alias("is_retry"), text.is_queue_growth(m).alias("is_queue"), text.trigger_key(m).alias("trigger_key"), text.token_estimate(m).alias("tokens"), text.timeline_trigger_class(m).alias("trigger_class"), text.effect_severity(m).alias("severity"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 60 THEN text WHEN p > 30 THEN substr(h, 1, p) || '…' ELSE h || '…' END AS short
FROM (SELECT *, 60 - strpos(reverse(h), ' ') AS p0, CASE WHEN strpos(reverse(h), ' ') = 0 THEN -1 ELSE 60 - strpos(reverse(h), ' ') END AS p FROM (SELECT doc_id, text, substr(text, 1, 60) AS h FROM documents))""")
def truncate_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_words(F.col("text"), 60).alias("short"))


# Clusters


_RANKED = "ORDER BY score DESC, c DESC, fingerprint"


@query(f"""WITH {LOGS}, {_clusters_sql("k", A)} SELECT fingerprint, message, c AS "count", list_aggregate(services, 'string_agg', ',') AS services, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen,
baseline_count, round(change_ratio, 6) AS change_ratio, round(score, 6) AS importance FROM k {_RANKED} LIMIT 10""")
def clusters_topk(spark, sf_dir):
    c = cluster.clusters(logs(spark, sf_dir), A, DAY, "default", top=10)
    return c.select("fingerprint", F.col("representative_message").alias("message"), "count", F.array_join(F.map_keys("services"), ",").alias("services"), _micros("first_seen"), _micros("last_seen"), "baseline_count", F.round("change_ratio", 6).alias("change_ratio"), F.round("importance_score", 6).alias("importance"))


@query(f"WITH {LOGS} SELECT fingerprint, service, count(*) AS n FROM logs WHERE {_between(A)} GROUP BY 1, 2")
def cluster_service_hist(spark, sf_dir):
    return cluster.histogram(cluster.in_window(logs(spark, sf_dir), A), "service")


@query(f"WITH {LOGS} SELECT fingerprint, level, count(*) AS n FROM logs WHERE {_between(A)} GROUP BY 1, 2")
def cluster_level_hist(spark, sf_dir):
    return cluster.histogram(cluster.in_window(logs(spark, sf_dir), A), "level")


@query(f"WITH {LOGS} SELECT fingerprint, count(*) AS baseline_count FROM logs WHERE {_between(Window(A.start - DAY, A.start))} AND scope = 'default' GROUP BY 1")
def baseline_count(spark, sf_dir):
    return cluster.baseline_counts(logs(spark, sf_dir), A, DAY, "default")


@query(f"WITH {LOGS} SELECT count(*) AS n FROM logs WHERE {_between(A)} AND service = 'svc-1' AND ingestion_job_id = 'job-2'")
def window_count(spark, sf_dir):
    return cluster.in_window(plain_logs(spark, sf_dir), A, service="svc-1", job_id="job-2").agg(F.count("*").alias("n"))


@query(f"WITH {LOGS} SELECT ingestion_job_id AS job_id, max(epoch_us(timestamp)) AS finished_at FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def latest_job(spark, sf_dir):
    jobs = plain_logs(spark, sf_dir).groupBy(F.col("ingestion_job_id").alias("job_id")).agg(F.max(F.unix_micros("timestamp")).alias("finished_at"))
    return jobs.orderBy(F.desc("finished_at"), "job_id").limit(1)


# Evidence


_TRIGGER_SQL = f"""trig AS (SELECT substr(normalized_message, 1, 500) AS message, timestamp, service FROM logs
  WHERE {_between(Window(A.start - timedelta(minutes=10), A.end))} AND scope = 'default' AND regexp_matches(normalized_message, '{_any(patterns.TRIGGERS)}')),
cand AS (SELECT message, timestamp, service FROM (SELECT *, row_number() OVER (PARTITION BY trim(substr(message, 1, 100)) ORDER BY timestamp, message, service) AS r FROM trig) WHERE r = 1)"""


@query(f"WITH {LOGS}, {_TRIGGER_SQL} SELECT message, epoch_us(timestamp) AS timestamp, service FROM cand ORDER BY timestamp, message LIMIT 3")
def trigger_candidates(spark, sf_dir):
    return evidence.trigger_candidates(logs(spark, sf_dir), A, scope="default").select("message", _micros("timestamp"), "service")


_ROLES_SQL = f"""{_clusters_sql("k", A)}, capped AS (SELECT * FROM k {_RANKED} LIMIT 15),
sig0 AS (SELECT *, list_has_any(levels, {patterns.SIGNIFICANT}) AS hit, max(list_has_any(levels, {patterns.SIGNIFICANT})) OVER () AS anyhit FROM capped),
sig AS (SELECT *, row_number() OVER ({_RANKED}) AS r FROM sig0 WHERE hit OR NOT anyhit),
roles AS (SELECT * FROM (SELECT *, CASE WHEN r = 1 THEN 0 ELSE row_number() OVER (PARTITION BY r > 1 ORDER BY c DESC, r) END AS role FROM sig) WHERE role <= 4)"""


def _capped(spark, sf_dir):
    return cluster.clusters(logs(spark, sf_dir), A, DAY, "default", top=15)


@query(f"""WITH {LOGS}, {_ROLES_SQL} SELECT role, fingerprint, c AS "count" FROM roles""")
def evidence_roles(spark, sf_dir):
    return evidence.roles(_capped(spark, sf_dir)).select("role", "fingerprint", "count")


@query(f"WITH {LOGS}, {_ROLES_SQL} SELECT DISTINCT unnest(services) AS service FROM capped")
def services_affected(spark, sf_dir):
    return evidence.services_affected(_capped(spark, sf_dir))


@query(f"""WITH {LOGS}, {_ROLES_SQL}, {_TRIGGER_SQL}, f AS (SELECT *, (SELECT count(*) > 0 FROM cand) AS t, (SELECT count(*) > 1 FROM sig) AS sec FROM capped),
p AS (SELECT fingerprint, t, CASE WHEN c >= 50 THEN 2 WHEN c >= 10 THEN 1 ELSE 0 END + CASE WHEN baseline_count > 0 THEN CASE WHEN change_ratio > 10 THEN 2 WHEN change_ratio > 3 THEN 1 ELSE 0 END ELSE 0 END
  + CASE WHEN t THEN 2 ELSE 0 END + CASE WHEN sec THEN 1 ELSE 0 END + CASE WHEN s > 1 THEN 1 ELSE 0 END AS points FROM f),
l AS (SELECT *, CASE WHEN points >= 5 AND t THEN 'high' WHEN points >= 4 THEN 'medium-high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS label FROM p)
SELECT fingerprint, CAST(points AS INTEGER) AS points, label, CASE label WHEN 'high' THEN 0.9 WHEN 'medium-high' THEN 0.72 WHEN 'medium' THEN 0.5 ELSE 0.25 END::DOUBLE AS score FROM l""")
def confidence(spark, sf_dir):
    found = _capped(spark, sf_dir)
    facts = evidence.trigger_candidates(logs(spark, sf_dir), A, scope="default").agg((F.count("*") > 0).alias("t"))
    sec = evidence.significant(found).agg((F.count("*") > 1).alias("sec"))
    c = found.join(F.broadcast(facts)).join(F.broadcast(sec))
    points = evidence.confidence_points(F.col("count"), F.col("baseline_count"), F.col("change_ratio"), F.col("t"), F.col("sec"), F.size("services"))
    label = evidence.confidence_label(F.col("points"), F.col("t"), F.lit(True))
    return c.withColumn("points", points).withColumn("label", label).select("fingerprint", "points", "label", evidence.confidence_score(F.col("label")).alias("score"))


# Timeline


def _short_sql(c: str, n: int = 100) -> str:
    back = f"strpos(reverse(substr({c}, 1, {n})), ' ')"
    return f"CASE WHEN length({c}) <= {n} THEN {c} WHEN {back} > 0 AND {n} - {back} > {n // 2} THEN substr({c}, 1, {n} - {back}) || '…' ELSE substr({c}, 1, {n}) || '…' END"


_MINUTES = "nullif(CAST(floor((epoch_us(last_seen) - epoch_us(first_seen)) / 6e7) AS INTEGER), 0)"
_TIMELINE_SQL = f"""{_ROLES_SQL}, {_TRIGGER_SQL}, cand3 AS (SELECT * FROM cand ORDER BY timestamp, message LIMIT 3),
prim AS (SELECT first_seen AS start FROM roles WHERE role = 0),
other AS (SELECT *, regexp_matches(message, '(?i)retry') AND regexp_matches(message, '(?i)evt_') AS retry FROM roles LEFT JOIN prim ON true WHERE role > 0),
ev AS (
  SELECT 0 AS bucket, timestamp, CASE WHEN regexp_matches(lower(message), 'deploy|release|rollout|pushed|promote') THEN 'deploy' WHEN regexp_matches(lower(message), 'started|starting|boot|launch|listening|port') THEN 'startup' ELSE 'trigger' END AS category, {_short_sql("message")} AS description, NULL::BIGINT AS n, service AS services, NULL::INTEGER AS minutes FROM cand3
  UNION ALL SELECT 1, first_seen, 'error', {_short_sql("message")}, c, list_aggregate(services, 'string_agg', ','), {_MINUTES} FROM roles WHERE role = 0
  UNION ALL SELECT 2, greatest(first_seen, start), CASE WHEN regexp_matches(lower(message), 'queue|pending|backlog') THEN 'symptom' ELSE 'effect' END, {_short_sql("message")}, c, list_aggregate(services, 'string_agg', ','), {_MINUTES} FROM other WHERE NOT retry
  UNION ALL SELECT 2, greatest(min(first_seen), max(start)), 'effect', 'Webhook retries (' || sum(c) || ' retry events)', sum(c)::BIGINT, list_aggregate(list_sort(list_distinct(flatten(list(services)))), 'string_agg', ','), NULL FROM other WHERE retry HAVING count(*) > 0),
tl AS (SELECT *, row_number() OVER (ORDER BY bucket, timestamp, CASE WHEN bucket = 2 THEN CASE category WHEN 'error' THEN 0 WHEN 'symptom' THEN 2 ELSE 1 END ELSE 0 END,
  CASE WHEN bucket = 2 THEN CASE WHEN regexp_matches(lower(description), '500|error|fail') THEN 0 WHEN regexp_matches(lower(description), 'latency|slow|timeout') THEN 1 ELSE 2 END ELSE 0 END, description) AS position FROM ev)"""


def _timeline(spark, sf_dir):
    e = logs(spark, sf_dir)
    return timelines.timeline(evidence.trigger_candidates(e, A, scope="default"), evidence.roles(_capped(spark, sf_dir)))


@query(f"""WITH {LOGS}, {_TIMELINE_SQL} SELECT CAST(position AS INTEGER) AS position, epoch_us(timestamp) AS timestamp, category, description, n AS "count", services, minutes AS duration_minutes FROM tl""")
def timeline_order(spark, sf_dir):
    return _timeline(spark, sf_dir).select("position", _micros("timestamp"), "category", "description", "count", F.array_join("services", ",").alias("services"), "duration_minutes")


@query(f"WITH {LOGS}, {_TIMELINE_SQL} SELECT CAST(position AS INTEGER) AS position, coalesce(epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (ORDER BY position)) > 60000000, false) AS gap_before FROM tl")
def timeline_gaps(spark, sf_dir):
    return timelines.with_gaps(_timeline(spark, sf_dir)).select("position", "gap_before")


# Comparison


_DIRECTION = "CASE WHEN count_a IS NULL THEN 'disappeared' WHEN count_b IS NULL THEN 'new' WHEN count_a / greatest(count_b, 1) >= 1.5 THEN 'increased' WHEN count_a / greatest(count_b, 1) <= 1 / 1.5 THEN 'decreased' ELSE 'stable' END"


def _lists(spark, sf_dir):
    e = logs(spark, sf_dir)
    return [cluster.clusters(e, w, DAY, "default", top=None) for w in (A, B)]


@query(f"""WITH {LOGS}, {_clusters_sql("ka", A)}, {_clusters_sql("kb", B)}, d AS (SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, coalesce(a.message, b.message) AS message, a.c AS count_a, b.c AS count_b FROM ka a FULL JOIN kb b ON a.fingerprint = b.fingerprint)
SELECT fingerprint, message, count_a, count_b, {_DIRECTION} AS direction, coalesce(count_a, 0) - coalesce(count_b, 0) AS delta FROM d""")
def compare_windows(spark, sf_dir):
    return compare.cluster_diff(*_lists(spark, sf_dir)).select("fingerprint", "message", "count_a", "count_b", "direction", "delta")


def _collapsed_sql(k: str) -> str:
    retry = "regexp_matches(message, '(?i)retry') AND regexp_matches(message, '(?i)evt_')"
    queue = "regexp_matches(message, '(?i)queue.{0,30}(growing|pending|backlog)') OR regexp_matches(message, '(?i)(pending|backlog).{0,30}queue')"
    return f"""{k}_n AS (SELECT *, CASE WHEN {retry} THEN 'retries' WHEN {queue} THEN 'queue_growth' END AS g FROM {k}),
{k}_c AS (SELECT fingerprint, message, c FROM {k}_n WHERE g IS NULL
  UNION ALL SELECT '__collapsed_' || g || '__', CASE WHEN g = 'retries' THEN 'Webhook retries (' || count(*) || ' distinct events, ' || sum(c) || ' total)' ELSE 'Webhook queue growing' END, sum(c)::BIGINT FROM {k}_n WHERE g IS NOT NULL GROUP BY g)"""


@query(f"""WITH {LOGS}, {_clusters_sql("ka", A)}, {_clusters_sql("kb", B)}, {_collapsed_sql("ka")}, {_collapsed_sql("kb")},
d AS (SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, coalesce(a.message, b.message) AS message, a.c AS count_a, b.c AS count_b FROM ka_c a FULL JOIN kb_c b ON a.fingerprint = b.fingerprint)
SELECT fingerprint, message, count_a, count_b, {_DIRECTION} AS direction FROM d""")
def compare_collapsed(spark, sf_dir):
    return compare.cluster_diff(*map(compare.collapse_noise, _lists(spark, sf_dir))).select("fingerprint", "message", "count_a", "count_b", "direction")


def _window_triggers_sql(name: str, w: Window) -> str:
    return f"""{name}_t AS (SELECT substr(normalized_message, 1, 500) AS message, timestamp, service FROM logs WHERE {_between(Window(w.start - timedelta(minutes=10), w.end))} AND regexp_matches(normalized_message, '{_any(patterns.TRIGGERS)}') AND level = 'info'),
{name} AS (SELECT message, service, trim(regexp_replace(trim(lower(message)), '{patterns.VERSION}', '')) AS k FROM (SELECT *, row_number() OVER (PARTITION BY trim(substr(message, 1, 100)) ORDER BY timestamp, message, service) AS r FROM {name}_t) WHERE r = 1)"""


C = Window(datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 10, 3, tzinfo=UTC))
D = Window(datetime(2024, 1, 9, tzinfo=UTC), datetime(2024, 1, 9, 1, tzinfo=UTC))


def _two_triggers(spark, sf_dir):
    e = logs(spark, sf_dir).where("level = 'info'")
    return [evidence.trigger_candidates(e, w, top=None) for w in (C, D)]


@query(f"""WITH {LOGS}, {_window_triggers_sql("ta", C)}, {_window_triggers_sql("tb", D)} SELECT message, service, 'a' AS only_in FROM ta WHERE k NOT IN (SELECT k FROM tb)
UNION ALL SELECT message, service, 'b' FROM tb WHERE k NOT IN (SELECT k FROM ta)""")
def trigger_diff(spark, sf_dir):
    return compare.trigger_diff(*_two_triggers(spark, sf_dir))


@query(f"""WITH {LOGS}, {_clusters_sql("ka", A)}, {_clusters_sql("kb", B)}, d AS (SELECT a.c AS count_a, b.c AS count_b FROM ka a FULL JOIN kb b ON a.fingerprint = b.fingerprint), {_window_triggers_sql("ta", C)}, {_window_triggers_sql("tb", D)}
SELECT (SELECT coalesce(max({_DIRECTION} <> 'stable'), false) FROM d) OR (SELECT count(*) > 0 FROM ta WHERE k NOT IN (SELECT k FROM tb)) AS has_changes""")
def has_changes(spark, sf_dir):
    return compare.has_changes(compare.cluster_diff(*_lists(spark, sf_dir)), compare.trigger_diff(*_two_triggers(spark, sf_dir)))


# Questions and similar incidents


QUESTION = "Why did checkout fail with upstream problems on release day?"
_WORDS = retrieval.keywords(QUESTION)[:6]
_ASK_SQL = f"""hits AS (SELECT * FROM logs WHERE {_between(A)} AND scope = 'default' AND level = 'error' AND ({" OR ".join(f"normalized_message ILIKE '%{w}%'" for w in _WORDS)}) ORDER BY timestamp DESC, id LIMIT 500)"""


def _hits(spark, sf_dir):
    return retrieval.keyword_search(logs(spark, sf_dir), retrieval.keywords(QUESTION), A, level=retrieval.level_hint(QUESTION), scope="default")


@query(f"WITH {LOGS}, {_ASK_SQL} SELECT id, epoch_us(timestamp) AS timestamp, fingerprint FROM hits")
def ask_keyword(spark, sf_dir):
    return _hits(spark, sf_dir).select("id", _micros("timestamp"), "fingerprint")


@query(f"WITH {LOGS} SELECT id, epoch_us(timestamp) AS timestamp, level FROM logs WHERE {_between(A)} AND scope = 'default' AND level IN ('error', 'fatal', 'warn', 'critical') ORDER BY logs.timestamp DESC, id LIMIT 500")
def ask_fallback(spark, sf_dir):
    return retrieval.fallback_search(logs(spark, sf_dir), A, scope="default").select("id", _micros("timestamp"), "level")


@query(f"""WITH {LOGS}, {_ASK_SQL}, newest AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY timestamp DESC, hex(id) DESC) AS r FROM hits)
SELECT fingerprint AS key, max(CASE WHEN r = 1 THEN normalized_message END) AS message, max(CASE WHEN r = 1 THEN level END) AS level, count(*) AS "count", list_aggregate(list_sort(list(DISTINCT service)), 'string_agg', ',') AS services,
epoch_us(min(timestamp)) AS first_seen, epoch_us(max(timestamp)) AS last_seen FROM newest GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 8""")
def ask_clusters(spark, sf_dir):
    return retrieval.group_hits(_hits(spark, sf_dir)).select("key", "message", "level", "count", F.array_join("services", ",").alias("services"), _micros("first_seen"), _micros("last_seen"))


_COS = "list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"SELECT CAST(x.vec_id AS VARCHAR) AS id, round({_COS}, 6) AS similarity FROM embeddings x, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_COS} >= 0.2 ORDER BY {_COS} DESC, 1 LIMIT 100")
def ask_semantic(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    q = [float(x) for x in v.where("id = '0'").first().embedding]
    return retrieval.semantic_search(v.select("id"), v, q, 0.2, 100).select("id", F.round("similarity", 6).alias("similarity"))


@query("""WITH s AS (SELECT CAST(label AS VARCHAR) AS scope, CAST(vec_id AS VARCHAR) AS fingerprint, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT fingerprint, e FROM s WHERE fingerprint IN ('0', '1', '2', '3', '4')),
n AS (SELECT s.scope, s.fingerprint, q.fingerprint AS q, list_cosine_similarity(s.e, q.e) AS sim FROM s, q WHERE s.scope <> '0'),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, scope, fingerprint) AS r FROM n WHERE sim >= 0.3)
SELECT scope, fingerprint, round(max(sim), 6) AS similarity FROM r WHERE r <= 10 GROUP BY 1, 2 ORDER BY max(sim) DESC, 1, 2 LIMIT 10""")
def similar_semantic(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("scope"), F.col("vec_id").cast("string").alias("fingerprint"), F.lit("t").alias("template"), "embedding", F.lit(None).cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"), F.lit(1).cast("bigint").alias("count"))
    q = s.where(F.col("fingerprint").isin("0", "1", "2", "3", "4")).select("fingerprint", "embedding")
    return retrieval.similar_semantic(q, s, retrieval.Visibility(True, None), "0", 0.3).select("scope", "fingerprint", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {LOGS}, {_clusters_sql("k", A)}, q AS (SELECT fingerprint FROM k {_RANKED} LIMIT 5)
SELECT scope, fingerprint, min(normalized_message) AS template, epoch_us(min(timestamp)) AS first_seen, epoch_us(max(timestamp)) AS last_seen, count(*) AS "count", 1.0::DOUBLE AS similarity
FROM logs WHERE scope <> 'default' AND fingerprint IN (SELECT fingerprint FROM q) GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 10""")
def similar_fingerprint(spark, sf_dir):
    e = logs(spark, sf_dir)
    q = [r.fingerprint for r in cluster.clusters(e, A, DAY, "default", top=5).select("fingerprint").collect()]
    return retrieval.similar_fingerprint(q, e, None, retrieval.Visibility(True, None), "default").select("scope", "fingerprint", "template", _micros("first_seen"), _micros("last_seen"), "count", "similarity")


# Merging by vectors: the vectors stand for ranked clusters


def _vectors(spark, sf_dir):
    """All vectors of the table, each a cluster of its own."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("fingerprint"), "embedding")


_REPS = "reps AS MATERIALIZED (SELECT CAST(vec_id AS VARCHAR) AS fingerprint, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_EDGES = "edges AS MATERIALIZED (SELECT * FROM (SELECT a.fingerprint AS a, b.fingerprint AS b, list_cosine_similarity(a.e, b.e) AS s FROM reps a JOIN reps b ON a.fingerprint < b.fingerprint) WHERE s >= 0.45)"


@query(f"WITH {_REPS}, {_EDGES} SELECT a, b, round(s, 6) AS similarity FROM edges")
def merge_edges(spark, sf_dir):
    return semantic.merge_edges(_vectors(spark, sf_dir), 0.45).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH RECURSIVE {_REPS}, {_EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT fingerprint AS n, fingerprint AS m FROM reps UNION SELECT n, b FROM reach JOIN both_ways ON m = a),
comp AS (SELECT n, min(m) AS component FROM reach GROUP BY n) SELECT component, count(*) AS size, sum(label)::BIGINT AS labels FROM comp JOIN (SELECT CAST(vec_id AS VARCHAR) AS n, label FROM embeddings) USING (n) GROUP BY 1""")
def merge_components(spark, sf_dir):
    from .operators.graph import min_label_components

    v = _vectors(spark, sf_dir)
    parts = min_label_components(v.select(F.col("fingerprint").alias("node")), semantic.merge_edges(v, 0.45))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("node"), "label")
    return parts.join(labels, "node").groupBy("component").agg(F.count("*").alias("size"), F.sum("label").alias("labels"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letter_counts(template):
    """A vector that SQL can give, too: how often each letter occurs."""
    return F.array(*[(F.length(template) - F.length(F.replace(template, F.lit(x), F.lit("")))).cast("float") for x in _LETTERS])


_VECTOR = "[" + ", ".join(f"CAST(length(message) - length(replace(message, '{x}', '')) AS DOUBLE)" for x in _LETTERS) + "]"


@query(f"""WITH RECURSIVE {LOGS}, {_clusters_sql("k", A)}, v AS (SELECT fingerprint, {_VECTOR} AS e FROM k WHERE trim(message) <> ''),
edges AS (SELECT a.fingerprint AS a, b.fingerprint AS b FROM v a JOIN v b ON a.fingerprint <> b.fingerprint WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT fingerprint AS n, fingerprint AS m FROM k UNION SELECT n, b FROM reach JOIN edges ON m = a),
comp AS (SELECT n AS fingerprint, min(m) AS component FROM reach GROUP BY n),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component {_RANKED}) AS r FROM k JOIN comp USING (fingerprint)) WHERE r = 1),
g AS (SELECT component, count(*) AS n, sum(c)::BIGINT AS c, sum(sev * c) / sum(c) AS sev, sum(baseline_count)::BIGINT AS b, len(list_distinct(flatten(list(services)))) AS s FROM k JOIN comp USING (fingerprint) GROUP BY 1),
t AS (SELECT g.*, best.fingerprint, message, best.score AS own, regexp_matches(message, '{_any(patterns.TRIGGERS)}') AND n > 1 AS trig, (g.c + 1.0) / (b + 1.0) AS ratio FROM g JOIN best USING (component))
SELECT fingerprint, message AS representative_message, c AS "count", b AS baseline_count, trig AS is_trigger,
  round(CASE WHEN n > 1 THEN sev + ln(c + 1) + ln(ratio + 1) + 0.5 * ln(s + 1) + CASE WHEN trig THEN 2 ELSE 0 END ELSE own END, 6) AS importance, n - 1 AS merged FROM t""")
def merge_clusters(spark, sf_dir):
    """All clusters of the window, merged by vectors of their templates."""
    shared_dir(spark)  # names a checkpoint folder where a local session has none
    # one row a cluster; merging names them several times, and the log is read once
    ranked = cluster.clusters(logs(spark, sf_dir), A, DAY, "default", top=None).checkpoint()
    vectors = ranked.select("fingerprint", _letter_counts(F.col("representative_message")).alias("embedding"))
    merged = semantic.merge_clusters(ranked, vectors, 0.98)
    return merged.select("fingerprint", "representative_message", "count", "baseline_count", "is_trigger", F.round("importance_score", 6).alias("importance"), F.size("merged_fingerprints").alias("merged"))


# Storing


@query("""WITH b AS (SELECT CAST(event_id AS VARCHAR) AS id, 'default' AS scope, concat('file-', user_id % 3) AS source_ref, sha256(event_type || user_id % 50) AS h, CASE WHEN event_id % 10 = 0 THEN NULL ELSE date_trunc('day', CAST(ts AS TIMESTAMP)) END AS t FROM events),
stored AS (SELECT DISTINCT scope, source_ref, h, t FROM b WHERE CAST(id AS BIGINT) % 7 = 0 AND t IS NOT NULL),
fresh AS (SELECT b.* FROM b LEFT JOIN stored s ON b.scope = s.scope AND b.source_ref = s.source_ref AND b.h = s.h AND b.t = s.t WHERE b.t IS NOT NULL AND s.h IS NULL)
SELECT min(id) AS id, source_ref, h AS line_hash, epoch_us(t) AS timestamp FROM fresh GROUP BY source_ref, h, t UNION ALL SELECT id, source_ref, h, NULL FROM b WHERE t IS NULL""")
def dedup_insert(spark, sf_dir):
    b = table(spark, sf_dir, "events").selectExpr("CAST(event_id AS STRING) AS id", "'default' AS scope", "concat('file-', user_id % 3) AS source_ref", "sha2(concat(event_type, user_id % 50), 256) AS original_line_hash", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE date_trunc('day', CAST(ts AS TIMESTAMP)) END AS timestamp")
    fresh = ingest.new_entries(b, b.where("CAST(id AS BIGINT) % 7 = 0"))
    return fresh.select("id", "source_ref", F.col("original_line_hash").alias("line_hash"), _micros("timestamp"))


@query("""SELECT concat('s', user_id % 3) AS scope, event_type AS fingerprint, arg_max(value, event_id) AS value, min(event_id) AS created_at, max(event_id) AS updated_at FROM events GROUP BY 1, 2""")
def upsert_latest(spark, sf_dir):
    # events come in the order of their ids, which stand for times here
    t = table(spark, sf_dir, "events").selectExpr("event_id", "concat('s', user_id % 3) AS scope", "event_type AS fingerprint", "value", "event_id AS created_at", "event_id AS updated_at")
    old, new = t.where("event_id % 2 = 0").drop("event_id"), t.where("event_id % 2 = 1").drop("event_id")
    return ingest.upsert_latest(old, new, ["scope", "fingerprint"])


# Retention


_POLICY = [("default", "10d", None), ("other", "off", "5d")]
_CUTS = {"default": ("2024-01-21", "2024-01-11"), "other": (None, "2024-01-26")}


def _tables(spark, sf_dir):
    e = plain_logs(spark, sf_dir).withColumn("created_at", F.col("timestamp"))
    runs = e.where("level = 'info'").select("id", "scope", F.lit(None).cast("timestamp").alias("window_end"), "created_at")
    members = e.select(F.col("id").alias("log_entry_id"), F.concat(F.lit("c"), F.pmod(F.col("id").cast("bigint"), F.lit(100))).alias("cluster_id"))
    return {"log_entries": e, "cluster_members": members, "cluster_runs": runs, "clusters": runs.select(F.col("id").alias("run_id"), F.concat(F.lit("c"), "id").alias("cluster_id")), "explanations": e.where("level = 'error'").select("id", "scope", "created_at")}


def _policies(spark, tables):
    overrides = spark.createDataFrame(_POLICY, "scope string, raw_interval string, summary_interval string")
    policy = retention.policies(retention.scopes_of([tables["log_entries"], tables["cluster_runs"], tables["explanations"]]), overrides, "30d", "20d", NOW)
    # a row for each scope, found once and not for each table that it judges
    folder = shared_dir(spark)
    policy.write.parquet(f"{folder}/policy")
    return spark.read.schema(policy.schema).parquet(f"{folder}/policy")


_CUT_SQL = "cuts(scope, raw, summary) AS (VALUES ('default', TIMESTAMP '2024-01-21', TIMESTAMP '2024-01-11'), ('other', NULL, TIMESTAMP '2024-01-26'))"


@query(f"""WITH {LOGS}, {_CUT_SQL}, r AS (SELECT l.*, raw, summary FROM logs l JOIN cuts USING (scope))
SELECT scope, 'log_entries' AS "table", count(*) AS n FROM r WHERE timestamp < raw GROUP BY 1 UNION ALL SELECT scope, 'cluster_members', count(*) FROM r WHERE timestamp < raw GROUP BY 1
UNION ALL SELECT scope, 'cluster_runs', count(*) FROM r WHERE timestamp < summary AND level = 'info' GROUP BY 1 UNION ALL SELECT scope, 'clusters', count(*) FROM r WHERE timestamp < summary AND level = 'info' GROUP BY 1
UNION ALL SELECT scope, 'explanations', count(*) FROM r WHERE timestamp < summary AND level = 'error' GROUP BY 1""")
def retention_counts(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return retention.counts(t, _policies(spark, t))


@query(f"""WITH {LOGS}, {_CUT_SQL}, r AS (SELECT l.*, raw, summary FROM logs l JOIN cuts USING (scope)) SELECT 'log_entries' AS "table", count(*) AS n FROM r WHERE NOT coalesce(timestamp < raw, false)
UNION ALL SELECT 'cluster_members', count(*) FROM r WHERE NOT coalesce(timestamp < raw, false) UNION ALL SELECT 'cluster_runs', count(*) FROM r WHERE level = 'info' AND NOT coalesce(timestamp < summary, false)
UNION ALL SELECT 'clusters', count(*) FROM r WHERE level = 'info' AND NOT coalesce(timestamp < summary, false) UNION ALL SELECT 'explanations', count(*) FROM r WHERE level = 'error' AND NOT coalesce(timestamp < summary, false)""")
def retention_purge(spark, sf_dir):
    t = _tables(spark, sf_dir)
    kept = retention.purge(t, _policies(spark, t))
    out = None
    for name, rows in kept.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {LOGS} SELECT DISTINCT scope FROM logs UNION SELECT DISTINCT concat('label-', label) FROM embeddings")
def scopes_union(spark, sf_dir):
    return retention.scopes_of([plain_logs(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.concat(F.lit("label-"), "label").alias("scope"))])


@query(f"""WITH {LOGS}, g AS (SELECT concat('run-', CAST(id AS BIGINT) % 100 % 10) AS run_id, scope, count(*) AS n FROM logs GROUP BY 1, 2)
SELECT run_id, scope FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, scope) AS r FROM g) WHERE r = 1""")
def majority_scope(spark, sf_dir):
    e = plain_logs(spark, sf_dir)
    n = F.pmod(F.col("id").cast("bigint"), F.lit(100))
    members = e.select(F.col("id").alias("log_entry_id"), F.concat(F.lit("c"), n).alias("cluster_id"))
    clusters = e.select(F.concat(F.lit("c"), n).alias("cluster_id"), F.concat(F.lit("run-"), n % 10).alias("run_id")).distinct()
    return retention.majority_scope(clusters, members, e)


# Parsing: events written as lines of several shapes


def _raw(spark, sf_dir, line: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.expr(line).alias("text"), F.expr("concat('file-', event_id % 3)").alias("source_ref"))
    return tail.with_line_fields(t)


_ISO_SPARK = "date_format(date_trunc('second', CAST(ts AS TIMESTAMP)), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
_JSON_LINE = f"""CASE event_id % 4 WHEN 0 THEN to_json(named_struct('ts', {_ISO_SPARK}, 'severity', upper(event_type), 'app', concat('svc-', user_id % 5), 'msg', {MESSAGE}, 'k', props))
WHEN 1 THEN to_json(named_struct('time', unix_seconds(CAST(ts AS TIMESTAMP)) * 1000, 'LEVEL', 'WARNING', 'kubernetes', named_struct('container_name', 'web', 'namespace_name', 'prod', 'pod_name', 'p1'), 'log', event_type)) WHEN 2 THEN CASE event_id % 5 WHEN 0 THEN '{{broken' WHEN 1 THEN concat('{{"msg":"', event_type, '"}} tail}}') WHEN 2 THEN replace('{{~msg~:~single~}}', '~', chr(39)) WHEN 3 THEN concat('{{"msg":"', event_type, '"}}] {{y}}')
ELSE concat('{{"a":1,"msg":"old","a":2,"level":"warning","service":"0","msg":"', event_type, '"}}') END ELSE '  ' END"""


@query("""SELECT event_id AS ordinal, CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('second', CAST(ts AS TIMESTAMP))) WHEN 1 THEN epoch_us(date_trunc('second', CAST(ts AS TIMESTAMP))) END AS timestamp,
CASE event_id % 4 WHEN 0 THEN CASE WHEN event_type = 'error' THEN 'error' ELSE event_type END WHEN 1 THEN 'warn' WHEN 2 THEN CASE WHEN event_id % 5 = 4 THEN 'warn' END END AS level,
CASE event_id % 4 WHEN 0 THEN concat('svc-', user_id % 5) WHEN 1 THEN 'web' WHEN 2 THEN CASE WHEN event_id % 5 = 4 THEN '0' END END AS service,
CASE event_id % 4 WHEN 1 THEN 'prod' END AS environment, CASE event_id % 4 WHEN 1 THEN 'p1' END AS host, CASE event_id % 4 WHEN 0 THEN """ + MESSAGE + """ WHEN 1 THEN event_type WHEN 2 THEN CASE WHEN event_id % 5 = 4 THEN event_type END END AS message,
CASE event_id % 4 WHEN 0 THEN props WHEN 2 THEN CASE WHEN event_id % 5 = 4 THEN '2' END END AS extra_k, event_id % 4 = 2 AND event_id % 5 <> 4 AS failed FROM events WHERE event_id % 4 <> 3""")
def parse_json_lines(spark, sf_dir):
    p = F.col("parsed")
    t = parse.with_parsed_json(_raw(spark, sf_dir, _JSON_LINE)).where(p.isNotNull())
    return t.select("ordinal", F.unix_micros(p["timestamp"]).alias("timestamp"), p["level"].alias("level"), p["service"].alias("service"), p["environment"].alias("environment"), p["host"].alias("host"), p["message"].alias("message"), F.coalesce(p["extra"]["k"], p["extra"]["a"]).alias("extra_k"), p["parse_error"].isNotNull().alias("failed"))


_TEXT_LINE = f"""CASE event_id % 6 WHEN 0 THEN concat({_ISO_SPARK}, ' ERROR svc-', user_id % 5, ' failed ', event_type) WHEN 1 THEN concat({_ISO_SPARK}, ' stdout F WARN billing slow ', event_type)
WHEN 2 THEN concat('[ns/pod-1/web] ', {_ISO_SPARK}, ' INFO connection open ', event_type) WHEN 3 THEN concat('[', {_ISO_SPARK}, '] [DEBUG] cache ', event_type) WHEN 4 THEN concat('ERROR failed to connect ', event_type) ELSE '' END"""


@query("""SELECT event_id AS ordinal, CASE WHEN event_id % 6 < 4 THEN epoch_us(date_trunc('second', CAST(ts AS TIMESTAMP))) END AS timestamp, CASE event_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' WHEN 2 THEN 'info' WHEN 3 THEN 'debug' ELSE 'error' END AS level,
CASE event_id % 6 WHEN 0 THEN concat('svc-', user_id % 5) WHEN 1 THEN 'billing' WHEN 2 THEN 'web' END AS service, CASE event_id % 6 WHEN 2 THEN 'ns' END AS environment, CASE event_id % 6 WHEN 2 THEN 'pod-1' END AS host,
CASE event_id % 6 WHEN 0 THEN 'failed ' || event_type WHEN 1 THEN 'slow ' || event_type WHEN 2 THEN 'connection open ' || event_type WHEN 3 THEN 'cache ' || event_type ELSE 'ERROR failed to connect ' || event_type END AS message FROM events WHERE event_id % 6 < 5""")
def parse_text_lines(spark, sf_dir):
    p = F.col("parsed")
    t = parse.with_parsed_text(_raw(spark, sf_dir, _TEXT_LINE)).where(p.isNotNull())
    return t.select("ordinal", F.unix_micros(p["timestamp"]).alias("timestamp"), p["level"].alias("level"), p["service"].alias("service"), p["environment"].alias("environment"), p["host"].alias("host"), p["message"].alias("message"))


_CRI = "concat('2024-01-01T00:00:00Z ', CASE WHEN event_id % 5 = 0 THEN 'stderr' ELSE 'stdout' END, CASE WHEN event_type IN ('view', 'click') THEN ' P ' ELSE ' F ' END, event_type, user_id)"


@query(f"""WITH l AS (SELECT event_id, concat('file-', event_id % 3) AS f, CASE WHEN event_id % 5 = 0 THEN 'stderr' ELSE 'stdout' END AS st, event_type IN ('view', 'click') AS part, concat(event_type, user_id) AS m FROM events),
g AS (SELECT *, CASE WHEN lag(part) OVER w AND lag(st) OVER w = st THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY f ORDER BY event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY f ORDER BY event_id) AS grp FROM g)
SELECT f AS source_ref, min(event_id) AS ordinal, '2024-01-01T00:00:00Z ' || min(st) || ' F ' || string_agg(m, '' ORDER BY event_id) AS text FROM n GROUP BY f, grp""")
def cri_reassembly(spark, sf_dir):
    return sources.reassemble_cri(_raw(spark, sf_dir, _CRI)).select("source_ref", "ordinal", "text")


@query("""SELECT event_id AS ordinal, CASE event_id % 10 WHEN 0 THEN 'plain ' || event_type WHEN 1 THEN event_type || ' "quoted"' WHEN 2 THEN '{"raw":"' || event_type || '","k":' || user_id || ',"n":{"a":[1,true,null]},"message":"' || event_type || '"}'
WHEN 3 THEN '{"message":"' || event_type || '","k":1}' WHEN 4 THEN '{"message":null,"raw":"' || event_type || '"}' WHEN 5 THEN '{"text":null,"msg":7,"message":7}'
WHEN 6 THEN '{"k":2,"msg":"' || event_type || '","message":"' || event_type || '"}' WHEN 7 THEN '{"message":"' || event_type || '"}] t' WHEN 8 THEN '{"z":1.0,"n":' || event_id || '12345678901234567890123,"a":{"z":2.50,"a":[1]},"raw":{"t":"a \\"b\\""},"message":{"t":"a \\"b\\""}}'
ELSE replace('{~msg~:~' || event_type || '~}', '~', chr(39)) END AS text FROM events""")
def push_ndjson(spark, sf_dir):
    line = """CASE event_id % 10 WHEN 0 THEN concat(' plain ', event_type, ' ') WHEN 1 THEN concat('"', event_type, ' \\\\"quoted\\\\""') WHEN 2 THEN concat('{"raw": "', event_type, '", "k": ', user_id, ', "n": {"a": [1, true, null]}}')
WHEN 3 THEN concat('{"message": "', event_type, '", "k": 1}') WHEN 4 THEN concat('{"message":null,"raw":"', event_type, '"}') WHEN 5 THEN '{"text":null,"msg":7}'
WHEN 6 THEN concat('{"k":1,"msg":"', event_type, '","k":2}') WHEN 7 THEN concat('{"message":"', event_type, '"}] t') WHEN 8 THEN concat('{"z": 1.0, "n":', event_id, '12345678901234567890123, "a":{"z":2.50,"a":[1]},"raw":{"t":"a \\\\"b\\\\""}}') ELSE replace(concat('{~msg~:~', event_type, '~}'), '~', chr(39)) END"""
    return sources.parse_push(_raw(spark, sf_dir, line)).select("ordinal", "text")


@query(f"""WITH {LOGS} SELECT fingerprint, raw_message AS raw, service, level, epoch_us(date_trunc('second', timestamp)) AS timestamp FROM logs""")
def ingest_entries(spark, sf_dir):
    """Events as JSON lines through the whole write path."""
    line = f"to_json(named_struct('ts', {_ISO_SPARK}, 'level', {LEVEL}, 'service', concat('svc-', user_id % 5), 'message', {MESSAGE}))"
    e = ingest.to_entries(_raw(spark, sf_dir, line), created_at=F.lit(NOW))
    return e.select("fingerprint", F.get_json_object("raw_message", "$.message").alias("raw"), "service", "level", _micros("timestamp"))


# Jobs, keys, runs and vectors: events stand for jobs of customers' sources


_JOB = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' WHEN 'click' THEN 'pending' WHEN 'signup' THEN 'paused' ELSE 'completed' END"
_MODE = "CASE WHEN user_id % 2 = 0 THEN 'tail' ELSE 'batch' END"


def _jobs(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("CAST(event_id AS STRING) AS id", f"{_JOB} AS status", f"{_MODE} AS mode", f"{SCOPE} AS scope", "concat('src-', user_id % 20) AS source_id", "event_id % 100 AS parsed_count", "CAST(ts AS TIMESTAMP) AS finished_at")


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("concat('src-', c_custkey) AS id", "c_name AS name", "c_mktsegment AS type")


_JOBS_SQL = f"jobs AS (SELECT CAST(event_id AS VARCHAR) AS id, {_JOB} AS status, {_MODE} AS mode, {SCOPE} AS scope, concat('src-', user_id % 20) AS source_id, event_id % 100 AS parsed_count, CAST(ts AS TIMESTAMP) AS finished_at FROM events)"
_SOURCES_SQL = "sources AS (SELECT concat('src-', c_custkey) AS id, c_name AS name, c_mktsegment AS type FROM customer)"


@query(f"WITH {_JOBS_SQL}, {_SOURCES_SQL} SELECT j.id, name AS source_name, parsed_count, epoch_us(finished_at) AS finished_at FROM jobs j JOIN sources s ON s.id = source_id WHERE status = 'completed' AND scope = 'default' ORDER BY j.finished_at DESC, j.id LIMIT 25")
def list_ingestions(spark, sf_dir):
    return registry.list_jobs(_jobs(spark, sf_dir), _sources(spark, sf_dir), "default").withColumn("finished_at", F.unix_micros("finished_at"))


@query(f"WITH {_JOBS_SQL} SELECT id, status, scope FROM jobs WHERE status = 'completed' AND scope = 'default' ORDER BY finished_at DESC, id LIMIT 1")
def latest_completed_job(spark, sf_dir):
    return registry.latest_job(_jobs(spark, sf_dir), "default").select("id", "status", "scope")


@query(f"WITH {_JOBS_SQL} SELECT id, status, mode, parsed_count FROM jobs WHERE id = '20' AND scope = (SELECT scope FROM jobs WHERE id = '20')")
def ingestion_detail(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    scope = jobs.where("id = '20'").first().scope
    return registry.job_detail(jobs, "20", scope).select("id", "status", "mode", "parsed_count")


@query(f"WITH {_JOBS_SQL} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (mode = 'tail' AND status = 'running') AS running, count(*) FILTER (mode = 'tail' AND status = 'paused') AS paused FROM jobs")
def tail_counts(spark, sf_dir):
    return registry.job_counts(_jobs(spark, sf_dir))


@query(f"""WITH {_SOURCES_SQL} SELECT 'log_entries' AS "table", count(*) AS n FROM events UNION ALL SELECT 'sources', count(*) FROM sources UNION ALL SELECT 'jobs', count(*) FROM events""")
def status_counts(spark, sf_dir):
    return registry.store_counts({"log_entries": plain_logs(spark, sf_dir), "sources": _sources(spark, sf_dir), "jobs": _jobs(spark, sf_dir)})


@query(f"""WITH {_SOURCES_SQL}, w AS (SELECT DISTINCT c_name AS name, c_mktsegment AS type FROM customer UNION SELECT s_name, 'SUPPLIER' FROM supplier)
SELECT id, name, type FROM sources UNION ALL SELECT sha256(name), name, min(type) FROM w WHERE name NOT IN (SELECT name FROM sources) GROUP BY name""")
def find_or_create_source(spark, sf_dir):
    return registry.add_sources(_sources(spark, sf_dir), table(spark, sf_dir, "customer").selectExpr("c_name AS name", "c_mktsegment AS type").union(table(spark, sf_dir, "supplier").selectExpr("s_name AS name", "'SUPPLIER' AS type")))


@query(f"WITH {LOGS} SELECT DISTINCT scope FROM logs WHERE scope <> '' ORDER BY 1")
def purge_scopes(spark, sf_dir):
    return registry.scopes_to_purge(plain_logs(spark, sf_dir))


_KEYS_SQL = """keys AS (SELECT concat('k', event_id) AS key, concat('job-', event_id) AS job_id, CAST(ts AS TIMESTAMP) AS expires_at FROM events WHERE event_id % 3 = 0),
reqs AS (SELECT concat('k', event_id) AS key, concat('new-', min(user_id)) AS job_id FROM events WHERE event_id % 2 = 0 GROUP BY 1),
live AS (SELECT * FROM keys WHERE expires_at > TIMESTAMP '2024-01-15')"""


@query(f"WITH {_KEYS_SQL} SELECT r.key, coalesce(l.job_id, r.job_id) AS job_id, l.key IS NOT NULL AS replayed FROM reqs r LEFT JOIN live l ON l.key = r.key")
def idempotency_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    keys = e.where("event_id % 3 = 0").selectExpr("concat('k', event_id) AS key", "concat('job-', event_id) AS job_id", "CAST(ts AS TIMESTAMP) AS expires_at")
    requests = e.where("event_id % 2 = 0").selectExpr("concat('k', event_id) AS key", "concat('new-', user_id) AS job_id", "CAST(ts AS TIMESTAMP) AS expires_at")
    return registry.claim_keys(keys, requests, datetime(2024, 1, 15, tzinfo=UTC))[1]


@query(f"""WITH {LOGS}, {_clusters_sql("k", A)} SELECT 'run-1' AS run_id, k.fingerprint, message, c AS "count", least(c, 100) > 0 AS has_members FROM k""")
def stored_run(spark, sf_dir):
    """Rows of a stored run: its clusters, with whether members were kept."""
    c, members = cluster.cluster_rows(cluster.clusters(logs(spark, sf_dir), A, DAY, "default", top=None), "run-1")
    kept = members.groupBy("run_id", "fingerprint").agg((F.count("*") > 0).alias("has_members"))
    return c.join(kept, ["run_id", "fingerprint"]).select("run_id", "fingerprint", F.col("representative_message").alias("message"), "count", "has_members")


@query(f"""WITH {LOGS}, x AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN concat('svc-', o_custkey % 5) END AS service_filter, CASE WHEN o_orderkey % 4 = 0 THEN 'prod' END AS environment_filter, TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 600) HOUR + INTERVAL 17 MINUTE AS a, o_orderkey % 50 AS h FROM orders),
n AS (SELECT x.id, l.scope, count(*) AS n FROM x JOIN logs l ON l.timestamp BETWEEN a AND a + INTERVAL (h) HOUR AND (service_filter IS NULL OR l.service = service_filter) AND (environment_filter IS NULL OR environment_filter = 'prod') GROUP BY 1, 2)
SELECT id, scope FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, scope) AS r FROM n) WHERE r = 1""")
def explanation_scopes(spark, sf_dir):
    x = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS id", "CASE WHEN o_orderkey % 3 = 0 THEN concat('svc-', o_custkey % 5) END AS service_filter", "CASE WHEN o_orderkey % 4 = 0 THEN 'prod' END AS environment_filter", "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, CAST(o_orderkey % 600 AS INT), 17) AS window_start", "CAST(o_orderkey % 50 AS INT) AS h")
    x = x.withColumn("window_end", F.expr("window_start + make_interval(0, 0, 0, 0, h)"))
    return registry.majority_scope_by_window(x, plain_logs(spark, sf_dir))


@query("""WITH n AS (SELECT CAST(label AS VARCHAR) AS scope, CAST(vec_id AS VARCHAR) AS fingerprint, vec_id FROM embeddings)
SELECT scope, fingerprint, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'old' END AS template FROM n WHERE vec_id % 2 = 1 OR vec_id % 10 <> 0
UNION ALL SELECT scope, fingerprint, 'old' FROM n WHERE vec_id % 10 = 0""")
def cluster_vector_upsert(spark, sf_dir):
    """Vectors of templates written over stored ones; every tenth has a blank template and stays."""
    v = table(spark, sf_dir, "embeddings").selectExpr("CAST(label AS STRING) AS scope", "CAST(vec_id AS STRING) AS fingerprint", "vec_id", "embedding")
    at = F.lit(NOW - DAY)
    stored = v.select("scope", "fingerprint", F.lit("old").alias("template"), "embedding", at.alias("first_seen"), at.alias("last_seen"), F.lit(1).cast("bigint").alias("count"), at.alias("updated_at"), at.alias("created_at"))
    fresh = v.where("vec_id % 2 = 0").select("scope", "fingerprint", F.when(F.expr("vec_id % 10 = 0"), " ").otherwise("new").alias("template"), "embedding", at.alias("first_seen"), at.alias("last_seen"), F.lit(2).cast("bigint").alias("count"), F.lit(NOW).alias("updated_at"), F.lit(NOW).alias("created_at"))
    kept = registry.usable_vectors(fresh.where(F.trim("template") != ""), lambda t: t, 64)
    return ingest.upsert_latest(stored, kept, ["scope", "fingerprint"]).select("scope", "fingerprint", "template")


@query(f"""WITH {LOGS}, {_clusters_sql("k", A)} SELECT fingerprint, message, c AS "count", list_aggregate(services, 'string_agg', ',') AS services, round(change_ratio, 1) AS change_ratio, round(score, 1) AS importance_score FROM k {_RANKED} LIMIT 10""")
def cluster_response(spark, sf_dir):
    out = registry.cluster_rows_out(cluster.clusters(logs(spark, sf_dir), A, DAY, "default", top=10), lambda c: F.round(c, 1))
    return out.select("fingerprint", "message", "count", F.array_join("services", ",").alias("services"), "change_ratio", "importance_score")


@query(f"""WITH {LOGS}, {_ROLES_SQL}, {_TRIGGER_SQL}, p AS (SELECT first_seen FROM roles WHERE role = 0)
SELECT message, service, epoch_us(timestamp) AS timestamp, CASE {" ".join(f"WHEN regexp_matches(message, '(?i){x}') THEN '{t}'" for x, t in patterns.TRIGGER_TYPES)} END AS type, CASE WHEN timestamp <= first_seen THEN 'precedes_primary_spike' END AS correlation FROM cand, p""")
def trigger_response(spark, sf_dir):
    first = evidence.roles(_capped(spark, sf_dir)).where("role = 0").first().first_seen
    found = evidence.trigger_candidates(logs(spark, sf_dir), A, scope="default", top=None)
    return registry.trigger_out(found, F.lit(first)).withColumn("timestamp", F.unix_micros("timestamp"))


# Verbs


@query()
def explain(spark, sf_dir):
    p = Analyzer(logs(spark, sf_dir)).explain(A)
    return spark.createDataFrame([(p["total_logs"], p["primary"]["fingerprint"], p["confidence"], "\n".join(p["evidence"]), p["summary"])], "total_logs long, primary string, confidence string, evidence string, summary string")


@query()
def ask(spark, sf_dir):
    a = Analyzer(logs(spark, sf_dir)).ask(QUESTION, A)
    return spark.createDataFrame([(a["mode"], a["total_matches"], a["answer"])], "mode string, total_matches long, answer string")


@query("""SELECT CAST(date_trunc('day', CAST(ts AS TIMESTAMP)) AS TIMESTAMP) AS start, CAST(date_trunc('day', CAST(ts AS TIMESTAMP)) + INTERVAL 1 DAY AS TIMESTAMP) AS "end", event_type AS fingerprint, count(*) AS n
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3""")
def stream_windowed_counts(spark, sf_dir):
    """Tumbling counts of a stream of events, run until all is read; open windows count, too."""
    path, folder = f"{sf_dir}/events.parquet", shared_dir(spark)
    schema = table(spark, sf_dir, "events").schema
    # the source is a file or a folder; a glob reads both
    e = spark.readStream.schema(schema).parquet(path if _is_folder(spark, path) else f"{sf_dir}/events*.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS timestamp", "event_type AS fingerprint")
    counts = tail.windowed_counts(e, "1 day", "1 day")
    spark.createDataFrame([], counts.schema).write.parquet(f"{folder}/counts")
    # complete mode: each batch brings every window anew, and the last one stands
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/counts")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/counts")


def _replay(spark, folder: str, slices: list[DataFrame], start) -> None:
    """Run a stream over slices, a micro-batch each, however many files a slice has; it goes on from its checkpoint."""
    for part in slices:
        part.write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(slices[0].schema).parquet(f"{folder}/in")).awaitTermination()


#: Lines of a micro-batch, at most about so many.
SLICE = 1_000_000


def _slices(lines: DataFrame, folder: str) -> list[DataFrame]:
    """All lines in the order of `ordinal`, in three slices or as many more as keep each small; stored once."""
    n = lines.count()
    k = max(3, -(-n // SLICE))
    cuts = lines.agg(F.percentile_approx("ordinal", [i / k for i in range(1, k)], 100 * k)).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c < F.col("ordinal")))
    dealt = lines.withColumn("_slice", at)
    dealt.write.partitionBy("_slice").parquet(f"{folder}/slices")
    stored = lines.sparkSession.read.schema(dealt.schema).parquet(f"{folder}/slices")
    return [stored.where(F.col("_slice") == i).select(lines.columns) for i in range(k)]


@query(ORACLE_SQL["cri_reassembly"])
def stream_cri_reassembly(spark, sf_dir):
    """Container lines in three micro-batches or more: fragments that are open between them wait in the state."""
    folder, raw = shared_dir(spark), _raw(spark, sf_dir, _CRI)
    # a blank line at the end of each file closes what is open
    ends = raw.groupBy("source_ref").agg((F.max("ordinal") + 1).alias("ordinal")).select("ordinal", F.lit("").alias("text"), "source_ref")

    def start(lines):
        return tail.join_fragments(lines).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()

    _replay(spark, folder, [*_slices(raw, folder), tail.with_line_fields(ends).select(raw.columns)], start)
    return spark.read.schema(raw.schema).parquet(f"{folder}/out").where("text <> ''").select("source_ref", "ordinal", "text")


_TIMED = f"concat({_ISO_SPARK}, ' ERROR svc-', user_id % 5, ' failed ', event_type)"


@query("""SELECT DISTINCT concat('file-', event_id % 3) AS source_ref, strftime(date_trunc('second', CAST(ts AS TIMESTAMP)), '%Y-%m-%dT%H:%M:%SZ') || ' ERROR svc-' || user_id % 5 || ' failed ' || event_type AS raw_message,
epoch_us(date_trunc('second', CAST(ts AS TIMESTAMP))) AS timestamp FROM events""")
def stream_dedup(spark, sf_dir):
    """Lines of which half come a second time, through the stream's state into a store."""
    folder, raw = shared_dir(spark), _raw(spark, sf_dir, _TIMED)
    _replay(spark, folder, [raw.where("ordinal % 2 = 0"), raw], lambda lines: tail.start_ingest(lines, f"{folder}/store", f"{folder}/state", job_id="j", interval=None, lateness="1 hour", alone=True))
    return Store(spark, f"{folder}/store").read("log_entries").select("source_ref", "raw_message", _micros("timestamp"))


_ENTRY = "CAST(event_id AS STRING) AS id", f"{SCOPE} AS scope", "event_type AS level", "CAST(ts AS TIMESTAMP) AS created_at", "CAST(CAST(ts AS TIMESTAMP) AS DATE) AS event_date"


@query(f"""WITH {_CUT_SQL}, e AS (SELECT *, {SCOPE} AS scope, CAST(ts AS TIMESTAMP) AS t FROM events),
k AS (SELECT e.*, coalesce(t >= raw, true) AS kept, coalesce(t >= summary, true) AS fresh FROM e JOIN cuts USING (scope))
SELECT scope, 'log_entries' AS "table", count(*) FILTER (kept) AS n, count(*) FILTER (NOT kept) AS purged FROM k GROUP BY 1
UNION ALL SELECT scope, 'cluster_members', count(*) FILTER (kept), count(*) FILTER (NOT kept) FROM k WHERE event_id % 2 = 0 GROUP BY 1
UNION ALL SELECT scope, 'explanations', count(*) FILTER (fresh), count(*) FILTER (NOT fresh) FROM k WHERE event_type = 'error' GROUP BY 1""")
def store_purge(spark, sf_dir):
    """A stored copy of events with members and explanations, purged in one version: what is left and what went."""
    e, store = table(spark, sf_dir, "events").selectExpr(*_ENTRY), Store(spark, shared_dir(spark))
    store.append("log_entries", e, ("scope", "event_date"), F.col("created_at"))
    store.append("cluster_members", e.where("CAST(id AS BIGINT) % 2 = 0").select(F.col("id").alias("log_entry_id"), "scope"), ("scope",))
    store.append("explanations", e.where("level = 'error'").select("id", "scope", "created_at"), ("scope",), F.col("created_at"))
    overrides = spark.createDataFrame(_POLICY, "scope string, raw_interval string, summary_interval string")
    gone = spark.createDataFrame([(*k, n) for k, n in retention.purge_store(store, overrides, "30d", "20d", NOW).items()], "scope string, table string, purged long")
    left = [store.read(t).groupBy("scope").agg(F.count("*").alias("n")).select("scope", F.lit(t).alias("table"), "n") for t in ("log_entries", "cluster_members", "explanations")]
    return reduce(DataFrame.unionByName, left).join(gone, ["scope", "table"], "full").na.fill(0)


@query(ORACLE_SQL["upsert_latest"])
def store_upsert(spark, sf_dir):
    """upsert_latest on a stored table, in two versions."""
    t, store = table(spark, sf_dir, "events").selectExpr("event_id", "concat('s', user_id % 3) AS scope", "event_type AS fingerprint", "value", "event_id AS created_at", "event_id AS updated_at"), Store(spark, shared_dir(spark))
    for part in (0, 1):
        ingest.upsert_store(store, "vectors", t.where(F.col("event_id") % 2 == part).drop("event_id"), ["scope", "fingerprint"])
    return store.read("vectors")


@query(ORACLE_SQL["similar_semantic"])
def similar_indexed(spark, sf_dir):
    """similar_semantic over stored vectors in cells, written in two parts; all cells are read, so it is exact."""
    store, at = Store(spark, shared_dir(spark)), F.lit(NOW)
    s = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("scope"), F.col("vec_id").cast("string").alias("fingerprint"), F.lit("t").alias("template"), "embedding", F.lit(None).cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"), F.lit(1).cast("bigint").alias("count"), at.alias("updated_at"), at.alias("created_at"))
    for part in (0, 1):
        vectorindex.put_vectors(store, s.where(F.col("vec_id") % 2 == part).drop("vec_id"))
    q = s.where(F.col("fingerprint").isin("0", "1", "2", "3", "4")).select("fingerprint", "embedding")
    found = retrieval.similar_semantic(q, vectorindex.near_vectors(store, q, exact=True), retrieval.Visibility(True, None), "0", 0.3)
    return found.select("scope", "fingerprint", F.round("similarity", 6).alias("similarity"))


@query(ORACLE_SQL["ask_keyword"])
def ask_templates(spark, sf_dir):
    """ask_keyword over stored entries: words are sought in the store's templates, lines found by fingerprint."""
    folder = shared_dir(spark)
    e = logs(spark, sf_dir).withColumn("source_ref", F.col("ingestion_job_id")).withColumn("original_line_hash", F.col("id")).withColumn("created_at", F.lit(NOW))
    ingest.append_entries(e, folder)
    store = Store(spark, folder)
    hits = retrieval.keyword_search(store.read("log_entries"), retrieval.keywords(QUESTION), A, level=retrieval.level_hint(QUESTION), scope="default", templates=store.read("templates"))
    return hits.select("id", _micros("timestamp"), "fingerprint")


def _is_folder(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters_topk(spark, sf_dir)
