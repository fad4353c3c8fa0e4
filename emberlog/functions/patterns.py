"""Fixed values of the log model: patterns, word lists and weights that results depend on."""

# Message normalisation, in order (pattern, replacement). \1 in the rule is $1 here.
NORMALIZATION = [
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"eyJ[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{10,}", "<jwt>"),
    (r"\b[0-9a-fA-F]{8,}\b", "<hex>"),
    (r"\b[A-Za-z0-9_\-]{32,}\b", "<token>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", "<ip>"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}\b", "<ipv6>"),
    (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "<email>"),
    (r"(https?://[^\s?]+)\?[^\s]*", r"$1?<params>"),
    (r"\b(request_id|req_id|trace_id|span_id|correlation_id)=\S+", r"$1=<*>"),
    (r"(?i)\b(user|account|order|transaction|session|job|task|worker|tenant|customer|invoice)\s+(?:id\s+)?#?(\d+)\b", r"$1 <id>"),
    (r"\b\d+(?:\.\d+)?\s*(?:ms|s|sec|seconds?|minutes?|min|hours?|hr)\b", "<duration>"),
    (r":(\d{4,5})\b", ":<port>"),
    (r"\b\d{5,}\b", "<num>"),
    (r"/(?:[a-zA-Z0-9_\-\.]+/){3,}[a-zA-Z0-9_\-\.]*", "<path>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<timestamp>"),
]

# Messages that trigger incidents (case-insensitive).
TRIGGERS = [
    r"deploy(?:ment)?\s+(?:started|completed|finished|done)",
    r"application\s+(?:started|restarted|restart)",
    r"service\s+(?:started|restarted|restart)",
    r"pod\s+(?:restart|restarted|terminated|evicted)",
    r"config(?:uration)?\s+(?:reloaded|changed|updated)",
    r"migration\s+(?:started|completed|running)",
    r"queue\s+(?:full|saturated|overflow)",
    r"circuit[\s_]?breaker\s+(?:open|tripped|activated)",
    r"webhook\s+(?:secret|key|config)\s+(?:changed|invalid|expired)",
    r"token\s+(?:expired|expiration|invalid)",
    r"release\s+\S+\s+(?:deployed|started|live)",
    r"rollout\s+(?:started|completed|done)",
]

# Families of triggers, the first that matches (case-insensitive).
TRIGGER_TYPES = [
    (r"deploy(?:ment)?|rollout|release\s+\S+\s+(?:deployed|started|live)", "deploy"),
    (r"pod\s+(?:restart|restarted|terminated|evicted)", "pod"),
    (r"config(?:uration)?\s+(?:reloaded|changed|updated)", "config"),
    (r"migration\s+(?:started|completed|running)", "migration"),
    (r"queue\s+(?:full|saturated|overflow)", "queue"),
    (r"circuit[\s_]?breaker\s+(?:open|tripped|activated)", "circuit_breaker"),
    (r"webhook\s+(?:secret|key|config)\s+(?:changed|invalid|expired)", "webhook"),
    (r"token\s+(?:expired|expiration|invalid)", "token"),
    (r"(?:application|service)\s+(?:started|restarted|restart)|restart", "restart"),
]

# Fixed value: a version at the end of a lower-cased message.
VERSION = r"\bv\d+[\d.\-a-z]*$"

# Keys under which log lines hold a field, in the order in which they are tried.
ALIASES = {
    "timestamp": ["timestamp", "ts", "time", "@timestamp", "datetime", "date", "log_timestamp"],
    "message": ["message", "msg", "log", "text", "body", "content", "log_message"],
    "level": ["level", "severity", "log_level", "loglevel", "lvl", "priority"],
    "service": ["service", "app", "logger", "component", "application", "service_name", "app_name", "source"],
    "environment": ["environment", "env", "deployment", "stage", "namespace"],
    "trace_id": ["trace_id", "traceId", "trace", "x_trace_id", "X-Trace-Id"],
    "request_id": ["request_id", "requestId", "req_id", "reqId", "correlation_id", "correlationId"],
    "host": ["host", "hostname", "server", "instance", "pod", "node"],
}

# Spellings of levels.
LEVELS = {
    "fatal": "fatal",
    "critical": "fatal",
    "crit": "fatal",
    "error": "error",
    "err": "error",
    "warn": "warn",
    "warning": "warn",
    "info": "info",
    "information": "info",
    "informational": "info",
    "debug": "debug",
    "dbg": "debug",
    "trace": "debug",
    "verbose": "debug",
}

# Weight of a level in a cluster's severity; any other level weighs 1.
SEVERITY = {"fatal": 5.0, "critical": 5.0, "error": 4.0, "err": 4.0, "warn": 3.0, "warning": 3.0, "info": 1.0, "debug": 0.5, "trace": 0.5}

# Levels of clusters that can be a cause, and of lines that answer without keywords.
SIGNIFICANT = ["error", "fatal", "warn", "critical"]

# Timestamps in text, in the order in which they are tried.
TIMESTAMPS = [
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?",
    r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}",
    r"\b1[5-9]\d{8}(?:\.\d+)?\b",
]

# Other forms of a field that holds a time: what they look like, and how Spark reads them.
DATE_FORMS = [
    (r"^\d{1,2} [A-Za-z]{3} \d{4} ", "d MMM yyyy HH:mm[:ss][.SSSSSS][ Z]"),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4} ", "MMM d[,] yyyy HH:mm[:ss][ Z]"),
    (r"^[A-Za-z]{3} \d{1,2} \d\d:\d\d:\d\d \d{4}", "MMM d HH:mm:ss yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}[ T]", "yyyy/M/d[ ]['T']HH:mm[:ss][.SSSSSS][XXX][ Z]"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4} .*[AaPp][Mm]$", "M/d/yyyy h:mm[:ss] a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} ", "M/d/yyyy HH:mm[:ss]"),
    (r"^\d{8}T\d{6}", "yyyyMMdd'T'HHmmss[XXX][X]"),
]

# Words of a question that say nothing, and those that hint at a level.
STOP_WORDS = (
    "the a an in on at to is was did do why what when how which who service error fail failed not working happening "
    "going causing there are any all and or but for with my our your"
).split()
LEVEL_HINTS = {
    "error": ["error", "fail", "failure", "failed", "exception", "crash", "broken", "unavailable", "refused", "denied", "invalid", "unauthorized"],
    "warn": ["warn", "warning", "slow", "latency", "timeout", "degraded"],
    "info": ["start", "started", "deploy", "restart", "launch"],
}

# Level words in text lines, and the shapes of such lines.
LEVEL_WORDS = "FATAL|CRITICAL|ERROR|ERR|WARN(?:ING)?|INFO(?:RMATION(?:AL)?)?|DEBUG|TRACE|VERBOSE"
BRACKET_LEVELS = "FATAL|CRITICAL|ERROR|ERR|WARN(?:ING)?|INFO|DEBUG|TRACE"
CRI_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))\s+(stdout|stderr)\s+([FP])\s+(.*)$"
KUBECTL_LINE = r"^\[(?:([\w.-]+)/)?([\w.-]+)/([\w.-]+)\]\s+(.*)$"

# The four shapes of text lines, by what they begin with: a time and service, a level, a
# time behind a prefix that names the service, brackets.
LINE_SHAPES = {
    "s": rf"(?iuUd)^(\S+(?:\s\S+)?)\s+({LEVEL_WORDS})\s+(\S+)\s+(.+)$",
    "l": rf"(?iuUd)^({LEVEL_WORDS})\s+(\S+)\s+(.+)$",
    "t": rf"(?iuUd)^(\S+(?:\s\S+)?)\s+({LEVEL_WORDS})\s+(.+)$",
    "b": rf"(?iuUd)^\[([^\]]+)\]\s*\[?({BRACKET_LEVELS})\]?\s*(.+)$",
}

# Words of timeline events and effects.
DEPLOY_WORDS = "deploy release rollout pushed promote"
STARTUP_WORDS = "started starting boot launch listening port"
SYMPTOM_WORDS = "queue pending backlog"
FAILURE_WORDS = "500 error fail"
SLOWNESS_WORDS = "latency slow timeout"

# Sentences of evidence, each with the condition under which it stands.
NO_EVIDENCE = ["Total logs in window: {total}", "No significant error clusters detected"]
PRIMARY_EVIDENCE = [
    ("found", "{count} similar failures in {where}"),
    ("unseen", "Not observed in prior 24h baseline"),
    ("surging", "Count increased {change_ratio:.0f}x vs baseline ({baseline_count} prior events)"),
    ("recurring", "Baseline had {baseline_count} similar events (change ratio: {change_ratio:.1f}x)"),
    ("triggered", "First error spike occurred {minutes}m after {trigger}"),
    ("endpoint", "Endpoint '{endpoint}' appears in the primary error cluster"),
]
SECONDARY_EVIDENCE = [
    ("pending", "Webhook queue grew to {pending} pending items (observed in {log_events})"),
    ("later failures", "{count} checkout 500s in {where} started after the primary failure spike"),
    ("later slowness", "{count} elevated-latency checkout responses followed the same period"),
    ("later", "{count} '{short}' events in {where} (started after primary)"),
    ("found", "Related: {count} '{short}' events in {where}"),
]

# Sentences and titles of the texts that are returned.
INSUFFICIENT = [
    "Incident summary",
    "",
    "Window: {window}",
    "",
    "Insufficient evidence to identify a likely issue in the requested window.",
    "",
    "Evidence:",
    "- {total} total logs matched filters",
    "- No error-level clusters detected",
    "- No cluster showed meaningful deviation from baseline",
    "",
    "Confidence: low",
]
NO_EVENTS = "  No significant events found in this window."
NO_CHANGES = "  No significant changes between windows."
NOTHING_FOUND = "No logs found in window"
NO_ANSWER = "No log activity found in the requested window. Try a wider time range with --since."
REDIRECT = "Operators can redirect this command to a file for tickets and postmortems:"
DIRECTIONS = [
    ("new", "+", "New error clusters"),
    ("disappeared", "-", "Errors that disappeared"),
    ("increased", "↑", "Errors that increased"),
    ("decreased", "↓", "Errors that decreased"),
]
TRIGGER_SIDES = [("a", "+", "Triggers in A not seen in B"), ("b", "-", "Triggers in B not seen in A")]
