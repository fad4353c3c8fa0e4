"""Schemas of the stored tables."""

LOG_ENTRIES = (
    "id string, source_id string, ingestion_job_id string, timestamp timestamp, service string, environment string, level string, trace_id string, "
    "request_id string, host string, raw_message string, normalized_message string, fingerprint string, parser_type string, extra_json string, "
    "source_adapter string, source_ref string, original_line_hash string, scope string, created_at timestamp"
)
CLUSTERS = (
    "fingerprint string, representative_message string, count bigint, services map<string,bigint>, levels map<string,bigint>, first_seen timestamp, "
    "last_seen timestamp, baseline_count bigint, change_ratio double, importance_score double, is_trigger boolean, log_entry_ids array<string>, merged_fingerprints array<string>"
)
CLUSTER_EMBEDDINGS = "scope string, fingerprint string, template string, embedding array<float>, first_seen timestamp, last_seen timestamp, count bigint, updated_at timestamp, created_at timestamp"
RAW_LINES = "text string, source_ref string, ordinal bigint, received_at timestamp, default_service string, default_environment string, default_host string, extra map<string,string>"
INGESTION_JOBS = "id string, source_id string, status string, mode string, scope string, started_at timestamp, finished_at timestamp, parsed_count bigint, inserted_count bigint, skipped_count bigint, error_count bigint, cursor string"
EXPLANATIONS = "prompt_hash string, scope string, result_json string, created_at timestamp"
DEFAULT_SCOPE = "default"
