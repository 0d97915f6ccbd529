"""Spark schemas of the record types, as DDL text."""

LEDGER = (
    "schema_version int, ts timestamp, run_id string, event string, arm string, unit_id string, seed long, "
    "model string, prompt_tokens long, completion_tokens long, cache_hit_prompt_tokens long, "
    "reasoning_tokens long, cached boolean, latency_ms long, usd double, pricing_version string, "
    "pricing_tier string, attempt int, status_code int, error_kind string, error string, "
    "request_sha256 string, search_provider string, search_query_sha256 string, replicate string, "
    "steps int, approximate boolean, rollout_uid string"
)
LEDGER_REQUIRED = ["schema_version", "ts", "run_id", "event", "arm", "unit_id", "seed", "model"]

TRACE = "schema_version int, seq long, ts timestamp, run_id string, kind string, payload string"
TRACE_REQUIRED = ["schema_version", "seq", "ts", "run_id", "kind", "payload"]

ENTRY = (
    "rollout_id string, ord long, step long, role string, "
    "message struct<content:string,reasoning_content:string,"
    "tool_calls:array<struct<id:string,name:string,arguments:string>>>, "
    "tool_call struct<id:string,name:string,arguments:string>, "
    "tool_output struct<content:string,stdout:string,stderr:string,exit_code:int,timeout:boolean,"
    "duration_seconds:double>, "
    "token_usage struct<prompt_tokens:long,completion_tokens:long,cached_tokens:long>, "
    "completed_at double"
)

METADATA = (
    "rollout_id string, exit_reason string, final_answer string, steps long, duration_seconds double, "
    "token_usage struct<prompt_tokens:long,completion_tokens:long,cached_tokens:long>"
)

SCORE = "passed boolean, value double, reason string, task_failure string"

ROLLOUT = (
    "rollout_uid string, task_id string, source string, replicate string, attempt int, exit_reason string, "
    "steps long, duration_seconds double, started_at timestamp, usd double, partial boolean, "
    "error_family string, error_kind string, error string"
)

STAGE_LOG = "ts timestamp, stage string, run_id string, event string"
DISPATCH = "tool_name string, response_status int"
