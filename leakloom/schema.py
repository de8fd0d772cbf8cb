"""Schemas of the engine's tables."""

from __future__ import annotations

CHUNKS = "chunk_id long, source_type string, source_name string, text string, container string, parent string, ext string, path string, base_line int, meta map<string,string>"
FINDINGS = (
    "chunk_id long, detector string, verifier_backed boolean, raw string, raw_v2 string, redacted string, secret_hash string, severity_rank int, severity string, "
    "start_byte long, end_byte long, line long, decoded_from string, suppressed_by string"
)
COVERAGE = "source string, kind string, severity string, detector string, error string"
STATE = "run_key string, resource_key string, fingerprint string, scanner_fingerprint string, updated_at timestamp"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
