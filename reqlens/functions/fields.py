"""Logical field resolution against a DataFrame's columns.

Resolution happens at plan time on the driver and only looks at
``df.columns`` — no data is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

# ---------------------------------------------------------------------------
# Alternative column names per logical field, in priority order
# (used when neither the exact name nor the field map resolves a field).
# ---------------------------------------------------------------------------
FIELD_ALTERNATIVES: dict[str, list[str]] = {
    "timestamp": ["time", "timestamp", "@timestamp", "datetime", "date", "request_time"],
    "url": ["request_url", "url", "uri", "request_uri", "path"],
    "method": ["request_method", "method", "verb", "http_method"],
    "status": ["elb_status_code", "status", "status_code", "response_code", "http_status"],
    "response_time": ["target_processing_time", "response_time", "request_processing_time",
                      "elapsed_time", "duration", "processing_time"],
    "client_ip": ["client_ip", "remote_addr", "client", "ip", "clientip", "client:port"],
    "bytes": ["sent_bytes", "bytes_sent", "body_bytes_sent", "bytes", "size"],
    "sent_bytes": ["sent_bytes", "bytes_sent", "size", "response_size", "body_bytes_sent"],
    "received_bytes": ["received_bytes", "bytes", "request_size"],
    "target_ip": ["target_ip", "backend_ip", "upstream_addr"],
    "target_port": ["target_port", "backend_port"],
    "request_processing_time": ["request_processing_time", "request_time", "response_time", "response_time_us",
                                "response_time_ms", "elapsed_time", "duration", "processing_time"],
    "target_processing_time": ["target_processing_time", "upstream_response_time", "response_time", "response_time_us",
                               "response_time_ms", "elapsed_time", "duration", "processing_time"],
    "response_processing_time": ["response_processing_time", "response_time", "response_time_us", "response_time_ms",
                                 "elapsed_time", "duration", "processing_time"],
    "user_agent": ["user_agent", "http_user_agent", "agent", "useragent"],
    "referer": ["referer", "http_referer", "referrer"],
}
# Column-name variants used to infer a field map from a column
# list; each column takes at most one role, first role in this order wins.
ROLE_VARIANTS: list[tuple[str, list[str]]] = [
    ("timestamp", ["time", "timestamp", "@timestamp", "datetime", "request_time"]),
    ("method", ["method", "request_method", "request_verb", "verb", "http_method"]),
    ("url", ["url", "request_url", "uri", "request_uri", "path"]),
    ("status", ["status", "status_code", "elb_status_code", "http_status", "response_code"]),
    ("responseTime", ["response_time", "request_time", "response_time_us",
                      "target_processing_time", "request_processing_time", "duration", "elapsed"]),
    ("clientIp", ["client_ip", "remote_addr", "client", "ip", "clientip", "remote_ip"]),
]
# logical names used by field maps → keys of FIELD_ALTERNATIVES
_ROLE_ALIASES = {"responseTime": "response_time", "clientIp": "client_ip", "time": "timestamp"}


class FieldNotFound(KeyError):
    pass


def infer_field_map(columns: Iterable[str], explicit: Mapping[str, str] | None = None) -> dict[str, str]:
    """Role → column from names (an explicit map wins outright)."""
    if explicit:
        return dict(explicit)
    out: dict[str, str] = {}
    for col in columns:
        low = col.lower()
        for role, variants in ROLE_VARIANTS:
            if role not in out and low in variants:
                out[role] = col
                break
    return out


def find_field(columns: Iterable[str], name: str, field_map: Mapping[str, str] | None = None,
               candidates: Iterable[str] | None = None) -> str | None:
    """Exact name → field map → caller's candidates → default alternatives."""
    cols = list(columns)
    if name in cols:
        return name
    fm = field_map or {}
    if name in fm and fm[name] in cols:
        return fm[name]
    for c in candidates or []:
        if c in cols:
            return c
    key = _ROLE_ALIASES.get(name, name)
    for c in FIELD_ALTERNATIVES.get(key, []):
        if c in cols:
            return c
    return None


def require_field(df: DataFrame, name: str, field_map: Mapping[str, str] | None = None,
                  candidates: Iterable[str] | None = None) -> str:
    found = find_field(df.columns, name, field_map, candidates)
    if found is None:
        raise FieldNotFound(f"field {name!r} not found in columns {df.columns}")
    return found


# Which features a table supports, from its columns alone.
FEATURE_FIELDS: dict[str, list[str]] = {
    "request_per_uri": ["timestamp", "url"],
    "xlog": ["timestamp", "response_time"],
    "received_bytes": ["timestamp", "url", "received_bytes"],
    "sent_bytes": ["timestamp", "url", "sent_bytes"],
    "processing_time": ["timestamp", "url", "response_time"],
    "request_per_target": ["timestamp", "target_ip", "target_port"],
    "request_per_client": ["timestamp", "client_ip"],
    "dashboard": ["timestamp"],
}


def feature_availability(df: DataFrame, field_map: Mapping[str, str] | None = None) -> dict[str, bool]:
    """Feature → available, e.g. ``sent_bytes`` is satisfied by ``bytes_sent``."""
    cols = df.columns
    return {feat: all(find_field(cols, f, field_map) is not None for f in need)
            for feat, need in FEATURE_FIELDS.items()}
