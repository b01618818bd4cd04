"""Log format descriptors: presets, Apache ``LogFormat`` compiler.

A ``LogFormat`` is plan-time metadata: a regex whose capture groups map by
position to columns, declared column types, the response-time unit, the zone
policy and a field map.  Nothing here touches data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from reqlens.functions.fields import infer_field_map

HTTPD_TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"


@dataclass(frozen=True)
class LogFormat:
    name: str
    pattern: str                      # Python/Java regex; matched at the line start
    columns: tuple[str, ...]          # group i -> columns[i]; empty = fallback mapping (S15)
    types: dict[str, str] = field(default_factory=dict)   # str | int | float | datetime
    pattern_type: str = "GROK"        # ALB | HTTPD | JSON | GROK
    field_map: dict[str, str] = field(default_factory=dict)
    rt_unit: str = "ms"
    timezone: str = "fromLog"         # UTC | fromLog
    time_format: str | None = None    # Spark datetime pattern for datetime columns

    @property
    def n_groups(self) -> int:
        return re.compile(self.pattern).groups if self.pattern_type != "JSON" else 0

    def with_field_map(self) -> "LogFormat":
        return replace(self, field_map=infer_field_map(self.columns, self.field_map))


# ---------------------------------------------------------------------------
# Preset formats (regex, column order, column types, units).
# ---------------------------------------------------------------------------
ALB_PATTERN = (
    r'([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*):([0-9]*) ([^ ]*)[:-]([0-9]*) ([-.0-9]*) ([-.0-9]*) ([-.0-9]*) '
    r'(|[-0-9]*) (-|[-0-9]*) ([-0-9]*) ([-0-9]*) "([^ ]*) (.*) (- |[^ ]*)" "([^"]*)" ([A-Z0-9-_]+) '
    r'([A-Za-z0-9.-]*)(?: ([^ ]*) "([^"]*)" "([^"]*)" "([^"]*)" ([-.0-9]*) ([^ ]*) "([^"]*)" "([^"]*)" '
    r'"([^"]*)" "([^\s]+?)" "([^\s]+)" "([^ ]*)" "([^ ]*)" ?([^ ]*)?)?')
ALB_COLUMNS = (
    "type", "time", "elb", "client_ip", "client_port", "target_ip", "target_port",
    "request_processing_time", "target_processing_time", "response_processing_time",
    "elb_status_code", "target_status_code", "received_bytes", "sent_bytes", "request_verb",
    "request_url", "request_proto", "user_agent", "ssl_cipher", "ssl_protocol", "target_group_arn",
    "trace_id", "domain_name", "chosen_cert_arn", "matched_rule_priority", "request_creation_time",
    "actions_executed", "redirect_url", "lambda_error_reason", "target_port_list",
    "target_status_code_list", "classification", "classification_reason", "conn_trace_id")
ALB_TYPES = {
    "time": "datetime", "request_creation_time": "datetime",
    "client_port": "int", "target_port": "int", "elb_status_code": "int", "target_status_code": "int",
    "received_bytes": "int", "sent_bytes": "int", "matched_rule_priority": "int",
    "request_processing_time": "float", "target_processing_time": "float",
    "response_processing_time": "float",
}
# the first 17 ALB columns, used when a format has no column list
ALB_FALLBACK_COLUMNS = ALB_COLUMNS[:17]

HTTPD_PATTERN = r'([^ ]*) ([^ ]*) ([^ ]*) \[([^\]]*)] "([^"]*)" ([0-9]*) ([0-9\-]*)(?: "([^"]*)" "([^"]*)")?'
HTTPD_COLUMNS = ("client_ip", "identity", "user", "time", "request", "status", "bytes_sent", "referer",
                 "user_agent")
HTTPD_TYPES = {"time": "datetime", "status": "int", "bytes_sent": "int"}

HTTPD_CUSTOM_PATTERN = r'([^ ]*) ([^ ]*) ([^ ]*) \[([^\]]*)\] "([^"]*)" ([0-9]*) ([0-9\-]*) ([0-9]+)'
HTTPD_CUSTOM_COLUMNS = ("client_ip", "identity", "user", "time", "request", "status", "bytes_sent",
                        "response_time_us")
HTTPD_CUSTOM_TYPES = {"time": "datetime", "status": "int", "bytes_sent": "int", "response_time_us": "int"}

# identity is captured here, so the 12 groups line up with the 12 columns
HTTPD_WITH_TIME_PATTERN = (r'([^ ]*) ([^ ]*) ([^ ]*) \[([^\]]*)\] "([^ ]*) ([^ ]*) ([^"]*)" ([0-9]*) '
                           r'([0-9\-]*) "([^"]*)" "([^"]*)" ([0-9]+)')
HTTPD_WITH_TIME_COLUMNS = ("client_ip", "identity", "user", "time", "request_method", "request_url",
                           "request_proto", "status", "bytes_sent", "referer", "user_agent",
                           "response_time_us")
HTTPD_WITH_TIME_TYPES = {"time": "datetime", "status": "int", "bytes_sent": "int", "response_time_us": "int"}

NGINX_PATTERN = (r'([^ ]*) - ([^ ]*) \[([^\]]*)\] "([^ ]*) ([^ ]*) ([^"]*)" ([0-9]*) ([0-9\-]*) '
                 r'"([^"]*)" "([^"]*)" ([0-9.]+)')
NGINX_COLUMNS = ("client_ip", "remote_user", "time", "request_method", "request_url", "request_proto",
                 "status", "bytes_sent", "referer", "user_agent", "request_time")
NGINX_TYPES = {"time": "datetime", "status": "int", "bytes_sent": "int", "request_time": "float"}

GROK_PATTERN = r'(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[([^\]]+)\] (.*)'
GROK_COLUMNS = ("timestamp", "level", "message")
GROK_TYPES = {"timestamp": "datetime"}

HTTPD_FIELD_MAP = {"timestamp": "time", "method": "request_method", "url": "request_url",
                   "status": "status", "clientIp": "client_ip"}

PRESETS: dict[str, LogFormat] = {
    "alb": LogFormat("alb", ALB_PATTERN, ALB_COLUMNS, ALB_TYPES, "ALB",
                     {"timestamp": "time", "method": "request_verb", "url": "request_url",
                      "status": "elb_status_code", "responseTime": "target_processing_time",
                      "clientIp": "client_ip"}, "s", "UTC"),
    "httpd": LogFormat("httpd", HTTPD_PATTERN, HTTPD_COLUMNS, HTTPD_TYPES, "HTTPD", HTTPD_FIELD_MAP,
                       "ms", "fromLog", HTTPD_TIME_FORMAT),
    "httpd_custom": LogFormat("httpd_custom", HTTPD_CUSTOM_PATTERN, HTTPD_CUSTOM_COLUMNS, HTTPD_CUSTOM_TYPES,
                              "HTTPD", {"timestamp": "time", "status": "status", "clientIp": "client_ip",
                                        "responseTime": "response_time_us"}, "us", "fromLog",
                              HTTPD_TIME_FORMAT),
    "httpd_with_time": LogFormat("httpd_with_time", HTTPD_WITH_TIME_PATTERN, HTTPD_WITH_TIME_COLUMNS,
                                 HTTPD_WITH_TIME_TYPES, "HTTPD",
                                 {**HTTPD_FIELD_MAP, "responseTime": "response_time_us"}, "us", "fromLog",
                                 HTTPD_TIME_FORMAT),
    "nginx": LogFormat("nginx", NGINX_PATTERN, NGINX_COLUMNS, NGINX_TYPES, "HTTPD",
                       {**HTTPD_FIELD_MAP, "responseTime": "request_time"}, "s", "fromLog",
                       HTTPD_TIME_FORMAT),
    "grok": LogFormat("grok", GROK_PATTERN, GROK_COLUMNS, GROK_TYPES, "GROK", {"timestamp": "timestamp"},
                      "ms", "fromLog", "yyyy-MM-dd HH:mm:ss"),
    "json": LogFormat("json", "JSON", (), {}, "JSON",
                      {"timestamp": "timestamp", "method": "method", "url": "url", "status": "status",
                       "responseTime": "response_time", "clientIp": "client_ip"}, "ms", "fromLog"),
}


def preset(name: str) -> LogFormat:
    try:
        return PRESETS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown format preset {name!r}; one of {sorted(PRESETS)}") from None


#: a group that is matched but is no column of the result
UNNAMED = "_unnamed_"


def custom_format(pattern: str, columns=(), types=None, pattern_type: str = "GROK",
                  rt_unit: str = "ms", time_format: str | None = None) -> LogFormat:
    """A user regex.  Named groups (``(?P<n>...)``) give the columns
    when no column list is passed; an empty pattern falls back to ``.*``."""
    pattern = pattern or ".*"
    named = re.compile(pattern).groupindex
    if not columns and named:
        # by group number; the unnamed groups between them are not columns
        names = {i: n for n, i in named.items()}
        columns = tuple(names.get(i, f"{UNNAMED}{i}") for i in range(1, max(names) + 1))
    # Java group names allow no underscores, and mapping is positional anyway:
    # named groups become plain groups, named back-references numeric ones.
    java = re.sub(r"\(\?P<[A-Za-z_][A-Za-z0-9_]*>", "(", pattern)
    java = re.sub(r"\(\?P=([A-Za-z_][A-Za-z0-9_]*)\)", lambda m: "\\" + str(named[m.group(1)]), java)
    fmt = LogFormat("custom", java, tuple(columns), dict(types or {}), pattern_type, {}, rt_unit,
                    "fromLog", time_format)
    return fmt.with_field_map()


# ---------------------------------------------------------------------------
# Apache LogFormat strings
# ---------------------------------------------------------------------------
# Directive -> (regex, column, type)
APACHE_DIRECTIVES: dict[str, tuple[str, str, str]] = {
    "%h": (r"([^ ]+)", "client_ip", "str"),
    "%a": (r"([^ ]+)", "client_ip", "str"),
    "%l": (r"([^ ]+)", "identity", "str"),
    "%u": (r"([^ ]+)", "user", "str"),
    "%t": (r"\[([^\]]+)\]", "time", "datetime"),
    "%r": (r'([^"]*)', "request", "str"),
    "%m": (r"([^ ]+)", "request_method", "str"),
    "%U": (r"([^ ]+)", "request_url", "str"),
    "%q": (r"([^ ]*)", "query_string", "str"),
    "%H": (r"([^ ]+)", "request_proto", "str"),
    "%s": (r"([-0-9]+)", "status", "int"),
    "%>s": (r"([-0-9]+)", "status", "int"),
    "%b": (r"([-0-9]+)", "bytes_sent", "int"),
    "%B": (r"([0-9]+)", "bytes_sent", "int"),
    "%D": (r"([0-9]+)", "response_time_us", "int"),
    "%T": (r"([0-9.]+)", "response_time_s", "float"),
    "%v": (r"([^ ]+)", "server_name", "str"),
    "%V": (r"([^ ]+)", "server_name", "str"),
    "%p": (r"([0-9]+)", "server_port", "int"),
    "%A": (r"([^ ]+)", "server_ip", "str"),
    "%P": (r"([0-9]+)", "process_id", "int"),
    "%I": (r"([0-9]+)", "bytes_received", "int"),
    "%O": (r"([0-9]+)", "bytes_sent_including_headers", "int"),
}
# Named LogFormat presets.
APACHE_PRESETS = {
    "common": '%h %l %u %t "%r" %>s %b',
    "combined": '%h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-agent}i"',
    "combined_with_time": '%h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-agent}i" %D',
    "vhost_combined": '%v:%p %h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-agent}i"',
    "referer": "%{Referer}i -> %U",
    "agent": "%{User-agent}i",
}
_TOKEN = re.compile(r"%%|%\{([^}]*)\}([a-zA-Z])|%[<>!][a-zA-Z]|%[a-zA-Z]|%|.", re.S)


def compile_apache_format(fmt: str) -> LogFormat:
    """A LogFormat string (or a preset name) → regex, columns, types.

    ``%{Name}i`` request headers become ``referer``/``user_agent`` or the
    lower-cased header name, ``%{Name}o`` → ``resp_<name>``, ``%{Name}e`` →
    ``env_<name>``; unknown directives are skipped; literals are escaped.
    Time and durations: ``%t`` is HTTPD time, ``%D`` µs, ``%T`` s.
    """
    fmt = APACHE_PRESETS.get(fmt, fmt)
    parts: list[str] = []
    cols: list[str] = []
    types: dict[str, str] = {}
    for m in _TOKEN.finditer(fmt):
        tok = m.group(0)
        if tok == "%%":
            parts.append("%")          # a literal percent sign
        elif m.group(1) is not None:
            name, kind = m.group(1), m.group(2)
            if kind not in "ioe":
                continue               # notes, time formats and the like are skipped
            col = name.lower().replace("-", "_")
            if kind == "i":
                col = {"referer": "referer", "referrer": "referer", "user_agent": "user_agent"}.get(col, col)
                parts.append(r'([^"]*)')
            elif kind == "o":
                col = f"resp_{col}"
                parts.append(r'([^"]*)')
            else:
                col = f"env_{col}"
                parts.append(r"([^ ]+)")
            cols.append(col)
            types[col] = "str"
        elif tok.startswith("%") and len(tok) > 1:
            if tok in APACHE_DIRECTIVES:
                rx, col, typ = APACHE_DIRECTIVES[tok]
                parts.append(rx)
                cols.append(col)
                if typ != "str":
                    types[col] = typ
            # unknown directive: skipped
        elif tok == "%":
            continue
        else:
            parts.append(re.escape(tok) if tok not in ' "' else tok)
    # of directives with one column the last counts
    cols = [c if c not in cols[i + 1:] else f"{UNNAMED}{i + 1}" for i, c in enumerate(cols)]
    units = "us" if "response_time_us" in cols else ("s" if "response_time_s" in cols else "ms")
    lf = LogFormat("apache", "".join(parts), tuple(cols), types, "HTTPD", {}, units, "fromLog",
                   HTTPD_TIME_FORMAT)
    return lf.with_field_map()
