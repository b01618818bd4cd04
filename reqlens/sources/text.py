"""Text log sources (S1–S5, S12–S20, S25; L7, L8).

Reading is ``spark.read.text`` (gzip by extension, one task per split;
a single ``.gz`` is one split, so land it as Parquet once or repartition
after parsing).  Parsing is one native pass per line: the line is matched once
with ``rlike`` and rewritten once with ``regexp_replace`` into the requested
groups joined by a separator, then split — no Python, no per-group re-match.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.functions.exprs import trailing_micros_as_seconds
from reqlens.sources.formats import (ALB_FALLBACK_COLUMNS, PRESETS, UNNAMED, LogFormat, compile_apache_format, custom_format,
                                     preset)

SEP = "\u0001"
# The characters Python's str.strip() removes (str.isspace()).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
# the same set as a regex class both Java regex and RE2 accept
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
            r"\x{205F}\x{3000}]")
NULL_TOKENS = ("", "-", " ")
# HTTPD fallback mapping of the first 10 groups (no column list).
HTTPD_FALLBACK_COLUMNS = ("client_ip", "user", "time", "request_method", "request_url", "request_proto",
                          "status", "bytes_sent", "referer", "user_agent")
# Detection rules on the head sample.
ALB_PREFIXES = ("http ", "https ", "h2 ", "ws ", "wss ")
APACHE_HINT = r'\d+\.\d+\.\d+\.\d+.*\[.*\].*"[A-Z]+.*".*\d{3}'
# true of the same lines; the nearest continuation is tried first
_APACHE_HINT_FAST = r'\d\.\d+\.\d+\.\d.*?\[.*?\].*?"[A-Z].*?".*?\d{3}'
# Line patterns of the single-page edition.
LINE_ALB = (r'^([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*):([0-9]*) ([^ ]*)[:-]([0-9]*) ([-.0-9]*) ([-.0-9]*) ([-.0-9]*) '
            r'(|[-0-9]*) (-|[-0-9]*) ([-0-9]*) ([-0-9]*) "([^ ]*) (.*?) (- |[^ ]*)" "([^"]*)" (.*)')
LINE_CLF = r'^([^ ]*) ([^ ]*) ([^ ]*) \[([^\]]*)\] "([^"]*)" ([0-9]*) ([0-9\-]*) (.*)'
# JSON key candidates per role (first present key wins).
JSON_ROLE_KEYS = {
    "timestamp": ["timestamp", "time", "@timestamp", "datetime"],
    "method": ["method", "request_method", "verb"],
    "url": ["url", "uri", "path", "request_uri"],
    "status": ["status", "status_code", "response_status"],
    "responseTime": ["response_time", "duration", "elapsed"],
    "clientIp": ["client_ip", "remote_addr", "ip"],
}


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` as a native expression (a character-set trim:
    it only looks at the two ends of the line)."""
    return F.btrim(c, F.lit(WHITESPACE))


def null_token(c: Column) -> Column:
    """``''``, ``'-'`` and ``' '`` become NULL."""
    return F.when(c.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


# ---------------------------------------------------------------------------
# lines
# ---------------------------------------------------------------------------
def folder_of(file: Column) -> Column:
    """The folder of a path, without a regex a line."""
    return F.left(file, F.length(file) - F.locate("/", F.reverse(file)))


def read_lines(spark: SparkSession, paths: str | list[str], partitions: int | None = None, by_folder: bool = False) -> DataFrame:
    """``(file, value)`` for every non-blank line of one or more files or
    globs (gzip read by extension); lines are whitespace-stripped.

    A gzip file cannot be split, so one large ``.gz`` is read by one task;
    ``partitions`` spreads its lines (round-robin) before the parse.  With
    ``by_folder`` a log is a folder of files, and ``file`` names the folder."""
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths))
    path = F.col("_metadata.file_path")
    raw = raw.select("value", (folder_of(path) if by_folder else path).alias("__file"))
    if partitions:
        raw = raw.repartition(partitions)
    v = strip_ws(F.col("value"))
    return raw.select(F.col("__file").alias("file"), v.alias("value")).filter(F.col("value") != "")


def lines_frame(df: DataFrame, column: str = "value") -> DataFrame:
    """Lines already in a DataFrame (stripped, blanks dropped)."""
    return df.select(*[c for c in df.columns if c != column], strip_ws(F.col(column)).alias("value")) \
        .filter(F.col("value") != "")


# ---------------------------------------------------------------------------
# Regex parse
# ---------------------------------------------------------------------------
@dataclass
class ParseResult:
    records: DataFrame
    rejected: DataFrame
    format: LogFormat

    def failed_count(self) -> int:
        return self.rejected.count()

    def failed_sample(self, n: int = 10) -> DataFrame:
        return self.rejected.limit(n)


def _typed(c: Column, typ: str | None, fmt: LogFormat) -> Column:
    if typ in ("int", "integer", "int64"):
        return c.try_cast("bigint")
    if typ in ("float", "float64", "double"):
        return c.try_cast("double")
    if typ in ("datetime", "timestamp"):
        if fmt.time_format and fmt.time_format.endswith(("Z", "X")):
            # the text carries its offset: an instant
            t = F.try_to_timestamp(c, F.lit(fmt.time_format))
            return F.coalesce(t, F.try_to_timestamp(c, F.lit(fmt.time_format[:-1] + "XXX")))
        if fmt.time_format:
            # zone-less text is the log's wall clock: TIMESTAMP_NTZ (parsed and
            # cast back in the same session zone, so the digits are kept)
            return F.try_to_timestamp(c, F.lit(fmt.time_format)).cast("timestamp_ntz")
        return F.try_to_timestamp(c)
    return c


def _split_request(req: Column) -> tuple[Column, Column, Column]:
    """``METHOD URL PROTO`` with at most 3 parts; 2 → (m, u, null);
    1 → (null, u, null); missing → nulls."""
    parts = F.split(strip_ws(req), " ", 3)
    n = F.size(parts)
    method = F.when(req.isNotNull() & (n >= 2), parts[0])
    url = F.when(req.isNotNull() & (n >= 2), parts[1]).when(req.isNotNull() & (n == 1), parts[0])
    proto = F.when(req.isNotNull() & (n == 3), parts[2])
    return method, url, proto


def parse_lines(lines: DataFrame, fmt: LogFormat, columns: list[str] | None = None,
                keep: list[str] | None = None) -> ParseResult:
    """Parse ``value`` with ``fmt`` into typed columns.

    * start-anchored match (``re.match`` semantics), not end-anchored
    * group *i* → ``fmt.columns[i]``; groups beyond the pattern are null
    * ``''``/``'-'``/``' '`` → NULL; declared types via ``try_cast`` /
      ``try_to_timestamp`` (invalid → NULL)
    * validity: ALB needs time, URL or verb; HTTPD needs time or status
    * HTTPD ``request`` is split into method / URL / protocol
    * ``columns`` prunes the output (and the regex rewrite) to those columns;
      ``request`` is pulled in when a derived request column is asked for
    * lines that do not match or are not valid go to ``rejected``
    """
    if fmt.pattern_type == "JSON":
        return parse_json_lines(lines, fmt, columns=columns, keep=keep)
    keep = list(keep or [c for c in lines.columns if c != "value"])
    n = fmt.n_groups
    cols = list(fmt.columns)
    if not cols:
        return _parse_fallback(lines, fmt, keep)
    derived = fmt.pattern_type == "HTTPD" and "request" in cols
    want = list(columns) if columns else [c for c in cols if not c.startswith(UNNAMED)]
    if derived and any(c in want for c in ("request_method", "request_url", "request_proto")) \
            and "request" not in want:
        want_req = want + ["request"]
    else:
        want_req = want
    check = {"ALB": ["time", "request_url", "request_verb"],
             "HTTPD": ["time", "timestamp", "status", "status_code"]}.get(fmt.pattern_type, [])
    check = [c for c in check if c in cols]
    needed = [c for c in cols if c in want_req or c in check or (derived and c == "request")]
    idx = {c: i + 1 for i, c in enumerate(cols) if i < n}
    in_regex = [c for c in needed if c in idx]
    value = F.col("value")
    # One regex evaluation per line: a match is rewritten to SEP + the wanted
    # groups joined by SEP; a line that does not match comes back unchanged.
    # A line that holds SEP itself has its groups extracted one by one.  The
    # rewrite is materialised once in ``stage``; records and rejects are then selected
    # with a generator rather than a Filter, so the optimizer cannot copy the
    # regex into a pushed-down predicate.
    stage = _one_pass(lines, fmt.pattern, [idx[c] for c in in_regex], keep)
    parts = F.col("__p")

    def of_group(groups: Column, c: str) -> Column:
        return null_token(F.element_at(groups, in_regex.index(c) + 1)) if c in idx else F.lit(None).cast("string")
    if fmt.pattern_type in ("ALB", "HTTPD") and check:
        valid = F.coalesce(*[of_group(parts, c) for c in check]).isNotNull()
    else:
        valid = F.lit(True)
    ok = F.col("__hit") & valid
    out_cols = [c for c in cols if c in want]
    # the groups pass the generator as one array, and columns are made of them after it: Catalyst drops those that
    # nobody reads, and no generated method grows with the number of groups beyond what the JIT compiles
    picked = stage.select(*keep, F.explode(F.when(ok, F.array(parts))).alias("__groups"))
    named = picked.select(*keep, *[of_group(F.col("__groups"), c).alias(c) for c in needed])
    projected = [_typed(F.col(c), fmt.types.get(c), fmt).alias(c) for c in out_cols]
    if derived and "request" in needed:
        # the derived request columns always come along (as in the reference)
        m, u, p = _split_request(F.col("request"))
        projected += [m.alias("request_method"), u.alias("request_url"), p.alias("request_proto")]
    records = named.select(*keep, *projected)
    rejected = stage.select(*keep, F.explode(F.when(~ok, F.array(F.col("value")))).alias("value"))
    return ParseResult(records, rejected, fmt)


def _one_pass(lines: DataFrame, pattern: str, groups: list[int], keep: list[str]) -> DataFrame:
    """``keep, value, __hit, __p``: one regex rewrite per line into ``groups``
    (extraction group by group for a line that holds the separator)."""
    value, whole = F.col("value"), f"(?s)^(?:{pattern}).*$"
    odd = value.contains(SEP)
    out = F.when(~odd, F.regexp_replace(value, whole, SEP + SEP.join(f"${i}" for i in groups)))
    each = F.array(*[F.regexp_extract(value, whole, i) for i in groups]).cast("array<string>")
    rewritten = F.col("__o")
    return (lines.select(*keep, "value", out.alias("__o"))
            .select(*keep, "value",
                    F.when(rewritten.isNotNull(), rewritten.startswith(SEP)).otherwise(value.rlike(whole)).alias("__hit"),
                    F.when(rewritten.isNotNull(), F.split(F.substr(rewritten, F.lit(2)), SEP, -1)).otherwise(each).alias("__p")))


def _parse_fallback(lines: DataFrame, fmt: LogFormat, keep: list[str]) -> ParseResult:
    """No column list — ALB: first 17 named + ``_extra_groups``; HTTPD with
    ≥ 10 groups: fixed names; otherwise the raw group array."""
    n = fmt.n_groups
    stage = _one_pass(lines, fmt.pattern, list(range(1, n + 1)), keep)
    g = F.col("__p") if n else F.array().cast("array<string>")
    if fmt.pattern_type == "ALB" and n:
        k = min(n, 17)
        fields = [null_token(F.element_at(g, i + 1)).alias(ALB_FALLBACK_COLUMNS[i]) for i in range(k)]
        if n > k:
            fields.append(F.slice(g, k + 1, n - k).alias("_extra_groups"))
    elif fmt.pattern_type == "HTTPD" and n >= 10:
        fields = [null_token(F.element_at(g, i + 1)).alias(c) for i, c in enumerate(HTTPD_FALLBACK_COLUMNS)]
    else:
        fields = [g.alias("raw_groups")]
    records = stage.select(*keep, F.inline(F.when(F.col("__hit"), F.array(F.struct(*fields)))))
    rejected = stage.select(*keep, F.explode(F.when(~F.col("__hit"), F.array(F.col("value")))).alias("value"))
    return ParseResult(records, rejected, fmt)


# ---------------------------------------------------------------------------
# JSON lines
# ---------------------------------------------------------------------------
# how a JSON text starts; a parse that fails costs an exception, some 10 times a match
JSON_START = r'^(?:[{\["]|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?(?:[ \t\r\n]|$)|true|false|null)'


def json_text(value: Column) -> Column:
    """Whether a stripped line is JSON; only lines that start like it are parsed."""
    return F.coalesce(value.rlike(JSON_START), F.lit(False)) & F.try_parse_json(value).isNotNull()


def _json_object(value: Column) -> Column:
    return value.startswith("{") & F.try_parse_json(value).isNotNull()


MAX_JSON_KEYS = 10000


def _last_key_wins(df: DataFrame) -> DataFrame:
    """Objects that repeat a key are parsed, and its last value counts."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return df


def _key_path(k: str) -> str:
    return "$['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _objects(lines: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, value, __v``: each line parsed once; null where it is no object."""
    v = F.when(F.col("value").startswith("{"), F.try_parse_json("value"))
    return _last_key_wins(lines).select(*keep, "value", v.alias("__v"))


def open_records(lines: DataFrame, keep: list[str] | None = None, column: str = "record") -> ParseResult:
    """S5 without a schema: every JSON object as one VARIANT, whatever keys
    there are; one parse per line.  Land it once (``writers.save_snapshot``
    keeps VARIANT columns), then ``open_keys`` and ``shred`` read no text."""
    keep = [c for c in lines.columns if c != "value"] if keep is None else list(keep)
    stage = _objects(lines, keep)
    # outer generators and a filter on what they make: any other filter would be pushed down and parse the line again
    v = F.col("__v")
    records = stage.select(*keep, F.explode_outer(F.when(v.isNotNull(), F.array(v))).alias(column)).where(F.col(column).isNotNull())
    rejected = stage.select(*keep, F.explode_outer(F.when(v.isNull(), F.array("value"))).alias("value")).where("value IS NOT NULL")
    return ParseResult(records, rejected, PRESETS["json"])


def open_keys(records: DataFrame, column: str = "record") -> DataFrame:
    """``(key, type, n)`` of every top-level key: the merged type and the
    number of objects that have it.  A grouped table, so keys may be many."""
    each = records.select(column).lateralJoin(records.sparkSession.tvf.variant_explode(F.col(column).outer()))
    return each.groupBy("key").agg(F.schema_of_variant_agg("value").alias("__t"), F.count(F.lit(1)).alias("n")).select(
        "key", variant_type(F.col("__t")).alias("type"), "n")


def shred(records: DataFrame, fields: dict[str, str], column: str = "record") -> DataFrame:
    """Add chosen keys (name -> type) as columns."""
    return records.select("*", *(F.try_variant_get(column, _key_path(k), t).alias(k) for k, t in fields.items()))


def variant_type(t: Column) -> Column:
    """The column type that holds all values of a merged VARIANT type."""
    return (F.when(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), F.lit("bigint")).when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit("double"))
            .when(t.startswith("BOOLEAN"), F.lit("boolean")).otherwise(F.lit("string")))


def infer_json_fields(lines: DataFrame, max_keys: int = MAX_JSON_KEYS) -> list[tuple[str, str]] | None:
    """Top-level keys of every JSON object in the input with one merged type
    each, in order of first appearance, from one pass; None for more than
    ``max_keys``: too many for columns (``open_records`` takes them)."""
    objs = _objects(lines, []).where("__v IS NOT NULL").select(
        F.monotonically_increasing_id().alias("__line"), F.json_object_keys("value").alias("__keys"), "__v")
    each = objs.lateralJoin(lines.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    keys = (each.groupBy("key").agg(F.min(F.struct("__line", F.array_position("__keys", F.col("key")))).alias("__first"),
                                    F.schema_of_variant_agg("value").alias("__t"))
            .orderBy("__first").limit(max_keys + 1).select("key", variant_type(F.col("__t")).alias("type")).collect())
    return None if len(keys) > max_keys else [(r["key"], r["type"]) for r in keys]


def json_field_map(lines: DataFrame) -> dict[str, str | None]:
    """Role → key of the first valid JSON object (one line to the driver)."""
    first = _last_key_wins(lines).filter(_json_object(F.col("value"))).select("value").limit(1).collect()
    if not first:
        return {}
    obj = json.loads(first[0]["value"])
    return {role: next((k for k in keys if k in obj), None) for role, keys in JSON_ROLE_KEYS.items()}


def parse_json_lines(lines: DataFrame, fmt: LogFormat | None = None, schema: str | None = None,
                     columns: list[str] | None = None, keep: list[str] | None = None) -> ParseResult:
    """JSON objects → typed columns.  With ``schema`` (DDL) the lines go
    through ``from_json``; otherwise the keys and types of the whole input are
    inferred (``infer_json_fields``) and read from the parsed VARIANT.  An input of more
    keys than columns can be keeps its objects whole in a VARIANT column ``record``.  The
    field-mapped timestamp becomes a TIMESTAMP; a line that is not a JSON
    object is rejected.  ``columns`` prunes the result (and what is read from
    the objects) to those fields."""
    fmt = fmt or PRESETS["json"]
    keep = [c for c in lines.columns if c != "value"] if keep is None else list(keep)
    opened = open_records(lines, keep, "__v")
    rejected = opened.rejected
    if schema:
        good = _last_key_wins(lines).select(*keep, "value", _json_object(F.col("value")).alias("__m")).filter("__m")
        parsed = good.select(*keep, F.from_json("value", schema).alias("__r")).select(*keep, "__r.*")
    else:
        fields = infer_json_fields(lines)
        if fields is None:
            mapped = {k: "string" for k in dict.fromkeys([*(columns or ()), *fmt.field_map.values()])}
            parsed = shred(opened.records, mapped, "__v").withColumnRenamed("__v", "record")
            columns = [*columns, "record"] if columns else None
        else:
            parsed = shred(opened.records, {k: t for k, t in fields if not columns or k in columns}, "__v").drop("__v")
    ts = fmt.field_map.get("timestamp")
    if ts and ts in parsed.columns:
        parsed = parsed.withColumn(ts, F.try_to_timestamp(F.col(ts).cast("string")))
    if columns:
        parsed = parsed.select(*keep, *[c for c in columns if c in parsed.columns])
    return ParseResult(parsed, rejected, fmt)


def _falsy_or(v: Column, path: str) -> Column:
    """A JSON value as text, or null where JavaScript would call it falsy
    (missing, null, ``""``, numeric 0, ``false``)."""
    s = F.try_variant_get(v, path, "string")
    typ = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    num = typ.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    zero = num & (F.try_variant_get(v, path, "double") == 0)
    falsy = s.isNull() | (s == "") | F.coalesce(zero, F.lit(False)) | ((typ == "BOOLEAN") & (s == "false"))
    return F.when(~falsy, s)


def json_defaults(lines: DataFrame) -> DataFrame:
    """JSON records with alternative keys and defaults — time from
    time/timestamp/datetime, URL from url/request_uri/path, method GET,
    status 200, bytes 0, client ``unknown``, response time from
    request_time/duration or 0."""
    v = F.try_parse_json(F.col("value"))
    g = lambda k: _falsy_or(v, f"$.{k}")
    return (lines.filter(F.col("value").startswith("{") & v.isNotNull())
            .select(F.coalesce(g("time"), g("timestamp"), g("datetime")).alias("time"),
                    F.coalesce(g("url"), g("request_uri"), g("path")).alias("url"),
                    F.coalesce(g("method"), F.lit("GET")).alias("method"),
                    F.coalesce(g("status"), F.lit("200")).alias("status"),
                    F.coalesce(g("bytes_sent"), F.lit("0")).try_cast("double").alias("bytes"),
                    F.coalesce(g("client_ip"), F.lit("unknown")).alias("client_ip"),
                    F.coalesce(g("request_time"), g("duration"), F.lit("0")).try_cast("double")
                    .alias("response_time")))


# ---------------------------------------------------------------------------
# Detection and success rates
# ---------------------------------------------------------------------------
def line_scores(v: Column) -> tuple[Column, Column, Column]:
    """Whether a line looks like ALB, JSON, APACHE."""
    n_tok = F.size(F.split(strip_ws(v), r"\s+"))
    alb = F.lit(False)
    for p in ALB_PREFIXES:
        alb = alb | v.startswith(p)
    alb = alb & (n_tok > 10) & v.contains("app/")
    js = (v.startswith("{") | v.startswith("[")) & F.try_parse_json(v).isNotNull()
    return alb, js, v.contains('"') & v.contains("[") & v.rlike(_APACHE_HINT_FAST)


def detect_format(lines: DataFrame, sample: int | None = None) -> DataFrame:
    """Score all lines in one distributed pass (or the first ``sample``) as ALB / JSON / APACHE; the best score wins (ties in
    that order); none → GROK with confidence 0.1.  ``mixed.file_formats`` decides file by file."""
    alb, js, ap = line_scores(F.col("value"))
    head = lines.select("value") if sample is None else lines.select("value").limit(sample)
    s = head.agg(F.count_if(alb).alias("alb"), F.count_if(js).alias("json"), F.count_if(ap).alias("apache"),
                 F.count(F.lit(1)).alias("n"))
    best = F.greatest("alb", "json", "apache")
    kind = (F.when(best == 0, F.lit("GROK")).when(F.col("alb") == best, F.lit("ALB"))
            .when(F.col("json") == best, F.lit("JSON")).otherwise(F.lit("APACHE")))
    conf = F.when(best == 0, F.lit(0.1)).otherwise(best / F.col("n"))
    return s.select(kind.alias("log_type"), conf.alias("confidence"), "alb", "json", "apache", "n")


def format_success_rates(lines: DataFrame, formats: dict[str, LogFormat] | None = None,
                         sample: int | None = None) -> DataFrame:
    """Share of lines each candidate format matches (JSON: valid JSON), of
    the whole input in one distributed pass, or of the first ``sample``."""
    formats = formats or PRESETS
    src = lines.select("value") if sample is None else lines.select("value").limit(sample)
    v = F.col("value")
    aggs = []
    for name, f in formats.items():
        hit = json_text(strip_ws(v)) if f.pattern_type == "JSON" else v.rlike(f"^(?:{f.pattern})")
        aggs.append(F.avg(hit.cast("double")).alias(name))
    wide = src.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}`" for n in formats)
    return wide.selectExpr(f"stack({len(formats)}, {stack}) AS (format, success_rate)")


def line_type(v: Column) -> Column:
    """JSON / ALB / CLF / UNKNOWN for one line."""
    return (F.when(strip_ws(v).startswith("{"), F.lit("JSON")).when(v.rlike(LINE_ALB), F.lit("ALB"))
            .when(v.rlike(LINE_CLF), F.lit("CLF")).otherwise(F.lit("UNKNOWN")))


def detect_line_type(lines: DataFrame) -> DataFrame:
    """The type of the first line decides the whole file."""
    return lines.select("value").limit(1).select(line_type(F.col("value")).alias("log_type"))


def clf_response_seconds(v: Column) -> Column:
    """The trailing integer of a common-log line's tail read as µs → s, else 0."""
    tail = F.regexp_extract(v, LINE_CLF, 8)
    return F.when(v.rlike(LINE_CLF), trailing_micros_as_seconds(tail))


def parse_preview(lines: DataFrame, fmt: LogFormat) -> DataFrame:
    """``(value, matched, groups)`` — what the pattern captures per line."""
    stage = _one_pass(lines, fmt.pattern, list(range(1, fmt.n_groups + 1)), [])
    return stage.select("value", F.col("__hit").alias("matched"),
                        F.when(F.col("__hit"), F.col("__p")).alias("groups"))


# ---------------------------------------------------------------------------
# One entry point: explicit regex > LogFormat string > preset > detection
# ---------------------------------------------------------------------------
def resolve_format(lines: DataFrame | None = None, log_regex: str | None = None,
                   apache_format: str | None = None, fmt: str | LogFormat | None = None,
                   columns: list[str] | None = None) -> LogFormat:
    if log_regex:
        return custom_format(log_regex, columns or ())
    if apache_format:
        return compile_apache_format(apache_format)
    if isinstance(fmt, LogFormat):
        return fmt
    if fmt:
        return preset(fmt)
    if lines is None:
        raise ValueError("nothing to detect the format from")
    kind = detect_format(lines).first()["log_type"]
    if kind == "ALB":
        return PRESETS["alb"]
    if kind == "JSON":
        return PRESETS["json"]
    if kind == "APACHE":
        # score every HTTPD-style preset on the sample and take the best
        cand = {k: PRESETS[k] for k in ("httpd_with_time", "nginx", "httpd_custom", "httpd")}
        rates = {r["format"]: r["success_rate"] or 0.0 for r in format_success_rates(lines, cand).collect()}
        return cand[max(cand, key=lambda k: rates.get(k, 0.0))]
    return custom_format(".*")


def recommend_format(lines: DataFrame, sample: int | None = None) -> dict:
    """S19 + S20: the chosen format with ``confidence`` (detection score),
    ``success_rate`` (share of sampled lines it parses) and their product."""
    det = detect_format(lines).first()
    fmt = resolve_format(lines)
    rate = format_success_rates(lines, {fmt.name: fmt}, sample).first()["success_rate"] or 0.0
    return {"format": fmt.name, "pattern_type": fmt.pattern_type, "log_type": det["log_type"],
            "confidence": det["confidence"], "success_rate": rate, "score": det["confidence"] * rate,
            "columns": list(fmt.columns), "field_map": dict(fmt.field_map), "response_time_unit": fmt.rt_unit}


def read_requests(spark: SparkSession, paths: str | list[str], **kw) -> ParseResult:
    """Read and parse log files in one lazy plan (``fmt=``, ``apache_format=``,
    ``log_regex=``, ``columns=``, ``partitions=``); without a format the head
    of the input is scored (S19) and, for Apache-style logs, every HTTPD
    preset is tried on a sample (S20) and the best one used."""
    lines = read_lines(spark, paths, kw.pop("partitions", None))
    columns = kw.pop("columns", None)
    f = resolve_format(lines, **kw)
    return parse_lines(lines, f, columns)

