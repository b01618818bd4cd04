"""Sinks (K1–K8): every writer is a distributed ``DataFrameWriter`` call — one
file per task, never a single document assembled on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.operators.rules import RULE_SCHEMA

ISO_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
ISO_TS_NTZ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K1/K3/K7: rows as JSON lines with ISO-8601 timestamps (not epoch numbers)."""
    (df.write.mode(mode).option("timestampFormat", ISO_TS).option("timestampNTZFormat", ISO_TS_NTZ)
     .option("ignoreNullFields", "false").json(path))
    return path


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("timestampFormat", ISO_TS)
            .option("timestampNTZFormat", ISO_TS_NTZ).json(path))


def write_sections(sections: dict[str, DataFrame], path: str) -> dict[str, str]:
    """K2: each statistics section (A12) as its own JSON-lines folder."""
    return {name: write_json_lines(df, f"{path}/{name}") for name, df in sections.items()}


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "utf-8", header: bool = True,
              mode: str = "overwrite") -> str:
    """K4: delimited text with a chosen separator and encoding."""
    (df.write.mode(mode).option("sep", sep).option("encoding", encoding).option("header", header)
     .option("timestampFormat", ISO_TS).option("timestampNTZFormat", ISO_TS_NTZ).csv(path))
    return path


def read_csv(spark: SparkSession, path: str, schema, sep: str = ",", encoding: str = "utf-8",
             header: bool = True) -> DataFrame:
    return (spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("header", header)
            .option("timestampFormat", ISO_TS).option("timestampNTZFormat", ISO_TS_NTZ).csv(path))


def save_table(df: DataFrame, name: str, path: str | None = None, mode: str = "overwrite") -> str:
    """K5: a named table, replaced on write (external at ``path`` when given)."""
    w = df.write.mode(mode).format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)
    return name


def load_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def save_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """K6: Parquet snapshot (optionally partitioned, e.g. by date for pruning)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---------------------------------------------------------------------------
# K8: rule files
# ---------------------------------------------------------------------------
def save_rules(rules: DataFrame, path: str) -> str:
    """Rule table ``(ord, pattern, replacement)`` as JSON lines."""
    return write_json_lines(rules.select("ord", "pattern", "replacement"), path)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, RULE_SCHEMA)


def read_rule_document(spark: SparkSession, path: str) -> DataFrame:
    """A rule document ``{"patternRules": [{pattern, replacement}...]}`` — or the
    older ``{"patterns": [...]}`` / ``{"urls": [...]}`` lists, which become
    literal wildcard rules — as a rule table.  The document is small (a rule
    list), read as one text value."""
    doc = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "struct<patternRules:array<struct<pattern:string,replacement:string>>,"
                                  "patterns:array<string>,urls:array<string>>")
    d = doc.select(parsed.alias("d"))

    def literal_rule(p):
        # '*' → '.*', everything else literal, full match (as wildcard_to_regex)
        esc = F.regexp_replace(p, r"([()\[\]{}?+|^$\\.&~# \t\n\r\x0B\f-])", r"\\$1")
        return F.struct(F.concat(F.lit("^"), F.regexp_replace(esc, r"\*", ".*"), F.lit("$")).alias("pattern"),
                        p.alias("replacement"))

    explicit = F.col("d.patternRules")
    listed = F.transform(F.coalesce(F.col("d.patterns"), F.col("d.urls")), literal_rule)
    chosen = F.when(F.size(F.coalesce(explicit, F.array())) > 0, explicit).otherwise(listed)
    return (d.select(F.posexplode(chosen).alias("ord", "r"))
            .select(F.col("ord").cast("int").alias("ord"), F.col("r.pattern").alias("pattern"),
                    F.col("r.replacement").alias("replacement"))
            .filter(F.col("pattern").isNotNull()))
