"""Fetch-log lines, routing to sinks, status summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Line formats, level numbers and the logger family of requests.
REQUEST_LINE = "%-12s %-4s%-14s %-15s\n\t%s"
SIMPLE_LINE = "%-15s %-8s %s"
REQUEST_FILE_LINE = "%s - %-6s - %-40s"
DETAILED_LINE = "%s [%s] %-8s - %s"
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
REQUEST_FAMILY = "request.fail"


def region_of(host: str) -> str:
    """Third label of a host, or ''."""
    return f"coalesce(get(split({host}, '\\\\.', -1), 2), '')"


def with_request_line(requests: DataFrame) -> DataFrame:
    """Add ``region`` and ``line`` to ``(host, status, reason, ip, message)``."""
    located = requests.withColumn("region", F.expr(region_of("host")))
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("region", "status", "reason", "ip", "message")]
    return located.withColumn("line", F.format_string(REQUEST_LINE, *text))


def log_routes(records: DataFrame, root_level: str = "INFO") -> DataFrame:
    """One row per (record, sink) with the formatted line.

    ``records(ts, logger, level, message, …)``.  A record can reach several sinks:
    the console below WARNING, the error console from WARNING on, the request file
    for the request family from INFO on, the error file for all others from ERROR
    on.  Nothing below the root level is routed.
    """
    cases = " ".join(f"WHEN '{name}' THEN {number}" for name, number in LEVELS.items())
    number = f"CASE level {cases} END"
    family = f"(logger = '{REQUEST_FAMILY}' OR startswith(logger, '{REQUEST_FAMILY}.'))"
    routed = records.selectExpr(
        "*",
        f"""explode(array_compact(array(
            if({number} < {LEVELS['WARNING']}, 'console', NULL),
            if({number} >= {LEVELS['WARNING']}, 'console_error', NULL),
            if({number} >= {LEVELS['INFO']} AND {family}, 'request_fail', NULL),
            if({number} >= {LEVELS['ERROR']} AND NOT {family}, 'error', NULL)))) AS sink""",
    ).where(f"{number} >= {LEVELS[root_level]}")
    time = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.date_format("ts", "SSS"))
    simple = F.format_string(SIMPLE_LINE, "logger", "level", "message")
    return routed.withColumn(
        "line",
        F.when(F.col("sink") == "request_fail", F.format_string(REQUEST_FILE_LINE, time, "level", "message"))
        .when(F.col("sink") == "error", F.format_string(DETAILED_LINE, time, "logger", "level", "message"))
        .otherwise(simple),
    )


def fetch_status_summary(requests: DataFrame, with_totals: bool = False) -> DataFrame:
    """Counts by region, status and reason; optionally with subtotals."""
    columns = ["region", "status", "reason"]
    grouped = requests.rollup(*columns) if with_totals else requests.groupBy(*columns)
    return grouped.agg(F.count("*").alias("n"))
