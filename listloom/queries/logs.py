"""Fetch logs and attempts made of the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listloom.operators import attempts as A
from listloom.operators import fetchlog as L
from listloom.queries.registry import query, table

REGIONS = ["us-east-1", "eu-west-3", "ap-northeast-2"]

#: Requests: every event is one; errors are failures, signups have no status.
REQUESTS = """
    SELECT event_id, ts, CASE WHEN user_id % 4 = 3 THEN '' ELSE 'a1b2.execute-api.' || ['us-east-1', 'eu-west-3', 'ap-northeast-2'][user_id % 4 + 1] || '.test' END AS host,
        CASE WHEN user_id % 4 = 3 THEN '' ELSE ['us-east-1', 'eu-west-3', 'ap-northeast-2'][user_id % 4 + 1] END AS region,
        CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 404 ELSE 200 END AS status,
        CASE event_type WHEN 'error' THEN 'Service Unavailable' WHEN 'click' THEN 'Not Found' ELSE 'OK' END AS reason,
        CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || user_id END AS ip, 'https://shop.test/' || event_id AS message
    FROM events
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = "get(array('us-east-1', 'eu-west-3', 'ap-northeast-2'), cast(user_id % 4 AS int))"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts",
        f"if(user_id % 4 = 3, NULL, concat('a1b2.execute-api.', {region}, '.test')) AS host",
        "CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 404 ELSE 200 END AS status",
        "CASE event_type WHEN 'error' THEN 'Service Unavailable' WHEN 'click' THEN 'Not Found' ELSE 'OK' END AS reason",
        "if(event_id % 2 = 0, concat('10.0.0.', user_id), NULL) AS ip",
        "concat('https://shop.test/', event_id) AS message",
    )


@query(
    f"""
    SELECT event_id, region, rpad(region, CAST(greatest(12, length(region)) AS INTEGER), ' ') || ' ' || rpad(CAST(status AS VARCHAR), 4, ' ')
        || rpad(reason, CAST(greatest(14, length(reason)) AS INTEGER), ' ') || ' ' || rpad(coalesce(ip, ''), 15, ' ')
        || chr(10) || chr(9) || message AS line
    FROM ({REQUESTS}) t
    """
)
def fetch_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_request_line(requests(spark, sf_dir)).select("event_id", "region", "line")


@query(f"SELECT region, status, reason, count(*) AS n FROM ({REQUESTS}) t GROUP BY 1, 2, 3")
def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fetch_status_summary(L.with_request_line(requests(spark, sf_dir)))


@query(f"SELECT region, status, reason, count(*) AS n FROM ({REQUESTS}) t GROUP BY ROLLUP (region, status, reason)")
def fetch_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fetch_status_summary(L.with_request_line(requests(spark, sf_dir)), with_totals=True)


RECORDS = """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad(CAST(CAST(date_part('millisecond', ts) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS t,
        ['DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL'][event_id % 5 + 1] AS level, event_id % 5 AS rank,
        ['request.fail', 'request.fail.Vans', 'request.failed', 'Adidas.Extractors'][user_id % 4 + 1] AS logger,
        user_id % 4 < 2 AS family, event_type AS message
    FROM events
"""


@query(
    f"""
    WITH r AS (SELECT * FROM ({RECORDS}) x WHERE rank >= 1), routed AS (
        SELECT *, 'console' AS sink FROM r WHERE rank < 2
        UNION ALL SELECT *, 'console_error' FROM r WHERE rank >= 2
        UNION ALL SELECT *, 'request_fail' FROM r WHERE family
        UNION ALL SELECT *, 'error' FROM r WHERE rank >= 3 AND NOT family
    )
    SELECT event_id, sink, CASE sink
        WHEN 'request_fail' THEN t || ' - ' || rpad(level, CAST(greatest(6, length(level)) AS INTEGER), ' ') || ' - ' || rpad(message, 40, ' ')
        WHEN 'error' THEN t || ' [' || logger || '] ' || rpad(level, 8, ' ') || ' - ' || message
        ELSE rpad(logger, CAST(greatest(15, length(logger)) AS INTEGER), ' ') || ' ' || rpad(level, 8, ' ') || ' ' || message END AS line
    FROM routed
    """
)
def log_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "event_type AS message",
        "get(array('DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL'), cast(event_id % 5 AS int)) AS level",
        "get(array('request.fail', 'request.fail.Vans', 'request.failed', 'Adidas.Extractors'), cast(user_id % 4 AS int)) AS logger",
    )
    return L.log_routes(records).select("event_id", "sink", "line")


@query(
    """
    WITH a AS (
        SELECT user_id, event_type NOT IN ('error', 'click', 'view') AS ok,
            row_number() OVER (PARTITION BY user_id ORDER BY ts) AS attempt FROM events
    ), o AS (
        SELECT user_id, min(attempt) FILTER (WHERE ok) AS attempt, count(*) AS made FROM a WHERE attempt <= 4 GROUP BY 1)
    SELECT user_id, coalesce(attempt, made) AS tries, attempt IS NOT NULL AS success, CAST(attempt AS INTEGER) AS attempt,
        coalesce(attempt = 4, false) AS direct FROM o
    """
)
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return A.first_success(tried, "user_id", ["ts"], "event_type NOT IN ('error', 'click', 'view')")
