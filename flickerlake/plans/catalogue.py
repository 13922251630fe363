"""Registry of the engine's queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The views of sources.tables for the other engine.
VIEWS = """
px AS (
    SELECT user_id % 15 AS x, user_id // 15 AS y,
           (CASE WHEN event_type = 'error' THEN 255 WHEN value < 1 THEN 128 ELSE floor(log2(value)) END)::BIGINT AS d,
           ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000)::BIGINT AS t,
           (CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END)::BIGINT AS p,
           least(255, trunc(value))::BIGINT AS v8, value, event_id AS seq
    FROM events
),
plane AS (SELECT 15::BIGINT AS w, max(y) + 1 AS h FROM px),
img AS (SELECT t // 86400 AS frame, x, y, last(v8 ORDER BY t, seq) AS v FROM px GROUP BY ALL),
run AS (
    SELECT o_custkey % 50 AS video, ((o_orderkey // 4) % 4) * 3 AS crf, o_orderkey % 2 AS feat, o_orderkey AS interval_no,
           o_totalprice / 1000.0 AS bitrate, least(60.0, o_totalprice % 70.0) AS quality,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 11) / 10.0 END AS precision_
    FROM orders
),
delta AS (SELECT *, t - coalesce(lag(t) OVER (PARTITION BY x, y ORDER BY t, seq), 0) AS dt FROM px)
"""


def query(name: str, sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query and the SQL body (or further WITH items, from a comma on) that gives its rows."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS.strip()}{sql}"
        return function

    return add


from . import codec, features, folds, frames, metrics, scalars, streams, windows  # noqa: E402, F401
