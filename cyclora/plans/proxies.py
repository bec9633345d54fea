"""Feature tables made of the test tables, and the same in SQL.

A user's events in time are the features of a container in order; an event's type is its token, its value decides its
strand, and its duration makes it an interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclora.session import Tables


def features(t: Tables) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select(
        F.col("user_id").alias("container"),
        F.col("ts").alias("pos"),
        F.col("event_id").alias("sub"),
        F.col("event_type").alias("token"),
        F.concat("event_type", F.lit("_"), (k % 7).cast("string")).alias("token2"),
        F.when(F.col("value") >= 30, 1).otherwise(-1).alias("strand"),
        "value",
        seconds.alias("start"),
        (seconds + F.floor(F.col("value") * 60)).alias("stop"),
    )


FEATURES = """f AS (SELECT user_id AS container, ts AS pos, event_id AS sub, event_type AS token,
    event_type || '_' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS VARCHAR) AS token2,
    CASE WHEN value >= 30 THEN 1 ELSE -1 END AS strand, value, CAST(floor(epoch(ts)) AS BIGINT) AS start,
    CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) AS stop FROM events)"""
ORDER = ["pos", "sub"]
#: Neighbours on the circle.
NEAR = f"""{FEATURES}, nb AS (SELECT *, count(*) OVER p AS n, row_number() OVER w AS rn,
    coalesce(lead(token2) OVER w, first_value(token2) OVER w) AS right2,
    coalesce(lag(token2) OVER w, last_value(token2) OVER (PARTITION BY container ORDER BY pos, sub ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS left2,
    coalesce(lead(token) OVER w, first_value(token) OVER w) AS right1, coalesce(lead(strand) OVER w, first_value(strand) OVER w) AS rstrand
    FROM f WINDOW p AS (PARTITION BY container), w AS (PARTITION BY container ORDER BY pos, sub))"""
#: Contexts of token2, and entropies by it.
CTX = f"{NEAR}, c AS (SELECT * FROM nb WHERE n > 1)"
ENT = f"""{CTX}, cc AS (SELECT token2, left2, right2, count(*) AS k FROM c GROUP BY ALL),
    h AS (SELECT token2, CAST(sum(k) AS BIGINT) AS n_obs, count(*) AS n_contexts, greatest(0, log2(sum(k)) - sum(k * log2(k)) / sum(k)) AS h FROM cc GROUP BY token2),
    e AS (SELECT token2, n_obs, n_contexts, CASE WHEN n_obs <= 1 THEN NULL WHEN n_contexts <= 1 THEN 0 ELSE round(h, 6) END AS entropy, h FROM h)"""


def container_edges(t: Tables) -> DataFrame:
    """(container, src, dst) of tokens that follow one another on the circle, of all features: tokens are a type and a number."""
    from cyclora.operators.circular import circular_neighbours

    k = F.get_json_object("props", "$.k")
    f = t.events.select(F.col("user_id").alias("container"), F.col("ts").alias("pos"), F.col("event_id").alias("sub"), F.concat("event_type", k).alias("token3"))
    near = circular_neighbours(f, "container", ORDER, ["token3"])
    return near.select("container", F.col("token3").alias("src"), F.col("right_token3").alias("dst"))


def token_edges(t: Tables) -> DataFrame:
    """The edges of all containers, once each."""
    return container_edges(t).select("src", "dst").distinct()


GRAPH = """edge AS (SELECT DISTINCT token3 AS src, coalesce(lead(token3) OVER w, first_value(token3) OVER w) AS dst
    FROM (SELECT user_id, ts, event_id, event_type || json_extract_string(props, '$.k') AS token3 FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
