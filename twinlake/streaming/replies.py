"""Request/reply correlation with a timeout (T5) and the reply sink.

Batch and streaming share one plan: a left outer join of requests to replies on
the correlation id, bounded by an event-time interval.  In a stream both sides
carry watermarks, so the join state is dropped once the interval has passed
and an unmatched request is emitted as a timeout (503) at that point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.envelope import TIMEOUT_MESSAGE, TIMEOUT_STATUS


def correlate(requests: DataFrame, replies: DataFrame, timeout_s: int, key: str = "event_id",
              req_ts: str = "ts", rep_ts: str = "rts") -> DataFrame:
    """Per request: 200 with the latency when a reply arrived within the timeout
    (inclusive), else 503 ``Service temporarily unavailable``."""
    rep = replies.withColumnRenamed(key, "_rk")
    cond = ((F.col(key) == F.col("_rk")) & (F.col(rep_ts) >= F.col(req_ts))
            & (F.col(rep_ts) <= F.col(req_ts) + F.expr(f"INTERVAL {int(timeout_s)} SECONDS")))
    j = requests.join(rep, cond, "left")
    hit = F.col("_rk").isNotNull()
    return j.select(key, F.when(hit, 200).otherwise(TIMEOUT_STATUS).alias("code"),
                    F.when(~hit, F.lit(TIMEOUT_MESSAGE)).alias("message"),
                    F.when(hit, F.timestamp_diff("MILLISECOND", F.col(req_ts), F.col(rep_ts))).alias("latency_ms"))


def correlate_stream(requests: DataFrame, replies: DataFrame, timeout_s: int, key: str = "event_id",
                     req_ts: str = "ts", rep_ts: str = "rts", lateness: str = "10 seconds") -> DataFrame:
    """T5 on streams: watermarks on both sides bound the join state; a request
    with no reply inside the interval is emitted as 503 once the watermark passes
    ``ts + timeout``."""
    rq = requests.withColumn(req_ts, F.col(req_ts).cast("timestamp")).withWatermark(req_ts, lateness)
    rp = replies.withColumn(rep_ts, F.col(rep_ts).cast("timestamp")).withWatermark(rep_ts, lateness)
    return correlate(rq, rp, timeout_s, key, req_ts, rep_ts)


def account(requests: DataFrame, replies: DataFrame, timeout_s: int, key: str = "event_id",
            req_ts: str = "ts", rep_ts: str = "rts") -> DataFrame:
    """T5 with every input row accounted for: ``correlate``'s rows, and each reply that answered no request in time as
    a row with ``late`` (a reply after its 503, or to an unknown request).

    ``key, code, message, latency_ms, late``.  One full outer interval join; requests are answered once.
    """
    rep = replies.withColumnRenamed(key, "_rk")
    cond = ((F.col(key) == F.col("_rk")) & (F.col(rep_ts) >= F.col(req_ts))
            & (F.col(rep_ts) <= F.col(req_ts) + F.expr(f"INTERVAL {int(timeout_s)} SECONDS")))
    j = requests.join(rep, cond, "full_outer")
    asked, answered = F.col(key).isNotNull(), F.col("_rk").isNotNull()
    return j.select(F.coalesce(key, "_rk").alias(key), F.when(asked & answered, 200).when(asked, TIMEOUT_STATUS).alias("code"),
                    F.when(asked & ~answered, F.lit(TIMEOUT_MESSAGE)).alias("message"),
                    F.when(asked & answered, F.timestamp_diff("MILLISECOND", F.col(req_ts), F.col(rep_ts))).alias("latency_ms"),
                    (~asked).alias("late"))


def account_stream(requests: DataFrame, replies: DataFrame, timeout_s: int, lateness: str, key: str = "event_id",
                   req_ts: str = "ts", rep_ts: str = "rts") -> DataFrame:
    """``account`` on streams.  ``lateness`` is how far behind the newest row a row may come; rows behind that are dropped
    by the join and counted in the query's progress (``dropped_rows``)."""
    rq = requests.withColumn(req_ts, F.col(req_ts).cast("timestamp")).withWatermark(req_ts, lateness)
    rp = replies.withColumn(rep_ts, F.col(rep_ts).cast("timestamp")).withWatermark(rep_ts, lateness)
    return account(rq, rp, timeout_s, key, req_ts, rep_ts)


def dropped_rows(query) -> int:
    """Input rows that a finished query's stateful operators dropped behind the watermark, from its progress reports
    (the newest ``spark.sql.streaming.numRecentProgressUpdates`` of them)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
