"""Structured event logs: read, per-trace stages, call attempts, outcomes (SRC-7, LOG-*).

All summaries are grouped aggregates (partial aggregation before the
shuffle); nothing is collected per trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare import contracts as C


# ISO-8601 as Python's isoformat() writes it: microseconds only when non-zero.
LOG_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"
LOG_TIME_WRITE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: one JSON object per line, explicit schema, unknown keys dropped."""
    return spark.read.schema(C.LOG_EVENT).option("timestampFormat", LOG_TIME_FORMAT).json(path)


def stage_seconds(logs: DataFrame) -> DataFrame:
    """LOG-1: seconds per timer name per trace (the three stage timers).

    Sums run over DECIMAL so the result does not depend on summation order.
    """
    t = logs.filter((F.col("event") == "timer") & F.col("trace_id").isNotNull())
    wide = (t.groupBy("trace_id").pivot("name", C.TIMER_NAMES)
            .agg(F.sum(F.col("elapsed_seconds").cast("decimal(18,3)"))))
    return wide.select("trace_id", *[F.col(f"`{n}`").cast("double").alias(a) for n, a in
                                     zip(C.TIMER_NAMES, ["analyze_seconds", "agents_seconds", "answer_seconds"])])


def call_attempts(logs: DataFrame) -> DataFrame:
    """LOG-2: per (trace, agent): starts, errors and the last event by (attempt, time)."""
    calls = logs.filter(F.col("event").isin(*C.CALL_START_EVENTS, *C.CALL_SUCCESS_EVENTS, *C.CALL_ERROR_EVENTS))
    order = F.struct("attempt", "time", "event")
    return calls.groupBy("trace_id", "agent").agg(
        F.count_if(F.col("event").isin(*C.CALL_START_EVENTS)).alias("starts"),
        F.count_if(F.col("event").isin(*C.CALL_ERROR_EVENTS)).alias("errors"),
        F.max("attempt").alias("attempts"),
        F.max_by("event", order).alias("last_event"))


def open_attempts(logs: DataFrame) -> DataFrame:
    """LOG-3: starts with no success or error for the same (trace, agent, attempt)."""
    key = ["trace_id", "agent", "attempt"]
    starts = logs.filter(F.col("event").isin(*C.CALL_START_EVENTS))
    ends = logs.filter(F.col("event").isin(*C.CALL_SUCCESS_EVENTS, *C.CALL_ERROR_EVENTS)).select(*key).distinct()
    return starts.join(ends, key, "left_anti")


def trace_outcome(logs: DataFrame) -> DataFrame:
    """LOG-4: the last ``route_query_done`` status; else need_clarification if
    the trace asked for it; else no_supported_agent if its last analysis names
    no supported agent; else open. (Clarification and no-agent returns log no
    done event, see X11.) An analysis event without a list of agents says
    nothing."""
    t = logs.filter(F.col("trace_id").isNotNull())
    done = F.when(F.col("event") == "route_query_done", F.struct("time", "status"))
    supported = F.arrays_overlap(F.array_compact("required_agents"), F.array(*[F.lit(a) for a in C.SUPPORTED_AGENTS]))
    analysis = F.when((F.col("event") == "route_analysis_done") & F.col("required_agents").isNotNull(),
                      F.struct("time", supported.alias("supported")))
    g = t.groupBy("trace_id").agg(
        F.max(analysis).alias("__analysis"),
        F.max(done).alias("__done"),
        F.max(F.col("event") == "route_need_clarification").alias("__clar"),
        F.count(F.lit(1)).alias("events"))
    return g.select("trace_id", F.coalesce(F.col("__done.status"),
                                           F.when(F.col("__clar"), F.lit("need_clarification")),
                                           F.when(~F.col("__analysis.supported"), F.lit("no_supported_agent")),
                                           F.lit("open")).alias("outcome"), "events")
