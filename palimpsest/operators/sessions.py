"""Sessions of files as tables of events: what a session's queue, its results and its
end are after all of them. Order decides, so that states are windows over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closing(queued: DataFrame, events: DataFrame) -> DataFrame:
    """session, closed_at: the first event `close` after each of the queued files has been
    completed or has failed; earlier ones are refused. queued: session, file; events:
    session, at, event, file, ... with at unique in a session."""
    done = events.filter(F.col("event").isin("complete", "fail")).join(queued, ["session", "file"], "left_semi").groupBy("session", "file").agg(F.min("at").alias("_done"))
    ready = queued.join(done, ["session", "file"], "left").groupBy("session").agg(F.count_if(F.col("_done").isNull()).alias("_open"), F.max("_done").alias("_ready"))
    closes = events.filter("event = 'close'").join(ready.filter("_open = 0"), "session").filter("at > _ready")
    return closes.groupBy("session").agg(F.min("at").alias("closed_at"))


def final_states(queued: DataFrame, events: DataFrame) -> DataFrame:
    """session, file, state (pending, completed, failed), output, error of each queued file
    of sessions that weren't discarded. The last event of a file counts; events of files that
    aren't queued and events after the end have no effect."""
    gone = events.filter("event = 'discard'").select("session").distinct()
    mine = queued.join(gone, "session", "left_anti")
    told = events.filter(F.col("event").isin("complete", "fail")).join(closing(queued, events), "session", "left").filter("closed_at IS NULL OR at < closed_at")
    last = told.groupBy("session", "file").agg(F.max(F.struct("at", "event", "detail")).alias("e"))
    x = mine.join(last, ["session", "file"], "left")
    kind = F.col("e.event")
    return x.select(
        "session",
        "file",
        F.when(kind == "complete", "completed").when(kind == "fail", "failed").otherwise("pending").alias("state"),
        F.when(kind == "complete", F.col("e.detail")).alias("output"),
        F.when((kind == "fail") & (F.col("e.detail") != ""), F.col("e.detail")).alias("error"),
    )


def session_states(queued: DataFrame, events: DataFrame) -> DataFrame:
    """session, n, completed, failed, pending, is_complete of sessions that weren't discarded."""
    x = final_states(queued, events).groupBy("session").agg(F.count("*").alias("n"), *(F.count_if(F.col("state") == s).alias(s) for s in ("completed", "failed", "pending")))
    ends = closing(queued, events).select("session", F.lit(True).alias("is_complete"))
    return x.join(ends, "session", "left").withColumn("is_complete", F.coalesce("is_complete", F.lit(False)))
