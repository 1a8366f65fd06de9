"""Progress events as streams: runs by gaps, stalled runs and busy hosts; and reads that settle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds without progress that make a stall, and answers that ask to slow down.
STALL_SECONDS = 180
BUSY = [429, 503]


def gap_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "3 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of each key, ended by a gap: began, ended and events. Later events than the watermark allows are left out."""
    windowed = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w"))
    return windowed.agg(F.count("*").alias("events"), F.min(ts).alias("began"), F.max(ts).alias("ended")).select(key, "began", "ended", "events")


def stalls(events: DataFrame, key: str, ts: str = "ts", what: str = "message", late: str = "1 minute") -> DataFrame:
    """A row for each time that a key stays without events for STALL_SECONDS of event time: key, last, last_message.

    A session that ends by such a gap is one; sums of sessions are all that is kept of a key,
    however many events it has. operators.merges.stall_warnings tells the warnings that follow, streaming.stalls those of live runs.
    """
    windowed = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, f"{STALL_SECONDS} seconds").alias("w"))
    return windowed.agg(F.max(ts).alias("last"), F.max_by(what, ts).alias("last_message")).select(key, "last", "last_message")


def busy_hosts(answers: DataFrame, host: str, ts: str = "ts", width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """For each host and minute of answers (host, ts, status): how many there were, and how many asked to slow down."""
    windowed = answers.withWatermark(ts, late).groupBy(host, F.window(ts, width).alias("w"))
    return windowed.agg(F.count("*").alias("answers"), F.count_if(F.col("status").isin(BUSY)).alias("busy")).select(host, F.col("w.start").alias("minute"), "answers", "busy")


def stable_read(sizes: DataFrame, key: str, needed: int = 2) -> DataFrame:
    """(key, best, polls, settled) of repeated reads (key, seq, n; n null for a failed read): the largest read, and whether it held.

    A larger read starts the count of equal ones anew and asks for one more of them. All of
    it is running sums and maxima over a key's reads; nothing gathers them in an array.
    """
    turn = Window.partitionBy(key).orderBy("seq")
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    upto = turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.coalesce(F.col("n").cast("long"), F.lit(-1).cast("long"))
    reads = sizes.select(key, "seq", n.alias("n"))
    marked = reads.withColumn("top", F.coalesce(F.max("n").over(before), F.lit(-1).cast("long")))
    marked = marked.withColumn("same", (F.col("n") == F.col("top")) & (F.col("n") >= 0)).withColumn("grown", (F.col("n") > F.col("top")) & (F.col("top") >= 0))
    marked = marked.withColumn("stretch", F.count_if(~F.col("same")).over(upto)).withColumn("asked", needed + F.count_if("grown").over(upto))
    streak = F.count_if("same").over(Window.partitionBy(key, "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = marked.withColumn("polls", F.row_number().over(turn)).withColumn("best", F.greatest("n", "top")).withColumn("settled", streak >= F.col("asked"))
    # the first read that settles, or else the last one
    first = F.min(F.when(F.col("settled"), F.struct("polls", "best")))
    last = F.max(F.struct("polls", "best"))
    ends = marked.groupBy(key).agg(first.alias("first"), last.alias("last"))
    end = F.coalesce("first", "last")
    return ends.select(key, end["best"].alias("best"), end["polls"].alias("polls"), F.col("first").isNotNull().alias("settled"))
