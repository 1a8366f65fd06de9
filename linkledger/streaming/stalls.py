"""Live warnings of runs that make no progress: timers on the time of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .progress import STALL_SECONDS

#: Fixed value: seconds between the warnings of one stall.
EVERY_SECONDS = 30
#: Seconds without progress after which a run is given up and its state forgotten.
GIVE_UP = 6 * 3600
WARNING = "run string, at timestamp, quiet_seconds long, warning long, course string, section string, url string"
PLACES = ["course", "section", "url"]
STATE = "last long, told long, warnings long, course string, section string, url string"


def with_timers(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Watch(StatefulProcessor):
    """Of each run: the time of its last progress, up to when warnings were given, how many, and where it was; one timer, for the next warning."""

    def __init__(self, give_up: int = GIVE_UP) -> None:
        self.give_up = 1000 * give_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", STATE)

    def _told(self, run: str, s: list, until: int) -> list[tuple]:
        """The warnings that are due before `until`; they are noted in the state."""
        out = []
        due = max(s[0] + 1000 * STALL_SECONDS, s[1] + 1000 * EVERY_SECONDS)
        while due < until and due <= s[0] + self.give_up:
            s[1], s[2] = due, s[2] + 1
            out.append((run, pd.Timestamp(due, unit="ms", tz="UTC"), (due - s[0]) // 1000, s[2], s[3], s[4], s[5]))
            due += 1000 * EVERY_SECONDS
        return out

    def _waits(self, s: list) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update(tuple(s))
        self.handle.registerTimer(min(max(s[0] + 1000 * STALL_SECONDS, s[1] + 1000 * EVERY_SECONDS), s[0] + self.give_up + 1))

    def _forgets(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.clear()

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.split()[0] for f in WARNING.split(", ")])

    @staticmethod
    def _summed(spans: dict[int, list], batch: pd.DataFrame) -> None:
        """Adds events, in any order, to what is known of each EVERY_SECONDS: first and last time, whether the last one ended the run, and when each place was last named."""
        batch = batch.sort_values("at_ms", kind="stable")
        for n, rows in batch.groupby(batch["at_ms"] // (1000 * EVERY_SECONDS), sort=False):
            first, last, over = int(rows["at_ms"].iloc[0]), int(rows["at_ms"].iloc[-1]), bool(rows["ended"].iloc[-1])
            places = [(int(named["at_ms"].iloc[-1]), named[c].iloc[-1]) if len(named := rows[rows[c] != ""]) else (-1, "") for c in PLACES]
            held = spans.setdefault(int(n), [first, last, over, places])
            if first < held[0]:
                held[0] = first
            if last > held[1]:
                held[1], held[2] = last, over
            held[3] = [new if new[0] >= old[0] else old for new, old in zip(places, held[3], strict=True)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = list(self.state.get()) if self.state.exists() else None
        spans: dict[int, list] = {}
        for batch in rows:
            self._summed(spans, batch)
        ended, told = False, []
        for _, (first, last, over, places) in sorted(spans.items()):
            if s is None:
                s = [first - 1, 0, 0, "", "", ""]
            if first > s[0] and not ended:
                told += self._told(key[0], s, first)
            if last > s[0]:
                s[0], s[1], ended = last, 0, over
            # the last place that was named counts
            s[3:] = [place or old for (_, place), old in zip(places, s[3:], strict=True)]
        if told:
            yield self._frame(told)
        if ended:
            self._forgets()
        elif s is not None:
            self._waits(s)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        s = list(self.state.get())
        now = timerValues.getCurrentWatermarkInMs()
        told = self._told(key[0], s, now + 1)
        if now > s[0] + self.give_up:
            self._forgets()
        else:
            self._waits(s)
        if told:
            yield self._frame(told)


def stall_warnings(events: DataFrame, run: str = "run", ts: str = "ts", late: str = "1 minute", give_up: int = GIVE_UP) -> DataFrame:
    """A warning every EVERY_SECONDS while a run is quiet, from STALL_SECONDS after its last event on: WARNING.

    events: run, ts, course, section, url and ended, which may be null; any event is progress,
    and `ended` ends a run. The last course, section and address that were named are told.
    Warnings come as soon as the watermark, the newest time of all runs less `late`, passes
    them, so one quiet run is told by the progress of others. What comes late, but within the
    watermark, ends a stall from then on. A run's state is one row, whatever it has sent, and
    goes when the run ends, or `give_up` seconds after its last progress, with its last warning.
    Events of a micro-batch may come in any order: of each EVERY_SECONDS of a run, only their
    first and last time and the places are held. with_timers() gives the session the state store that this needs.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    named = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(F.col(run).cast("string").alias("run"), F.unix_millis(F.col(ts)).alias("at_ms"), F.coalesce(F.col("ended"), F.lit(False)).alias("ended"), text("course"), text("section"), text("url"), F.col(ts).alias("ts"))
    return named.groupBy("run").transformWithStateInPandas(Watch(give_up), WARNING, "Append", "EventTime")
