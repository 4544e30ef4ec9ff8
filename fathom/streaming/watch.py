"""A watcher: polled readings of a target settle for one interval, then are acted on once a digest.

A reading (target, seq, digest, work) follows the last; the step it leads to is
  idle      if there is no work,
  settling  if its digest differs from the last reading's,
  skip      if it was acted on already,
  rebuild   otherwise, which acts on it.
The state of a target is its last digest and the last one acted on.

``steps`` decides when the next reading comes.  ``acts`` needs no next reading: a timer of the target, set at the change and moved by each further change,
fires after one quiet interval and acts on what it finds.  Its rows are
  settling  a reading whose digest is new, and that has work; the timer starts anew,
  idle      a reading without work; no timer stays,
  waiting   a reading that repeats the digest while its timer runs,
  skip      a reading that repeats what was acted on,
  rebuild   the timer's own row: once for each digest that stayed for the interval.
Without a reading nothing but the timer runs, and both state and timer are in Spark's state store: a query that starts again from its checkpoint acts
on what it had seen before, if the interval is over, with the first batch (a reading of any target).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEPS = "target string, seq long, digest string, step string"
_STATE = "previous string, acted string"


def decide(previous: str | None, acted: str | None, digest: str, work: bool) -> str:
    if not work:
        return "idle"
    if previous != digest:
        return "settling"
    return "skip" if acted == digest else "rebuild"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    previous, acted = state.get if state.exists else (None, None)
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for seq, digest, work in zip(rows["seq"], rows["digest"], rows["work"], strict=True):
        step = decide(previous, acted, digest, bool(work))
        previous, acted = digest, digest if step == "rebuild" else acted
        out.append((key[0], seq, digest, step))
    state.update((previous, acted))
    yield pd.DataFrame(out, columns=["target", "seq", "digest", "step"])


def steps(readings: DataFrame) -> DataFrame:
    """The step of every reading of a stream; the state lives in Spark's state store and survives lost executors."""
    return readings.groupBy("target").applyInPandasWithState(_advance, STEPS, _STATE, "append", GroupStateTimeout.NoTimeout)


def steps_of_batch(readings: DataFrame) -> DataFrame:
    """The same answer for a finished table: window functions only.

    Of readings with work that repeat the last digest, those are skipped whose digest is that of the last rebuild.  A run of
    equal digests rebuilds at most once, at its first such reading, and only if the digest rebuilt before differs.
    """
    order = Window.partitionBy("target").orderBy("seq")
    rows = readings.withColumn("_same", F.col("digest").eqNullSafe(F.lag("digest").over(order)) & (F.row_number().over(order) > 1))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(order)).withColumn("_ripe", F.col("_same") & F.col("work"))
    first = F.col("_ripe") & (F.sum(F.col("_ripe").cast("int")).over(Window.partitionBy("target", "_run").orderBy("seq")) == 1)
    rows = rows.withColumn("_first", first)
    before = F.last(F.when(F.col("_first"), F.col("digest")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(~F.col("work"), "idle").when(~F.col("_same"), "settling").when(F.col("_first") & ~F.col("digest").eqNullSafe(before), "rebuild").otherwise("skip")
    return rows.select("target", "seq", "digest", step.alias("step"))


ACTS = "target string, seq long, digest string, step string"
_WATCHED = "digest string, seq long, acted string, due long"
#: The state store that keeps timers; a session has to name it before the query starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Settle(StatefulProcessor):
    """One quiet interval, in milliseconds of processing time, for each target."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watched", _WATCHED)

    def _known(self) -> tuple[str | None, int | None, str | None, int | None]:
        return tuple(self.state.get()) if self.state.exists() else (None, None, None, None)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        digest, seq, acted, due = self._known()
        for r in sorted(rows, key=lambda r: r.seq):
            new = r.digest != digest
            if due is not None and (new or not r.work):
                self.handle.deleteTimer(due)
                due = None
            if not r.work:
                step = "idle"
            elif new or (due is None and r.digest != acted):
                due = timerValues.getCurrentProcessingTimeInMs() + self.quiet
                self.handle.registerTimer(due)
                step = "settling"
            else:
                step = "waiting" if due is not None else "skip"
            if r.digest == acted and due is not None:  # back to what was acted on: nothing to do
                self.handle.deleteTimer(due)
                due, step = None, "skip"
            digest, seq = r.digest, r.seq
            yield Row(target=key[0], seq=r.seq, digest=r.digest, step=step)
        self.state.update((digest, seq, acted, due))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        digest, seq, acted, due = self._known()
        if due is not None and expiredTimerInfo.getExpiryTimeInMs() == due:  # a timer that was moved is none
            self.state.update((digest, seq, digest, None))
            yield Row(target=key[0], seq=seq, digest=digest, step="rebuild")

    def close(self) -> None:
        pass


def acts(readings: DataFrame, quiet: int) -> DataFrame:
    """(target, seq, digest, step) of a stream of readings, with a rebuild after ``quiet`` milliseconds in which a target's digest didn't change."""
    return readings.groupBy("target").transformWithState(statefulProcessor=Settle(quiet), outputStructType=ACTS, outputMode="append", timeMode="processingTime")
