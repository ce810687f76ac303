"""Progress along a route from fix to fix: as a stream with typed state and timers, and over a table that has it all.

A trip is a user's fixes without a pause longer than `idle` seconds. From one fix to the next the position may have gone as far as the
speed so far allows, with some slack and the fix's own error, and no further than is looked ahead. The speed along the route
is smoothed; only what lies beyond the farthest point reached counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Motion:
    """Factor and slack (m/s) on the speed, error of a fix, look-ahead (m), smoothing. max_speed is the vehicle's."""

    max_speed: float = 50.0
    factor: float = 1.5
    slack: float = 5.0
    error: float = 30.0
    ahead: float = 2000.0
    smoothing: float = 0.5


TRACKED = "user_id long, started double, fixes long, at double, reached double, speed double, reach double, ended boolean"
_STATE = "started double, fixes long, at double, reached double, speed double, reach double"


def steps(at: np.ndarray, progress: np.ndarray, before: tuple | None, motion: Motion) -> tuple:
    """The state after fixes in order of time: (started, fixes, at, reached, speed or None, reach). Fixes before the last known go."""
    if before is not None:
        later = at >= before[2]
        at, progress = at[later], progress[later]
        if not len(at):
            return before
    started, fixes, last, reached, speed, reach = before or (float(at[0]), 0, None, None, None, motion.ahead)
    times, farthest = at, np.maximum.accumulate(progress)
    if last is not None:
        times, farthest = np.concatenate(([last], at)), np.maximum(np.concatenate(([reached], farthest)), reached)
    dt = np.diff(times)
    moved = dt > 0
    seen = np.clip(np.diff(farthest)[moved] / dt[moved], 0, motion.max_speed)
    speeds = [speed]  # before the first interval and after each
    for o in seen.tolist():
        speeds.append(o if speeds[-1] is None else speeds[-1] + (o - speeds[-1]) * motion.smoothing)
    if len(dt):
        known = speeds[-2] if moved[-1] else speeds[-1]
        limit = motion.max_speed if known is None else min(known * motion.factor + motion.slack, motion.max_speed)
        reach = min(limit * float(dt[-1]) + motion.error, motion.ahead)
    return started, fixes + len(at), float(times[-1]), float(farthest[-1]), speeds[-1], float(reach)


class Tracker(StatefulProcessor):
    """State of each user's trip; a timer at `idle` seconds of event time after the last fix ends it."""

    def __init__(self, motion: Motion, idle: int):
        self.motion, self.idle = motion, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trip", _STATE)

    def _row(self, key: tuple, state: tuple, ended: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *state, ended)], columns=[c.split()[0] for c in TRACKED.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("at", kind="stable")
        at, progress = own["at"].to_numpy(float), own["progress"].to_numpy(float)
        before = tuple(self.state.get()) if self.state.exists() else None
        if before is not None:  # what comes after its trip has gone on is late
            at, progress = at[at >= before[2]], progress[at >= before[2]]
        cuts = np.flatnonzero(np.diff(np.concatenate(([before[2]], at)) if before is not None else at) > self.idle) + (before is None)
        state, parts = before, np.split(np.arange(len(at)), cuts)
        for i, part in enumerate(parts):
            if i > 0:
                if state is not None:
                    yield self._row(key, state, True)
                state = None
            if len(part):
                state = steps(at[part], progress[part], state, self.motion)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update(state)
        self.handle.registerTimer(int((state[2] + self.idle) * 1000) + 1)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get())
        self.state.clear()
        yield self._row(key, state, True)

    def close(self) -> None:
        pass


def tracked_stream(fixes: DataFrame, motion: Motion = Motion(), idle: int = 1800, late: str = "10 minutes") -> DataFrame:
    """Rows of TRACKED for every change of a trip, and one that is `ended` when it is over.

    fixes: a stream of user_id, stamp (timestamp, watermarked here), progress (meters along the route). A fix that comes after a
    later one of its user is left out. Needs the RocksDB state store.
    """
    rows = fixes.withWatermark("stamp", late).select("user_id", F.col("stamp").cast("double").alias("at"), F.col("progress").cast("double").alias("progress"), "stamp")
    return rows.groupBy("user_id").transformWithStateInPandas(Tracker(motion, idle), TRACKED, "Update", "EventTime")


def tracked(fixes: DataFrame, motion: Motion = Motion(), idle: int = 1800, at: str = "at", tie: str | None = None) -> DataFrame:
    """(user_id, started, fixes, at, reached, speed, reach) of every trip in a table of user_id, `at` (seconds) and progress.

    Trips are numbered in a window by user and folded one by one, so only a trip's own fixes come together. `tie` orders fixes
    of one second. speed is null for a trip without two times.
    """
    order = [at] + ([tie] if tie else [])
    w = Window.partitionBy("user_id").orderBy(*order)
    gap = F.col(at) - F.lag(at).over(w) > idle
    numbered = fixes.withColumn("_trip", F.sum(F.when(gap, 1).otherwise(0)).over(w))
    fix = F.struct(*[F.col(c) for c in order], F.col(at).cast("double").alias("t"), F.col("progress").cast("double").alias("p"))
    trips = numbered.groupBy("user_id", "_trip").agg(F.sort_array(F.collect_list(fix)).alias("f"))
    none = F.lit(None).cast("double")
    start = F.struct(F.get("f", F.lit(0)).t.alias("at"), F.get("f", F.lit(0)).p.alias("reached"), none.alias("speed"), F.lit(motion.ahead).alias("reach"))

    def step(s: Column, x: Column) -> Column:
        dt, reached = x.t - s["at"], F.greatest(s.reached, x.p)
        limit = F.when(s.speed.isNull(), F.lit(motion.max_speed)).otherwise(F.least(s.speed * motion.factor + motion.slack, F.lit(motion.max_speed)))
        seen = F.least(F.greatest((reached - s.reached) / dt, F.lit(0.0)), F.lit(motion.max_speed))
        speed = F.when(dt > 0, F.when(s.speed.isNull(), seen).otherwise(s.speed + (seen - s.speed) * motion.smoothing)).otherwise(s.speed)
        return F.struct(x.t.alias("at"), reached.alias("reached"), speed.alias("speed"), F.least(limit * dt + motion.error, F.lit(motion.ahead)).alias("reach"))

    end = F.aggregate(F.slice("f", F.lit(2), F.greatest(F.size("f"), F.lit(1))), start, step)
    return trips.select("user_id", F.get("f", F.lit(0)).t.alias("started"), F.size("f").cast("long").alias("fixes"), end.alias("e")).select("user_id", "started", "fixes", "e.*")
