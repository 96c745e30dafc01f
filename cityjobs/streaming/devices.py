"""Live device feeds as streams, with batch twins that give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cityjobs.functions import geo
from cityjobs.operators.heights import Heights, bilinear_height
from cityjobs.operators.scan import RANGE_ROWS, carried_scan

OUT = "event_id long, device long, ts timestamp, dx double, dy double, dz double, ux double, uy double, uz double"
STATE = "dx double, dy double, dz double, ux double, uy double, uz double"
_V = ["dx", "dy", "dz", "ux", "uy", "uz"]


def vectors(events: DataFrame) -> DataFrame:
    """Direction and up vectors of orientation events (event_id, device, ts, alpha, beta, gamma); incomplete ones go.

    Where events have them: ``compass``, a compass heading, takes the place of alpha; events
    that are not ``absolute`` and have no heading go; ``offset`` degrees are taken off as the
    user's correction, and ``screen`` is how far the screen is turned.
    """
    given = lambda name, kind: F.col(name) if name in events.columns else F.lit(None).cast(kind)
    compass, offset, screen = (given(n, "double") for n in ("compass", "offset", "screen"))
    full = events.filter("alpha IS NOT NULL AND beta IS NOT NULL AND gamma IS NOT NULL AND device IS NOT NULL")
    full = full.filter(compass.isNotNull() | F.coalesce(given("absolute", "boolean"), F.lit(True)))
    alpha = F.coalesce(360 - compass, F.col("alpha").cast("double")) - F.coalesce(offset, F.lit(0.0))
    look, up = geo.device_vectors(alpha, F.col("beta"), F.col("gamma"), F.coalesce(screen, F.lit(0.0)))
    names = [*((look, i, n) for i, n in enumerate(_V[:3])), *((up, i, n) for i, n in enumerate(_V[3:]))]
    return full.select("event_id", "device", "ts", *[F.get(v, i).alias(n) for v, i, n in names])


def _smooth(values: np.ndarray, starts: list[int], state: np.ndarray | None, share: float) -> np.ndarray:
    """Each row moves its device's state by ``share`` towards it; both vectors are kept at length 1.

    Rows are in order, those of a device from each of ``starts`` on; ``state`` is that of the
    first one. All devices take their next step together.
    """
    out = np.array(values, float)
    begin = np.array(starts)
    left = np.diff([*starts, len(values)])
    on = np.argsort(-left, kind="stable")  # those with more rows first, so that the ones still going on are the front
    begin, left = begin[on], left[on]
    s = out[begin]
    if state is not None:
        s[on == 0] = _step(state[None, :], s[on == 0], share)
    out[begin] = s
    for k in range(1, int(left[0])):
        n = int(np.searchsorted(-left, -k))
        s = _step(s[:n], out[begin[:n] + k], share)
        out[begin[:n] + k] = s
    return out


def _step(s: np.ndarray, v: np.ndarray, share: float) -> np.ndarray:
    s = s + (v - s) * share
    for part in (s[:, :3], s[:, 3:]):
        size = np.sqrt(part[:, 0] * part[:, 0] + part[:, 1] * part[:, 1] + part[:, 2] * part[:, 2])
        part /= np.where(size == 0, 1.0, size)[:, None]
    return s


def smoothed(events: DataFrame, share: float = 0.25, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Batch: orientation vectors smoothed per device in order of time, over ranges of device and time: a device may hold any share."""

    def scan(pdf: pd.DataFrame, starts: list[int], state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        pdf[_V] = _smooth(pdf[_V].to_numpy(), starts, None if state is None else np.array(state), share)
        return pdf[["event_id", "device", "ts", *_V]], tuple(float(x) for x in pdf[_V].iloc[-1])

    return carried_scan(vectors(events), "device", ["ts", "event_id"], scan, OUT, STATE, range_rows)


def smoothed_stream(events: DataFrame, share: float = 0.25, timeout: str = "1 hour") -> DataFrame:
    """Stream: the same with the last vectors of each device as state, dropped after ``timeout`` of quiet."""
    ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        pdf[_V] = _smooth(pdf[_V].to_numpy(), [0], np.array(state.get) if state.exists else None, share)
        state.update(tuple(float(x) for x in pdf[_V].iloc[-1]))
        state.setTimeoutDuration(ms)
        yield pdf[["event_id", "device", "ts", *_V]]

    return vectors(events).groupBy("device").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def enriched(pings: DataFrame, heights: Heights, above: float) -> DataFrame:
    """Positions with the height of the terrain between the four cells around them (0 outside the grid), and the eye above it.

    The store of heights is one static table, so a stream of pings is enriched alike.
    """
    return bilinear_height(pings, heights, "ground").withColumn("eye", F.col("ground") + F.lit(above))


def first_flagged(pings: DataFrame) -> DataFrame:
    """Batch: whether a ping is its device's first (``first``), in order of time."""
    least = pings.groupBy("device").agg(F.min(F.struct("ts", "event_id")).alias("__first"))
    return pings.join(least, "device", "left").withColumn("first", F.coalesce(F.struct("ts", "event_id") == F.col("__first"), F.lit(False))).drop("__first")


class _FirstPing(StatefulProcessor):
    """Holds a device's pings until the watermark passes the earliest of them, which is its first then; later ones go straight on."""

    def __init__(self, schema: T_.StructType):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first timestamp")
        self.held = handle.getListState("held", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))[self.schema.names]
        if self.seen.exists():
            yield pdf.assign(first=False)
            return
        self.held.appendList([tuple(r) for r in pdf.itertuples(index=False)])
        self.handle.registerTimer(pdf["ts"].min().value // 1_000_000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():  # the timer of a ping that came before an earlier one
            yield pd.DataFrame()
            return
        pdf = pd.DataFrame(list(self.held.get()), columns=self.schema.names).sort_values(["ts", "event_id"])
        self.seen.update((pdf["ts"].iloc[0].to_pydatetime(),))
        self.held.clear()
        yield pdf.assign(first=[True] + [False] * (len(pdf) - 1))

    def close(self) -> None:
        pass


def first_flagged_stream(pings: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Stream: the same rows, though pings may come in any order within ``late`` of the latest; later ones are dropped.

    A device's pings are held until the watermark has passed its earliest one, by an
    event-time timer; from then on its state is that one time. Needs a state store for
    arbitrary state (``spark.sql.streaming.stateStore.providerClass`` of RocksDB).
    """
    schema = T_.StructType([*pings.schema.fields, T_.StructField("first", T_.BooleanType())])
    marked = pings.filter("device IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return marked.groupBy("device").transformWithStateInPandas(_FirstPing(pings.schema), schema, "Append", "EventTime")


def settled_views(views: DataFrame, quiet: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last event of each run of a device's events that are closer than ``quiet`` to each other.

    In a stream events may come in any order within ``late`` of the latest; a run is given out
    once the watermark has passed its end, and later events are dropped. In batch the
    watermark has no effect.
    """
    v = views.withWatermark("ts", late) if views.isStreaming else views
    runs = v.groupBy("device", F.session_window("ts", quiet).alias("w"))
    return runs.agg(F.max(F.struct("ts", "event_id")).alias("last"), F.count(F.lit(1)).alias("n")).select("device", F.col("last.event_id").alias("event_id"), F.col("last.ts").alias("ts"), "n")
