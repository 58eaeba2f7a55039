"""Live tables over landing files: dedup, work units, carried state, loops, nudges, windowed counts."""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator
from heapq import merge
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

IDLE = "1801 seconds"  # a gap of exactly half an hour still joins, at the stamps' resolution


def tail(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Rows of Parquet files as they land in ``folder``."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def first_calls(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark; replays go."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def work_units(events: DataFrame, late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late).groupBy("project", F.session_window("ts", IDLE).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return e.select("project", F.col("w.start").alias("first"), "last", "n")


def tumbling(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


LOOSE, RUN, SLICE, GIVEN = 1000, 10_000, 200, 10_000


class InOrder(StatefulProcessor):
    """A key's rows through ``step(state, row) -> (state, output or None)`` in order of (us, event_id).

    Rows wait until the watermark has passed them. A key's first LOOSE of them wait in its one value, read and
    written once a batch; more go to map state as sorted runs of up to RUN rows, SLICE an entry, and runs are merged when they
    are due. So a task holds RUN rows of input, or LOOSE rows and a slice of each run of a key. A key has one timer: when
    its earliest row is due, or, with none waiting, when it is forgotten. Rows behind the watermark are late and go. A row more
    than ``forget_ms`` after the key's last one finds no state, whether or not the timer that clears the state has come.
    Input is (key, ts, *columns); a row out is the key and up to GIVEN outputs as JSON, as PySpark keeps what a task's timers give
    until all have fired.
    """

    def __init__(self, step: Callable, columns: list[str], forget_ms: int):
        self.step, self.forget_ms = step, forget_ms
        self.row, self.by = namedtuple("row", columns), itemgetter(0, 1)

    def init(self, handle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run bigint, slice bigint, first bigint", "rows string")
        self.held = handle.getValueState("held", "state string, seen bigint, loose string, runs bigint, timer bigint")

    def _now(self) -> tuple:
        state, seen, loose, runs, timer = self.held.get() or (None, None, "[]", 0, None)
        return state, seen, json.loads(loose), runs, timer

    def _timer(self, old: int | None, new: int) -> int:
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)
        return new

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, seen, loose, runs, timer = self._now()
        first = None

        def spill():
            run = sorted((self.row(*r) for r in loose), key=self.by)
            for k in range(0, len(run), SLICE):
                self.runs.updateValue((runs, k // SLICE, run[k].us), (json.dumps(run[k : k + SLICE]),))

        for r in rows:
            if r[3] is None:  # a row without id only moves the watermark
                continue
            loose.append(tuple(r)[2:])
            first = r[2] if first is None else min(first, r[2])
            if len(loose) == RUN:
                spill()
                loose, runs = [], runs + 1
        if len(loose) > LOOSE:
            spill()
            loose, runs = [], runs + 1
        if first is not None:
            due = -(-first // 1000)
            if timer is None or due < timer:
                timer = self._timer(timer, due)
            self.held.update((state, seen, json.dumps(loose), runs, timer))
        return iter([])

    def _run(self, slices: list[tuple], upto: int, left: list[int]) -> Iterator[tuple]:
        """A run's rows as far as they are due, a slice at a time; ``left`` gets the time of the first that isn't."""
        for run, k, first in slices:
            if first > upto:
                left.append(first)
                return
            rows = json.loads(self.runs.getValue((run, k, first))[0])
            self.runs.removeKey((run, k, first))
            later = [r for r in rows if r[0] > upto]
            if later:
                self.runs.updateValue((run, k, later[0][0]), (json.dumps(later),))
                left.append(later[0][0])
            yield from (self.row(*r) for r in rows[: len(rows) - len(later)])
            if later:
                return

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        upto = now * 1000
        text, seen, loose, runs, timer = self._now()
        left = [r[0] for r in loose if r[0] > upto]
        due = [sorted((self.row(*r) for r in loose if r[0] <= upto), key=self.by)]
        loose = [r for r in loose if r[0] > upto]
        if runs:
            for _, slices in groupby(sorted(tuple(k) for k in self.runs.keys()), key=lambda k: k[0]):
                due.append(self._run(list(slices), upto, left))
        state, done = tuple(json.loads(text)) if text else None, []
        for r in merge(*due, key=self.by):
            if seen is not None and r.us // 1000 - seen > self.forget_ms:
                state = None
            state, got = self.step(state, r)
            seen = r.us // 1000
            if got is not None:
                done.append(got)
            if len(done) == GIVEN:
                yield Row(key=key[0], done=json.dumps(done))
                done = []
        if done:
            yield Row(key=key[0], done=json.dumps(done))
        if not left and (seen is None or seen + self.forget_ms <= now):
            self.held.clear()
            return
        timer = self._timer(None, -(-min(left) // 1000) if left else seen + self.forget_ms)
        # without slices left, the next timer needn't list them
        self.held.update((None if state is None else json.dumps(state), seen, json.dumps(loose), runs if len(left) > len(loose) else 0, timer))

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, key: str, out: dict[str, str], step: Callable, late: str, forget_ms: int) -> DataFrame:
    """``step`` over the rows of each key in time order, as far as the watermark has come; ``out``: its outputs' names and types."""
    columns = ["us", "event_id", "event_type", "k"]
    rows = events.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("us"), *columns[1:])
    done = rows.groupBy(key).transformWithState(InOrder(step, columns, forget_ms), "key long, done string", "append", "eventTime")
    each = F.explode(F.from_json("done", "array<array<string>>")).alias("o")
    return done.select("key", each).select(F.col("key").alias(key), *[F.col("o")[i].cast(t).alias(c) for i, (c, t) in enumerate(out.items())])


LATE, FORGET_MS = "1 hour", 90 * 86_400_000


def carried_modes(events: DataFrame, late: str = LATE, forget_ms: int = FORGET_MS) -> DataFrame:
    """Each event with the permission mode carried from earlier ones, false before the first."""

    def step(state, r):
        mode = state[0] if state else False
        mode = True if r.k % 10 == 0 else False if r.k % 10 == 1 else mode
        return (mode,), (r.event_id, mode)

    return _stateful(events, "user_id", {"event_id": "long", "mode": "boolean"}, step, late, forget_ms)


def live_loops(events: DataFrame, least: int = 3, late: str = LATE, forget_ms: int = FORGET_MS) -> DataFrame:
    """A row when a call repeats for the ``least``-th time in a row, and at each repeat after."""

    def step(state, r):
        call = f"{r.event_type}:{r.k % 3}"
        n = state[1] + 1 if state and state[0] == call else 1
        return (call, n), ((r.event_id, call, n) if n >= least else None)

    return _stateful(events, "user_id", {"event_id": "long", "call": "string", "repeats": "long"}, step, late, forget_ms)


def nudges(events: DataFrame, every: int = 3, late: str = LATE, forget_ms: int = FORGET_MS) -> DataFrame:
    """A row whenever a session's edits reach the last announced count and ``every`` more."""

    def step(state, r):
        n, told = state or (0, 0)
        n += r.event_type in ("click", "purchase")
        if n >= told + every:
            return (n, n), (r.event_id, n)
        return (n, told), None

    return _stateful(events, "user_id", {"event_id": "long", "edits": "long"}, step, late, forget_ms)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what has landed and return the result table; complete results replace the last ones."""
    spark = stream.sparkSession
    spark.conf.set(_PROVIDER, ROCKS)  # map state and timers need it
    out, log = f"{folder}/out", f"{folder}/log"
    w = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out).start()
    else:
        q = w.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
