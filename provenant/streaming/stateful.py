"""Streams that keep state by key: turns of a session, abandoned work, hourly windows with a side output, and the verify cursor.

State is bounded by the watermark: what it has passed is put out and forgotten,
and what arrives behind it is dropped. Each query goes on where it stopped when
it is started again on the same folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from provenant.operators import content, upkeep
from provenant.streaming.buckets import Buckets, newest

_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds after which work without an end counts as abandoned, and how far a stamp may lie ahead of its arrival.
AGE, SKEW = 180, "1 hour"
#: Shares of the keys that abandoned work is kept by, and slots of a share; a checkpoint holds for the numbers that it was started with.
SHARES, SLOTS = 1024, 32


def _started(stream: DataFrame, top: str, **options) -> StreamingQuery:
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps the store that it was started with
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).outputMode(options.get("mode", "append"))
        made = writer.foreachBatch(options["batch"]).start() if "batch" in options else writer.format("parquet").option("path", f"{top}/rows").start()
        made.awaitTermination()
        return made
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def drain(stream: DataFrame, top: str) -> DataFrame:
    """Run a stream to the end of what is there and return all that it has put out under top, each row exactly once."""
    _started(stream, top)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{top}/rows")


class _Turns(StatefulProcessor):
    """Messages wait for the watermark, by their place in the session; then they go out in order, numbered by the user messages up to them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "turn_seq long", "role string, at long")
        self.done = handle.getValueState("done", "segment long, turn_seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done = self.done.get()
        for frame in rows:
            for seq, role, at in zip(frame["turn_seq"], frame["role"], frame["at"], strict=True):
                if (done is None or seq > done[1]) and not self.waiting.containsKey((int(seq),)):
                    self.waiting.updateValue((int(seq),), (role, int(at)))
                    self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        segment, last = self.done.get() or (0, None)
        out = []
        for (seq,), (role, at) in sorted(self.waiting.iterator(), key=lambda x: x[0][0]):
            if at > passed:
                break
            segment, last = segment + (role == "user"), seq
            out.append((key[0], seq, role, segment))
            self.waiting.removeKey((seq,))
        if out:
            self.done.update((segment, last))
            yield pd.DataFrame(out, columns=["session", "turn_seq", "role", "segment"])

    def close(self) -> None:
        pass


def turns(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """capture.turn_segments of a stream (session long, turn_seq, role, ts): (session, turn_seq, role, segment) of each message, once, when the watermark has passed it.

    A message that repeats a turn_seq counts once. One that comes before the
    watermark has passed its stamp is put in its place, however late; one that
    comes after, or that has a turn_seq before what is out, is dropped.
    """
    rows = messages.select(F.col("session").cast("long").alias("session"), F.col("turn_seq").cast("long").alias("turn_seq"), "role", "ts").filter("session IS NOT NULL AND turn_seq IS NOT NULL AND ts IS NOT NULL")
    timed = rows.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts"))
    return timed.groupBy("session").transformWithStateInPandas(_Turns(), "session long, turn_seq long, role string, segment long", "append", "eventTime")


_WORK = ("kind", "id", "started", "steps", "seq", "target", "ended", "revision", "due")
_WORK_TYPE = "kind array<string>, id array<string>, started array<long>, steps array<long>, seq array<long>, target array<string>, ended array<boolean>, revision array<int>, due array<long>"


class _Abandoned(StatefulProcessor):
    """Pieces of work from their start to their end; a timer speaks up where no end comes in time.

    One call has the work of a share of all keys, for a call, a timer and a
    state access cost far more than the few rows of one piece. Its work stands
    in slots, of which a batch rewrites those that its keys fall in, and the
    share has one timer, for the earliest of what is due.
    """

    def __init__(self, age_ms: int):
        self.age = age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot int", _WORK_TYPE)
        self.due = handle.getValueState("due", "at array<long>, timer long")

    def _load(self, slot: int) -> dict[tuple, list]:
        columns = self.slots.getValue((slot,)) if self.slots.containsKey((slot,)) else ()
        return {(kind, name): list(work) for kind, name, *work in zip(*columns, strict=True)}

    def _store(self, slot: int, held: dict[tuple, list], due: list) -> None:
        due[slot] = min((work[-1] for work in held.values() if work[-1] is not None), default=None)
        if held:
            self.slots.updateValue((slot,), tuple(map(list, zip(*((*key, *work) for key, work in held.items()), strict=True))))
        elif self.slots.containsKey((slot,)):
            self.slots.removeKey((slot,))

    def _wait(self, due: list, timer: int | None) -> None:
        """One timer, for the earliest of what is due."""
        first = min((at for at in due if at is not None), default=None)
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.due.update((due, first))

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["kind", "id", "state", "steps", "last_target", "revision"])

    def _taken(self, work: list, events: list[tuple]) -> tuple[list, bool]:
        """Work after these events, and whether what was said of it has changed."""
        started, steps, last, target, ended, revision, due = work
        fresh, changed = started is None, False
        for event, at, seq, aim in events:
            if event == "start":
                started = at if started is None else min(started, at)
            elif event == "end":
                due = min(due, at + self.age) if ended else at + self.age
                changed, ended = changed or not ended, True
            else:
                if last is None or (seq, aim or "") > (last, target or ""):
                    last, target = seq, aim
                steps, changed = steps + 1, True
        if fresh and started is not None and not ended:
            due = started + self.age
        said = bool(revision) and changed
        return [started, steps, last, target, ended, revision + said, due], said

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: dict[int, dict[tuple, list]] = {}
        for frame in rows:
            for slot, kind, name, event, at, seq, aim in zip(*(frame[c].tolist() for c in ("slot", "kind", "id", "event", "at", "seq", "target")), strict=True):
                came.setdefault(slot, {}).setdefault((kind, name), []).append((event, at, seq, aim if isinstance(aim, str) else None))
        due, timer = self.due.get() or ([None] * SLOTS, None)
        due, out = list(due), []
        for slot, works in came.items():
            held = self._load(slot)
            for piece, events in works.items():
                held[piece], said = self._taken(held.get(piece, [None, 0, None, None, False, 0, None]), events)
                if said:
                    _, steps, _, target, ended, revision, _ = held[piece]
                    out.append((*piece, "taken_back" if ended else "abandoned", steps, target, revision))
            self._store(slot, held, due)
        self._wait(due, timer)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due, out = list(self.due.get()[0]), []
        for slot in [k for k, at in enumerate(due) if at is not None and at <= passed]:
            held = self._load(slot)
            for piece, work in list(held.items()):
                if work[-1] is None or work[-1] > passed:
                    continue
                _, steps, _, target, ended, _, _ = work
                if ended:
                    del held[piece]
                else:
                    work[-2:] = [1, None]
                    out.append((*piece, "abandoned", steps, target, 1))
            self._store(slot, held, due)
        self._wait(due, None)  # the one that has fired goes by itself
        yield from self._frame(out)

    def close(self) -> None:
        pass


def abandoned(events: DataFrame, delay: str = "10 minutes", age: int = AGE) -> DataFrame:
    """A change log (kind, id, state, steps, last_target, revision) of work on a stream of events (kind, id, event, ts, seq, target).

    kind tells operations and claims apart, event is start, step or end. Work
    whose start the watermark has left behind by age seconds without an end is
    abandoned. A step that comes later gives it a new revision; an end that
    comes later takes it back. State of ended work goes age seconds after its
    end. still_open reads the log.

    State is kept by shares of the keys, so its cost goes with rows and slots,
    not with calls by piece of work.
    """
    rows = events.select(F.col("kind").cast("string").alias("kind"), F.col("id").cast("string").alias("id"), "event", "ts", F.coalesce(F.col("seq").cast("long"), F.lit(0).cast("long")).alias("seq"), F.col("target").cast("string").alias("target")).filter("kind IS NOT NULL AND id IS NOT NULL AND ts IS NOT NULL")
    place = F.pmod(F.xxhash64("kind", "id"), F.lit(SHARES * SLOTS)).cast("int")
    timed = rows.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts")).withColumns({"share": F.floor(place / SLOTS).cast("int"), "slot": place % SLOTS})
    return timed.groupBy("share").transformWithStateInPandas(_Abandoned(1000 * age), "kind string, id string, state string, steps long, last_target string, revision int", "append", "eventTime")


def still_open(changes: DataFrame) -> DataFrame:
    """(kind, id, steps, last_target) of the work that the log leaves abandoned."""
    last = changes.groupBy("kind", "id").agg(F.max_by(F.struct("state", "steps", "last_target"), "revision").alias("x"))
    return last.filter("x.state = 'abandoned'").select("kind", "id", "x.steps", "x.last_target")


def recency(records: DataFrame, top: str, delay: str = "1 day", skew: str = SKEW) -> tuple[DataFrame, DataFrame]:
    """records (ts, arrived, refused_kind) to (hour, records, refused) by event time, and a side output of the rows stamped more than skew after they arrived.

    A window is written again whenever its counts change, and forgotten by the
    stream, not by the table, when the watermark has passed it. Rows with a
    stamp far ahead never reach the watermark, which they would carry away. The
    last day is the sum of its hours, at query time.
    """
    spark, ahead = records.sparkSession, F.col("ts") > F.col("arrived") + F.expr(f"INTERVAL {skew}")
    stamped = records.filter(F.col("ts").isNotNull())
    counts = stamped.filter(~ahead).withWatermark("ts", delay).groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("records"), F.count("refused_kind").alias("refused"))
    hours = Buckets(spark, f"{top}/hours/table", "hour", 16)
    _started(counts.select(F.col("window.start").alias("hour"), "records", "refused"), f"{top}/hours", mode="update", batch=lambda rows, epoch: hours.merge(epoch, rows, newest("hour")) and None)
    future = drain(stamped.filter(ahead), f"{top}/future")
    found = hours.read()
    return spark.createDataFrame([], "hour timestamp, records long, refused long") if found is None else found, future


def verify_runs(spark: SparkSession, runs: DataFrame, reads: DataFrame, top: str, index: Buckets) -> DataFrame:
    """Verify passes over a kept index: each row (run_at, n) of a stream of runs checks the n stalest rows, as content.verdicts does.

    The cursor is verified_at in the table: it moves for a batch of runs in one
    commit with their outcomes, so that the next run goes on with other rows and
    a run that is killed has either moved it for all of its rows or for none.
    The runs of one batch share out its work list in the order of run_at; none
    of them meets a row that another one has.
    """

    def check(batch: DataFrame, epoch: int) -> None:
        orders = sorted(batch.collect(), key=lambda r: r["run_at"])  # orders, not data: a handful of rows
        rows = index.read(before=epoch + 1)
        if rows is None or not orders:
            return
        upto, stamp = 0, F.lit(None).cast("timestamp")
        for r in orders:
            stamp = F.when((F.col("nth") > upto) & (F.col("nth") <= upto + r["n"]), F.lit(r["run_at"])).otherwise(stamp)
            upto += r["n"]
        # The list is cut to what the runs ask for before it is numbered.
        order = Window.orderBy(F.asc_nulls_first("verified_at"), "url")
        due = upkeep.needs_verify(rows, upto).withColumn("nth", F.row_number().over(order)).withColumn("at", stamp)
        judged = content.verdicts(due, reads.join(due.select("url"), "url", "left_semi")).join(due.select("url", "at"), "url").select("url", "at", "verdict")
        index.merge(epoch + 1, judged, _verified)

    query = runs.writeStream.foreachBatch(check).option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return index.read()


def _verified(old: DataFrame, new: DataFrame) -> DataFrame:
    moved = {"verified_at": F.coalesce("at", "verified_at"), "verify_outcome": F.coalesce("verdict", "verify_outcome")}
    return old.join(new, "url", "left").select(*(moved.get(c, F.col(c)).alias(c) for c in old.columns))
