"""Counters that live as long as they are hit, monthly quotas and notices sent once, each in keyed state.

All times are those of the rows (micros since 1970 inside), never of the clock, so that a stream that
is run again gives the same rows. State goes by event-time timers once the watermark has passed them.
Rows without key, id or time have no row in the result: they are not counted, not granted, not sent.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000
ZONE = "Asia/Tokyo"


def _schema(df: DataFrame, names: Sequence[str], **more) -> StructType:
    return StructType([df.schema[n] for n in names] + [StructField(n, t) for n, t in more.items()])


def _whole(df: DataFrame, *names: str) -> DataFrame:
    return df.where(" and ".join(f"`{n}` is not null" for n in names))


class _Counter(StatefulProcessor):
    """Per id in one value: its kept days with count and last hit, the total, which stays, and when its timer is set for.

    An id has one timer, for the first of its days to run out, which is set anew when it has gone off. One value and one
    timer are read and set once a micro-batch; a call for each day would be most of the work.
    """

    def __init__(self, names: Sequence[str], keep: int) -> None:
        self.row, self.keep = Row(*names), keep

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "days array<string>, counts array<bigint>, lasts array<bigint>, total bigint, timer bigint")

    def _read(self) -> tuple[dict[str, tuple[int, int]], int, int | None]:
        days, counts, lasts, total, timer = self.state.get() or ((), (), (), 0, None)
        return dict(zip(days, zip(counts, lasts, strict=True), strict=True)), total, timer

    def _write(self, kept: dict[str, tuple[int, int]], total: int, timer: int | None) -> None:
        """Sets a timer for the first day to run out, unless one will go off before."""
        first = min((self._timer(last) for _, last in kept.values()), default=None)
        if first is not None and (timer is None or first < timer):
            self.handle.registerTimer(first)
            timer = first
        self.state.update((list(kept), [n for n, _ in kept.values()], [last for _, last in kept.values()], total, timer))

    def _timer(self, last: int) -> int:
        return (last + self.keep) // 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        found: dict[str, tuple[int, int]] = {}
        for r in rows:
            n, last = found.get(r["day"], (0, 0))
            found[r["day"]] = (n + r["n"], max(last, r["at"]))
        kept, total, timer = self._read()
        total += sum(n for n, _ in found.values())
        for day, (n, last) in found.items():
            old_n, old_last = kept.get(day, (0, last))
            kept[day] = (n + old_n, max(last, old_last))
            yield self.row(*key, day, kept[day][0], total, kept[day][1], True)
        self._write(kept, total, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """All days go whose time is up by the watermark, as a timer of their own would have gone off, too."""
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        kept, total, _ = self._read()
        for day, (n, last) in list(kept.items()):
            if self._timer(last) <= now:
                del kept[day]
                yield self.row(*key, day, n, total, last, False)
        self._write(kept, total, None)


def counters(views: DataFrame, id_: str, ts: str, keep_days: int = 40, late: str = "1 hour") -> DataFrame:
    """(id, day, n, total, last, kept): the new state of each counter that was hit or that has run out.

    A day's count is kept for ``keep_days`` after its last hit; later rows of an (id, day) replace
    earlier ones (``latest``). Hits are added up before the shuffle, so that an id with a third of
    all views brings a row per Arrow batch and day, and state holds one pair per id and kept day.
    """
    day = F.date_format(F.from_utc_timestamp(F.col(ts), ZONE), "yyyy-MM-dd")
    hits = _whole(views.select(F.col(id_), F.col(ts).cast("timestamp").alias("hit"), day.alias("day")), id_, "hit")
    schema = StructType([views.schema[id_], *_schema(hits, ["day", "hit"]).fields, StructField("n", LongType())])

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.groupby([id_, "day"], as_index=False).agg(hit=("hit", "max"), n=("hit", "size"))

    folded = hits.mapInPandas(fold, schema).withWatermark("hit", late).withColumn("at", F.unix_micros("hit"))
    out = _schema(views, [id_], day=StringType(), n=LongType(), total=LongType(), last=LongType(), kept=BooleanType())
    return folded.groupBy(id_).transformWithState(_Counter(out.names, keep_days * DAY), out, "Update", "EventTime")


class _Quota(StatefulProcessor):
    """Per key and month: how many calls there were, the refused ones among them."""

    def __init__(self, names: Sequence[str], limit: int, keep: int) -> None:
        self.row, self.limit, self.keep = Row(*names), limit, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        """The earliest calls of a micro-batch take what is left; no more than that many are held."""
        state = self.used.get()
        used = state[0] if state else 0
        left, n, begin, first = max(self.limit - used, 0), 0, None, []
        for r in rows:
            call = (r["at"], r["call"])
            n, begin = n + 1, call[0] if begin is None else min(begin, call[0])
            insort(first, call)
            if len(first) > left:
                yield self.row(*key, first.pop()[1], None, False)
        for i, (_, call) in enumerate(first):
            yield self.row(*key, call, used + i + 1, True)
        self.used.update((used + n,))
        if state is None and begin is not None:
            self.handle.registerTimer((begin + self.keep) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.used.clear()
        return iter(())


def within_quota(calls: DataFrame, key: str, id_: str, ts: str, limit: int, late: str = "1 hour") -> DataFrame:
    """(key, month, call, used, granted) per call: the first ``limit`` of a key's month are granted and numbered.

    Equal times by ascending id. A refused call has no number. The counter goes 40 days after the month's
    first call. A key's calls of one micro-batch pass one task, of which it holds as many as may be granted.
    """
    month = F.date_format(F.from_utc_timestamp(F.col(ts), ZONE), "yyyy-MM")
    rows = _whole(calls.select(key, month.alias("month"), F.col(id_).alias("call"), F.col(ts).cast("timestamp").alias("hit")), key, "call", "hit")
    stamped = rows.withWatermark("hit", late).withColumn("at", F.unix_micros("hit"))
    out = _schema(stamped, [key, "month", "call"], used=LongType(), granted=BooleanType())
    return stamped.groupBy(key, "month").transformWithState(_Quota(out.names, limit, 40 * DAY), out, "Update", "EventTime")


class _Notice(StatefulProcessor):
    """Per notice: until when it is held back, and the request that holds it; one timer, set anew if it goes off too early."""

    def __init__(self, names: Sequence[str], hold: int) -> None:
        self.row, self.length = Row(*names), hold

    def init(self, handle) -> None:
        self.handle = handle
        self.hold = handle.getValueState("hold", "until bigint, request string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state = self.hold.get()
        until, holder = state or (None, None)
        for at, asked, request in sorted((r["at"], not r["failed"], r["request"]) for r in rows):
            if not asked:  # a report of failure: releases the hold that it names, no other
                if holder == request and until is not None:
                    until = min(until, at)
            elif until is None or at >= until:
                until, holder = at + self.length, request
                yield self.row(*key, request, "send")
            else:
                yield self.row(*key, request, "duplicate")
        if until is None or (state and tuple(state) == (until, holder)):
            return
        self.hold.update((until, holder))
        if not state:
            self.handle.registerTimer(until // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state = self.hold.get()
        if state and state[0] // 1000 + 1 > max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()):
            self.handle.registerTimer(state[0] // 1000 + 1)
        elif state:
            self.hold.clear()
        return iter(())


def notices(requests: DataFrame, keys: Sequence[str], id_: str, ts: str, failed: str, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """(keys, request, action) per request: ``send``, or ``duplicate`` if the same notice went out within ``hours``.

    A row whose ``failed`` is true is no request but a report that the delivery of the request of that
    id failed at its time: the notice may be sent again from then on. Reports of requests that were not
    sent, or that hold nothing any more, change nothing; at equal times reports come first, then
    smaller ids (as text). A notice's rows of one micro-batch are sorted in one task.
    """
    rows = requests.select(*keys, F.col(id_).cast("string").alias("request"), F.col(ts).cast("timestamp").alias("hit"), F.coalesce(failed, F.lit(False)).alias("failed"))
    stamped = _whole(rows, *keys, "request", "hit").withWatermark("hit", late).withColumn("at", F.unix_micros("hit"))
    out = _schema(stamped, keys, request=StringType(), action=StringType())
    return stamped.groupBy(*keys).transformWithState(_Notice(out.names, hours * DAY // 24), out, "Update", "EventTime")


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what has arrived, ends, and gives all its rows so far, with the number of their micro-batch.

    Called again with the same folder (shared by driver and executors) it goes on from its checkpoint.
    Every micro-batch overwrites a folder of its own: one that is repeated after a loss counts once.
    """
    spark, out = stream.sparkSession, f"{folder}/out"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        run.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)


def latest(rows: DataFrame, keys: Sequence[str], by: str | Column = "batch") -> DataFrame:
    """The last row of each key by the number of its micro-batch."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r")).select(*keys, "r.*")
