"""Counters, quotas and notices in state: ties, nulls, restarts, failed deliveries, what runs out."""

import datetime as dt

from pyspark.sql import functions as F

from eventloom.streaming import counters as C

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(hours: float) -> dt.datetime:
    return START + dt.timedelta(hours=hours)


def run(spark, tmp_path, schema, build, *arrivals):
    """All rows after each arrival was streamed by a run of its own."""
    for i, rows in enumerate(arrivals):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = C.drain(build(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "s"))
    return got


def test_counters_go_after_their_last_hit(spark, tmp_path):
    views = lambda s: C.counters(s, "id", "ts", keep_days=2)
    first = [("a", at(1)), ("a", at(1)), ("a", at(13)), ("b", at(1)), (None, at(1)), ("a", None)]
    got = run(spark, tmp_path, "id string, ts timestamp", views, first, [("c", at(30)), ("a", at(50)), ("a", at(51.5))], [("c", at(60))])
    rows = {(r["id"], r["day"]): (r["n"], r["total"], r["kept"]) for r in C.latest(got, ["id", "day"]).collect()}
    # 13:00 UTC is still the same day in Tokyo; b's only hit was 59 hours before the end, a's last of that day 47
    assert rows[("b", "2024-01-01")] == (1, 1, False)
    assert rows[("a", "2024-01-01")] == (3, 3, True)
    assert rows[("a", "2024-01-03")] == (2, 5, True)
    assert [rows[("c", d)][0] for d in ("2024-01-02", "2024-01-03")] == [1, 1]
    assert len(rows) == 5


def test_an_empty_arrival_gives_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, "id string, ts timestamp", lambda s: C.counters(s, "id", "ts"), []).count() == 0


def test_quota_counts_refused_calls_too(spark, tmp_path):
    first = [("k", i, at(h)) for i, h in ((5, 2), (4, 2), (1, 9), (9, 1))] + [("k", 7, None), (None, 8, at(1))]
    later = [("k", 20, at(24)), ("k", 21, at(24 * 31)), ("j", 22, at(24 * 31))]
    got = run(spark, tmp_path, "key string, id long, ts timestamp", lambda s: C.within_quota(s, "key", "id", "ts", 3), first, later)
    rows = {(r["key"], r["call"]): (r["month"], r["used"], r["granted"]) for r in got.collect()}
    assert {k: v[1] for k, v in rows.items()} == {("k", 9): 1, ("k", 4): 2, ("k", 5): 3, ("k", 1): None, ("k", 20): None, ("k", 21): 1, ("j", 22): 1}
    assert rows[("k", 21)] == ("2024-02", 1, True) and not rows[("k", 20)][2]


def test_notices_wait_unless_delivery_failed(spark, tmp_path):
    ask = lambda k, i, h: (k, i, at(h), False)
    fail = lambda k, i, h: (k, i, at(h), True)
    first = [ask("a", 1, 0), ask("a", 2, 5), ask("b", 3, 0), fail("b", 3, 4), ask("b", 4, 3), ask("b", 5, 4), ("c", 6, None, False)]
    # 2 was never sent, so its report releases nothing; 5 holds b until its own report, which names it
    later = [fail("a", 2, 6), ask("a", 7, 23.9), ask("a", 8, 24), fail("b", 3, 10), ask("b", 9, 11), ("b", 5, at(12), True), ask("b", 10, 12.5), ("a", 11, at(12.6), None)]
    build = lambda s: C.notices(s.withColumn("action", F.lit("clash")), ["k"], "id", "ts", "failed", late="2 days")
    got = run(spark, tmp_path, "k string, id long, ts timestamp, failed boolean", build, first, later)
    want = {1: "send", 2: "duplicate", 3: "send", 4: "duplicate", 5: "send", 7: "duplicate", 8: "send", 9: "duplicate", 10: "send", 11: "duplicate"}
    assert {int(r["request"]): r["action"] for r in got.collect()} == want
    assert got.select("batch").distinct().count() == 2


class Handle:
    """Stands for Spark's handle: keeps one value and the timers, and counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.append(ms)

    def fire(self, processor, watermark):
        """What is given when the timers up to the watermark go off, in order."""
        due, self.timers = sorted(t for t in self.timers if t <= watermark), [t for t in self.timers if t > watermark]
        now = type("Times", (), {"getCurrentWatermarkInMs": lambda self: watermark})()
        return [r for t in due for r in processor.handleExpiredTimer(("a",), now, type("Expired", (), {"getExpiryTimeInMs": lambda self, t=t: t})())]


def test_a_counter_asks_its_state_once_however_many_days(spark):
    handle, counter = Handle(), C._Counter(["id", "day", "n", "total", "last", "kept"], 10 * C.DAY)
    counter.init(handle)
    hit = lambda d, n=1: {"day": f"{d:02}", "n": n, "at": d * C.DAY}
    assert len(list(counter.handleInputRows(("a",), [hit(d) for d in range(20)], None))) == 20
    assert handle.calls == 3 and handle.timers == [10 * C.DAY // 1000]
    list(counter.handleInputRows(("a",), [hit(0), {"day": "03", "n": 2, "at": 12 * C.DAY}], None))
    gone = handle.fire(counter, 15 * C.DAY // 1000)
    assert [(r.day, r.n, r.total, r.kept) for r in gone] == [("00", 2, 23, False), ("01", 1, 23, False), ("02", 1, 23, False), ("04", 1, 23, False), ("05", 1, 23, False)]
    assert handle.timers == [16 * C.DAY // 1000] and handle.calls == 8
    assert len(handle.fire(counter, 60 * C.DAY // 1000)) == 15 and handle.timers == [] and handle.value[3] == 23


def test_a_notice_has_one_timer(spark):
    handle, notice = Handle(), C._Notice(["k", "request", "action"], 24 * C.DAY // 24)
    notice.init(handle)
    ask = lambda i, at, failed=False: {"at": at * C.DAY, "failed": failed, "request": str(i)}
    for day in range(5):
        assert [r.action for r in notice.handleInputRows(("a",), [ask(day, day)], None)] == ["send"]
    assert handle.calls == 11 and handle.timers == [C.DAY // 1000 + 1]
    handle.fire(notice, 4 * C.DAY // 1000)
    assert handle.value and handle.timers == [5 * C.DAY // 1000 + 1]
    handle.fire(notice, 6 * C.DAY // 1000)
    assert handle.value is None and handle.timers == []
