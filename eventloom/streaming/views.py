"""View counting on a stream: filters, a first-accept window per key in state, daily counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Words of user agents that are no people.
BOTS = r"bot|crawl|spider|slurp|preview|facebookexternalhit|embedly|quora link|whatsapp/|headless|phantom|puppeteer|playwright|selenium|lighthouse|pagespeed|gtmetrix|pingdom|uptime|monitor|curl|wget|python|httpclient|okhttp|java/|go-http|node-fetch|axios"


def is_bot(agent: Column) -> Column:
    return agent.isNull() | (F.trim(agent) == "") | agent.rlike(f"(?i)(?:{BOTS})")


def accepted(views: DataFrame, keys: Sequence[str], ts: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """(keys, ts) of the views that count: the first of a key opens a window that later ones do not extend.

    A key's state is one time; it goes when the watermark has passed its window.
    """
    schema = StructType([views.schema[k] for k in [*keys, ts]])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begin = state.get[0] if state.exists else None
        times = sorted(t for part in parts for t in part[ts])
        taken = []
        for t in times:
            micros = t.value // 1000
            if begin is None or micros >= begin + seconds * 1_000_000:
                begin = micros
                taken.append((*key, t))
        state.update((begin,))
        state.setTimeoutTimestamp(max(begin // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(taken, columns=[*keys, ts])

    stamped = views.select(*keys, ts).withWatermark(ts, late)
    return stamped.groupBy(*keys).applyInPandasWithState(step, schema, "begin bigint", "append", GroupStateTimeout.EventTimeTimeout)


def daily_counts(batch: DataFrame, id_: str, ts: str) -> DataFrame:
    """(id, day, n), to be added to a counter table in ``foreachBatch``."""
    return batch.groupBy(id_, F.to_date(F.from_utc_timestamp(ts, "Asia/Tokyo")).alias("day")).agg(F.count("*").alias("n"))


def windowed(views: DataFrame, id_: str, ts: str, length: str, late: str) -> DataFrame:
    """Counts per event-time window with a watermark."""
    return views.withWatermark(ts, late).groupBy(F.window(ts, length), id_).agg(F.count("*").alias("n")).select(id_, F.col("window.start").alias("begins"), "n")
