"""Keyed state over streams of snapshots and of deliveries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The processors need the RocksDB state store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STANDING = "period string, world bigint, european bigint, score bigint, qualified boolean"
CHANGES = "key string, period string, kind string, from_value bigint, to_value bigint, item string"
#: What is compared field by field, with the kind of change each gives.
COMPARED = ("world", "european", "score", "qualified")


class StandingDiff(StatefulProcessor):
    """The last standing of a key, and its last known results, to changes.

    A row of another period than the one seen last gives a change for each field that is known on both sides and differs; the fields are
    then replaced, unknown ones too. Results that the stored list lacks are told in any period; a null list (not read)
    keeps the stored one, an empty one empties it. The first row of a key tells nothing. Rows of a key that come in one batch
    are taken by period and then by their values; only they are held, as plain rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STANDING)
        self.results = handle.getListState("results", "item string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.last.get() if self.last.exists() else None
        known = before = None
        for row in sorted(rows, key=lambda r: (r.period, *((v is not None, v) for v in (*(r[c] for c in COMPARED), r.results)))):
            now = (row.period, *(row[c] for c in COMPARED))
            if state is not None and row.period != state[0]:
                for kind, was, value in zip(COMPARED, state[1:], now[1:], strict=True):
                    if was is not None and value is not None and was != value:
                        yield Row(key=key[0], period=row.period, kind=kind, from_value=int(was), to_value=int(value), item=None)
            if row.results is not None:
                if known is None:
                    known = before = [r[0] for r in self.results.get()] if state is not None and self.results.exists() else []
                if state is not None:
                    seen = set(known)
                    for item in row.results:
                        if item not in seen:
                            yield Row(key=key[0], period=row.period, kind="result", from_value=None, to_value=None, item=item)
                known = list(row.results)
            state = now
        self.last.update(state)
        if known is not None and known != before:
            self.results.put([(item,) for item in known]) if known else self.results.clear()

    def close(self) -> None:
        pass


def standing_changes(stream: DataFrame) -> DataFrame:
    """Changes (key, period, kind, from_value, to_value, item) of a stream of snapshots (key, period, world, european, score, qualified,
    results). Rows without a key or period cannot be placed and are left out."""
    rows = stream.where("key is not null and period is not null").select("key", "period", *COMPARED, "results")
    return rows.groupBy("key").transformWithState(StandingDiff(), CHANGES, "append", "None")


class OwedDeliveries(StatefulProcessor):
    """What could not be sent, by key: each failed try keeps it for `keep` microseconds more; one left alone for longer goes, by a
    timer or when the key's next try comes, whichever is first, at the same stated time."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.owed = handle.getValueState("owed", "since bigint, last bigint, tries bigint")

    def _told(self, key, what: str, at: int, owed: tuple) -> Row:
        return Row(user_id=key[0], kind=key[1], what=what, at_us=at, since_us=owed[0], tries=owed[2])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        owed = before = self.owed.get() if self.owed.exists() else None
        for row in sorted(rows, key=lambda r: (r.at_us, r.status)):
            if owed and row.at_us - owed[1] > self.keep:
                yield self._told(key, "expired", owed[1] + self.keep, owed)
                owed = None
            if row.status == "sent":
                if owed:
                    yield self._told(key, "sent", row.at_us, owed)
                owed = None
            else:
                owed = (owed[0], row.at_us, owed[2] + 1) if owed else (row.at_us, row.at_us, 1)
        if owed == before:
            return
        if before:
            self.handle.deleteTimer(self._due(before))
        if owed:
            self.owed.update(owed)
            self.handle.registerTimer(self._due(owed))
        else:
            self.owed.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        owed = self.owed.get() if self.owed.exists() else None
        if owed and self._due(owed) == expiredTimerInfo.getExpiryTimeInMs():
            yield self._told(key, "expired", owed[1] + self.keep, owed)
            self.owed.clear()

    def _due(self, owed: tuple) -> int:
        return -(-(owed[1] + self.keep) // 1000)

    def close(self) -> None:
        pass


OWED = "user_id bigint, kind string, what string, at_us bigint, since_us bigint, tries bigint"


def owed_deliveries(stream: DataFrame, ts: str, late: str, days: int = 7) -> DataFrame:
    """What became of failed deliveries, from a stream of tries (user_id, kind, status: sent or else failed, and the column ts): (user_id, kind, what, at_us,
    since_us, tries), what being sent after failed tries, or expired when none came for `days`. Times in microseconds; rows that lack a key or time are left out."""
    rows = stream.where(F.col(ts).isNotNull() & F.col("user_id").isNotNull() & F.col("kind").isNotNull()).withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    rows = rows.select("user_id", "kind", F.coalesce("status", F.lit("failed")).alias("status"), F.unix_micros("_t").alias("at_us"), "_t")
    return rows.groupBy("user_id", "kind").transformWithState(OwedDeliveries(days * 86_400_000_000), OWED, "append", "EventTime")
