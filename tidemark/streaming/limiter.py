"""ST1, ST2: the limiter as a stateful stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import limits


def rocks(spark: SparkSession) -> None:
    """State that may be larger than memory; queries started from now on keep it in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Waiting requests of a key beyond which they are put away by slot.
PART = 2000


class Limiter(StatefulProcessor):
    """The times of a key's allowed requests, ``limit`` at most, and requests that wait for their turn.

    With ``slot`` (microseconds) a request waits until all of its slot are there
    and is decided in order of time and id; a timer of the requests' own time
    ends the slot. Without it each trigger is decided at once.

    A key with few requests is one value, read and written once a trigger. What
    waits beyond ``PART`` requests goes into parts by slot, which are written
    once, read once and not touched in between.
    """

    def __init__(self, limit: int | None, window: int, slot: int | None, key: str, id: str, id_kind: str):
        self.limit, self.window, self.slot, self.key, self.id, self.id_kind = limit, window, slot, key, id, id_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = Row(self.key, self.id, "_at", "allowed", "retry_after")
        requests = f"array<struct<at: long, id: {self.id_kind}>>"
        self.state = handle.getValueState("state", f"hits array<long>, waiting {requests}, parted boolean")
        self.parts = handle.getMapState("parts", "slot long, part int", f"requests {requests}")
        self.counts = handle.getMapState("counts", "slot long", "parts int")

    def _now(self) -> tuple[deque, list[tuple], bool]:
        found = self.state.get()
        return (deque(found[0]), [tuple(r) for r in found[1]], found[2]) if found else (deque(), [], False)

    def _put(self, hits: deque, waiting: list[tuple], parted: bool) -> None:
        self.state.update((list(hits), waiting, parted))

    def _ends(self, slot: int) -> None:
        self.handle.registerTimer(-(-(slot + 1) * self.slot // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        hits, waiting, parted = self._now()
        asked = [(r["_at"], r[self.id]) for r in rows]
        if not self.slot:
            before = list(hits)
            yield from self._decide(key, hits, asked)
            if list(hits) != before:
                self._put(hits, [], False)
                self._quiet(hits)
            return
        known = min(at // self.slot for at, _ in waiting) if waiting else None
        waiting += asked
        if len(waiting) <= PART:
            first = min(at // self.slot for at, _ in waiting)
            if known is None or first < known:
                self._ends(first)
        else:
            dealt: dict[int, list[tuple]] = {}
            for r in waiting:
                dealt.setdefault(r[0] // self.slot, []).append(r)
            for slot, requests in dealt.items():
                n = self.counts.getValue((slot,))[0] if self.counts.containsKey((slot,)) else 0
                self.parts.updateValue((slot, n), (requests,))
                self.counts.updateValue((slot,), (n + 1,))
                if not n:
                    self._ends(slot)
            waiting, parted = [], True
        self._put(hits, waiting, parted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        hits, waiting, parted = self._now()
        # all slots that are over, in their order, whichever timer comes first
        over = max(at, timerValues.getCurrentWatermarkInMs() * 1000)
        due: dict[int, list[tuple]] = {}
        rest = []
        for r in waiting if self.slot else []:
            if (r[0] // self.slot + 1) * self.slot <= over:
                due.setdefault(r[0] // self.slot, []).append(r)
            else:
                rest.append(r)
        put_away = {x[0] for x in self.counts.keys()} if parted else set()
        ready = {x for x in put_away if (x + 1) * self.slot <= over}
        for slot in sorted(ready.union(due)):
            requests = due.get(slot, [])
            if slot in ready:
                for n in range(self.counts.getValue((slot,))[0]):
                    requests += map(tuple, self.parts.getValue((slot, n))[0])
                    self.parts.removeKey((slot, n))
                self.counts.removeKey((slot,))
            yield from self._decide(key, hits, requests)
        if due or ready:
            self._put(hits, rest, put_away != ready)
            if rest:
                self._ends(min(x // self.slot for x, _ in rest))
            self._quiet(hits)
        elif hits and not waiting and not put_away and max(hits) <= at - self.window:
            self.state.clear()

    def _quiet(self, hits: deque) -> None:
        """What is quiet for two windows is forgotten."""
        if hits:
            self.handle.registerTimer((hits[-1] + 2 * self.window) // 1000 + 1)

    def _decide(self, key, hits: deque, requests: list[tuple]) -> Iterator[Row]:
        for at, ident in sorted(requests, key=lambda r: (r[0], r[1] is not None, r[1])):
            yes, wait = limits.check(hits, self.limit, self.window, at, limits.SECOND)
            yield self.row(key[0], ident, at, yes, wait)

    def close(self) -> None:
        pass


def limited(
    requests: DataFrame,
    limit: int | None,
    window: float = limits.HOUR,
    key: str = "key",
    time: str = "ts",
    id: str = "id",
    late: str = "1 hour",
    slot: float | None = None,
) -> DataFrame:
    """ST1, ST2 as a stream: the state of a key is the times of its allowed requests, ``limit`` at most.

    Requests that are ``late`` or more behind go, as do those without a time.
    Without ``slot`` a trigger's requests are decided at once, in order of time
    and id: right if triggers follow each other in time; a key's requests of a
    trigger are in memory. With ``slot`` (seconds) a request is decided once no
    earlier one can come any more, so the result is that of ``limits.admit``
    however requests are dealt into triggers; what waits is in RocksDB, and in
    memory are the requests of a key and slot. Null keys are a key, whole numbers
    of any size stay exact, and a key's state goes when it was quiet for two windows.
    """
    rocks(requests.sparkSession)
    kinds = dict(requests.dtypes)
    wide = limits.micros(slot) if slot else None
    if wide is not None and (wide <= 0 or wide % 1000):
        raise ValueError("a slot is a whole number of milliseconds")
    processor = Limiter(limit, limits.micros(window), wide, key, id, kinds[id])
    rows = requests.where(F.col(time).isNotNull()).select(key, id, time, F.unix_micros(F.col(time).cast("timestamp")).alias("_at"))
    out = rows.withWatermark(time, late).groupBy(key).transformWithState(
        processor, f"`{key}` {kinds[key]}, `{id}` {kinds[id]}, _at long, allowed boolean, retry_after int", "append", "eventTime"
    )
    return out.select(key, id, F.timestamp_micros("_at").cast(kinds[time]).alias(time), "allowed", "retry_after")
