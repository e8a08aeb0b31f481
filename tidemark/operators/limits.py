"""A sliding-window limiter: refused requests don't count against the limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3600.0
#: Times are whole microseconds, so that a hit leaves the window at the very moment.
SECOND = 1_000_000


def check(hits: deque, limit: int | None, window: float, now: float, second: int = 1) -> tuple[bool, int | None]:
    """ST1, ST2: a request at ``now`` against the times of those allowed; allowed ones are added.

    A hit counts while it is younger than the window. The second value is how
    many seconds (of ``second`` units) to wait, one at least. No limit, or one
    of zero, allows all.
    """
    if limit is None or limit <= 0:
        return True, None
    while hits and hits[0] <= now - window:
        hits.popleft()
    if len(hits) >= limit:
        return False, max(1, int(-((now - hits[0] - window) // second)))
    hits.append(now)
    return True, None


def micros(seconds: float) -> int:
    return round(seconds * SECOND)


def client(forwarded: Column, remote: Column) -> Column:
    """ST2: who asks for a demo key: the first address that was forwarded, else the remote one."""
    first = F.trim(F.split(forwarded, ",")[0])
    return F.concat(F.lit("mint:"), F.when(forwarded.isNotNull() & (forwarded != ""), first).otherwise(F.coalesce(remote, F.lit("unknown"))))


def admit(requests: DataFrame, limit: int | None, window: float = HOUR, key: str = "key", time: str = "ts", id: str = "id") -> DataFrame:
    """ST1, ST2 (W15) over all requests: with ``allowed`` and ``retry_after``.

    A key's requests are read in order of time and id and never held: the state
    is ``limit`` times, however many requests a key makes. A null key is a key
    like any other. A request without a time can't be judged: both are null.
    """
    ordered = requests.repartition(key).withColumn("_at", F.unix_micros(F.col(time).cast("timestamp"))).sortWithinPartitions(key, "_at", id)
    columns, wide = requests.columns, micros(window)
    place, at = columns.index(key), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hits = (), deque()
        for rows in batches:
            allowed, wait = [], []
            for k, t in zip(rows.column(place).to_pylist(), rows.column(at).to_pylist()):
                if (k,) != now:
                    now, hits = (k,), deque()
                yes, seconds = (None, None) if t is None else check(hits, limit, wide, t, SECOND)
                allowed.append(yes)
                wait.append(seconds)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:at], pa.array(allowed, pa.bool_()), pa.array(wait, pa.int32())], names=[*columns, "allowed", "retry_after"]
            )

    kinds = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes)
    return ordered.mapInArrow(run, f"{kinds}, allowed boolean, retry_after int")
