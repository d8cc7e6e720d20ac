"""A cache with expiry and a bound on its entries, as state of a stream.

Each owner has a cache.  A lookup (owner, key, ts, id) is a hit if the key's entry is younger than ttl; else the key is stored
anew with the lookup's time, after the oldest entry was put out if the cache is full.  A hit doesn't renew an entry.

Lookups of one time are taken by id.  The state of an owner is its entries, `capacity` at most; when the watermark passes the
expiry of all of them a timer drops the state, so owners who don't come back cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_SECONDS, CAPACITY = 300, 500
LOOKUPS = "owner long, id long, hit boolean, put_out string"


def look_up(entries: list[tuple[str, int]], rows: list[tuple[str, int, int]], ttl: int, capacity: int) -> tuple[list[tuple[str, int]], list[tuple[int, bool, str | None]]]:
    """Entries (key, microseconds) in the order they were stored, after rows (key, microseconds, id), and (id, hit, put out)."""
    kept, out = dict(entries), []
    for key, at, number in rows:
        hit, gone = key in kept and at - kept[key] < ttl, None
        if not hit:
            kept.pop(key, None)
            if len(kept) >= capacity:
                gone = next(iter(kept))
                del kept[gone]
            kept[key] = at
        out.append((number, hit, gone))
    return list(kept.items()), out


def cached_lookups(lookups: DataFrame, ttl_seconds: int = TTL_SECONDS, capacity: int = CAPACITY, watermark: str = "1 hour") -> DataFrame:
    """(owner, id, hit, put_out) of each lookup of a stream or table (owner long, key string, ts timestamp, id long)."""
    ttl = ttl_seconds * 1_000_000
    rows = lookups.select("owner", "key", "id", F.col("ts").cast("timestamp").alias("ts")).withColumn("at", F.unix_micros("ts")).where("owner is not null and key is not null and ts is not null")

    def run(owner: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(batches)).sort_values(["at", "id"])
        before = list(zip(*state.get)) if state.exists else []
        after, found = look_up(before, list(batch[["key", "at", "id"]].itertuples(index=False, name=None)), ttl, capacity)
        state.update(tuple(map(list, zip(*after))))
        last = max(at for _, at in after) + ttl
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"owner": owner[0], "id": [x[0] for x in found], "hit": [x[1] for x in found], "put_out": [x[2] for x in found]})

    if lookups.isStreaming:
        rows = rows.withWatermark("ts", watermark)
        return rows.groupBy("owner").applyInPandasWithState(run, LOOKUPS, "keys array<string>, at array<long>", "append", GroupStateTimeout.EventTimeTimeout)

    def whole(owner: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["at", "id"])
        _, found = look_up([], list(batch[["key", "at", "id"]].itertuples(index=False, name=None)), ttl, capacity)
        return pd.DataFrame({"owner": owner[0], "id": [x[0] for x in found], "hit": [x[1] for x in found], "put_out": [x[2] for x in found]})

    return rows.groupBy("owner").applyInPandas(whole, LOOKUPS)
