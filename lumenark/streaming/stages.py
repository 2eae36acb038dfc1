"""A stage job as it runs: its events as a stream, and each item's state after every one, kept by item.

Events (EVENTS) come in any order: `item` (an item, its size), `source` (candidate number `place` can be read at `path`), `started` (a copy of
`path` began), `copied` (it gave size and hash), `there` (the destination has a file of size and hash). What is known of an item is Spark's
state, so a stopped stream goes on from its checkpoint; what that means is judged as a pass does (staging.judged), so that the last row of each
item is what staging.run_pass() says of the same facts. A copy that began and says nothing for `patience` seconds is stalled.

Give the query an interval, or run it once; with availableNow it does not end, as timers ask for one more batch each time. The session needs spark.sql.streaming.stateStore.providerClass set to the RocksDB provider (ROCKSDB).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenark.operators import staging

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "sha256 string, kind string, place int, path string, size long, hash string"
KNOWN = "size long, place int, src string, old_size long, old_sha string, started string, due long"
FACTS = "sha256 string, size long, _src string, _size long, _sha string, _old_size long, _old_sha string, stalled boolean"
NOTHING = (None,) * len(KNOWN.split(", "))


def _plain(value):
    return None if pd.isna(value) else value


class Items(StatefulProcessor):
    """What is known of each item: the readable source of the lowest number, each path's copy, the destination, and a copy under way."""

    def __init__(self, patience: float):
        self.patience = int(patience * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", KNOWN)
        self.copies = handle.getMapState("copies", "path string", "size long, sha string")

    def _row(self, key: tuple, known: tuple, stalled: bool) -> pd.DataFrame:
        size, _, src, old_size, old_sha, _, _ = known
        copy = self.copies.getValue((src,)) if src is not None and self.copies.containsKey((src,)) else (None, None)
        return pd.DataFrame([(key[0], size, src, copy[0], copy[1], old_size, old_sha, stalled)], columns=[c.split()[0] for c in FACTS.split(", ")]).astype({c: "Int64" for c in ("size", "_size", "_old_size")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size, place, src, old_size, old_sha, started, due = self.known.get() if self.known.exists() else NOTHING
        for frame in rows:
            for e in frame.itertuples():
                number, path = _plain(e.size), _plain(e.path)
                number = None if number is None else int(number)
                if e.kind == "item":
                    size = number
                elif e.kind == "source" and (place is None or (int(e.place), path) < (place, src)):
                    place, src = int(e.place), path
                elif e.kind == "there":
                    old_size, old_sha = number, _plain(e.hash)
                elif e.kind == "copied":
                    self.copies.updateValue((path,), (number, _plain(e.hash)))
                    started, due = (None, None) if started == path else (started, due)
                elif e.kind == "started" and not self.copies.containsKey((path,)):
                    started, due = path, timerValues.getCurrentProcessingTimeInMs() + self.patience
                    self.handle.registerTimer(due)
        known = (size, place, src, old_size, old_sha, started, due)
        self.known.update(known)
        yield self._row(key, known, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.known.get() if self.known.exists() else NOTHING
        if known[5] is not None and known[6] == expiredTimerInfo.getExpiryTimeInMs():
            yield self._row(key, known, True)

    def close(self) -> None:
        pass


def states(events: DataFrame, verify: bool, dry_run: bool = False, patience: float = 600) -> DataFrame:
    """sha256, size, state, verify_status, error, used_path, verified_sha, stalled of each item that an event tells of, whenever one does (output mode
    update). An item whose own event has not come yet has no size and is pending. events: a stream of EVENTS."""
    facts = events.groupBy("sha256").transformWithStateInPandas(statefulProcessor=Items(patience), outputStructType=FACTS, outputMode="Update", timeMode="ProcessingTime")
    none = F.lit(None).cast("string")
    judged = staging.judged(facts.withColumns({"state": F.lit("pending"), "verify_status": none, "error": none, "used_path": none, "verified_sha": none}), verify, dry_run)
    early = F.col("size").isNull()  # nothing can be said yet
    kept = {c: F.when(~early, F.col(c)) for c in ("verify_status", "error", "used_path", "verified_sha")}
    return judged.withColumns({"state": F.when(early, "pending").otherwise(F.col("state")), **kept}).select("sha256", "size", "state", "verify_status", "error", "used_path", "verified_sha", "stalled")
