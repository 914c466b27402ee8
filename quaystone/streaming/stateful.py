"""Keyed state over streams: rate limits, repair queues, audit chains.

State is bounded by the keys that are active: timers drop what has been idle. The steps equal the batch folds in
``quaystone.operators``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def token_bucket(requests: DataFrame, rate: float, burst: float, idle_ms: int = 600_000, by: str = "access_key") -> DataFrame:
    """Each request with whether it passes. A key's bucket is forgotten after ``idle_ms`` without requests."""

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["time", "req_id"], kind="stable")
        tokens, last = state.get if state.exists else (float(burst), None)
        passed = []
        for at in rows["time"].astype("int64") / (1e9 if rows["time"].dtype == "datetime64[ns]" else 1e6):
            tokens = min(float(burst), tokens + (0.0 if last is None else (at - last) * rate))
            last = at
            passed.append(tokens >= 1)
            tokens -= 1.0 if passed[-1] else 0.0
        state.update((tokens, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({by: key[0], "req_id": rows["req_id"], "passed": passed})

    kind = dict(requests.dtypes)[by]
    return requests.select(by, "time", "req_id").groupBy(by).applyInPandasWithState(
        fold, f"{by} {kind}, req_id bigint, passed boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def repair_queue(events: DataFrame) -> DataFrame:
    """Objects entering or leaving the repair queue: bucket, key, first_seen (null once healed)."""

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        for kind, at in pd.concat(list(batches)).sort_values("at", kind="stable")[["kind", "at"]].itertuples(index=False):
            if kind == "healed":
                first = None
            elif first is None:
                first = at.to_pydatetime()
        if first is None:
            if state.exists:
                state.remove()
        else:
            state.update((first,))
        yield pd.DataFrame({"bucket": [key[0]], "key": [key[1]], "first_seen": pd.Series([first], dtype="datetime64[us]")})

    return events.groupBy("bucket", "key").applyInPandasWithState(
        fold, "bucket string, key string, first_seen timestamp_ntz", "first_seen timestamp_ntz", "update", GroupStateTimeout.NoTimeout
    )


def audit_chain(entries: DataFrame) -> DataFrame:
    """chain, seq, prev_hash, hash for each entry as it comes; a chain's state is its last hash."""

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        before, after = [], []
        for body in rows["body"]:
            before.append(last)
            last = hashlib.sha256((last + body).encode()).hexdigest()
            after.append(last)
        state.update((last,))
        yield pd.DataFrame({"chain": key[0], "seq": rows["seq"], "prev_hash": before, "hash": after})

    kind = dict(entries.dtypes)["chain"]
    return entries.select("chain", "seq", "body").groupBy("chain").applyInPandasWithState(
        fold, f"chain {kind}, seq bigint, prev_hash string, hash string", "last string", "append", GroupStateTimeout.NoTimeout
    )
