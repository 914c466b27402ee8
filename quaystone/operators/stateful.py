"""Folds in time order: rate limits, breakers, locks, repair queues, caches.

Each is keyed. Rate limits and breakers stream a key's events in order and hold a few numbers; locks and caches gather
one resource's or node's events. Streams run the same steps in ``quaystone.streaming``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaystone.operators.fold import ordered_fold


def token_bucket(requests: DataFrame, rate: float, burst: float, by: str = "access_key") -> DataFrame:
    """For each key: requests that pass and that are refused. Tokens refill with time up to the burst; a request takes one."""
    kind = dict(requests.dtypes)[by]
    seconds = (F.unix_micros(F.col("time").cast("timestamp")) / 1_000_000).alias("t")

    def step(_: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, None]:
        tokens, last, passed, refused = state or (float(burst), None, 0, 0)
        for t in rows["t"].tolist():
            tokens = min(float(burst), tokens + (0.0 if last is None else t - last) * rate)
            last = t
            if tokens >= 1:
                tokens, passed = tokens - 1.0, passed + 1
            else:
                refused += 1
        return (tokens, last, passed, refused), None

    def finish(key: tuple, state: tuple) -> pd.DataFrame:
        return pd.DataFrame({by: [key[0]], "passed": [state[2]], "refused": [state[3]]})

    return ordered_fold(requests.select(by, seconds, "req_id"), [by], ["t", "req_id"], f"{by} {kind}, passed int, refused int", step, finish)


def breaker_trips(calls: DataFrame, failures: int = 4, by: str = "peer") -> DataFrame:
    """Runs of consecutive failures that are long enough to trip, as gaps and islands: peer, first_seq, tripped_seq, length."""
    order = W.partitionBy(by).orderBy("seq")
    rows = calls.withColumn("island", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where("NOT ok")
    place = F.row_number().over(W.partitionBy(by, "island").orderBy("seq"))
    rows = rows.withColumn("place", place)
    trip = F.min(F.when(F.col("place") == failures, F.col("seq"))).alias("tripped_seq")
    return rows.groupBy(by, "island").agg(F.min("seq").alias("first_seq"), trip, F.count("*").alias("length")).where(F.col("length") >= failures).drop("island")


def breaker_states(calls: DataFrame, failures: int = 4, cooldown: float = 5.0, by: str = "peer") -> DataFrame:
    """Each call's fate: called, refused (open) or probe (the one call let through after the cooldown)."""

    def step(_: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        (streak, opened), out = state or (0, None), []
        for at, ok in zip(rows["at"], rows["ok"], strict=True):
            if opened is not None and at - opened < cooldown:
                out.append("refused")
                continue
            out.append("probe" if opened is not None else "called")
            streak = 0 if ok else streak + 1
            if ok:
                opened = None
            elif opened is not None or streak >= failures:
                opened = at
        return (streak, opened), pd.DataFrame({by: rows[by], "seq": rows["seq"], "fate": out})

    kind = dict(calls.dtypes)[by]
    return ordered_fold(calls.select(by, "seq", "at", "ok"), [by], ["seq"], f"{by} {kind}, seq bigint, fate string", step)


def lock_log(ops: DataFrame, ttl: float = 60.0) -> DataFrame:
    """Outcomes of a lock log: resource, seq, granted.

    op is lock, rlock, unlock, refresh; token grows. A lock expires ``ttl`` seconds after its last refresh. A
    token below the highest one seen is refused (fencing); a clean unlock of an exclusive lock forgets that mark.
    """

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        holder, readers, until, high, out = None, set(), 0.0, -1, []
        for at, op, owner, token in zip(pdf["at"], pdf["op"], pdf["owner"], pdf["token"], strict=True):
            if at >= until:
                holder, readers = None, set()
            ok = False
            if op == "lock" and holder is None and not readers and token >= high:
                holder, until, high, ok = owner, at + ttl, token, True
            elif op == "rlock" and holder is None:
                readers.add(owner)
                until, ok = at + ttl, True
            elif op == "refresh" and (owner == holder or owner in readers):
                until, ok = at + ttl, True
            elif op == "unlock" and owner == holder:
                holder, high, ok = None, -1, True
            elif op == "unlock" and owner in readers:
                readers.discard(owner)
                ok = True
            out.append(ok)
        return pd.DataFrame({"resource": key[0], "seq": pdf["seq"], "granted": out})

    return ops.groupBy("resource").applyInPandas(fold, "resource string, seq bigint, granted boolean")


def repair_queue(events: DataFrame) -> DataFrame:
    """Objects waiting for repair with the time first seen: queued after their last heal."""
    healed = events.where("kind = 'healed'").groupBy("bucket", "key").agg(F.max("at").alias("healed_at"))
    waiting = events.where("kind = 'queued'").join(healed, ["bucket", "key"], "left").where(F.col("healed_at").isNull() | (F.col("at") > F.col("healed_at")))
    return waiting.groupBy("bucket", "key").agg(F.min("at").alias("first_seen"))


def lru_hits(reads: DataFrame, budget: int, ttl: float, by: str = "node") -> DataFrame:
    """Whether each read finds its object in a cache of ``budget`` bytes with an age limit, for each node."""
    from collections import OrderedDict

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        held: OrderedDict[str, tuple[int, float]] = OrderedDict()
        used, out = 0, []
        for k, size, at in zip(pdf["key"], pdf["size"], pdf["at"], strict=True):
            hit = k in held and at - held[k][1] < ttl
            if hit:
                held.move_to_end(k)
            else:
                used -= held.pop(k, (0, 0.0))[0]
                if size <= budget:
                    held[k] = (size, at)
                    used += size
                while used > budget:
                    used -= held.popitem(last=False)[1][0]
            out.append(hit)
        return pd.DataFrame({by: key[0], "seq": pdf["seq"], "hit": out})

    kind = dict(reads.dtypes)[by]
    return reads.select(by, "seq", "key", "size", "at").groupBy(by).applyInPandas(fold, f"{by} {kind}, seq bigint, hit boolean")


