"""Metrics over request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaystone.functions.requests import status_class

# Upper bounds of the latency histogram in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", status_class(F.col("status")).alias("class")).agg(F.count("*").alias("requests"))


def histogram(requests: DataFrame, *by: str) -> DataFrame:
    """Cumulative buckets: how many took at most each bound. One aggregation, then one row for each bound."""
    cells = [F.count_if(F.col("seconds") <= b).alias(f"_{i}") for i, b in enumerate(BOUNDS)]
    wide = requests.groupBy(*by).agg(*cells, F.count("*").alias("_n"))
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(BOUNDS)], F.struct(F.lit("+Inf").alias("le"), F.col("_n").alias("n")))
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.le", "r.n")


def percentile(requests: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    """Nearest rank: the sorted value at floor(n * p) mod n.

    Equal values are counted first, so the window runs over distinct values only.
    """
    sizes = requests.groupBy(*by, value).agg(F.count("*").alias("_c"))
    among = W.partitionBy(*by)
    upto = among.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    rows = sizes.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(among))
    at = F.pmod(F.floor(F.col("_n") * p), F.col("_n"))
    return rows.where((F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at)).select(*by, F.col(value).alias("value"), F.col("_n").alias("n"))


def throughput(requests: DataFrame, seconds: int = 3600) -> DataFrame:
    """Requests and bytes for each window of time, also as rates."""
    w = F.window("time", f"{seconds} seconds")
    out = requests.groupBy(w.alias("w")).agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "requests", "bytes", (F.col("requests") / seconds).alias("per_second"))


def errors(requests: DataFrame) -> DataFrame:
    return requests.where("status >= 400").groupBy("code").agg(F.count("*").alias("errors"))


def cache_stats(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count_if(F.col("cache") == "HIT").alias("hits"), F.count_if(F.col("cache") == "MISS").alias("misses"))


def recent(requests: DataFrame, n: int, errors_only: bool = False) -> DataFrame:
    """The last n requests, newest first: the limit is the ring's size."""
    rows = requests.where("status >= 400") if errors_only else requests
    return rows.orderBy(F.desc("time"), F.desc("req_id")).limit(n)


def in_flight(requests: DataFrame, budget: int, *by: str) -> DataFrame:
    """Bytes in flight after each start or end, and whether they are over the budget, inside each partition ``by``."""
    start = requests.select(*by, "req_id", F.col("time").alias("at"), F.col("bytes").alias("change"))
    stop = F.timestamp_add("MILLISECOND", F.col("dur_ms"), F.col("time")).cast("timestamp_ntz")
    end = requests.select(*by, "req_id", stop.alias("at"), (-F.col("bytes")).alias("change"))
    order = W.partitionBy(*by).orderBy("at", "change", "req_id").rowsBetween(W.unboundedPreceding, 0)
    return start.unionByName(end).withColumn("bytes", F.sum("change").over(order)).withColumn("over", F.col("bytes") > budget)


def sessions(requests: DataFrame, gap: str = "6 hours", by: str = "access_key") -> DataFrame:
    out = requests.groupBy(by, F.session_window("time", gap).alias("w")).agg(F.count("*").alias("requests"))
    return out.select(by, F.col("w.start").cast("timestamp_ntz").alias("start"), "requests")


def exposition(rows: DataFrame, metric: str, value: str, *labels: str) -> DataFrame:
    """One text line for each row, as scrapers read it."""
    parts = [F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels]
    return rows.select(F.concat(F.lit(metric + "{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string")).alias("line"))
