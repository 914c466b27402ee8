"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from quaystone.operators import audit
from quaystone.plans import catalogue
from quaystone.sources import views
from quaystone.streaming import events as ev
from quaystone.streaming import metrics, stateful


def replay(spark, rows, path):
    rows.write.parquet(str(path))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(query, spark, name, mode="append"):
    q = query.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name)


def test_windowed_counts(spark, data, tmp_path):
    rows = views.requests(spark, data).withColumn("time", F.col("time").cast("timestamp"))
    out = run(metrics.windowed_counts(replay(spark, rows.coalesce(1), tmp_path / "in"), "1 hour"), spark, "counts", "update")
    last = out.groupBy("start", "method", "class").agg(F.max("requests").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == rows.count()


def test_token_bucket(spark, data, tmp_path):
    rows = views.requests(spark, data).select("access_key", "time", "req_id").repartition(1).sortWithinPartitions("time")
    out = run(stateful.token_bucket(replay(spark, rows, tmp_path / "in"), 1 / 3600, 5), spark, "buckets")
    got = {r[0]: r[1] for r in out.groupBy("access_key").agg(F.count_if("passed")).collect()}
    assert got == {r.access_key: r.passed for r in catalogue.QUERIES["token_bucket"](spark, data).collect()}


def test_audit_chain(spark, data, tmp_path):
    rows = catalogue._entries(spark, data)
    early, late = rows.where("seq < 500").coalesce(1), rows.where("seq >= 500").coalesce(1)
    early.write.parquet(str(tmp_path / "in"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = run(stateful.audit_chain(stream), spark, "chain")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in audit.build(rows).select("chain", "seq", "prev_hash", "hash").collect()}


def test_repair_queue(spark, tmp_path):
    import datetime as dt

    at = lambda i: dt.datetime(2024, 1, 1, i)
    rows = spark.createDataFrame([("b", "x", "queued", at(1)), ("b", "x", "queued", at(2)), ("b", "y", "queued", at(1)), ("b", "y", "healed", at(3))], "bucket string, key string, kind string, at timestamp_ntz")
    out = run(stateful.repair_queue(replay(spark, rows.coalesce(1), tmp_path / "in")), spark, "repairs", "update")
    assert {(r.key, r.first_seen) for r in out.collect()} == {("x", at(1)), ("y", None)}


def test_fan_out_and_retries(spark, data, tmp_path):
    rows = catalogue._events(spark, data).withColumn("time", F.col("mod_time")).withColumn("etag", F.col("version_id"))
    targets = spark.createDataFrame(catalogue._TARGETS, "bucket string, target string, prefix string, suffix string, events array<string>")
    stream = ev.notifications(replay(spark, rows.coalesce(1), tmp_path / "in"), targets)
    seen, failed = [], []

    def send(batch, batch_id):
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("once")
        seen.extend((r.seq, r.target) for r in batch.select("seq", "target").collect())

    ev.deliver(stream, send, str(tmp_path / "ck")).awaitTermination(240)
    assert sorted(seen) == sorted((r.seq, r.target) for r in catalogue.QUERIES["webhook_fanout"](spark, data).collect())


@pytest.mark.parametrize("keys", [("req_id",)])
def test_deduplicated(spark, data, tmp_path, keys):
    rows = views.requests(spark, data).withColumn("time", F.col("time").cast("timestamp")).limit(50)
    twice = rows.unionByName(rows).coalesce(1)
    assert run(metrics.deduplicated(replay(spark, twice, tmp_path / "in"), *keys), spark, "once").count() == 50
