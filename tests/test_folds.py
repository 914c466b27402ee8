"""Folds that stream, batches that name a key twice, addresses and checksums."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaystone.functions import globs, hashing, meta
from quaystone.functions import requests as rq
from quaystone.operators import changes, versions
from quaystone.operators.fold import ordered_fold
from quaystone.sources import sinks


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, old)


def test_fold_goes_on_over_batches(spark, small_batches):
    """Keys that span batches, null keys, and a last state for each key."""
    rows = [(k, i) for k in ("a", "b", None) for i in range(8)]
    table = spark.createDataFrame(rows[::-1], "k string, i int")

    def step(_, state, part):
        total, seen = state or 0, []
        for i in part["i"]:
            total += int(i)
            seen.append(total)
        return total, pd.DataFrame({"k": part["k"], "i": part["i"], "sum": seen})

    out = ordered_fold(table, ["k"], ["i"], "k string, i int, sum bigint", step, lambda key, state: pd.DataFrame({"k": [key[0]], "i": [-1], "sum": [state]}))
    expected = [(k, i, i * (i + 1) // 2) for k, i in rows] + [(k, -1, 28) for k in ("a", "b", None)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    assert ordered_fold(table.limit(0), ["k"], ["i"], "k string, i int, sum bigint", step).count() == 0


def test_a_batch_may_name_a_key_twice(spark):
    old = spark.createDataFrame([("b", "x", 1)], "bucket string, key string, size int")
    new = spark.createDataFrame([("b", "x", 2, 0), ("b", "x", 3, 1), ("b", "y", 4, 0), ("b", "y", 5, -1)], "bucket string, key string, size int, place int")
    assert sorted((r.key, r.size) for r in sinks.put_objects(old, new, "place").collect()) == [("x", 3), ("y", 4)]
    log = spark.createDataFrame([("b", "x", 5, "v1", False)], "bucket string, key string, seq bigint, version_id string, delete_marker boolean")
    puts = spark.createDataFrame([("b", "x", "v3", 1), ("b", "x", "v2", 0)], "bucket string, key string, version_id string, place int")
    assert sorted((r.version_id, r.seq) for r in versions.put(log, puts, order=["place"]).collect()) == [("v1", 5), ("v2", 6), ("v3", 7)]
    last = versions.put(versions.put(log, puts, suspended=True, order=["place"]), puts, suspended=True, order=["place"])
    assert sorted(r.version_id for r in last.collect()) == ["null", "v1"]
    writes = spark.createDataFrame([("b", "x", 7, 0), ("b", "x", 7, 1), ("b", "x", None, 2)], "bucket string, key string, expected bigint, place int")
    out = sinks.commit(spark.createDataFrame([("b", "x", 7)], "bucket string, key string, revision bigint"), writes, "place").orderBy("place").collect()
    assert [(r.outcome, r.revision) for r in out] == [("ok", 8), ("conflict", None), ("ok", 9)]
    table = spark.createDataFrame([("b", "x", "old=1", None)], "bucket string, key string, user_tags string, mod_time timestamp_ntz")
    asked = spark.createDataFrame([("b", "x", "a=1", 1), ("b", "x", None, 2)], "bucket string, key string, tags string, place int")
    assert [r.user_tags for r in changes.set_tags(table, asked, "2024-01-01 00:00:00", "place").collect()] == [None]


@pytest.mark.parametrize(
    ("ip", "cidr", "hit"),
    [
        ("2001:db8::1", "2001:db8::/32", True), ("2001:db9::1", "2001:db8::/32", False), ("::1", "::/0", True), ("febf::1", "fe80::/10", True), ("fec0::1", "fe80::/10", False),
        ("::ffff:10.0.0.1", "10.0.0.0/8", True), ("10.0.0.1", "::ffff:10.0.0.0/104", True), ("1:2:3:4:5:6:7", "::/0", False), ("1::2::3", "::/0", False), ("10.0.0.1", "::/0", False), ("2001:DB8::1", "2001:db8:0:0::1", True),
    ],
)
def test_networks_of_both_kinds(spark, ip, cidr, hit):
    assert spark.range(1).select(globs.in_cidr(F.lit(ip), F.lit(cidr))).first()[0] is hit


def test_checksums(spark):
    row = spark.range(1).select(*[hashing.checksum(k, F.lit(b"123456789")).alias(k) for k in ("crc32", "crc32c")]).first()
    assert (row.crc32, row.crc32c) == ("y/Q5Jg==", "4waSgw==")


def test_names_that_come_twice(spark):
    row = spark.range(1).select(meta.tags(F.lit("a=1&b=2&a=3")).alias("t")).first()
    assert row.t == {"a": "3", "b": "2"}


@pytest.mark.parametrize(
    ("method", "bucket", "obj", "names", "action"),
    [
        ("GET", "", "", [], "ListAllMyBuckets"), ("HEAD", "b", "", [], "ListBucket"), ("GET", "b", "", ["tagging", "policy"], "GetBucketPolicy"), ("PATCH", "b", "", [], "ListBucket"), ("POST", "b", "", ["delete"], "DeleteObject"),
        ("POST", "b", "o", ["uploadId"], "PutObject"), ("POST", "b", "o", [], "GetObject"), ("DELETE", "b", "o", ["uploadId"], "AbortMultipartUpload"), ("PUT", "b", "o", ["tagging"], "PutObjectTagging"), ("DELETE", "b", "", ["tagging"], "PutBucketTagging"),
    ],
)
def test_actions(spark, method, bucket, obj, names, action):
    query = F.lit(names).cast("array<string>") if names else F.array().cast("array<string>")
    assert spark.range(1).select(rq.action_name(F.lit(method), F.lit(bucket), F.lit(obj), query)).first()[0] == f"s3:{action}"


@pytest.mark.parametrize(
    ("ip", "cidr", "hit"),
    [("10.1.2.3", "2001:db8::/32", False), ("2001:db8::1", "10.0.0.0/8", False), ("::FFFF:10.1.2.3", "10.0.0.0/8", True), ("10.1.2.3", "0:0:0:0:0:ffff:a00:0/104", True), ("2001:db8::ffff", "10.1.2.3", False), ("", "::/0", False), (None, "::/0", False)],
)
def test_networks_of_different_kinds(spark, ip, cidr, hit):
    assert spark.range(1).select(globs.in_cidr(F.lit(ip).cast("string"), F.lit(cidr))).first()[0] is hit
