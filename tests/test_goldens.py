"""Behaviour on tiny tables with known answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quaystone.functions import globs, hashing, keys, meta, projections, times
from quaystone.functions import requests as rq
from quaystone.operators import audit, changes, iam, lifecycle, listing, multipart, notify, quorum, snapshot, stateful, usage, versions
from quaystone.sources import readers, sinks

NOW = "2024-02-01 00:00:00"


def ago(**kw):
    return dt.datetime(2024, 2, 1) - dt.timedelta(**kw)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def objects(spark, names):
    return spark.createDataFrame([("b", k, s, "e") for k, s in names.items()], "bucket string, key string, size bigint, etag string")


def versions_of(spark, rows):
    schema = "bucket string, key string, seq bigint, version_id string, delete_marker boolean, mod_time timestamp_ntz, size bigint, lock_mode string, retain_until timestamp_ntz, legal_hold boolean"
    full = [("b", k, s, i, m, t, 1, mode, until, hold) for k, s, i, m, t, mode, until, hold in rows]
    return spark.createDataFrame(full, schema)


RULE = "bucket string, rule_pos int, id string, prefix string, status string, expiration_days int, expiration_date timestamp_ntz, noncurrent_days int, abort_mpu_days int, transition_days int, transition_tier string"


def test_usage(spark):
    o = objects(spark, {"a.txt": 5, "d/b.txt": 9, "d/e/c.txt": 3})
    assert usage.by_bucket(o).first()[1:] == (3, 17)
    folders = {r.folder: (r.objects, r.bytes) for r in usage.by_folder(o).collect()}
    assert folders == {"": (3, 17), "d/": (2, 12), "d/e/": (1, 3)}
    assert {r.folder for r in usage.children(usage.by_folder(o), "b").collect()} == {"", "d/"}


def test_quota(spark):
    ask = spark.createDataFrame([("b", 6), ("c", 6)], "bucket string, add_bytes bigint")
    config = spark.createDataFrame([("b", 10, 0), ("c", 10, 0)], "bucket string, quota_bytes bigint, quota_objects bigint")
    used = usage.by_bucket(objects(spark, {"x": 5}))
    assert {r.bucket: r.exceeded for r in usage.quota_check(ask, config, used).collect()} == {"b": True, "c": False}


def test_delimiter_listing(spark):
    o = objects(spark, dict.fromkeys(["a.txt", "photos/1.jpg", "photos/2.jpg", "photos/sub/3.jpg", "z.txt"], 1))
    root = [(r.item, r.is_prefix) for r in listing.page(o, "b", delimiter="/").orderBy("item").collect()]
    assert root == [("a.txt", False), ("photos/", True), ("z.txt", False)]
    inner = [(r.item, r.is_prefix) for r in listing.page(o, "b", "photos/", "/").orderBy("item").collect()]
    assert inner == [("photos/1.jpg", False), ("photos/2.jpg", False), ("photos/sub/", True)]


@pytest.mark.parametrize(("delimiter", "size"), [("", 3), ("/", 1), ("/", 2)])
def test_pages_join_to_the_whole_list(spark, delimiter, size):
    rng = random.Random(size)
    o = objects(spark, {f"{rng.choice('abc')}/{i:02}" if rng.random() < 0.6 else f"k{i:02}": 1 for i in range(12)}).cache()
    whole = [r.item for r in listing.page(o, "b", delimiter=delimiter).orderBy("item").collect()]
    seen, after = [], ""
    while True:
        rows = listing.page(o, "b", delimiter=delimiter, after=after, max_keys=size).orderBy("item").collect()
        seen += [r.item for r in rows]
        if not rows or not rows[0].is_truncated:
            break
        after = rows[0].next_marker
    assert seen == whole


def test_clamp_and_tokens():
    assert [listing.clamp_keys(n) for n in (0, -1, 5, 1001, None)] == [1000, 1000, 5, 1000, 1000]
    assert listing.start_marker("m", "YWJj", "s") == "abc" and listing.start_marker("m", "not base64!", "s") == "not base64!"
    assert listing.start_marker("m", None, "s") == "s"


def test_version_lifecycle(spark):
    log = versions_of(spark, [("k", 1, "v1", False, ago(days=2), None, None, False), ("k", 2, "v2", False, ago(days=1), None, None, False)])
    marked = versions.delete(log, log.select("bucket", "key"), NOW)
    assert marked.count() == 3 and versions.heads(marked).count() == 0
    restored = marked.where("NOT delete_marker")
    assert versions.heads(restored).first().version_id == "v2"
    ask = spark.createDataFrame([("b", "k", "v1", False)], "bucket string, key string, version_id string, bypass boolean")
    assert versions.delete_version(restored, ask, NOW).count() == 1


def test_suspended_keeps_one_null(spark):
    log = versions_of(spark, [("k", 1, "a", False, None, None, None, False), ("k", 2, "b", False, None, None, None, False)])
    new = spark.createDataFrame([("b", "k")], "bucket string, key string").withColumn("delete_marker", F.lit(False))
    twice = versions.put(versions.put(log, new, suspended=True), new, suspended=True)
    assert twice.where("version_id = 'null'").count() == 1 and twice.count() == 3
    assert versions.latest(twice).first().version_id == "null"


def test_plain_object_is_adopted(spark):
    log = versions_of(spark, [])
    both = versions.put(versions.adopt_plain(log, objects(spark, {"k": 1})), objects(spark, {"k": 2}).withColumn("version_id", F.lit("new")).withColumn("delete_marker", F.lit(False)))
    assert both.count() == 2 and versions.latest(both).first().version_id == "new"


def test_object_lock(spark):
    log = versions_of(spark, [("k", 1, "v", False, None, "GOVERNANCE", dt.datetime(2024, 2, 2), False), ("h", 1, "v", False, None, "GOVERNANCE", dt.datetime(2024, 2, 2), True)])
    ask = lambda k, bypass: spark.createDataFrame([("b", k, "v", bypass)], "bucket string, key string, version_id string, bypass boolean")
    assert versions.delete_version(log, ask("k", False), NOW).count() == 2
    assert versions.delete_version(log, ask("k", True), NOW).count() == 1
    assert versions.delete_version(log, ask("h", True), NOW).count() == 2


def test_lifecycle(spark):
    o = spark.createDataFrame([("b", "logs/old", 1, ago(days=10)), ("b", "logs/new", 1, ago(hours=1)), ("b", "keep/x", 1, ago(days=30))], "bucket string, key string, size bigint, mod_time timestamp_ntz")
    on = spark.createDataFrame([("b", 0, "r", "logs/", "Enabled", 7, None, None, None, None, None)], RULE)
    assert [r.key for r in lifecycle.expire(o, on, NOW).collect()] == ["logs/old"]
    assert lifecycle.expire(o, on.withColumn("status", F.lit("Disabled")), NOW).count() == 0


def test_noncurrent_expiry(spark):
    log = versions_of(spark, [("k", i, f"v{i}", False, t, None, None, False) for i, t in enumerate([ago(days=40), ago(days=35), ago(hours=1), ago(hours=0)])])
    rule = spark.createDataFrame([("b", 0, "r", "", "Enabled", None, None, 30, None, None, None)], RULE)
    assert lifecycle.expire_noncurrent(log, rule, NOW).count() == 2


def test_snapshot_and_backup(spark):
    table = lambda rows: spark.createDataFrame([("b", k, i) for k, i in rows.items()], "bucket string, key string, version_id string")
    d = snapshot.diff(table({"a": "a1", "b": "b1"}), table({"a": "a2", "c": "c1"}))
    assert {r.key: r.action for r in d.collect()} == {"a": "restore", "b": "restore", "c": "remove"}
    local = objects(spark, {"a.txt": 3, "dir/b.txt": 6})
    assert snapshot.backup_plan(local, local.limit(0)).count() == 2
    assert snapshot.backup_plan(local, local).count() == 0 and snapshot.backup_skip(local, local).count() == 2


def test_dedup(spark):
    o = spark.createDataFrame([("b", "a", 1, "h"), ("b", "b", 1, "h"), ("b", "c", 1, "i")], "bucket string, key string, size bigint, data_ref string")
    assert [(r.data_ref, r.copies, r.saved) for r in snapshot.dedup_groups(o).collect()] == [("h", 2, 1)]
    blobs = spark.createDataFrame([("h", ago(days=1)), ("i", ago(days=1))], "hash string, installed_at timestamp_ntz")
    now = F.lit(NOW).cast("timestamp_ntz")
    assert snapshot.collectable(blobs, o, now).count() == 0
    assert [r.hash for r in snapshot.collectable(blobs, o.where("key = 'c'"), now).collect()] == ["h"]


def replicas(spark, contents):
    return spark.createDataFrame([("b", "k", i, c, r, True) for i, (c, r) in enumerate(contents)], "bucket string, key string, disk_idx int, content string, revision bigint, online boolean")


def test_votes(spark):
    assert quorum.majority(replicas(spark, [("v2", 2)] * 4 + [("v1", 1)] * 2)).first().content == "v2"
    tie = quorum.vote(replicas(spark, [("old", 1), ("new", 2)] * 3), 3).first()
    assert (tie.content, tie.outcome) == ("new", "ok")
    first = quorum.vote(replicas(spark, [("old", 1)] * 3 + [("new", 2)] * 3), 3, first_quorum=True).first()
    assert first.content == "old"
    assert quorum.vote(replicas(spark, [("a", 1), ("b", 2), ("c", 3)]), 2).first().outcome == "corrupt"


def test_drain_guards():
    assert quorum.drain_guard(2, [], 1) == "ok" and quorum.drain_guard(1, [], 0) == "only set"
    assert quorum.drain_guard(3, [1], 1) == "already draining" and quorum.drain_guard(2, [0], 1) == "no active set left" and quorum.drain_guard(2, [], 5) == "out of range"


def test_multipart(spark):
    import hashlib

    md5 = [hashlib.md5(bytes([i])).hexdigest() for i in range(2)]
    have = spark.createDataFrame([("u", 1, 6 << 20, md5[0]), ("u", 2, 10, md5[1])], "upload_id string, part_number int, size bigint, etag string")
    done = multipart.complete(have).first()
    assert done.size == (6 << 20) + 10 and done.etag == hashlib.md5(bytes.fromhex("".join(md5))).hexdigest() + "-2"
    ask = lambda order: spark.createDataFrame([("u", i, n, md5[n - 1]) for i, n in enumerate(order)], "upload_id string, pos int, part_number int, etag string")
    assert {r.outcome for r in multipart.validate(ask([1, 2]), have).collect()} == {"ok"}
    assert "InvalidPartOrder" in {r.outcome for r in multipart.validate(ask([2, 1]), have).collect()}
    assert "EntityTooSmall" in {r.outcome for r in multipart.validate(ask([1, 2]), have.withColumn("size", F.lit(5))).collect()}
    assert [(r.part_number, r["from"], r.bytes) for r in multipart.locate(have, (6 << 20) - 2, 5).orderBy("part_number").collect()] == [(1, (6 << 20) - 2, 2), (2, 0, 3)]


def test_audit(spark):
    rows = spark.createDataFrame([(0, i, f"row {i}") for i in range(25)], "chain int, seq bigint, body string")
    chained = audit.build(rows).join(rows, ["chain", "seq"]).cache()
    assert audit.verify(chained).first()[1:] == (25, None)
    bad = chained.withColumn("body", F.when(F.col("seq") == 12, "edited").otherwise(F.col("body")))
    assert audit.verify(bad).first().broken_seq == 12
    assert [r.seq for r in audit.tail(chained, 3).collect()] == [22, 23, 24]


@pytest.mark.parametrize(
    ("pattern", "text", "hit"),
    [("*", "anything", True), ("s3:Get*", "s3:GetObject", True), ("s3:Get*", "s3:PutObject", False), ("photos/*", "photos/a/b.jpg", True), ("photos/*", "videos/a.mp4", False), ("a?c", "abc", True), ("a?c", "ac", False), ("a.c", "abc", False)],
)
def test_globs(spark, pattern, text, hit):
    assert value(spark, globs.glob_match(F.lit(pattern), F.lit(text))) is hit


@pytest.mark.parametrize(("ip", "cidr", "hit"), [("10.1.2.3", "10.0.0.0/8", True), ("11.1.2.3", "10.0.0.0/8", False), ("10.1.2.3", "10.1.2.3", True), ("x", "10.0.0.0/8", False), ("1.2.3.4", "0.0.0.0/0", True)])
def test_cidr(spark, ip, cidr, hit):
    assert value(spark, globs.in_cidr(F.lit(ip), F.lit(cidr))) is hit


def decide(spark, statements, policies, strict=False, **request):
    r = {"request_id": 1, "access_key": "u", "action": "s3:GetObject", "bucket": "b", "object": "k", "source_ip": "10.0.0.1", "condition_values": {}} | request
    schema = "request_id int, access_key string, action string, bucket string, object string, source_ip string, condition_values map<string,array<string>>"
    grants = spark.createDataFrame([("u", p) for p in policies], "access_key string, policy string")
    table = spark.createDataFrame(statements, iam.STATEMENT).unionByName(iam.canned_policies(spark))
    return iam.decide(spark.createDataFrame([tuple(r.values())], schema), grants, table, strict).first().allowed


def test_policies(spark):
    assert decide(spark, [], ["readonly"]) and not decide(spark, [], ["readonly"], action="s3:PutObject")
    deny = [("d", 0, "Deny", None, ["s3:*"], None, None, None)]
    assert not decide(spark, deny, ["d"])
    assert decide(spark, deny, ["d", "readwrite"]) and not decide(spark, deny, ["d", "readwrite"], strict=True)
    like = [("l", 0, "Allow", None, ["s3:*"], None, None, {"StringLike": {"s3:prefix": ["x*"]}})]
    assert decide(spark, like, ["l"]) and not decide(spark, like, ["l"], condition_values={"s3:prefix": ["y"]})
    odd = [("o", 0, "Allow", None, ["s3:*"], None, None, {"Unheard": {"k": ["v"]}})]
    assert decide(spark, odd, ["o"])
    ip = [("i", 0, "Allow", None, ["s3:*"], None, None, {"NotIpAddress": {"aws:SourceIp": ["10.0.0.0/8"]}})]
    assert not decide(spark, ip, ["i"]) and decide(spark, ip, ["i"], source_ip="11.0.0.1")
    assert not decide(spark, [("n", 0, "Allow", None, None, ["s3:Get*"], None, None)], ["n"])
    assert decide(spark, [("p", 0, "Allow", ["arn:aws:iam::1:user/u"], ["s3:*"], None, ["arn:aws:s3:::b/*"], None)], ["p"])
    assert not decide(spark, [("p", 0, "Allow", ["other"], ["s3:*"], None, ["arn:aws:s3:::b/*"], None)], ["p"])


def test_policy_documents(spark):
    doc = '{"Statement":[{"Effect":"Allow","Principal":{"AWS":["*"]},"Action":"s3:Get*","Resource":["arn:aws:s3:::a","arn:aws:s3:::b"],"Condition":{"StringEquals":{"k":"v"}}}]}'
    r = iam.parse_policies(spark.createDataFrame([("p", doc)], "policy string, document string")).first()
    assert (r.principals, r.actions, r.resources, r.conditions) == (["*"], ["s3:Get*"], ["arn:aws:s3:::a", "arn:aws:s3:::b"], {"StringEquals": {"k": ["v"]}})


def test_form_policy(spark):
    cond = F.expr("array(named_struct('op','starts-with','field','$key','value','up/'), named_struct('op','content-length-range','field','','value','1,10'))")
    fields = lambda k: F.create_map(F.lit("key"), F.lit(k))
    assert value(spark, notify.form_policy_holds(cond, fields("up/x"), F.lit(5)))
    assert not value(spark, notify.form_policy_holds(cond, fields("no/x"), F.lit(5)))
    assert not value(spark, notify.form_policy_holds(cond, fields("up/x"), F.lit(11)))


@pytest.mark.parametrize(("text", "seconds"), [("72h", 259200), ("7d", 604800), ("2w", 1209600), ("5m", 300), ("1h30m", 5400), ("1.5h", 5400), ("0h", None), ("d", None), ("3y", None), ("3D", 259200), ("250ms", 0.25)])
def test_spans(spark, text, seconds):
    assert value(spark, times.span_seconds(F.lit(text))) == seconds


def test_expiry(spark):
    now = F.lit(NOW).cast("timestamp_ntz")
    assert value(spark, times.expiry_from(F.lit(None).cast("string"), F.lit("30d"), now)) == dt.datetime(2024, 3, 2)
    assert value(spark, times.expiry_from(F.lit("2024-01-01T00:00:00Z"), F.lit("30d"), now)) == dt.datetime(2024, 1, 1)
    assert value(spark, times.expiry_from(F.lit("nonsense"), F.lit("30d"), now)) is None
    assert value(spark, times.parse_time(F.lit("Tue, 02 Jan 2024 03:04:05 GMT"))) == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert value(spark, times.parse_time(F.lit("20240102T030405Z"))) == dt.datetime(2024, 1, 2, 3, 4, 5)


@pytest.mark.parametrize(("header", "found"), [("bytes=0-9", (0, 10)), ("bytes=90-", (90, 10)), ("bytes=-5", (95, 5)), ("bytes=-500", (0, 100)), ("bytes=5-2", None), ("bytes=1-2,4-5", None), ("items=1-2", None), ("bytes=-", None), ("bytes=95-500", (95, 5))])
def test_ranges(spark, header, found):
    r = value(spark, rq.byte_range(F.lit(header), F.lit(100)))
    assert (r and tuple(r)) == found


def test_conditions(spark):
    none = F.lit(None).cast("string")
    cases = {(None, None): True, ("cur", None): True, ("old", None): False, (None, "cur"): False, (None, "*"): False}
    for (match, none_match), ok in cases.items():
        assert value(spark, rq.put_condition(F.lit("cur"), F.lit(match).cast("string"), F.lit(none_match).cast("string"))) is ok
    assert value(spark, rq.put_condition(none, F.lit("x"), none)) is False
    size = F.lit(6)
    assert [value(spark, rq.append_outcome(size, F.lit(i), F.lit(1))) for i in (6, 5)] == ["ok", "InvalidWriteOffset"]


def test_names(spark):
    good, bad = ["abc", "a.b-c", "1234"], ["ab", "-abc", "a..b", "a.-b", "Abc", "1.2.3.4", "x" * 64]
    assert all(value(spark, keys.valid_bucket_name(F.lit(x))) for x in good) and not any(value(spark, keys.valid_bucket_name(F.lit(x))) for x in bad)
    assert all(value(spark, keys.valid_key(F.lit(x))) for x in ["a/b", "a..b/c"]) and not any(value(spark, keys.valid_key(F.lit(x))) for x in ["", "/a", "a/../b", "a\\b", "./a", "x" * 1025])


def test_fnv_vectors(spark):
    assert [value(spark, hashing.fnv1a(F.lit(t))) for t in ("", "a", "foobar")] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]


def test_meta(spark):
    assert value(spark, meta.size_bytes(F.lit("1MiB"))) == 1 << 20 and value(spark, meta.size_bytes(F.lit("64k"))) == 65536 and value(spark, meta.size_bytes(F.lit("x"))) is None
    assert value(spark, meta.human_size(F.lit(1536))) == "1.5 KiB"
    assert value(spark, meta.tag_text(meta.tags(F.lit("b=2&a=x%20y")))) == "a=x%20y&b=2"
    assert value(spark, meta.client_ip(F.lit(" 1.1.1.1 , 2.2.2.2"), F.lit("3.3.3.3:80"))) == "1.1.1.1" and value(spark, meta.client_ip(F.lit(None).cast("string"), F.lit("3.3.3.3:80"))) == "3.3.3.3"
    assert value(spark, meta.uri_encode(F.lit("a b*~/é"))) == "a%20b%2A~%2F%C3%A9"
    p = value(spark, meta.preview_size(F.lit(300), F.lit(200), F.lit(64), F.lit(0), F.lit("contain")))
    assert (p.w, p.h) == (64, 43)
    assert [value(spark, meta.clamp(F.lit(t), 1, 100, 80)) for t in ("500", "x", "0")] == [100, 80, 1]


def test_token_bucket(spark):
    rows = spark.createDataFrame([("k", dt.datetime(2024, 1, 1, 0, 0, 0, i * 1000), i) for i in range(20)], "access_key string, time timestamp_ntz, req_id int")
    r = stateful.token_bucket(rows, 5, 5).first()
    assert r.passed == 5 and r.refused == 15


def test_breaker(spark):
    calls = [(0, False), (1, False), (2, False), (3, False), (4, True), (9, False), (10, True), (15, True), (16, False)]
    rows = spark.createDataFrame([("p", i, float(at), ok) for i, (at, ok) in enumerate(calls)], "peer string, seq bigint, at double, ok boolean")
    assert [r.fate for r in stateful.breaker_states(rows).orderBy("seq").collect()] == ["called"] * 4 + ["refused", "probe", "refused", "probe", "called"]
    assert [tuple(r) for r in stateful.breaker_trips(rows).collect()] == [("p", 0, 3, 4)]


def test_locks(spark):
    log = [(0, "lock", "a", 1), (1, "lock", "b", 2), (2, "unlock", "b", 2), (70, "lock", "b", 2), (140, "lock", "a", 1), (141, "lock", "c", 3), (142, "unlock", "c", 3), (143, "rlock", "d", 0), (144, "rlock", "e", 0), (145, "lock", "f", 9)]
    rows = spark.createDataFrame([("r", i, float(at), op, o, t) for i, (at, op, o, t) in enumerate(log)], "resource string, seq bigint, at double, op string, owner string, token bigint")
    assert [r.granted for r in stateful.lock_log(rows).orderBy("seq").collect()] == [True, False, False, True, False, True, True, True, True, False]


def test_sinks_and_readers(spark, tmp_path):
    old = objects(spark, {"a": 1, "b": 2})
    assert sorted((r.key, r.size) for r in sinks.put_objects(old, objects(spark, {"b": 9})).collect()) == [("a", 1), ("b", 9)]
    (tmp_path / "audit-1.json").write_text('{"seq":1,"hash":"x"}\n{"seq":2,"hash":"y"}\n')
    assert audit.last_entry(readers.audit_log(spark, str(tmp_path))).first()[:] == (2, "y")
    assert [r[0] for r in readers.expand_endpoints(spark, "d{1...2}/x{8...9}").collect()] == ["d1/x8", "d1/x9", "d2/x8", "d2/x9"]
    configs = spark.createDataFrame([("a", '{"updatedAt":"t","config":{"quotaBytes":5}}'), ("b", '{"quotaBytes":7}')], "bucket string, raw string")
    assert {r.bucket: r.config.quotaBytes for r in readers.bucket_configs(configs).collect()} == {"a": 5, "b": 7}
    errors = rq.with_error(spark.createDataFrame([("object_not_found",), ("odd",), (None,)], "outcome string"))
    assert sorted((r.outcome or "", r.code or "", r.status) for r in errors.collect()) == [("", "", 200), ("object_not_found", "NoSuchKey", 404), ("odd", "InternalError", 500)]


def test_signatures(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        want = hmac.new(key, b"message", hashlib.sha256).hexdigest()
        assert value(spark, projections.hmac_sha256(key, F.lit("message"))) == want
    # the documented derivation for a signed request
    assert projections.signing_key("wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", "20120215", "us-east-1", "iam").hex() == "f4780e2d9f65fa895f9c67b32ce1baf0b0d8a43505a000a1a9e090d414db404d"


def test_projections(spark):
    assert value(spark, projections.bucket_of_host(F.lit("photos.s3.local:9000"), "s3.local")) == "photos" and value(spark, projections.bucket_of_host(F.lit("s3.local"), "s3.local")) is None
    m = F.create_map(F.lit("Content-Type"), F.lit("text/plain"), F.lit("Owner"), F.lit("me"))
    r = value(spark, projections.stored_metadata(m))
    assert (r.content_type, r.content_encoding, r.user) == ("text/plain", None, {"owner": "me"})
    h = value(spark, projections.response_headers(F.create_map(F.lit("a"), F.lit("1")), F.lit("e"), F.lit("x=1&y=2")))
    assert h == {"x-amz-meta-a": "1", "ETag": '"e"', "x-amz-tagging-count": "2"}
    assert value(spark, projections.data_location(F.lit("b"), F.lit("k"), F.lit(None).cast("string"))) == "b/k"


def test_changes(spark):
    xml = "<L><Rule><ID>a</ID><Filter><Prefix>f/</Prefix></Filter><Prefix>p/</Prefix><Expiration><Days>3</Days></Expiration></Rule><Rule><ID>b</ID><Prefix>p/</Prefix><Status>Disabled</Status></Rule></L>"
    rules = changes.lifecycle_rows(spark.createDataFrame([("b", xml)], "bucket string, document string")).orderBy("rule_pos").collect()
    assert [(r.id, r.prefix, r.status, r.expiration_days) for r in rules] == [("a", "f/", "Enabled", 3), ("b", "p/", "Disabled", None)]
    old = spark.createDataFrame([("b", "1", "s")], "bucket string, id string, secret string")
    new = spark.createDataFrame([("b", "1", "********"), ("b", "2", "n")], "bucket string, id string, secret string")
    assert {r.id: r.secret for r in changes.merge_secrets(old, new).collect()} == {"1": "s", "2": "n"}
    answers = spark.createDataFrame([("r", 1, True), ("r", 1, True), ("r", 1, False), ("r", 2, True)], "resource string, token int, granted boolean")
    assert {r.token: r.held for r in changes.lock_granted(answers, 3).collect()} == {1: True, 2: False}
    people = spark.createDataFrame([("a", "x"), ("b", "y")], "access_key string, status string")
    asked = spark.createDataFrame([("b", None, "remove"), ("c", "z", "put"), ("a", "w", "put")], "access_key string, status string, op string")
    assert sorted(map(tuple, changes.change_identities(people, asked).collect())) == [("a", "w"), ("c", "z")]
    text = spark.createDataFrame([("b", "k", bytearray(b"hello"))], "bucket string, key string, content binary")
    more = spark.createDataFrame([("b", "k", 5, bytearray(b"!")), ("b", "new", 0, bytearray(b"n")), ("b", "k", 3, bytearray(b"?"))], "bucket string, key string, offset long, content binary")
    assert sorted((r.outcome, bytes(r.new_content or b"")) for r in changes.append(text, more).collect()) == [("InvalidWriteOffset", b""), ("ok", b"hello!"), ("ok", b"n")]


def test_own_expiry_header_and_noise(spark):
    m = F.create_map(F.lit("x-amz-meta-Store-Expires"), F.lit("7d"), F.lit("other"), F.lit("x"))
    assert value(spark, meta.expiry_text(m)) == "7d" and value(spark, meta.expiry_text(F.create_map(F.lit("a"), F.lit("b")))) is None
    paths = ["/-/health/live", "/-/metrics", "/-/console/app.js", "/bucket/health/x", "/-/metricsx"]
    assert [value(spark, projections.internal_path(F.lit(p))) for p in paths] == [True, True, True, False, False]
