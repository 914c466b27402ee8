"""Queries over column functions: names, dates, sizes, headers, conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions import hashing, keys, meta, projections, times
from quaystone.functions import requests as rq
from quaystone.operators import iam, notify
from quaystone.plans import sqlviews as v
from quaystone.plans.registry import query
from quaystone.sources import views


def _events(spark, sf):
    return views.table(spark, sf, "events")


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _case(number, *values):
    """values[i] where number % len(values) is i."""
    out = None
    for i, value in enumerate(values):
        value = F.lit(value) if not hasattr(value, "alias") else value
        test = number % len(values) == i
        out = F.when(test, value) if out is None else out.when(test, value)
    return out




def _none(kind: str = "string"):
    return F.lit(None).cast(kind)


# Dates and spans.


@query("SELECT event_id, CASE WHEN days > 0 THEN ts + to_days(CAST(days AS INTEGER)) END AS until FROM (SELECT *, coalesce(CASE event_id % 3 WHEN 0 THEN event_id % 30 WHEN 1 THEN 0 END, 0) + coalesce(CASE WHEN event_id % 2 = 0 THEN event_id % 3 END, 0) * 365 AS days FROM events)")
def default_retention(spark, sf):
    i = F.col("event_id")
    days = _case(i, (i % 30).cast("int"), 0, _none("int"))
    years = F.when(i % 2 == 0, (i % 3).cast("int"))
    return _events(spark, sf).select("event_id", times.default_retention(days, years, F.col("ts")).alias("until"))


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-03-05 06:07:08' WHEN 1 THEN TIMESTAMP '2024-03-05 06:07:08' WHEN 3 THEN {v.NOW} + to_hours(2) END AS expiry FROM events")
def expiry_directive(spark, sf):
    absolute = _case(F.col("event_id"), "2024-03-05T06:07:08Z", "Tue, 05 Mar 2024 06:07:08 GMT", "nonsense", _none())
    return _events(spark, sf).select("event_id", times.expiry_from(absolute, F.lit("2h"), _at(views.NOW)).alias("expiry"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN date_trunc('second', ts) END AS parsed FROM events")
def time_parse(spark, sf):
    text = _case(F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.date_format("ts", "dd.MM.yyyy"))
    return _events(spark, sf).select("event_id", times.parse_time(text).alias("parsed"))


@query(
    f"""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' ELSE (s // 86400) || ' d ago' END AS ago
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 100 WHEN 1 THEN event_id % 7200 WHEN 2 THEN event_id * 7 % 200000 ELSE -5 END AS s FROM events)"""
)
def relative_time(spark, sf):
    i = F.col("event_id")
    s = _case(i, i % 100, i % 7200, i * 7 % 200000, F.lit(-5).cast("bigint"))
    at = F.timestamp_add("SECOND", -s, _at(views.NOW)).cast("timestamp_ntz")
    return _events(spark, sf).select("event_id", times.relative_time(at, _at(views.NOW)).alias("ago"))


@query(
    """SELECT event_id, e BETWEEN 1 AND 604800 AND age <= e AND age >= -900 AS valid FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 604800 WHEN 2 THEN 604801 ELSE 3600 END AS e, event_id % 8000 - 2000 AS age FROM events)"""
)
def presign_window(spark, sf):
    i = F.col("event_id")
    signed = F.timestamp_add("SECOND", -(i % 8000 - 2000), _at(views.NOW)).cast("timestamp_ntz")
    return _events(spark, sf).select("event_id", rq.presign_valid(_case(i, 0, 604_800, 604_801, 3600), signed, _at(views.NOW)).alias("valid"))


# Sizes.


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN n * 1024 WHEN 1 THEN n * 1048576 WHEN 2 THEN n * 1073741824 WHEN 3 THEN n WHEN 4 THEN n * 1024 END AS bytes FROM (SELECT event_id, event_id % 500 AS n FROM events)"""
)
def size_parse(spark, sf):
    n = (F.col("event_id") % 500).cast("string")
    text = _case(F.col("event_id"), F.concat(n, F.lit("k")), F.concat(n, F.lit("MiB")), F.concat(n, F.lit(" G")), n, F.concat(n, F.lit("KB")), F.concat(n, F.lit("x")))
    return _events(spark, sf).select("event_id", meta.size_bytes(text).alias("bytes"))


@query(
    """SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576) ELSE printf('%.1f GiB', n / 1073741824) END AS text
FROM (SELECT event_id, CAST(pow(10, event_id % 9) AS BIGINT) * (event_id % 97) * 2 + 7 AS n FROM events)"""
)
def human_size(spark, sf):
    n = F.pow(F.lit(10.0), F.col("event_id") % 9).cast("bigint") * (F.col("event_id") % 97) * 2 + 7
    return _events(spark, sf).select("event_id", meta.human_size(n).alias("text"))


@query(v.with_(v.DOCS) + "SELECT doc_id, CAST(size + ceil(size / 65536) * 16 AS BIGINT) AS sealed, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN size + 5 ELSE size END AS logical FROM docs")
def stored_sizes(spark, sf):
    sse, packed = F.when(F.col("doc_id") % 3 == 0, "AES256").otherwise(""), F.when(F.col("doc_id") % 4 == 0, "zstd")
    logical = meta.logical_size(F.col("size"), F.col("size") + 5, sse, packed)
    return views.doc_objects(spark, sf).select("doc_id", hashing.encrypted_size(F.col("size")).alias("sealed"), logical.alias("logical"))


@query("SELECT event_id, CAST(n // 2 AS INTEGER) AS parity, CAST(n - n // 2 AS INTEGER) AS read, CAST(n - n // 2 + 1 AS INTEGER) AS write FROM (SELECT event_id, event_id % 16 + 1 AS n FROM events)")
def quorum_sizes(spark, sf):
    parity, read, write = hashing.quorums(F.col("event_id") % 16 + 1)
    return _events(spark, sf).select("event_id", parity.alias("parity"), read.alias("read"), write.alias("write"))


@query(
    """SELECT event_id, CASE WHEN cover THEN ww ELSE greatest(1, CAST(floor(w * s + 0.5) AS INTEGER)) END AS w, CASE WHEN cover THEN wh ELSE greatest(1, CAST(floor(h * s + 0.5) AS INTEGER)) END AS h
FROM (SELECT *, event_id % 4 = 0 AND ww > 0 AND wh > 0 AS cover, least(CASE WHEN ww > 0 THEN ww::DOUBLE / w ELSE 1e9 END, CASE WHEN wh > 0 THEN wh::DOUBLE / h ELSE 1e9 END, 1.0::DOUBLE) AS s
FROM (SELECT event_id, CAST(event_id % 1900 + 1 AS INTEGER) AS w, CAST(event_id % 1100 + 1 AS INTEGER) AS h, CAST(event_id % 3 * 200 AS INTEGER) AS ww, CAST(event_id % 5 * 150 AS INTEGER) AS wh FROM events))"""
)
def preview_sizes(spark, sf):
    i = F.col("event_id")
    size = meta.preview_size((i % 1900 + 1).cast("int"), (i % 1100 + 1).cast("int"), (i % 3 * 200).cast("int"), (i % 5 * 150).cast("int"), F.when(i % 4 == 0, "cover").otherwise("contain"))
    return _events(spark, sf).withColumn("p", size).select("event_id", "p.w", "p.h")


# Names and paths.


@query(v.with_(v.DOCS) + "SELECT doc_id, 'a%20b%2Fc%2A~%C3%A9%2B' || doc_id AS encoded, 'a%20b/' || doc_id AS path, 'a%20=' || doc_id || '&b=%2F&z=' AS query, 'x y ' || doc_id AS header FROM docs")
def uri_texts(spark, sf):
    i = F.col("doc_id").cast("string")
    pair = lambda k, x: F.struct(F.lit(k).alias("key"), x.alias("value"))
    query_text = meta.canonical_query(F.array(pair("z", F.lit("")), pair("b", F.lit("/")), pair("a ", i)))
    return views.doc_objects(spark, sf).select(
        "doc_id", meta.uri_encode(F.concat(F.lit("a b/c*~é+"), i)).alias("encoded"), meta.uri_encode(F.concat(F.lit("a b/"), i), keep_slash=True).alias("path"), query_text.alias("query"), meta.header_value(F.concat(F.lit("  x \t y  "), i, F.lit(" "))).alias("header")
    )


@query(v.with_(v.DOCS) + "SELECT doc_id, bucket, 'a b' || doc_id AS key FROM docs")
def copy_sources(spark, sf):
    bucket, key = keys.copy_source(F.concat(F.lit("/"), F.col("bucket"), F.lit("/a%20b"), F.col("doc_id").cast("string"), F.lit("?versionId=1")))
    return views.doc_objects(spark, sf).select("doc_id", bucket.alias("bucket"), key.alias("key"))


@query(v.with_(v.DOCS) + "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' ELSE bucket END AS b, CASE doc_id % 3 WHEN 2 THEN key ELSE '' END AS o, CASE WHEN doc_id % 2 = 0 THEN bucket END AS vhost FROM docs")
def path_parse(spark, sf):
    path = _case(F.col("doc_id"), "/", F.concat(F.lit("/"), F.col("bucket")), F.concat(F.lit("/"), F.col("bucket"), F.lit("/"), F.col("key")))
    host = F.when(F.col("doc_id") % 2 == 0, F.concat("bucket", F.lit(".s3.local:9000"))).otherwise("s3.local:9000")
    b, o = keys.split_path(path)
    return views.doc_objects(spark, sf).select("doc_id", b.alias("b"), o.alias("o"), projections.bucket_of_host(host, "s3.local").alias("vhost"))


@query("SELECT event_id, 'up/f' || event_id || '.txt' AS named, 'in/' || strftime(ts, '%Y%m%dT%H%M%SZ') AS dated, CASE event_id % 3 WHEN 0 THEN least(900, greatest(10, event_id)) ELSE 10 END AS clamped, CASE event_id % 2 WHEN 0 THEN '1.2.3.4' ELSE '10.0.0.' || event_id END AS ip FROM events")
def request_names(spark, sf):
    i = F.col("event_id").cast("string")
    named = keys.template_name(F.lit("up/${filename}"), F.concat(F.lit("f"), i, F.lit(".txt")))
    clamped = meta.clamp(_case(F.col("event_id"), i, "x", "-5"), 10, 900)
    ip = meta.client_ip(_case(F.col("event_id"), " 1.2.3.4 , 9.9.9.9", ""), F.concat(F.lit("10.0.0."), i, F.lit(":5000")))
    return _events(spark, sf).select("event_id", named.alias("named"), keys.dated_key(F.lit("in/"), F.col("ts")).alias("dated"), clamped.alias("clamped"), ip.alias("ip"))


@query(v.with_(v.WEB) + "SELECT id, CASE WHEN key = '' OR key LIKE '%/' THEN key || 'index.html' ELSE key END AS first, id % 3 = 0 AS website, id % 4 < 2 AS internal FROM web")
def website_reads(spark, sf):
    names = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("acl")))
    path = _case(F.col("id"), "/-/health/live", "/-/metrics", F.concat(F.lit("/"), F.col("key")), "/-/other")
    rows = views.web_objects(spark, sf)
    return rows.select("id", keys.website_key(F.concat(F.lit("/"), F.col("key"))).alias("first"), projections.website_request(F.lit(True), names).alias("website"), projections.internal_path(path).alias("internal"))


# Metadata and headers.


@query(v.with_(v.DOCS) + "SELECT doc_id, 'text/plain' AS content_type, CASE WHEN doc_id % 2 = 0 THEN 'gzip' END AS content_encoding, bucket AS a, 2 AS n FROM docs")
def stored_metadata(spark, sf):
    base = F.create_map(F.lit("Content-Type"), F.lit("text/plain"), F.lit("X-A"), F.lit("first"), F.lit("x-a"), F.col("bucket"), F.lit("b"), F.lit("2"))
    options = F.when(F.col("doc_id") % 2 == 0, F.map_concat(base, F.create_map(F.lit("Content-Encoding"), F.lit("gzip")))).otherwise(base)
    return views.doc_objects(spark, sf).withColumn("m", projections.stored_metadata(options)).select("doc_id", "m.content_type", "m.content_encoding", F.col("m.user")["x-a"].alias("a"), F.size("m.user").alias("n"))


@query(v.with_(v.DOCS) + "SELECT doc_id, '\"' || etag || '\"' AS tag, bucket AS owner, CASE WHEN doc_id % 2 = 0 THEN '2' END AS tags, 'soon' || doc_id AS expires, CASE WHEN doc_id % 3 = 0 THEN 'x/y' ELSE 'text/plain; charset=utf-8' END AS kind FROM docs")
def response_headers(spark, sf):
    h = projections.response_headers(F.create_map(F.lit("owner"), F.col("bucket")), F.col("etag"), _case(F.col("doc_id"), "x=1&y=2", ""))
    expires = meta.expiry_text(F.create_map(F.lit("a"), F.lit("1"), F.lit("X-Store-Expires"), F.concat(F.lit("soon"), F.col("doc_id").cast("string"))))
    kind = meta.content_type(F.col("key"), _case(F.col("doc_id"), "x/y", "", _none()))
    get = lambda k: F.try_element_at("h", F.lit(k))
    return views.doc_objects(spark, sf).withColumn("h", h).select("doc_id", get("ETag").alias("tag"), get("x-amz-meta-owner").alias("owner"), get("x-amz-tagging-count").alias("tags"), expires.alias("expires"), kind.alias("kind"))


@query(v.with_(v.DOCS) + "SELECT doc_id, doc_id % 4 IN (0, 3) AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS verifiable FROM docs")
def verifiable_etags(spark, sf):
    etag = _case(F.col("doc_id"), F.col("etag"), F.concat("etag", F.lit("-2")), F.concat(F.lit("A"), F.substring("etag", 2, 31)), F.col("etag"))
    ok = meta.verifiable_etag(etag, F.when(F.col("doc_id") % 5 == 0, "AES256"), F.when(F.col("doc_id") % 7 == 0, "zstd"))
    return views.doc_objects(spark, sf).select("doc_id", ok.alias("verifiable"))


@query("SELECT doc_id, to_base64(unhex(sha1(text))) AS sha1, to_base64(unhex(sha256(text))) AS sha256 FROM documents")
def checksums(spark, sf):
    data = F.col("text").cast("binary")
    return views.table(spark, sf, "documents").select("doc_id", hashing.checksum("sha1", data).alias("sha1"), hashing.checksum("sha256", data).alias("sha256"))


@query(v.with_(v.DOCS) + "SELECT count(DISTINCT (bucket, etag)) AS contents FROM docs")
def content_votes(spark, sf):
    return views.doc_objects(spark, sf).agg(F.count_distinct(hashing.content_hash(F.col("bucket"), F.col("etag"))).alias("contents"))


_CODES = ", ".join(f"({i}, '{o}', '{c}', {rq.ERROR_STATUS[c]})" for i, (o, c) in enumerate(rq.OUTCOME_CODES.items()))


@query(f"SELECT event_id, CASE WHEN event_id % 21 < 20 THEN coalesce(code, 'InternalError') END AS code, CASE WHEN event_id % 21 = 20 THEN 200 ELSE coalesce(status, 500) END AS status FROM events LEFT JOIN (VALUES {_CODES}) t(i, outcome, code, status) ON i = event_id % 21")
def error_codes(spark, sf):
    return rq.with_error(_events(spark, sf).select("event_id", _case(F.col("event_id"), *rq.OUTCOME_CODES, "weird", _none()).alias("outcome"))).select("event_id", "code", "status")


# Conditions.


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN there WHEN 2 THEN there ELSE false END AND CASE doc_id % 5 WHEN 0 THEN NOT there ELSE true END AS go
FROM (SELECT doc_id, doc_id % 3 <> 0 AS there FROM documents)"""
)
def put_conditions(spark, sf):
    i = F.col("doc_id")
    match = _case(i, _none(), "*", F.concat(F.lit('"'), F.col("etag"), F.lit('"')), '"other"')
    none = _case(i, "*", '"other"', _none(), _none(), _none())
    return views.doc_objects(spark, sf).select("doc_id", rq.put_condition(F.when(i % 3 != 0, F.col("etag")), match, none).alias("go"))


@query(v.with_(v.DOCS) + "SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 <> 0 AND size BETWEEN 100 AND 4000 AND doc_id % 7 <> 0 AS holds FROM docs")
def form_policies(spark, sf):
    i = F.col("doc_id")
    one = lambda op, field, value: F.struct(F.lit(op).alias("op"), F.lit(field).alias("field"), F.lit(value).alias("value"))
    rules = F.array(one("eq", "$key", "a/b"), one("starts-with", "$Content-Type", "text/"), one("content-length-range", "", "100,4000"))
    rules = F.when(i % 7 == 0, F.array(one("matches", "$key", "a"))).otherwise(rules)
    fields = F.create_map(F.lit("key"), _case(i, "a/b", "a/c"), F.lit("content-type"), _case(i, "image/png", "text/plain", "text/html"))
    return views.doc_objects(spark, sf).select("doc_id", notify.form_policy_holds(rules, fields, F.col("size")).alias("holds"))


_PRINCIPALS = [
    ("all", ["*"], None), ("user", ["arn:aws:iam::1:user/7"], None), ("service", ["x", "svc:12"], None), ("nobody named", [], None), ("equals", None, {"StringEquals": {"aws:username": ["5", "6"]}}),
    ("differs", None, {"StringNotEquals": {"aws:username": ["5"]}}), ("case", None, {"StringEqualsIgnoreCase": {"agent": ["CURL"]}}), ("like", None, {"StringLike": {"agent": ["W*t"]}}), ("like nothing", None, {"StringLike": {"missing": ["x"]}}),
    ("network", None, {"IpAddress": {"aws:SourceIp": ["2001:db8::/32"]}}), ("outside", None, {"NotIpAddress": {"aws:SourceIp": ["2001:db8::/32", "10.0.0.0/8"]}}), ("unknown", None, {"DateGreaterThan": {"x": ["1"]}}),
    ("two", ["*"], {"StringEquals": {"aws:username": ["5"]}, "IpAddress": {"aws:SourceIp": ["10.1.2.3"]}}),
]
_HOLDS = [
    "true", "user_id = 7", "user_id = 12", "true", "user_id IN (5, 6)", "user_id <> 5", "event_id % 2 = 0", "event_id % 2 = 1", "true", "event_id % 3 = 0", "event_id % 3 = 2", "true", "user_id = 5 AND event_id % 3 = 1",
]


@query(" UNION ALL ".join(f"SELECT event_id, '{name}' AS statement FROM events WHERE {holds}" for (name, _, _), holds in zip(_PRINCIPALS, _HOLDS, strict=True)))
def statement_conditions(spark, sf):
    """Each statement against each request: statements are a fixed list here."""
    i = F.col("event_id")
    rows = _events(spark, sf).select(
        "event_id", F.col("user_id").cast("string").alias("access_key"), F.lit("s3:GetObject").alias("action"), F.lit("b").alias("bucket"), F.lit("k").alias("object"),
        _case(i, "2001:db8::a:1", "10.1.2.3", "192.168.0.1").alias("source_ip"), F.create_map(F.lit("agent"), F.array(_case(i, "curl", "Wget"))).alias("condition_values"),
    )
    held = [F.when(_statement_holds(p, c), F.lit(name)) for name, p, c in _PRINCIPALS]
    return rows.select("event_id", F.explode(F.array_compact(F.array(*held))).alias("statement"))


def _statement_holds(principals, conditions):
    given = F.lit(None).cast("array<string>") if principals is None else F.lit(principals).cast("array<string>")
    rules = F.lit(None).cast("map<string,map<string,array<string>>>")
    if conditions is not None:
        rules = F.create_map(*[x for op, kv in conditions.items() for x in (F.lit(op), F.create_map(*[y for k, w in kv.items() for y in (F.lit(k), F.lit(w))]))])
    return iam.principal_matches(given, F.col("access_key")) & iam.conditions_hold(rules, F.col("access_key"), F.col("source_ip"), F.col("condition_values"))


@query("SELECT c_custkey, c_custkey % 2 = 0 OR (c_custkey % 3 = 0 AND c_custkey % 5 <> 0) AS allowed FROM customer")
def bucket_policies(spark, sf):
    i = F.col("c_custkey")
    ok = iam.bucket_policy_decision(i % 2 == 0, F.when(i % 3 != 1, i % 3 == 0), i % 5 == 0)
    return views.table(spark, sf, "customer").select("c_custkey", ok.alias("allowed"))


@query("SELECT 'p' || c_custkey AS policy, 'Allow' AS effect, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS actions, 'arn:aws:s3:::b' || c_custkey || '/*' AS resource, CASE WHEN c_custkey % 3 = 0 THEN '10.0.0.0/8' END AS ip FROM customer")
def policy_documents(spark, sf):
    i = F.col("c_custkey")
    actions = F.when(i % 2 == 0, '"s3:Get*"').otherwise('["s3:Get*","s3:List*"]')
    condition = F.when(i % 3 == 0, ',"Condition":{"IpAddress":{"aws:SourceIp":"10.0.0.0/8"}}').otherwise("")
    doc = F.concat(F.lit('{"Statement":[{"Effect":"Allow","Action":'), actions, F.lit(',"Resource":"arn:aws:s3:::b'), i.cast("string"), F.lit('/*"'), condition, F.lit("}]}"))
    rows = iam.parse_policies(views.table(spark, sf, "customer").select(F.concat(F.lit("p"), i.cast("string")).alias("policy"), doc.alias("document")))
    ip = F.get(F.try_element_at(F.try_element_at("conditions", F.lit("IpAddress")), F.lit("aws:SourceIp")), F.lit(0))
    return rows.select("policy", "effect", F.size("actions").alias("actions"), F.get("resources", F.lit(0)).alias("resource"), ip.alias("ip"))
