"""Registry of the engine's queries, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions import globs, hashing, keys, meta, projections, times
from quaystone.functions import requests as rq
from quaystone.operators import audit, changes, iam, lifecycle, listing, metrics, multipart, notify, quorum, snapshot, stateful, usage, versions
from quaystone.plans import sqlviews as v
from quaystone.plans.registry import QUERIES, SQL, query
from quaystone.sources import sinks, views

__all__ = ["QUERIES", "SQL"]


# Usage.


@query(v.with_(v.WEB) + "SELECT bucket, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM web GROUP BY 1")
def usage_by_bucket(spark, sf):
    return usage.by_bucket(views.web_objects(spark, sf))


@query(v.with_(v.DOCS) + "SELECT CASE WHEN grouping(bucket) = 1 THEN '(all)' ELSE bucket END AS bucket, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM docs GROUP BY ROLLUP (bucket)")
def usage_rollup_total(spark, sf):
    return usage.with_total(views.doc_objects(spark, sf))


FOLDERS = """folders AS (SELECT bucket, size, unnest(list_transform(range(0, len(string_split(key, '/'))), lambda i: CASE WHEN i = 0 THEN '' ELSE array_to_string(string_split(key, '/')[1:i], '/') || '/' END)) AS folder FROM {t}),
usage AS (SELECT bucket, folder, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM folders GROUP BY 1, 2)"""


@query(v.with_(v.WEB, FOLDERS.format(t="web")) + "SELECT * FROM usage")
def folder_usage(spark, sf):
    return usage.by_folder(views.web_objects(spark, sf))


@query(v.with_(v.DOCS, FOLDERS.format(t="docs")) + "SELECT * FROM usage WHERE bucket = 'src0' AND (folder = '' OR regexp_matches(folder, '^[^/]+/$'))")
def folder_children(spark, sf):
    return usage.children(usage.by_folder(views.doc_objects(spark, sf)), "src0")


@query(
    v.with_(v.DOCS)
    + """, u AS (SELECT bucket, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM docs GROUP BY 1), r AS (SELECT DISTINCT bucket FROM docs UNION ALL SELECT 'nowhere')
SELECT r.bucket, coalesce(u.bytes + 1000 > 100000, false) AS exceeded FROM r LEFT JOIN u USING (bucket)"""
)
def quota_check(spark, sf):
    docs = views.doc_objects(spark, sf)
    buckets = docs.select("bucket").distinct().unionByName(spark.createDataFrame([("nowhere",)], "bucket string"))
    config = buckets.withColumn("quota_bytes", F.lit(100_000)).withColumn("quota_objects", F.lit(0))
    return usage.quota_check(buckets.withColumn("add_bytes", F.lit(1000)), config, usage.by_bucket(docs)).select("bucket", "exceeded")


@query(v.with_(v.DOCS, v.REPLICAS) + "SELECT disk_idx % 2 AS set_idx, count(DISTINCT disk_idx) AS disks FROM replicas GROUP BY 1")
def disks_by_set(spark, sf):
    return views.replicas(spark, sf).groupBy((F.col("disk_idx") % 2).alias("set_idx")).agg(F.count_distinct("disk_idx").alias("disks"))


@query(
    v.with_(v.DOCS, v.REPLICAS)
    + """, d AS (SELECT CAST(doc_id % 4 AS INTEGER) AS set_idx, doc_id % 3 <> 0 AS online FROM docs)
SELECT set_idx, count(*) AS disks, count(*) FILTER (online) AS online, CAST(count(*) - count(*) // 2 + 1 AS BIGINT) AS write_quorum, count(*) FILTER (online) >= count(*) - count(*) // 2 + 1 AS healthy FROM d GROUP BY 1"""
)
def set_health(spark, sf):
    d = views.doc_objects(spark, sf).select((F.col("doc_id") % 4).cast("int").alias("set_idx"), (F.col("doc_id") % 3 != 0).alias("online"))
    return usage.set_health(d)


# Listings.

LIST_HOST = "tionsh.example.net"
ITEMS = """items AS (SELECT coalesce(CASE WHEN contains(substr(key, {n}), '/') THEN '{p}' || split_part(substr(key, {n}), '/', 1) || '/' END, key) AS item,
  contains(substr(key, {n}), '/') AS is_prefix, size, etag FROM web WHERE bucket = '{b}' AND starts_with(key, '{p}')),
folded AS (SELECT item, is_prefix, max(CASE WHEN NOT is_prefix THEN size END) AS size, max(CASE WHEN NOT is_prefix THEN etag END) AS etag, count(*) AS keys FROM items WHERE item > '{a}' GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (ORDER BY item) AS n, count(*) OVER () AS total FROM folded)
SELECT item, is_prefix, size, etag, keys, total > {k} AS is_truncated, max(CASE WHEN n = {k} AND total > {k} THEN item END) OVER () AS next_marker FROM numbered QUALIFY n <= {k}"""
FLAT = """SELECT item, false AS is_prefix, size, etag, keys, total > {k} AS is_truncated, max(CASE WHEN n = {k} AND total > {k} THEN item END) OVER () AS next_marker
FROM (SELECT *, row_number() OVER (ORDER BY item) AS n, count(*) OVER () AS total FROM (SELECT key AS item, max(size) AS size, max(etag) AS etag, count(*) AS keys FROM web WHERE bucket = '{b}' AND starts_with(key, '{p}') AND key > '{a}' GROUP BY 1)) QUALIFY n <= {k}"""


def _items(p="", a="", k=1000, b=LIST_HOST) -> str:
    return v.with_(v.WEB) + ", " + ITEMS.format(p=p, n=len(p) + 1, a=a, k=k, b=b)


@query(v.with_(v.WEB) + FLAT.format(b=LIST_HOST, p="", a="", k=20))
def list_flat_page(spark, sf):
    return listing.page(views.web_objects(spark, sf), LIST_HOST, max_keys=20)


@query(_items(k=3))
def list_delimited_page(spark, sf):
    return listing.page(views.web_objects(spark, sf), LIST_HOST, delimiter="/", max_keys=3)


@query(v.with_(v.WEB) + FLAT.format(b=LIST_HOST, p="en/", a="en/2", k=1000))
def list_start_after(spark, sf):
    return listing.page(views.web_objects(spark, sf), LIST_HOST, prefix="en/", after=listing.start_marker(start_after="en/2"))


@query(v.with_(v.WEB) + "SELECT DISTINCT bucket, split_part(key, '/', 1) || '/' AS common_prefix FROM web WHERE contains(key, '/')")
def list_common_prefixes(spark, sf):
    rows = views.web_objects(spark, sf).select("bucket", keys.common_prefix(F.col("key"), "", "/").alias("common_prefix"))
    return rows.where("common_prefix IS NOT NULL").distinct()


@query(v.with_(v.WEB) + f"SELECT bucket, key, size, etag, id FROM web WHERE bucket = '{LIST_HOST}' AND contains(lower(key), 'html') ORDER BY key LIMIT 1000")
def key_search(spark, sf):
    return listing.search(views.web_objects(spark, sf), LIST_HOST, "HTML")


@query(v.with_(v.WEB) + "SELECT DISTINCT bucket, key FROM web")
def namespace_walk(spark, sf):
    return listing.namespace(views.web_objects(spark, sf))


# Versions.

_V = v.with_(v.VER, v.FLAGGED, v.LATEST)
_COLS = "bucket, key, seq, version_id, delete_marker, mod_time, size"
_VC = [c.strip() for c in _COLS.split(",")]


@query(_V + f"SELECT {_COLS} FROM latest")
def versions_latest(spark, sf):
    return versions.latest(views.versions(spark, sf).select(*_VC))


@query(_V + f"SELECT {_COLS}, CAST(place AS INTEGER) AS place, place = 1 AS is_latest FROM flagged")
def versions_all_flagged(spark, sf):
    return versions.flagged(views.versions(spark, sf).select(*_VC))


@query(v.with_(v.VER) + f"SELECT {_COLS} FROM ver WHERE mod_time <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) = 1")
def versions_as_of(spark, sf):
    return versions.as_of(views.versions(spark, sf).select(*_VC), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query(_V + "SELECT bucket, key, seq FROM latest WHERE delete_marker")
def delete_marker_heads(spark, sf):
    return versions.marker_heads(views.versions(spark, sf)).select("bucket", "key", "seq")


@query(_V + "SELECT bucket, key, seq, CAST(place AS INTEGER) AS place FROM flagged WHERE place > 1")
def noncurrent_versions(spark, sf):
    return versions.noncurrent(views.versions(spark, sf)).select("bucket", "key", "seq", "place")


@query(v.with_(v.VER) + "SELECT bucket, key, seq, row_number() OVER (PARTITION BY bucket, key ORDER BY seq) AS revision FROM ver")
def revision_counter(spark, sf):
    return versions.revisions(views.versions(spark, sf)).select("bucket", "key", "seq", "revision")


@query(
    _V
    + """, live AS (SELECT bucket, key, seq AS live_size FROM latest WHERE seq % 2 = 0 UNION ALL SELECT 'b0', 'plain', 5), logged AS (SELECT * FROM latest WHERE seq % 3 = 0)
SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NOT NULL THEN b.size ELSE live_size END AS size, coalesce(delete_marker, false) AS delete_marker, b.key IS NOT NULL AS versioned
FROM live a FULL JOIN logged b ON a.bucket = b.bucket AND a.key = b.key"""
)
def merged_namespace(spark, sf):
    last = versions.latest(views.versions(spark, sf))
    live = last.where("seq % 2 = 0").select("bucket", "key", F.col("seq").alias("size")).unionByName(spark.createDataFrame([("b0", "plain", 5)], "bucket string, key string, size bigint"))
    return versions.merged_namespace(live, last.where("seq % 3 = 0"))


@query(_V + "SELECT bucket, key, seq FROM ver WHERE seq NOT IN (SELECT seq FROM latest WHERE size % 2 = 0)")
def head_promotion(spark, sf):
    log = views.versions(spark, sf)
    gone = versions.latest(log).where("size % 2 = 0").select("bucket", "key", "version_id")
    return log.join(gone, ["bucket", "key", "version_id"], "left_anti").select("bucket", "key", "seq")


@query(
    v.with_(v.VER)
    + f"""SELECT bucket, key, seq, legal_hold OR coalesce(retain_until > {v.NOW} AND (lock_mode = 'COMPLIANCE' OR (lock_mode = 'GOVERNANCE' AND NOT seq % 2 = 0)), false) AS blocked FROM ver"""
)
def object_lock_blocked(spark, sf):
    now = F.lit(views.NOW).cast("timestamp_ntz")
    b = versions.lock_blocks(F.col("legal_hold"), F.col("retain_until"), F.col("lock_mode"), F.col("seq") % 2 == 0, now)
    return views.versions(spark, sf).select("bucket", "key", "seq", F.coalesce(b, F.lit(False)).alias("blocked"))


@query(
    _V
    + """SELECT bucket, key, max(seq) + n AS seq, 'new' || n AS version_id FROM ver, (SELECT range AS n FROM range(1, 3)) GROUP BY bucket, key, n HAVING max(seq) % 2 = 0 UNION ALL SELECT bucket, key, seq, version_id FROM ver"""
)
def put_versions(spark, sf):
    """Two puts of a key in one batch make two versions, in their order."""
    log = views.versions(spark, sf)
    new = versions.latest(log).where("seq % 2 = 0").select("bucket", "key", F.explode(F.lit([2, 1])).alias("place"))
    new = new.withColumn("version_id", F.concat(F.lit("new"), F.col("place").cast("string")))
    return versions.put(log, new, order=["place"]).select("bucket", "key", "seq", "version_id")


# Lifecycle.

_DUE = f"({{d}} > 0 AND {{t}} <= {v.NOW} - to_days({{d}}))"
_HEADS = v.with_(v.VER, v.FLAGGED, v.LATEST, v.RULES, "heads AS (SELECT * FROM latest WHERE NOT delete_marker)")
_MATCH = "ON o.bucket = r.rule_bucket AND starts_with(o.key, r.prefix)"
_EXPIRING = f"""SELECT o.bucket, o.key, arg_min(r.id, r.rule_pos) AS rule_id, any_value(o.size) AS size FROM heads o JOIN rules r {_MATCH}
  AND (coalesce({v.NOW} > expiration_date, false) OR coalesce({_DUE.format(d="expiration_days", t="mod_time")}, false)) GROUP BY 1, 2"""


@query(_HEADS + _EXPIRING)
def lifecycle_expire_first_match(spark, sf):
    return lifecycle.expire(versions.heads(views.versions(spark, sf)), views.rules(spark), views.NOW)


@query(
    _HEADS
    + f""", gone AS ({_EXPIRING}) SELECT o.bucket, o.key, arg_min(r.id, r.rule_pos) AS rule_id, arg_min(r.transition_tier, r.rule_pos) AS transition_tier FROM heads o JOIN rules r {_MATCH}
  AND {_DUE.format(d="transition_days", t="mod_time")} WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.bucket = o.bucket AND g.key = o.key) GROUP BY 1, 2"""
)
def lifecycle_transition(spark, sf):
    return lifecycle.transition(versions.heads(views.versions(spark, sf)), views.rules(spark), views.NOW)


@query(
    _HEADS
    + f"""SELECT bucket, key, seq, days FROM (SELECT o.bucket, o.key, o.seq, any_value(o.mod_time) AS t, min(noncurrent_days) AS days FROM flagged o JOIN rules r {_MATCH} AND noncurrent_days > 0 WHERE place > 1 GROUP BY 1, 2, 3)
WHERE {_DUE.format(d="days", t="t")}"""
)
def noncurrent_expire_min_rule(spark, sf):
    return lifecycle.expire_noncurrent(views.versions(spark, sf), views.rules(spark), views.NOW)


_STALE_NOW = "2001-08-02 00:00:00"


@query(
    v.with_(v.UPLOADS, v.RULES)
    + f"""SELECT bucket, key, upload_id, days FROM (SELECT o.bucket, o.key, o.upload_id, any_value(initiated) AS t, least(min(abort_mpu_days), 7) AS days FROM uploads o LEFT JOIN rules r {_MATCH} AND abort_mpu_days > 0 GROUP BY 1, 2, 3)
WHERE t <= TIMESTAMP '{_STALE_NOW}' - to_days(days)"""
)
def stale_upload_abort(spark, sf):
    return lifecycle.stale_uploads(views.uploads(spark, sf), views.rules(spark), _STALE_NOW)


@query(v.with_(v.VER) + f"SELECT bucket, key, seq FROM ver WHERE {v.NOW} > retain_until")
def ttl_expired(spark, sf):
    return lifecycle.own_expiry(views.versions(spark, sf).withColumn("expires_at", F.col("retain_until")), views.NOW).select("bucket", "key", "seq")


@query(v.with_(v.VER) + f"SELECT bucket, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM ver WHERE retain_until >= {v.NOW} GROUP BY 1")
def usage_scan(spark, sf):
    return usage.scan_usage(views.versions(spark, sf).withColumn("expires_at", F.col("retain_until")), views.NOW)


# Snapshots, backups, deduplication.

_SNAP = """, was AS (SELECT bucket, key, version_id FROM (SELECT * FROM ver WHERE mod_time <= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) = 1) WHERE NOT delete_marker),
cur AS (SELECT bucket, key, version_id FROM latest WHERE NOT delete_marker)"""


def _snap(spark, sf):
    log = views.versions(spark, sf)
    then = versions.as_of(log, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).where("NOT delete_marker")
    return then, versions.heads(log)


@query(
    _V + _SNAP
    + """ SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.key, b.key) AS key, a.version_id AS was, b.version_id AS now,
CASE WHEN a.version_id IS NULL THEN 'remove' WHEN a.version_id IS NOT DISTINCT FROM b.version_id THEN 'unchanged' ELSE 'restore' END AS action
FROM was a FULL JOIN cur b ON a.bucket = b.bucket AND a.key = b.key"""
)
def snapshot_diff(spark, sf):
    return snapshot.diff(*_snap(spark, sf))


@query(_V + _SNAP + " SELECT bucket, key FROM cur EXCEPT SELECT bucket, key FROM was")
def snapshot_removed(spark, sf):
    return snapshot.created_since(*_snap(spark, sf)).select("bucket", "key")


_REMOTE = "SELECT bucket, key, CASE WHEN doc_id % 5 = 1 THEN size + 1 ELSE size END AS size, etag FROM docs WHERE doc_id % 5 <> 0"


def _remote(docs):
    size = F.when(F.col("doc_id") % 5 == 1, F.col("size") + 1).otherwise(F.col("size"))
    return docs.where("doc_id % 5 <> 0").select("bucket", "key", size.alias("size"), "etag")


@query(v.with_(v.DOCS) + f", remote AS ({_REMOTE}) SELECT bucket, key, size FROM docs d WHERE NOT EXISTS (SELECT 1 FROM remote r WHERE r.bucket = d.bucket AND r.key = d.key AND r.size = d.size)")
def backup_copy_plan(spark, sf):
    docs = views.doc_objects(spark, sf)
    return snapshot.backup_plan(docs, _remote(docs)).select("bucket", "key", "size")


@query(v.with_(v.DOCS) + f", remote AS ({_REMOTE}) SELECT bucket, key, size FROM docs d WHERE EXISTS (SELECT 1 FROM remote r WHERE r.bucket = d.bucket AND r.key = d.key AND r.size = d.size)")
def backup_skip(spark, sf):
    docs = views.doc_objects(spark, sf)
    return snapshot.backup_skip(docs, _remote(docs)).select("bucket", "key", "size")


@query(v.with_(v.DOCS) + "SELECT data_ref, count(*) AS copies, max(size) AS size, min(bucket || '/' || key) AS first, (count(*) - 1) * max(size) AS saved FROM docs GROUP BY 1 HAVING count(*) > 1")
def dedup_groups(spark, sf):
    return snapshot.dedup_groups(views.doc_objects(spark, sf))


@query(v.with_(v.DOCS) + "SELECT count(*) AS groups, CAST(sum(saved) AS BIGINT) AS saved FROM (SELECT (count(*) - 1) * max(size) AS saved FROM docs GROUP BY data_ref HAVING count(*) > 1)")
def dedup_savings(spark, sf):
    return snapshot.dedup_groups(views.doc_objects(spark, sf)).agg(F.count("*").alias("groups"), F.sum("saved").alias("saved"))


@query(
    v.with_(v.DOCS)
    + f""", blobs AS (SELECT data_ref AS hash, max({v.NOW} - to_minutes(doc_id)) AS installed_at FROM docs GROUP BY 1)
SELECT hash FROM blobs b WHERE installed_at <= {v.NOW} - to_hours(1) AND NOT EXISTS (SELECT 1 FROM docs d WHERE d.data_ref = b.hash AND d.doc_id % 3 <> 0)"""
)
def cas_gc_candidates(spark, sf):
    docs, now = views.doc_objects(spark, sf), F.lit(views.NOW).cast("timestamp_ntz")
    at = F.timestamp_add("MINUTE", (-F.col("doc_id")).cast("int"), now).cast("timestamp_ntz")
    blobs = docs.groupBy(F.col("data_ref").alias("hash")).agg(F.max(at).alias("installed_at"))
    return snapshot.collectable(blobs, docs.where("doc_id % 3 <> 0"), now).select("hash")


# Requests.


@query(v.with_(v.REQ) + "SELECT method, (status // 100) || 'xx' AS class, count(*) AS requests FROM req GROUP BY 1, 2")
def req_counts(spark, sf):
    return metrics.counts(views.requests(spark, sf))


_BOUNDS = ", ".join(f"({b!r}, '{b}')" for b in metrics.BOUNDS)


@query(
    v.with_(v.REQ)
    + f"SELECT action, le, count(*) FILTER (seconds <= bound) AS n FROM req, (VALUES {_BOUNDS}, (CAST('inf' AS DOUBLE), '+Inf')) b(bound, le) GROUP BY 1, 2"
)
def latency_histogram(spark, sf):
    return metrics.histogram(views.requests(spark, sf), "action")


@query(
    v.with_(v.REQ)
    + """SELECT action, bytes AS value, n FROM (SELECT action, bytes, row_number() OVER (PARTITION BY action ORDER BY bytes) - 1 AS i, count(*) OVER (PARTITION BY action) AS n FROM req) WHERE i = CAST(floor(n * 0.95) AS BIGINT) % n"""
)
def latency_percentiles(spark, sf):
    return metrics.percentile(views.requests(spark, sf), "bytes", 0.95, "action")


@query(v.with_(v.REQ) + "SELECT req_id, time, action, status FROM req ORDER BY time DESC, req_id DESC LIMIT 500")
def recent_requests(spark, sf):
    return metrics.recent(views.requests(spark, sf), 500).select("req_id", "time", "action", "status")


@query(v.with_(v.REQ) + "SELECT CASE status WHEN 404 THEN 'NoSuchKey' ELSE 'SlowDown' END AS code, count(*) AS errors FROM req WHERE status >= 400 GROUP BY 1")
def error_counts(spark, sf):
    return metrics.errors(views.requests(spark, sf))


@query(v.with_(v.REQ) + "SELECT time_bucket(INTERVAL 1 HOUR, time) AS start, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) / 3600 AS per_second FROM req GROUP BY 1")
def throughput_hourly(spark, sf):
    return metrics.throughput(views.requests(spark, sf))


@query(v.with_(v.REQ) + "SELECT (CASE WHEN status <= 0 THEN 200 ELSE status END // 100) || 'xx' AS class, count(*) AS n FROM req GROUP BY 1")
def status_class(spark, sf):
    return views.requests(spark, sf).groupBy(rq.status_class(F.col("status")).alias("class")).agg(F.count("*").alias("n"))


@query(
    v.with_(v.REQ)
    + """SELECT CASE method WHEN 'PUT' THEN CASE WHEN req_id % 2 = 0 THEN 's3:PutObjectTagging' ELSE 's3:PutObject' END WHEN 'GET' THEN CASE WHEN req_id % 2 = 0 THEN 's3:GetObjectTagging' ELSE 's3:GetObject' END
WHEN 'DELETE' THEN 's3:DeleteObject' ELSE 's3:GetObject' END AS action_name, count(*) AS n FROM req GROUP BY 1"""
)
def action_mix(spark, sf):
    tagging = F.when(F.col("req_id") % 2 == 0, F.array(F.lit("tagging"))).otherwise(F.array().cast("array<string>"))
    name = rq.action_name(F.col("method"), F.lit("b"), F.lit("o"), tagging)
    return views.requests(spark, sf).groupBy(name.alias("action_name")).agg(F.count("*").alias("n"))


@query(v.with_(v.REQ) + "SELECT count(*) FILTER (cache = 'HIT') AS hits, count(*) FILTER (cache = 'MISS') AS misses FROM req")
def cache_stats(spark, sf):
    return metrics.cache_stats(views.requests(spark, sf))


@query(
    v.with_(v.REQ)
    + """, moves AS (SELECT access_key, req_id, time AS "at", bytes AS change FROM req UNION ALL SELECT access_key, req_id, time + to_milliseconds(bytes), -bytes FROM req)
SELECT access_key, req_id, "at", CAST(sum(change) OVER w AS BIGINT) AS bytes, sum(change) OVER w > 100000 AS over FROM moves WINDOW w AS (PARTITION BY access_key ORDER BY "at", change, req_id ROWS UNBOUNDED PRECEDING)"""
)
def in_flight_bytes(spark, sf):
    return metrics.in_flight(views.requests(spark, sf), 100_000, "access_key").select("access_key", "req_id", "at", "bytes", "over")


@query(
    v.with_(v.REQ)
    + """, marked AS (SELECT access_key, time, CASE WHEN time < lag(time) OVER (PARTITION BY access_key ORDER BY time) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM req),
s AS (SELECT access_key, time, sum(fresh) OVER (PARTITION BY access_key ORDER BY time) AS n FROM marked) SELECT access_key, min(time) AS start, count(*) AS requests FROM s GROUP BY access_key, n"""
)
def sessionised_requests(spark, sf):
    return metrics.sessions(views.requests(spark, sf))


@query(v.with_(v.REQ) + "SELECT time_bucket(INTERVAL 1 HOUR, time) AS start, action, count(*) AS requests FROM req GROUP BY 1, 2")
def tumbling_requests(spark, sf):
    rows = views.requests(spark, sf).groupBy(F.window("time", "1 hour").alias("w"), "action").agg(F.count("*").alias("requests"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "action", "requests")


@query(v.with_(v.REQ) + "SELECT 'requests_total{method=\"' || method || '\",class=\"' || (status // 100) || 'xx\"} ' || count(*) AS line FROM req GROUP BY method, status // 100")
def metrics_exposition(spark, sf):
    return metrics.exposition(metrics.counts(views.requests(spark, sf)), "requests_total", "requests", "method", "class")


@query(
    v.with_(v.REQ)
    + """SELECT peer, min(seq) AS first_seq, min(CASE WHEN place = 4 THEN seq END) AS tripped_seq, count(*) AS length FROM (
SELECT *, row_number() OVER (PARTITION BY peer, island ORDER BY seq) AS place FROM (SELECT access_key AS peer, req_id AS seq, status < 300 AS ok, sum(CASE WHEN status < 300 THEN 1 ELSE 0 END) OVER (PARTITION BY access_key ORDER BY req_id) AS island FROM req) WHERE NOT ok)
GROUP BY peer, island HAVING count(*) >= 4"""
)
def breaker_trips(spark, sf):
    calls = views.requests(spark, sf).select(F.col("access_key").alias("peer"), F.col("req_id").alias("seq"), (F.col("status") < 300).alias("ok"))
    return stateful.breaker_trips(calls)


@query(
    v.with_(v.REQ).replace("WITH", "WITH RECURSIVE", 1)
    + """, e AS (SELECT access_key, epoch_us(time) / 1000000 AS t, row_number() OVER (PARTITION BY access_key ORDER BY epoch_us(time) / 1000000, req_id) AS n FROM req),
f AS (SELECT access_key, n, t, 5.0::DOUBLE - 1.0 AS tokens, true AS ok FROM e WHERE n = 1 UNION ALL
SELECT access_key, n, t, CASE WHEN room >= 1 THEN room - 1 ELSE room END, room >= 1 FROM (SELECT e.access_key, e.n, e.t, least(5.0::DOUBLE, f.tokens + (e.t - f.t) * (1::DOUBLE / 3600)) AS room FROM f JOIN e ON e.access_key = f.access_key AND e.n = f.n + 1))
SELECT access_key, CAST(count(*) FILTER (ok) AS INTEGER) AS passed, CAST(count(*) FILTER (NOT ok) AS INTEGER) AS refused FROM f GROUP BY 1"""
)
def token_bucket(spark, sf):
    return stateful.token_bucket(views.requests(spark, sf), rate=1 / 3600, burst=5)


@query()
def breaker_states(spark, sf):
    at = F.unix_seconds(F.col("time").cast("timestamp")).cast("double").alias("at")
    calls = views.requests(spark, sf).select(F.col("access_key").alias("peer"), F.col("req_id").alias("seq"), at, (F.col("status") < 300).alias("ok"))
    return stateful.breaker_states(calls, failures=2, cooldown=86_400.0)


@query()
def lru_hits(spark, sf):
    at = F.unix_seconds(F.col("time").cast("timestamp")).cast("double").alias("at")
    reads = views.requests(spark, sf).select((F.col("access_key") % 16).alias("node"), F.col("req_id").alias("seq"), F.col("action").alias("key"), F.col("bytes").alias("size"), at)
    return stateful.lru_hits(reads, 60_000, 86_400.0)


@query(
    v.with_(v.REQ)
    + """, e AS (SELECT 'b' || access_key % 10 AS bucket, CAST(access_key AS VARCHAR) AS key, time AS "at", CASE WHEN status >= 500 THEN 'queued' ELSE 'healed' END AS kind FROM req WHERE status >= 500 OR status = 304),
h AS (SELECT bucket, key, max("at") AS healed_at FROM e WHERE kind = 'healed' GROUP BY 1, 2) SELECT e.bucket, e.key, min("at") AS first_seen FROM e LEFT JOIN h USING (bucket, key) WHERE kind = 'queued' AND (healed_at IS NULL OR "at" > healed_at) GROUP BY 1, 2"""
)
def repair_queue(spark, sf):
    rows = views.requests(spark, sf).where("status >= 500 OR status = 304")
    bucket = F.concat(F.lit("b"), (F.col("access_key") % 10).cast("string"))
    events = rows.select(bucket.alias("bucket"), F.col("access_key").cast("string").alias("key"), F.col("time").alias("at"), F.when(F.col("status") >= 500, "queued").otherwise("healed").alias("kind"))
    return stateful.repair_queue(events)


# Replicas and placement.

_R = v.with_(v.DOCS, v.REPLICAS)
_VOTE = """counts AS (SELECT bucket, key, content, count(*) AS votes, max(revision) AS revision FROM replicas WHERE online GROUP BY 1, 2, 3),
won AS (SELECT bucket, key, content, votes, revision, CASE WHEN votes >= 3 THEN 'ok' ELSE 'corrupt' END AS outcome FROM counts QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY votes DESC, revision DESC, content DESC) = 1)"""


@query(_R + ", " + _VOTE + " SELECT * FROM won")
def quorum_vote(spark, sf):
    return quorum.vote(views.replicas(spark, sf), 3)


@query(_R + ", counts AS (SELECT bucket, key, content, count(*) AS votes FROM replicas WHERE online GROUP BY 1, 2, 3) SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY votes DESC, content DESC) = 1")
def config_majority(spark, sf):
    return quorum.majority(views.replicas(spark, sf))


@query(_R + ", " + _VOTE + " SELECT r.bucket, r.key, r.disk_idx, r.content, w.content AS winner FROM replicas r JOIN won w USING (bucket, key) WHERE online AND outcome = 'ok' AND r.content <> w.content")
def read_repair(spark, sf):
    rows = views.replicas(spark, sf)
    return quorum.stale_replicas(rows, quorum.vote(rows, 3)).select("bucket", "key", "disk_idx", "content", "winner")


@query(
    _R + ", " + _VOTE
    + """, g AS (SELECT r.bucket, r.key, count(*) FILTER (online AND r.content = w.content) AS good, count(*) FILTER (NOT (online AND r.content = w.content)) AS bad FROM replicas r JOIN won w USING (bucket, key) GROUP BY 1, 2)
SELECT *, good >= 3 AS recoverable, good >= 3 AND bad > 0 AS queued FROM g"""
)
def heal_plan(spark, sf):
    rows = views.replicas(spark, sf)
    return quorum.heal_plan(rows, quorum.vote(rows, 3), 3)


@query(_R + "SELECT bucket, count(DISTINCT disk_idx) AS disks, min(revision) AS created FROM replicas WHERE online GROUP BY 1 HAVING count(DISTINCT disk_idx) >= 4")
def bucket_quorum(spark, sf):
    return listing.buckets_by_quorum(views.replicas(spark, sf).where("online").withColumn("created", F.col("revision")), 4)


@query(_R + ", seen AS (SELECT DISTINCT bucket, disk_idx FROM replicas WHERE size % 97 = disk_idx) SELECT b.bucket, d.i AS disk_idx FROM (SELECT DISTINCT bucket FROM seen) b, (SELECT CAST(range AS INTEGER) AS i FROM range(6)) d WHERE (b.bucket, d.i) NOT IN (SELECT (bucket, disk_idx) FROM seen)")
def disk_missing_buckets(spark, sf):
    seen = views.replicas(spark, sf).where("size % 97 = disk_idx")
    disks = spark.createDataFrame([(i, True) for i in range(6)], "disk_idx int, online boolean")
    return listing.missing_buckets(disks, seen)


@query(v.with_(v.WEB) + f"SELECT id, {v.fnv('key')} AS fnv, CAST({v.fnv('key')} % 4 AS INTEGER) AS set_idx FROM web")
def placement_hash(spark, sf):
    return views.web_objects(spark, sf).select("id", hashing.fnv1a(F.col("key")).alias("fnv"), hashing.placement(F.col("key"), 4).alias("set_idx"))


@query(v.with_(v.WEB) + f"SELECT id, array_to_string(list_transform(range(6), lambda j: (j + {v.fnv('key')} % 6) % 6), ',') AS dist, CAST((1 - {v.fnv('key')} % 6 + 6) % 6 AS INTEGER) AS first FROM web")
def shard_distribution(spark, sf):
    dist = hashing.distribution(F.col("key"), 6)
    return views.web_objects(spark, sf).select("id", F.array_join(F.transform(dist, lambda x: x.cast("string")), ",").alias("dist"), hashing.shard_of_disk(dist, F.lit(1)).alias("first"))


@query(v.with_(v.WEB) + f"SELECT id, CAST({v.fnv('key')} % 4 AS INTEGER) AS target FROM web WHERE id % 4 <> {v.fnv('key')} % 4")
def rebalance_plan(spark, sf):
    return quorum.misplaced(views.web_objects(spark, sf).withColumn("set_idx", F.col("id") % 4), 4).select("id", "target")


@query(v.with_(v.WEB) + f"SELECT id, [0, 2, 3][CAST({v.fnv('key')} % 3 AS INTEGER) + 1] AS target FROM web WHERE id % 4 = 1")
def drain_plan(spark, sf):
    return quorum.drain_plan(views.web_objects(spark, sf).withColumn("set_idx", (F.col("id") % 4).cast("int")), [1], 4).select("id", "target")


_BK = "(bucket || '/' || key)"


@query(v.with_(v.WEB) + f"SELECT id FROM web WHERE ({v.fnv(_BK)} + 3) % 16 = 0")
def heal_sample(spark, sf):
    return views.web_objects(spark, sf).where(hashing.heal_sample(F.col("bucket"), F.col("key"), 3, 16)).select("id")


# Access and notifications.

_STATEMENTS = [
    ("reader", 0, "Allow", None, ["s3:Get*", "s3:List*"], None, ["arn:aws:s3:::b*"], None),
    ("reader", 1, "Deny", None, ["s3:GetObject"], None, ["arn:aws:s3:::b3/*"], None),
    ("writer", 0, "Allow", None, ["s3:*"], None, ["arn:aws:s3:::*/1?/*"], {"IpAddress": {"aws:SourceIp": ["10.0.0.0/9", "10.200.1.7"]}}),
    ("all-but", 0, "Allow", None, None, ["s3:Delete*"], ["arn:aws:s3:::b5*"], {"StringLike": {"aws:username": ["1*"]}}),
]
_AUTHZ = """az AS (SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS access_key, CASE event_type WHEN 'purchase' THEN 's3:PutObject' WHEN 'error' THEN 's3:DeleteObject' WHEN 'signup' THEN 's3:ListBucket' ELSE 's3:GetObject' END AS action,
  'b' || user_id % 10 AS bucket, CASE WHEN event_type = 'signup' THEN '' ELSE user_id || '/' || event_id END AS object, '10.' || event_id % 250 || '.1.' || event_id % 9 AS source_ip, event_id % 250 AS octet FROM events),
named AS (SELECT *, CASE WHEN object = '' THEN bucket ELSE bucket || '/' || object END AS name FROM az),
m AS (SELECT *, (action LIKE 's3:Get%' OR action LIKE 's3:List%') AND name LIKE 'b%' AS reader_a, action = 's3:GetObject' AND name LIKE 'b3/%' AS reader_d,
  regexp_full_match(name, '.*/1./.*') AND (octet < 128 OR source_ip = '10.200.1.7') AS writer_a, NOT action LIKE 's3:Delete%' AND name LIKE 'b5%' AND access_key LIKE '1%' AS other_a FROM named)"""


def _authz(spark, sf):
    e = views.table(spark, sf, "events")
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "s3:PutObject").when(kind == "error", "s3:DeleteObject").when(kind == "signup", "s3:ListBucket").otherwise("s3:GetObject")
    ip = F.concat(F.lit("10."), (F.col("event_id") % 250).cast("string"), F.lit(".1."), (F.col("event_id") % 9).cast("string"))
    obj = F.when(kind == "signup", "").otherwise(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string")))
    return e.select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("access_key"), action.alias("action"), F.concat(F.lit("b"), (F.col("user_id") % 10).cast("string")).alias("bucket"),
        obj.alias("object"), ip.alias("source_ip"), F.create_map().cast("map<string,array<string>>").alias("condition_values"),
    )


def _decide(spark, sf, strict):
    rows = _authz(spark, sf)
    grants = rows.select("access_key", F.explode(F.array(F.lit("reader"), F.lit("writer"), F.lit("all-but"))).alias("policy")).distinct()
    return iam.decide(rows, grants, spark.createDataFrame(_STATEMENTS, iam.STATEMENT), strict).select("request_id", "allowed")


@query(v.with_(_AUTHZ) + "SELECT request_id, (reader_a AND NOT reader_d) OR writer_a OR other_a AS allowed FROM m")
def policy_eval(spark, sf):
    return _decide(spark, sf, False)


@query(v.with_(_AUTHZ) + "SELECT request_id, NOT reader_d AND (reader_a OR writer_a OR other_a) AS allowed FROM m")
def policy_eval_strict(spark, sf):
    return _decide(spark, sf, True)


@query(
    """WITH people AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'readonly' WHEN 1 THEN 'writeonly' ELSE 'diagnostics' END AS policy FROM customer), canned(policy, n) AS (VALUES ('writeonly', 5), ('diagnostics', 3))
SELECT CAST(c_custkey AS VARCHAR) AS access_key, policy, CAST(coalesce(n, 1) AS INTEGER) AS actions FROM people LEFT JOIN canned USING (policy)"""
)
def effective_permissions(spark, sf):
    name = F.when(F.col("c_custkey") % 3 == 0, "readonly").when(F.col("c_custkey") % 3 == 1, "writeonly").otherwise("diagnostics")
    people = views.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("access_key"), F.array(name).alias("policies"))
    custom = spark.createDataFrame([("readonly", 0, "Allow", None, ["s3:GetObject"], None, [iam.EVERYTHING], None)], iam.STATEMENT)
    return iam.effective_policies(people, custom, iam.canned_policies(spark)).select("access_key", "policy", F.size("actions").alias("actions"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'root' WHEN c_custkey % 4 = 0 THEN 'user' WHEN c_custkey % 4 = 1 THEN 'service' ELSE 'session' END AS kind, c_custkey = 1 OR (c_custkey % 4 = 1 AND c_custkey % 8 = 1) AS is_root
FROM customer WHERE c_custkey = 1 OR c_custkey % 4 IN (0, 1) OR (c_custkey % 4 = 2 AND c_custkey % 8 = 2)"""
)
def identities(spark, sf):
    c = views.table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("access_key"))
    users = c.where("c_custkey % 4 = 0").select("access_key", F.array(F.lit("readonly")).alias("policies"))
    services = c.where("c_custkey % 4 = 1").select("access_key", F.when(F.col("c_custkey") % 8 == 1, "1").otherwise("4").alias("parent"))
    expiry = F.when(F.col("c_custkey") % 8 == 2, "2024-03-01 00:00:00").otherwise("2024-01-01 00:00:00").cast("timestamp_ntz")
    sessions = c.where("c_custkey % 4 = 2").select("access_key", F.lit("4").alias("parent"), expiry.alias("expiry"))
    out = iam.identities(c.select("access_key"), users, services, sessions, "1", views.NOW)
    return out.select(F.col("access_key").cast("bigint").alias("c_custkey"), "kind", "is_root")


_GLOBS = ["*", "en/*", "*/1???*", "de/?1*.html", "fr/[x]", "*.html"]


@query(v.with_(v.WEB) + ", g(\"glob\") AS (VALUES " + ", ".join(f"('{g}')" for g in _GLOBS) + ") SELECT \"glob\", id FROM web, g WHERE regexp_full_match(key, '(?s)' || replace(replace(regexp_replace(\"glob\", '([.\\[\\]])', '\\\\\\1', 'g'), '*', '.*'), '?', '.'))")
def glob_match(spark, sf):
    rows = views.web_objects(spark, sf).withColumn("glob", F.explode(F.lit(_GLOBS)))
    return rows.where(globs.glob_match(F.col("glob"), F.col("key"))).select("glob", "id")


_KINDS = "CASE event_type WHEN 'error' THEN 's3:ObjectRemoved:Delete' WHEN 'purchase' THEN 's3:ObjectCreated:Put' ELSE 's3:ObjectCreated:Copy' END"
_TARGETS = [("b1", "all", None, None, None), ("b1", "created", "1", None, ["s3:ObjectCreated:*"]), ("b2", "puts", "", "3", ["s3:ObjectCreated:Put", "s3:ObjectRemoved:*"])]


def _events(spark, sf):
    return views.versions(spark, sf)


@query(
    v.with_(v.VER, f"k AS (SELECT ver.*, {_KINDS} AS kind FROM ver JOIN events ON event_id = seq)")
    + """SELECT seq, 'all' AS target FROM k WHERE bucket = 'b1' UNION ALL SELECT seq, 'created' FROM k WHERE bucket = 'b1' AND key LIKE '1%' AND kind LIKE 's3:ObjectCreated:%'
UNION ALL SELECT seq, 'puts' FROM k WHERE bucket = 'b2' AND key LIKE '%3' AND (kind = 's3:ObjectCreated:Put' OR kind LIKE 's3:ObjectRemoved:%')"""
)
def webhook_fanout(spark, sf):
    targets = spark.createDataFrame(_TARGETS, "bucket string, target string, prefix string, suffix string, events array<string>")
    return notify.webhooks(_events(spark, sf), targets).select("seq", "target")


@query(
    v.with_(v.VER, f"k AS (SELECT ver.*, {_KINDS} AS kind FROM ver JOIN events ON event_id = seq)")
    + "SELECT seq, 'x' AS dest FROM k WHERE bucket = 'b1' AND key LIKE '1%' UNION ALL SELECT seq, 'y' FROM k WHERE bucket = 'b1' AND kind NOT LIKE 's3:ObjectRemoved%'"
)
def replication_fanout(spark, sf):
    rules = spark.createDataFrame([("b1", "1", "x", True), ("b1", "", "y", False)], "bucket string, prefix string, dest string, delete_replication boolean")
    return notify.replications(_events(spark, sf), rules).select("seq", "dest")


@query(
    v.with_(v.WEB)
    + """, r AS (SELECT id, bucket AS origin, CASE WHEN id % 3 = 0 THEN 'PUT' ELSE 'GET' END AS method FROM web)
SELECT id AS request_id, CASE WHEN origin = 'tionsh.example.net' AND method = 'GET' THEN 0 WHEN origin LIKE '%.example.com' THEN 1 WHEN method = 'PUT' THEN 2 END AS rule_pos FROM r"""
)
def cors_match(spark, sf):
    rules = spark.createDataFrame(
        [("site", 0, ["tionsh.example.net"], ["get"]), ("site", 1, ["*.example.com"], ["*"]), ("site", 2, ["*"], ["PUT"])], "bucket string, rule_pos int, origins array<string>, methods array<string>"
    )
    reqs = views.web_objects(spark, sf).select(F.col("id").alias("request_id"), F.lit("site").alias("bucket"), F.col("bucket").alias("origin"), F.when(F.col("id") % 3 == 0, "PUT").otherwise("GET").alias("method"))
    return notify.cors(reqs, rules).select("request_id", "rule_pos")


# Multipart uploads.


def _parts(spark, sf):
    return multipart.upsert(views.parts(spark, sf), "last_modified", "tie", "etag", "size")


_P = v.with_(v.PARTS)


@query(_P + "SELECT upload_id, part_number, size, etag FROM parts WHERE upload_id = 7 AND part_number > 1 ORDER BY part_number LIMIT 1000")
def mpu_list_parts(spark, sf):
    return listing.list_parts(_parts(spark, sf), 7, after=1).select("upload_id", "part_number", "size", "etag")


@query(v.with_(v.UPLOADS) + "SELECT bucket, key, upload_id FROM uploads WHERE bucket = 'b3' AND key LIKE '1/%' ORDER BY key, upload_id LIMIT 1000")
def mpu_list_uploads(spark, sf):
    return listing.list_uploads(views.uploads(spark, sf), "b3", "1/").select("bucket", "key", "upload_id")


_ASK = "ask AS (SELECT upload_id, part_number, CASE WHEN upload_id % 5 = 0 THEN -part_number ELSE part_number END AS pos, CASE WHEN upload_id % 7 = 0 THEN 'wrong' ELSE '\"' || upper(etag) || '\"' END AS etag FROM parts)"


@query(
    _P + ", " + _ASK
    + """SELECT upload_id, pos, part_number, CASE WHEN before >= part_number THEN 'InvalidPartOrder' WHEN stored IS NULL OR sent <> stored THEN 'InvalidPart' WHEN after IS NOT NULL AND size < 5242880 THEN 'EntityTooSmall' ELSE 'ok' END AS outcome
FROM (SELECT a.*, p.size, p.etag AS stored, lower(trim(a.etag, '"')) AS sent, lag(a.part_number) OVER w AS before, lead(a.part_number) OVER w AS after FROM ask a LEFT JOIN parts p USING (upload_id, part_number) WINDOW w AS (PARTITION BY a.upload_id ORDER BY pos))"""
)
def mpu_validate_parts(spark, sf):
    have = _parts(spark, sf)
    pos = F.when(F.col("upload_id") % 5 == 0, -F.col("part_number")).otherwise(F.col("part_number"))
    etag = F.when(F.col("upload_id") % 7 == 0, "wrong").otherwise(meta.etag_quoted(F.upper("etag")))
    ask = have.select("upload_id", "part_number", pos.alias("pos"), etag.alias("etag"))
    return multipart.validate(ask, have).select("upload_id", "pos", "part_number", "outcome")


@query(_P + "SELECT upload_id, CAST(sum(size) AS BIGINT) AS size, count(*) AS parts FROM parts GROUP BY 1")
def mpu_total_size(spark, sf):
    return multipart.complete(_parts(spark, sf)).select("upload_id", "size", "parts")


@query(_P + "SELECT upload_id, md5(unhex(string_agg(etag, '' ORDER BY part_number))) || '-' || count(*) AS etag FROM parts GROUP BY 1")
def mpu_etag(spark, sf):
    return multipart.complete(_parts(spark, sf)).select("upload_id", "etag")


@query(_P + "SELECT upload_id, part_number, CAST(coalesce(sum(size) OVER (PARTITION BY upload_id ORDER BY part_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM parts")
def part_offsets(spark, sf):
    return multipart.offsets(_parts(spark, sf)).select("upload_id", "part_number", "begins")


@query(
    _P
    + """, o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY upload_id ORDER BY part_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM parts)
SELECT upload_id, part_number, CAST(greatest(0, 20000000 - begins) AS BIGINT) AS "from", CAST(least(size, 50000000 - begins) - greatest(0, 20000000 - begins) AS BIGINT) AS bytes FROM o WHERE begins + size > 20000000 AND begins < 50000000"""
)
def range_locate(spark, sf):
    return multipart.locate(_parts(spark, sf), 20_000_000, 30_000_000).select("upload_id", "part_number", "from", "bytes")


@query(
    v.with_(v.DOCS)
    + """, h AS (SELECT doc_id, size, CASE doc_id % 5 WHEN 0 THEN 'bytes=' || doc_id || '-' WHEN 1 THEN 'bytes=-' || doc_id WHEN 2 THEN 'bytes=5-' || doc_id WHEN 3 THEN 'bytes=1-2,4-5' ELSE 'bytes=-' END AS hdr FROM docs)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id WHEN 1 THEN size - least(doc_id, size) WHEN 2 THEN CASE WHEN doc_id >= 5 THEN 5 END END AS start,
CASE doc_id % 5 WHEN 0 THEN size - doc_id WHEN 1 THEN least(doc_id, size) WHEN 2 THEN CASE WHEN doc_id >= 5 THEN least(doc_id, size - 1) - 4 END END AS length FROM h"""
)
def range_resolve(spark, sf):
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 5
    header = F.when(k == 0, F.concat(F.lit("bytes="), i, F.lit("-"))).when(k == 1, F.concat(F.lit("bytes=-"), i)).when(k == 2, F.concat(F.lit("bytes=5-"), i)).when(k == 3, "bytes=1-2,4-5").otherwise("bytes=-")
    return views.doc_objects(spark, sf).withColumn("r", rq.byte_range(header, F.col("size"))).select("doc_id", "r.start", "r.length")


# Metadata.


@query(v.with_(v.DOCS) + "SELECT doc_id, 'team=' || bucket || '&z=1' AS tags, bucket AS team FROM docs")
def tag_parse(spark, sf):
    text = F.concat(F.lit("z=1&team=old&team="), F.col("bucket"))
    return views.doc_objects(spark, sf).withColumn("m", meta.tags(text)).select("doc_id", meta.tag_text(F.col("m")).alias("tags"), F.col("m")["team"].alias("team"))


@query(v.with_(v.DOCS) + "SELECT doc_id, bucket AS owner, 1 AS n FROM docs")
def metadata_projection(spark, sf):
    headers = F.create_map(F.lit("X-Amz-Meta-Owner"), F.lit("first"), F.lit("Content-Type"), F.lit("text/plain"), F.lit("x-amz-meta-owner"), F.col("bucket"))
    return views.doc_objects(spark, sf).withColumn("m", meta.user_metadata(headers)).select("doc_id", F.col("m")["owner"].alias("owner"), F.size("m").alias("n"))


@query(
    v.with_(v.WEB)
    + """SELECT id, CASE WHEN key LIKE '%.html' THEN 'text/html; charset=utf-8' END AS page, CASE id % 3 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'text/csv; charset=utf-8' END AS other FROM web"""
)
def mime_lookup(spark, sf):
    other = F.concat(F.lit("a/B"), F.when(F.col("id") % 3 == 0, ".MP4").when(F.col("id") % 3 == 1, ".csv").otherwise(".zzz"))
    return views.web_objects(spark, sf).select("id", meta.content_type(F.col("key")).alias("page"), meta.content_type(other).alias("other"))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 3600.0 * (event_id % 90 + 1) WHEN 1 THEN 86400.0 * (event_id % 90 + 1) WHEN 2 THEN 604800.0 * (event_id % 90 + 1) WHEN 3 THEN 60.0 * (event_id % 90 + 1) + 3600 END::DOUBLE AS seconds FROM events"""
)
def span_parse(spark, sf):
    n, k = (F.col("event_id") % 90 + 1).cast("string"), F.col("event_id") % 6
    text = F.when(k == 0, F.concat(n, F.lit("h"))).when(k == 1, F.concat(n, F.lit("d"))).when(k == 2, F.concat(n, F.lit("W"))).when(k == 3, F.concat(F.lit("1h"), n, F.lit("m"))).when(k == 4, F.concat(n, F.lit("y"))).otherwise("0h")
    return views.table(spark, sf, "events").select("event_id", times.span_seconds(text).alias("seconds"))


@query(v.with_(v.DOCS) + "SELECT doc_id, etag, doc_id % 2 = 0 AS listed FROM docs")
def etag_normalise(spark, sf):
    quoted = F.concat(F.lit(' "'), F.upper("etag"), F.lit('" '))
    listed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"x", W/"'), F.col("etag"), F.lit('"'))).otherwise('"y"')
    return views.doc_objects(spark, sf).select("doc_id", meta.etag_normalised(quoted).alias("etag"), meta.etag_in(listed, F.col("etag")).alias("listed"))


@query(v.with_(v.WEB) + "SELECT id, key LIKE '%.html' AND size >= 512 AND id % 5 <> 0 AS eligible FROM web")
def compression_eligible(spark, sf):
    kind = F.coalesce(meta.content_type(F.col("key")), F.lit("application/octet-stream"))
    return views.web_objects(spark, sf).select("id", meta.compressible(F.lit(True), F.col("id") % 5 == 0, kind, F.col("size")).alias("eligible"))


@query(
    v.with_(v.VER)
    + f"""SELECT seq, CASE WHEN seq % 4 = 0 THEN 304 WHEN seq % 4 = 1 AND date_trunc('second', mod_time) <= TIMESTAMP '2024-01-10' THEN 304
WHEN seq % 4 = 2 THEN 412 WHEN seq % 4 = 3 AND date_trunc('second', mod_time) > TIMESTAMP '2024-01-20' THEN 412 ELSE 0 END AS status FROM ver"""
)
def get_conditionals(spark, sf):
    k, none = F.col("seq") % 4, F.lit(None).cast("string")
    at = lambda i, t: F.when(k == i, F.lit(t).cast("timestamp_ntz"))
    status = rq.get_conditions(F.col("version_id"), F.col("mod_time"), F.when(k == 0, "*").otherwise(none), at(1, "2024-01-10 00:00:00"), F.when(k == 2, '"other"').otherwise(none), at(3, "2024-01-20 00:00:00"))
    return views.versions(spark, sf).select("seq", status.alias("status"))


@query(v.with_(v.WEB) + "SELECT id, regexp_matches(bucket, '^[a-z0-9.-]{3,63}$') AS bucket_ok, key <> '' AND octet_length(encode(key)) <= 1024 AS key_ok FROM web")
def name_validity(spark, sf):
    return views.web_objects(spark, sf).select("id", keys.valid_bucket_name(F.col("bucket")).alias("bucket_ok"), keys.valid_key(F.col("key")).alias("key_ok"))


@query(v.with_(v.DOCS) + "SELECT doc_id, CAST((size // 4194304) * 1048576 + ceil((size % 4194304) / 4) AS BIGINT) AS shard, size <= 131072 AS inline FROM docs")
def shard_sizes(spark, sf):
    return views.doc_objects(spark, sf).select("doc_id", hashing.shard_size(F.col("size"), 4).alias("shard"), hashing.inline_eligible(F.lit(1), F.col("size")).alias("inline"))


@query(
    v.with_(v.VER)
    + """, cur AS (SELECT bucket, key, max(seq) AS revision FROM ver GROUP BY 1, 2), w AS (SELECT *, CASE WHEN revision % 2 = 0 THEN revision WHEN revision % 3 = 0 THEN 1 END AS expected FROM cur),
f AS (SELECT *, expected IS NULL OR expected = revision AS ok FROM w)
SELECT bucket, key, 0 AS place, CASE WHEN ok THEN 'ok' ELSE 'conflict' END AS outcome, CASE WHEN ok THEN revision + 1 END AS revision FROM f UNION ALL
SELECT bucket, key, 1, CASE WHEN ok THEN 'ok' ELSE 'conflict' END, CASE WHEN ok THEN revision + 2 END FROM f UNION ALL SELECT bucket, key, 2, 'ok', revision + CASE WHEN ok THEN 3 ELSE 1 END FROM f"""
)
def revision_commit(spark, sf):
    """Three writes of each key: one that may expect another revision, one that expects the first to have gone through, one that expects nothing."""
    cur = views.versions(spark, sf).groupBy("bucket", "key").agg(F.max("seq").alias("revision"))
    first = F.when(F.col("revision") % 2 == 0, F.col("revision")).when(F.col("revision") % 3 == 0, F.lit(1).cast("bigint"))
    writes = cur.select("bucket", "key", F.col("revision").alias("r"), first.alias("e"), F.explode(F.lit([2, 1, 0])).alias("place"))
    writes = writes.select("bucket", "key", "place", F.when(F.col("place") == 0, F.col("e")).when(F.col("place") == 1, F.col("r") + 1).alias("expected"))
    return sinks.commit(cur, writes, "place").select("bucket", "key", "place", "outcome", "revision")


# Audit chains.

_CHAIN = """WITH RECURSIVE e AS (SELECT user_id AS chain, event_id AS seq, event_type || ':' || event_id AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT chain, seq, n, '' AS prev_hash, sha256('' || body) AS hash FROM e WHERE n = 1 UNION ALL SELECT e.chain, e.seq, e.n, c.hash, sha256(c.hash || e.body) FROM c JOIN e ON e.chain = c.chain AND e.n = c.n + 1)"""


def _entries(spark, sf):
    e = views.table(spark, sf, "events")
    return e.select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("body"))


@query(_CHAIN + " SELECT chain, seq, prev_hash, hash FROM c")
def audit_chain(spark, sf):
    return audit.build(_entries(spark, sf))


@query(_CHAIN + " SELECT chain, count(*) AS entries, min(CASE WHEN seq % 1000 = 13 THEN seq END) AS broken_seq FROM c GROUP BY 1")
def audit_verify(spark, sf):
    rows = _entries(spark, sf)
    chained = audit.build(rows).join(rows, ["chain", "seq"])
    edited = chained.withColumn("body", F.when(F.col("seq") % 1000 == 13, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return audit.verify(edited)


# Changes.


@query(
    _V + _SNAP
    + """, plan AS (SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.key, b.key) AS key, a.version_id AS was, b.version_id AS now FROM was a FULL JOIN cur b ON a.bucket = b.bucket AND a.key = b.key),
last AS (SELECT bucket, key, max(seq) AS top FROM ver GROUP BY 1, 2)
SELECT bucket, key, seq, delete_marker, size FROM ver UNION ALL
SELECT bucket, key, top + 1, false, size FROM plan p JOIN last USING (bucket, key) JOIN (SELECT version_id AS was, size FROM ver) USING (was) WHERE p.was IS NOT NULL AND p.was IS DISTINCT FROM p.now UNION ALL
SELECT bucket, key, top + 1, true, NULL FROM plan p JOIN last USING (bucket, key) WHERE p.was IS NULL"""
)
def snapshot_restore(spark, sf):
    log = views.versions(spark, sf).select(*_VC)
    then = versions.as_of(log, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).where("NOT delete_marker")
    return changes.restore(log, then, views.NOW).select("bucket", "key", "seq", "delete_marker", "size")


@query(v.with_(v.DOCS) + f"SELECT bucket, key, CASE WHEN doc_id % 3 = 0 THEN 'a=1' ELSE 'old=1' END AS user_tags, CASE WHEN doc_id % 3 = 0 THEN {v.NOW} ELSE TIMESTAMP '2024-01-01' END AS mod_time FROM docs")
def tag_change(spark, sf):
    docs = views.doc_objects(spark, sf)
    table = docs.withColumn("user_tags", F.lit("old=1")).withColumn("mod_time", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    asked = docs.where("doc_id % 3 = 0").select("bucket", "key", F.explode(F.lit([1, 0])).alias("place"))
    asked = asked.withColumn("tags", F.concat(F.lit("a="), F.col("place").cast("string")))
    return changes.set_tags(table, asked, views.NOW, "place").select("bucket", "key", "user_tags", "mod_time")


@query(v.with_(v.DOCS) + "SELECT bucket, key, size FROM docs WHERE doc_id % 4 <> 1 UNION ALL SELECT bucket, key, size FROM docs WHERE doc_id % 4 = 1 UNION ALL SELECT 'copies', bucket || '/' || key, size FROM docs WHERE doc_id % 4 = 1 UNION ALL SELECT 'copies', 'same', arg_max(size, struct_pack(b := bucket, k := key)) FROM docs WHERE doc_id % 4 = 2")
def copy_objects(spark, sf):
    docs = views.doc_objects(spark, sf)
    table = docs.select("bucket", "key", "size", F.create_map(F.lit("a"), F.lit("1")).alias("user_meta"), F.lit(views.NOW).cast("timestamp_ntz").alias("mod_time"))
    to_key = F.when(F.col("doc_id") % 4 == 1, F.concat_ws("/", "bucket", "key")).otherwise("same")
    asked = docs.where("doc_id % 4 IN (1, 2)").select(
        "bucket", "key", F.lit("copies").alias("to_bucket"), to_key.alias("to_key"), F.lit("REPLACE").alias("directive"), F.create_map(F.lit("b"), F.lit("2")).alias("user_meta")
    )
    return changes.copy_objects(table, asked, views.NOW).select("bucket", "key", "size")


@query(
    v.with_(v.DOCS)
    + """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ok' WHEN size = 0 THEN 'ok' ELSE 'InvalidWriteOffset' END AS outcome, CASE WHEN doc_id % 2 = 0 OR size = 0 THEN CAST(size + 2 AS INTEGER) END AS new_size FROM docs"""
)
def append_objects(spark, sf):
    docs = views.doc_objects(spark, sf)
    offset = F.when(F.col("doc_id") % 2 == 0, F.col("size")).otherwise(0)
    asked = docs.select("bucket", "key", "doc_id", offset.alias("offset"), F.lit(b"xy").alias("content"))
    return changes.append(docs.select("bucket", "key", "content"), asked).select("doc_id", "outcome", F.octet_length("new_content").alias("new_size"))


@query(v.with_(v.WEB) + "SELECT id, CASE WHEN id % 2 = 0 THEN 'cas/' || substr(etag, 1, 2) || '/' || etag ELSE bucket || '/' || key END AS location, 'STANDARD' AS storage_class FROM web")
def data_location(spark, sf):
    ref = F.when(F.col("id") % 2 == 0, F.col("etag"))
    return views.web_objects(spark, sf).select("id", projections.data_location(F.col("bucket"), F.col("key"), ref).alias("location"), projections.storage_class(F.lit("")).alias("storage_class"))


@query(v.with_(v.REQ) + "SELECT req_id FROM req WHERE status < 400 AND method IN ('PUT', 'DELETE')")
def audit_admission(spark, sf):
    none = F.array().cast("array<string>")
    keep = projections.audited(F.col("status"), F.col("method"), none, F.lit("application/json"), F.lit("/b/k"))
    return views.requests(spark, sf).where(keep).select("req_id")


@query(v.with_(v.DOCS) + "SELECT doc_id, doc_id % 5 = 0 AND key LIKE 'en/%' AS allowed FROM docs")
def ingest_match(spark, sf):
    token = F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string"))
    ok = projections.ingest_allowed(token, F.sha2(F.lit("t0"), 256), F.col("key"), F.lit("en/"))
    return views.doc_objects(spark, sf).select("doc_id", ok.alias("allowed"))


@query(v.with_(v.REQ) + "SELECT method, CASE method WHEN 'GET' THEN 'get-object' WHEN 'PUT' THEN 'put-object' WHEN 'DELETE' THEN 'delete-object' ELSE 'new-upload' END AS operation, count(*) AS n FROM req GROUP BY 1, 2")
def operation_mix(spark, sf):
    names = F.when(F.col("method") == "POST", F.array(F.lit("uploads"))).otherwise(F.array().cast("array<string>"))
    name = rq.operation_name(F.col("method"), F.lit("b"), F.lit("o"), names, F.lit(False))
    return views.requests(spark, sf).groupBy("method", name.alias("operation")).agg(F.count("*").alias("n"))


# Further parts of the registry.
from quaystone.plans import columns, tables  # noqa: E402, F401
