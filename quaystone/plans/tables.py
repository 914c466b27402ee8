"""Queries over whole tables: lists, reports, changes, configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions import hashing
from quaystone.operators import changes, iam, lifecycle, listing, multipart, snapshot, usage, versions
from quaystone.plans import sqlviews as v
from quaystone.plans.registry import query
from quaystone.sources import readers, sinks, views


def _now():
    return F.lit(views.NOW).cast("timestamp_ntz")


def _docs(spark, sf):
    return views.doc_objects(spark, sf)


# Reports.


@query(v.with_(v.DOCS) + "SELECT CAST(sum(size) AS BIGINT) AS total, CAST(sum(size // 2) AS BIGINT) AS used, count(*) FILTER (doc_id % 4 <> 3) AS online, count(*) AS disks FROM docs")
def capacity(spark, sf):
    i = F.col("doc_id")
    state = F.when(i % 4 == 0, "ok").when(i % 4 == 1, "").when(i % 4 == 3, "offline")
    return usage.capacity(_docs(spark, sf).select(F.col("size").alias("total"), F.expr("size div 2").alias("used"), state.alias("state")))


@query(v.with_(v.DOCS) + "SELECT count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM docs")
def snapshot_totals(spark, sf):
    return snapshot.totals(_docs(spark, sf))


@query("SELECT count(*) FILTER (c_custkey % 3 <> 0) AS peers_up, count(*) AS peers_total FROM customer")
def peers_up(spark, sf):
    return usage.peers(views.table(spark, sf, "customer").select((F.col("c_custkey") % 3 != 0).alias("up")))


_KINDS = ("seen", "expired", "noncurrent", "aborted", "healed", "tiered", "error")


@query(
    "SELECT count(DISTINCT user_id % 10) AS buckets_scanned, "
    + ", ".join(f"count(*) FILTER (event_id % 7 = {i}) AS {n}" for i, n in enumerate(("", "objects_expired", "versions_expired", "uploads_aborted", "objects_healed", "objects_tiered", "errors")) if n)
    + " FROM events"
)
def scan_report(spark, sf):
    kind = F.get(F.lit(list(_KINDS)), (F.col("event_id") % 7).cast("int"))
    return usage.scan_report(views.versions(spark, sf).withColumn("event_id", F.col("seq")).select("bucket", kind.alias("kind")))


# Lists.


@query(v.with_(v.DOCS) + "SELECT bucket, id, created, objects, bytes FROM (SELECT bucket, doc_id AS id, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 50 AS INTEGER)) AS created, doc_id AS objects, size AS bytes FROM docs) WHERE bucket = 'src1'")
def snapshot_list(spark, sf):
    created = F.timestamp_add("DAY", (F.col("doc_id") % 50).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).cast("timestamp_ntz")
    rows = _docs(spark, sf).select("bucket", F.col("doc_id").alias("id"), created.alias("created"), F.col("doc_id").alias("objects"), F.col("size").alias("bytes"), F.lit("many").alias("entries"))
    return listing.snapshots(rows, "src1")


@query(v.with_(v.DOCS) + "SELECT DISTINCT 'config/' || bucket AS name FROM docs WHERE doc_id % 3 <> 0")
def config_list(spark, sf):
    name = F.concat(F.lit("config/"), F.col("bucket"), F.lit("/doc.json"))
    rows = _docs(spark, sf).select(name.alias("name"), (F.col("doc_id") % 3 != 0).alias("online"))
    return listing.configs(rows.unionByName(rows.select(F.lit("other/x").alias("name"), "online")), "config/")


@query(v.with_(v.DOCS) + "SELECT key, size FROM docs ORDER BY size DESC, key LIMIT 40")
def listing_by_size(spark, sf):
    return listing.sorted_rows(_docs(spark, sf).withColumn("mod_time", _now()), "size", descending=True).select("key", "size").limit(40)


@query(v.with_(v.DOCS) + "SELECT key, size FROM docs ORDER BY lower(key), key LIMIT 40")
def listing_by_name(spark, sf):
    return listing.sorted_rows(_docs(spark, sf).withColumn("mod_time", _now()), "name").select("key", "size").limit(40)


@query(
    v.with_(v.DOCS)
    + """, folders AS (SELECT bucket, lang || '/' AS item, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT bucket, split_part(key, '/', 1) AS lang, size FROM docs) GROUP BY 1, 2),
items AS (SELECT DISTINCT split_part(key, '/', 1) || '/' AS item FROM docs WHERE bucket = 'src0') SELECT item, objects, bytes FROM items JOIN folders USING (item) WHERE bucket = 'src0' UNION ALL SELECT 'a file', NULL, NULL"""
)
def folder_rows(spark, sf):
    docs = _docs(spark, sf)
    rows = listing.items(docs, "src0", delimiter="/").select(F.lit("src0").alias("bucket"), "item", "is_prefix")
    rows = rows.unionByName(spark.createDataFrame([("src0", "a file", False)], "bucket string, item string, is_prefix boolean"))
    return listing.with_folder_usage(rows, usage.by_folder(docs)).select("item", "objects", "bytes")


_R = v.with_(v.DOCS, v.REPLICAS)


@query(_R + "SELECT bucket, count(DISTINCT disk_idx) AS disks, min(revision) AS created FROM replicas WHERE online AND bucket = 'src1' GROUP BY 1 HAVING count(DISTINCT disk_idx) >= 3")
def bucket_stat(spark, sf):
    return listing.bucket_stat(views.replicas(spark, sf).where("online").withColumn("created", F.col("revision")), "src1", 3)


@query(v.with_(v.DOCS) + "SELECT bucket, CASE WHEN bucket = 'empty' THEN TIMESTAMP '2024-01-02' END AS created FROM (SELECT DISTINCT bucket FROM docs UNION ALL SELECT 'empty')")
def bucket_list(spark, sf):
    import datetime as dt

    return listing.buckets(_docs(spark, sf), spark.createDataFrame([("empty", dt.datetime(2024, 1, 3)), ("empty", dt.datetime(2024, 1, 2))], "bucket string, created timestamp_ntz"))


@query(v.with_(v.DOCS) + "SELECT bucket, key, size FROM docs WHERE bucket = 'src1' AND key LIKE 'en/%'")
def list_recursive(spark, sf):
    return listing.recursive(_docs(spark, sf), "src1", "en/").select("bucket", "key", "size")


@query(v.with_(v.DOCS) + "SELECT bucket, key FROM docs WHERE NOT (bucket = 'src1' AND key LIKE 'en/%')")
def remove_recursive(spark, sf):
    return changes.remove_prefix(_docs(spark, sf), "src1", "en/").select("bucket", "key")


@query(v.with_(v.DOCS) + "SELECT key, 'null' AS version_id, true AS is_latest, false AS delete_marker FROM docs WHERE bucket = 'src2'")
def unversioned_listing(spark, sf):
    return versions.unversioned(_docs(spark, sf).where("bucket = 'src2'")).select("key", "version_id", "is_latest", "delete_marker")


@query(v.with_(v.WEB) + f"SELECT bucket, key, CAST({v.fnv('key')} % 4 AS INTEGER) AS owner FROM (SELECT DISTINCT bucket, key FROM web)")
def owner_map(spark, sf):
    web = views.web_objects(spark, sf)
    return listing.namespace(web.unionByName(web)).withColumn("owner", hashing.placement(F.col("key"), 4))


@query(
    v.with_(v.WEB)
    + f""", o AS (SELECT DISTINCT bucket, key, {v.fnv('key')} % 4 AS hashed FROM web), seen AS (SELECT bucket, key, hashed, s.i FROM o, (SELECT range AS i FROM range(4)) s WHERE (length(key) + s.i) % 2 = 0)
SELECT bucket, key, CAST(coalesce(max(CASE WHEN i = hashed THEN i END), min(i)) AS INTEGER) AS set_idx FROM seen GROUP BY 1, 2"""
)
def owner_or_found(spark, sf):
    keys_ = views.web_objects(spark, sf).select("bucket", "key").distinct()
    seen = keys_.withColumn("set_idx", F.explode(F.lit([0, 1, 2, 3]))).where((F.length("key") + F.col("set_idx")) % 2 == 0)
    return changes.owner_or_found(keys_, seen, hashing.placement(F.col("key"), 4))


@query(
    v.with_(v.DOCS)
    + """, h AS (SELECT DISTINCT bucket, CASE doc_id % 4 WHEN 0 THEN key WHEN 1 THEN 'site/index.html' WHEN 2 THEN 'index.html' ELSE 'x/' || doc_id END AS key FROM docs),
r AS (SELECT doc_id, bucket, CASE doc_id % 5 WHEN 0 THEN '/' || key WHEN 1 THEN '/site' WHEN 2 THEN '/' WHEN 3 THEN '/site/' ELSE '/nothing' END AS path FROM docs),
f AS (SELECT *, CASE WHEN path = '/' OR path LIKE '%/' THEN substr(path, 2) || 'index.html' ELSE substr(path, 2) END AS one, CASE WHEN path NOT LIKE '%/' THEN substr(path, 2) || '/index.html' END AS two FROM r)
SELECT doc_id, coalesce(a.key, b.key) AS served FROM f LEFT JOIN h a ON a.bucket = f.bucket AND a.key = one LEFT JOIN h b ON b.bucket = f.bucket AND b.key = two"""
)
def website_objects(spark, sf):
    i, docs = F.col("doc_id"), _docs(spark, sf)
    have = docs.select("bucket", F.when(i % 4 == 0, F.col("key")).when(i % 4 == 1, "site/index.html").when(i % 4 == 2, "index.html").otherwise(F.concat(F.lit("x/"), i.cast("string"))).alias("key"))
    path = F.when(i % 5 == 0, F.concat(F.lit("/"), F.col("key"))).when(i % 5 == 1, "/site").when(i % 5 == 2, "/").when(i % 5 == 3, "/site/").otherwise("/nothing")
    return listing.website_objects(docs.select("doc_id", "bucket", path.alias("path")), have).select("doc_id", "served")


# Versions and deletes.

_V = v.with_(v.VER, v.FLAGGED, v.LATEST)


@query(_V + "SELECT bucket, key, seq FROM latest WHERE NOT delete_marker UNION ALL SELECT bucket, key, -1 FROM ver WHERE version_id = md5('5')")
def version_resolve(spark, sf):
    log = views.versions(spark, sf)
    import hashlib

    return versions.resolve(log).select("bucket", "key", "seq").unionByName(versions.resolve(log, hashlib.md5(b"5").hexdigest()).select("bucket", "key", F.lit(-1).cast("bigint").alias("seq")))


@query(_V + "SELECT bucket, key, seq, version_id FROM ver UNION ALL SELECT bucket, key, 0, 'null' FROM (SELECT 'plain' AS bucket, key FROM latest)")
def adopt_plain(spark, sf):
    log = views.versions(spark, sf)
    heads = versions.latest(log).select("bucket", "key", "size")
    return versions.adopt_plain(log, heads.unionByName(heads.withColumn("bucket", F.lit("plain")))).select("bucket", "key", "seq", "version_id")


@query(
    v.with_(v.VER)
    + f"""SELECT seq, CASE WHEN asked AND ok THEN new_mode ELSE lock_mode END AS lock_mode, CASE WHEN asked AND ok THEN new_until ELSE retain_until END AS retain_until
FROM (SELECT *, coalesce(NOT coalesce(retain_until > {v.NOW}, false) OR (coalesce(new_until >= retain_until, false) AND new_mode = lock_mode) OR (lock_mode = 'GOVERNANCE' AND seq % 6 = 0), true) AS ok
FROM (SELECT *, seq % 2 = 0 AS asked, CASE WHEN seq % 4 = 0 THEN 'GOVERNANCE' ELSE 'COMPLIANCE' END AS new_mode, retain_until + to_days(CAST(seq % 5 - 2 AS INTEGER)) AS new_until FROM ver))"""
)
def retention_change(spark, sf):
    log, i = views.versions(spark, sf), F.col("seq")
    until = F.timestamp_add("DAY", (i % 5 - 2).cast("int"), F.col("retain_until")).cast("timestamp_ntz")
    asked = log.where("seq % 2 = 0").select("bucket", "key", "version_id", F.when(i % 4 == 0, "GOVERNANCE").otherwise("COMPLIANCE").alias("mode"), until.alias("until"), (i % 3 == 0).alias("bypass"))
    return changes.set_retention(log, asked, views.NOW).select("seq", "lock_mode", "retain_until")


@query(
    v.with_(v.VER)
    + f"""SELECT seq, CASE seq % 3 WHEN 0 THEN 'marker' WHEN 1 THEN CASE WHEN legal_hold OR coalesce(retain_until > {v.NOW} AND (lock_mode = 'COMPLIANCE' OR (lock_mode = 'GOVERNANCE' AND seq % 2 <> 0)), false) THEN 'AccessDenied' ELSE 'deleted' END ELSE 'deleted' END AS outcome, seq % 3 = 1 AS existed FROM ver"""
)
def delete_outcomes(spark, sf):
    log, i = views.versions(spark, sf), F.col("seq")
    version = F.when(i % 3 == 1, F.col("version_id")).when(i % 3 == 2, "no such version")
    return sinks.delete_objects(log, log.select("seq", "bucket", "key", version.alias("version_id"), (i % 2 == 0).alias("bypass")), views.NOW).select("seq", "outcome", "existed")


@query(v.with_(v.VER) + f"SELECT bucket, key, seq FROM ver WHERE bucket <> 'b3' OR legal_hold OR coalesce(retain_until > {v.NOW} AND lock_mode IN ('COMPLIANCE', 'GOVERNANCE'), false)")
def empty_bucket(spark, sf):
    return versions.emptied(views.versions(spark, sf), "b3", views.NOW).select("bucket", "key", "seq")


@query(v.with_(v.VER) + "SELECT seq, CASE WHEN length(key) % 2 = 0 THEN 2 ELSE 0 END AS set_idx FROM ver")
def move_set(spark, sf):
    log = views.versions(spark, sf).withColumn("set_idx", F.lit(0))
    plan = log.where(F.length("key") % 2 == 0).select("bucket", "key", F.lit(2).alias("target"))
    return changes.move_set(log, plan).select("seq", "set_idx")


# Tiers.


@query(v.with_(v.DOCS) + "SELECT doc_id, CASE WHEN moved THEN 'cold' WHEN doc_id % 5 = 0 THEN 'archive' END AS tier, CASE WHEN moved THEN bucket || '/' || key END AS tier_key, size FROM (SELECT *, doc_id % 2 = 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS moved FROM docs)")
def tier_stubs(spark, sf):
    i = F.col("doc_id")
    docs = _docs(spark, sf).withColumn("tier", F.when(i % 5 == 0, "archive")).withColumn("tier_key", F.lit(None).cast("string")).withColumn("sse", F.when(i % 3 == 0, "AES256").otherwise("")).withColumn("data_ref", F.when(i % 7 == 0, F.col("data_ref")))
    moves = docs.where(i % 2 == 0).select("bucket", "key", F.lit("cold").alias("transition_tier"))
    return lifecycle.tier_stub(docs, moves).select("doc_id", "tier", "tier_key", "size")


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN md5('far' || doc_id) ELSE md5('34567') END AS body FROM documents")
def tiered_reads(spark, sf):
    i = F.col("doc_id")
    docs = _docs(spark, sf).select(
        "doc_id", F.when(i % 2 == 0, "cold").alias("tier"), F.concat_ws("/", "bucket", "key").alias("tier_key"), F.lit("0123456789").cast("binary").alias("content"),
        F.when(i % 2 == 1, 3).alias("start"), F.when(i % 2 == 1, 5).alias("length"),
    )
    remote = docs.where((i % 2 == 0) & (i % 3 != 0)).select("tier", "tier_key", F.concat(F.lit("far"), i.cast("string")).cast("binary").alias("content"))
    return changes.tiered_content(docs, remote).select("doc_id", F.md5("body").alias("body"))


# Uploads.

_P = v.with_(v.PARTS, v.UPLOADS)


@query(
    _P
    + """, good AS (SELECT upload_id, CAST(sum(size) AS BIGINT) AS size, count(*) AS parts, bool_and(size >= 5242880 OR part_number = mx) AS ok FROM (SELECT *, max(part_number) OVER (PARTITION BY upload_id) AS mx FROM parts) WHERE upload_id % 3 = 0 GROUP BY 1),
old AS (SELECT bucket, key, CAST(1 AS BIGINT) AS size FROM uploads WHERE upload_id % 6 = 0)
SELECT coalesce(n.bucket, o.bucket) AS bucket, coalesce(n.key, o.key) AS key, coalesce(n.size, o.size) AS size FROM (SELECT bucket, key, g.size FROM good g JOIN uploads u USING (upload_id) WHERE ok) n FULL JOIN old o ON n.bucket = o.bucket AND n.key = o.key"""
)
def complete_uploads(spark, sf):
    uploads = views.uploads(spark, sf)
    parts = multipart.upsert(views.parts(spark, sf), "last_modified", "tie", "etag", "size")
    asked = parts.where("upload_id % 3 = 0").select("upload_id", "part_number", F.col("part_number").alias("pos"), "etag")
    objects = uploads.where("upload_id % 6 = 0").select("bucket", "key", F.lit(1).cast("bigint").alias("size"))
    return changes.complete_upload(objects, uploads, parts, asked, views.NOW).select("bucket", "key", "size")


@query(_P + "SELECT 'upload' AS kind, upload_id, 0 AS part_number FROM uploads WHERE upload_id % 4 <> 0 UNION ALL SELECT 'part', upload_id, part_number FROM parts WHERE upload_id % 4 <> 0")
def abort_uploads(spark, sf):
    parts = multipart.upsert(views.parts(spark, sf), "last_modified", "tie", "etag", "size")
    uploads = views.uploads(spark, sf)
    left, kept = changes.abort_uploads(uploads, parts, uploads.where("upload_id % 4 = 0").select("upload_id"))
    return left.select(F.lit("upload").alias("kind"), "upload_id", F.lit(0).alias("part_number")).unionByName(kept.select(F.lit("part").alias("kind"), "upload_id", "part_number"))


@query(_P + f"SELECT bucket, key, CAST(upload_id AS VARCHAR) AS upload_id FROM uploads UNION ALL SELECT bucket, key, sha256(bucket || '/' || key || '/' || n || '/' || '{views.NOW}') FROM uploads, (SELECT range AS n FROM range(2)) WHERE upload_id % 10 = 0")
def new_uploads(spark, sf):
    uploads = views.uploads(spark, sf)
    asked = uploads.where("upload_id % 10 = 0").select("bucket", "key", F.explode(F.lit([0, 1])).alias("nonce"))
    return changes.new_uploads(uploads, asked, views.NOW).select("bucket", "key", "upload_id")


@query(
    _P
    + """SELECT upload_id, part_number, CASE WHEN upload_id % 5 = 0 AND part_number = 1 THEN 77 ELSE size END AS size FROM parts UNION ALL SELECT upload_id, 99, 11 FROM (SELECT DISTINCT upload_id FROM parts) WHERE upload_id % 5 = 0
UNION ALL SELECT upload_id, 1, 77 FROM (SELECT upload_id FROM uploads WHERE upload_id % 5 = 0 EXCEPT SELECT upload_id FROM parts WHERE part_number = 1) UNION ALL SELECT upload_id, 99, 11 FROM (SELECT upload_id FROM uploads WHERE upload_id % 5 = 0 EXCEPT SELECT upload_id FROM parts)"""
)
def put_parts(spark, sf):
    parts = multipart.upsert(views.parts(spark, sf), "last_modified", "tie", "etag", "size")
    uploads = views.uploads(spark, sf)
    some = uploads.where("upload_id % 5 = 0").select("upload_id")
    # part 1 comes twice, part 99 is new, and one upload is not known
    new = [some.select("upload_id", F.lit(n).alias("part_number"), F.lit(size).cast("bigint").alias("size"), F.lit(place).alias("place")) for n, size, place in ((1, 66, 0), (1, 77, 1), (99, 11, 0))]
    unknown = spark.createDataFrame([(-5, 1, 5, 0)], "upload_id bigint, part_number int, size bigint, place int")
    return changes.put_parts(parts, uploads, new[0].unionByName(new[1]).unionByName(new[2]).unionByName(unknown), "place").select("upload_id", "part_number", "size")


@query(v.with_(v.DOCS) + "SELECT doc_id AS upload_id, 1 AS part_number, CASE WHEN doc_id % 2 = 0 THEN least(10, greatest(0, size - 5)) ELSE size END AS size FROM docs")
def copy_parts(spark, sf):
    docs = _docs(spark, sf)
    uploads = docs.select(F.col("doc_id").alias("upload_id"))
    even = F.col("doc_id") % 2 == 0
    asked = docs.select("bucket", "key", F.col("doc_id").alias("upload_id"), F.lit(1).alias("part_number"), F.when(even, 5).alias("start"), F.when(even, 10).alias("length"))
    none = spark.createDataFrame([], "upload_id bigint, part_number int, size bigint, etag string")
    return changes.copy_parts(none, uploads, docs, asked).select("upload_id", "part_number", "size")


# Configuration.


@query("SELECT 'b' || c_custkey AS bucket, i AS rule_pos, CASE i WHEN 0 THEN 'old' ELSE 'logs' END AS id, CASE i WHEN 0 THEN 'a/' ELSE 'tmp/' END AS prefix, CASE i WHEN 0 THEN 'Enabled' ELSE 'Disabled' END AS status, CASE i WHEN 0 THEN CAST(c_custkey % 90 + 1 AS INTEGER) END AS expiration_days, CASE i WHEN 1 THEN 3 END AS noncurrent_days, CASE i WHEN 1 THEN 'cold' END AS transition_tier FROM customer, (SELECT CAST(range AS INTEGER) AS i FROM range(2))")
def lifecycle_rules(spark, sf):
    i = F.col("c_custkey")
    days = (i % 90 + 1).cast("string")
    document = F.concat(
        F.lit("<LifecycleConfiguration><Rule><ID>old</ID><Prefix>z/</Prefix><Filter><Prefix>a/</Prefix></Filter><Expiration><Days>"), days, F.lit("</Days></Expiration></Rule>"),
        F.lit("<Rule><ID>logs</ID><Status>Disabled</Status><Prefix>tmp/</Prefix><NoncurrentVersionExpiration><NoncurrentDays>3</NoncurrentDays></NoncurrentVersionExpiration><Transition><Days>9</Days><StorageClass>cold</StorageClass></Transition></Rule></LifecycleConfiguration>"),
    )
    rows = views.table(spark, sf, "customer").select(F.concat(F.lit("b"), i.cast("string")).alias("bucket"), document.alias("document"))
    return changes.lifecycle_rows(rows).select("bucket", "rule_pos", "id", "prefix", "status", "expiration_days", "noncurrent_days", "transition_tier")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'old' || c_custkey WHEN c_custkey % 2 = 0 THEN NULL ELSE 'new' || c_custkey END AS secret FROM customer")
def merged_secrets(spark, sf):
    i = F.col("c_custkey")
    rows = views.table(spark, sf, "customer").select(F.lit("b").alias("bucket"), i.alias("id"), F.when(i % 2 == 0, "********").otherwise(F.concat(F.lit("new"), i.cast("string"))).alias("secret"))
    old = rows.where("id % 3 <> 0").withColumn("secret", F.concat(F.lit("old"), F.col("id").cast("string")))
    return changes.merge_secrets(old, rows).select("id", "secret")


@query("SELECT CAST(c_custkey AS VARCHAR) AS access_key, CASE WHEN c_custkey % 4 = 0 THEN 'changed' WHEN c_custkey % 4 = 3 THEN 'back' ELSE 'first' END AS secret FROM customer WHERE c_custkey % 4 <> 1")
def identity_changes(spark, sf):
    i = F.col("c_custkey")
    people = views.table(spark, sf, "customer").select(i.cast("string").alias("access_key"), F.lit("first").alias("secret"), i)
    row = lambda rest, op, secret, place: people.where(i % 4 == rest).select("access_key", F.lit(secret).alias("secret"), i, F.lit(op).alias("op"), F.lit(place).alias("place"))
    # keys of rest 0 change twice, those of rest 1 go, those of rest 3 go and come back
    asked = row(0, "put", "once", 0).unionByName(row(0, "put", "changed", 1)).unionByName(row(1, "remove", "", 0)).unionByName(row(3, "remove", "", 0)).unionByName(row(3, "put", "back", 1))
    return changes.change_identities(people, asked).select("access_key", "secret")


@query(v.with_(v.DOCS) + "SELECT bucket, max(doc_id) AS stamp FROM docs GROUP BY 1")
def newest_configs(spark, sf):
    rows = _docs(spark, sf).select("bucket", F.col("doc_id").alias("stamp"), F.col("key").alias("name"))
    return readers.newest_config(rows, stamp="stamp").select("bucket", "stamp")


@query(v.with_(v.DOCS) + "SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN size END AS size, CASE WHEN doc_id % 4 <> 3 THEN etag END AS etag, CASE doc_id % 2 WHEN 0 THEN 7 ELSE 9 END AS quota FROM docs")
def stored_documents(spark, sf):
    """Metadata documents, a quarter of them damaged, and bucket configuration in both envelopes."""
    i = F.col("doc_id")
    raw = F.to_json(F.struct("size", F.lit("t").alias("modTime"), "etag", F.lit(1).cast("bigint").alias("revision")))
    rows = readers.replica_documents(_docs(spark, sf).withColumn("raw", F.when(i % 4 == 3, F.substring(raw, 5, 10)).otherwise(raw)))
    config = F.when(i % 2 == 0, '{"updatedAt":"t","config":{"quotaBytes":7}}').otherwise('{"quotaBytes":9}')
    return readers.bucket_configs(rows.withColumn("raw", config)).select("doc_id", F.col("meta.size").alias("size"), F.col("meta.etag").alias("etag"), F.col("config.quotaBytes").cast("int").alias("quota"))


@query("SELECT 'd' || a || '/x' || b AS endpoint FROM (SELECT range AS a FROM range(1, 5)), (SELECT range AS b FROM range(0, 3))")
def endpoints(spark, sf):
    return readers.expand_endpoints(spark, "d{1...4}/x{0...2}")


@query("SELECT doc_id, md5(substr(key, 3, 4)) AS piece FROM (" + v.with_(v.DOCS) + " SELECT doc_id, key FROM docs)")
def byte_ranges(spark, sf):
    piece = readers.byte_range(F.col("key").cast("binary"), F.lit(2), F.lit(4))
    return _docs(spark, sf).select("doc_id", F.md5(piece).alias("piece"))


# Access.


@query(
    "SELECT c_custkey, c_custkey % 2 = 0 AS allowed FROM customer"
)
def granted_by_group(spark, sf):
    """Keys with and without a policy; no grant denies."""
    i = F.col("c_custkey")
    c = views.table(spark, sf, "customer").select(i, i.cast("string").alias("access_key"))
    asked = c.select(
        i.alias("request_id"), "access_key", F.lit("s3:GetObject").alias("action"), F.lit("b").alias("bucket"), F.lit("k").alias("object"), F.lit("::1").alias("source_ip"), F.create_map().cast("map<string,array<string>>").alias("condition_values"),
    )
    out = iam.decide(asked, c.where("c_custkey % 2 = 0").select("access_key", F.lit("readonly").alias("policy")), iam.canned_policies(spark))
    return out.select(F.col("request_id").alias("c_custkey"), "allowed")
