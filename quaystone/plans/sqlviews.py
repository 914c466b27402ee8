"""The views of ``quaystone.sources.views`` in DuckDB's SQL, for the oracles."""

WEB = """web AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS bucket, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS key,
  CAST(octet_length(encode(html)) AS BIGINT) AS size, md5(html) AS etag, page_id AS id FROM pages)"""

DOCS = """docs AS (SELECT source AS bucket, lang || '/' || doc_id || '.txt' AS key, CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS etag,
  sha256(text) AS data_ref, doc_id FROM documents)"""

VER = """ver AS (SELECT 'b' || (user_id % 10) AS bucket, user_id || '/' || (CAST(json_extract(props, '$.k') AS BIGINT) % 5) AS key, event_id AS seq,
  md5(CAST(event_id AS VARCHAR)) AS version_id, event_type = 'error' AS delete_marker, ts AS mod_time, CAST(floor(value * 100 + 0.5) AS BIGINT) AS size,
  event_id % 7 = 0 AS legal_hold, CASE event_id % 3 WHEN 0 THEN 'COMPLIANCE' WHEN 1 THEN 'GOVERNANCE' END AS lock_mode,
  ts + to_days(CAST(event_id % 40 AS INTEGER)) AS retain_until FROM events)"""

FLAGGED = """flagged AS (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY seq DESC) AS place FROM ver)"""

REQ = """req AS (SELECT ts AS time, user_id AS access_key, event_type AS action,
  CASE event_type WHEN 'purchase' THEN 'PUT' WHEN 'signup' THEN 'POST' WHEN 'error' THEN 'DELETE' ELSE 'GET' END AS method,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 404 ELSE 503 END WHEN event_id % 11 = 0 THEN 304 ELSE 200 END AS status,
  CAST(floor(value * 100 + 0.5) AS BIGINT) AS bytes, value / 10 AS seconds, event_id AS req_id, CASE WHEN event_id % 4 = 0 THEN 'HIT' ELSE 'MISS' END AS cache FROM events)"""

PARTS = """allparts AS (SELECT l_orderkey AS upload_id, l_linenumber AS part_number, CAST(l_quantity * 1048576 AS BIGINT) AS size,
  md5(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey) AS etag, l_shipdate AS last_modified, l_partkey AS tie FROM lineitem),
parts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upload_id, part_number ORDER BY last_modified DESC, tie DESC, etag DESC, size DESC) AS rn FROM allparts) WHERE rn = 1)"""

UPLOADS = """uploads AS (SELECT 'b' || (o_custkey % 10) AS bucket, lower(substr(o_orderpriority, 1, 1)) || '/' || o_orderkey AS key, o_orderkey AS upload_id, o_orderdate AS initiated FROM orders)"""

REPLICAS = """base AS (SELECT d.*, r.i AS disk_idx, (doc_id + r.i) % 7 AS turn FROM docs d, (SELECT CAST(range AS INTEGER) AS i FROM range(6)) r),
replicas AS (SELECT bucket, key, disk_idx, CASE WHEN turn = 2 AND doc_id % 5 = 0 THEN 'bad' || disk_idx WHEN turn IN (0, 1) AND doc_id % 3 = 0 THEN 'old' || etag ELSE etag END AS content,
  CAST(CASE WHEN turn IN (0, 1) AND doc_id % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS revision, (doc_id + disk_idx * 3) % 11 <> 0 AS online, size FROM base)"""

RULES = """rules AS (SELECT 'b' || b AS rule_bucket, p.* FROM (SELECT CAST(range AS INTEGER) AS b FROM range(10)) x, LATERAL (VALUES
  (0, 'short', '1', 'Enabled', 7 + b, CAST(NULL AS TIMESTAMP), 5, 2, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR)),
  (1, 'late', '1', 'Enabled', 3, NULL, 20, NULL, 10, 'cold'), (2, 'off', '', 'Disabled', 1, NULL, 1, 1, 1, 'cold'),
  (3, 'dated', '2', '', NULL, TIMESTAMP '2024-01-15' + to_days(b), NULL, NULL, 12, 'archive'), (4, 'rest', '', 'Enabled', NULL, NULL, 12, 5, 14, 'cold'))
  p(rule_pos, id, prefix, status, expiration_days, expiration_date, noncurrent_days, abort_mpu_days, transition_days, transition_tier) WHERE status IN ('', 'Enabled'))"""

NOW = "TIMESTAMP '2024-02-01 00:00:00'"

LATEST = "latest AS (SELECT * FROM flagged WHERE place = 1)"

FNV = """list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, CAST(length(hex(encode({k}))) AS BIGINT) // 2 + 1),
  lambda i: CAST(('0x' || substr(hex(encode({k})), 2 * i - 1, 2)) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"""


def fnv(key: str) -> str:
    return FNV.format(k=key)


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
