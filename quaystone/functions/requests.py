"""Requests: names of operations and actions, ranges, conditions, status classes, error codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.meta import etag_in

# Error codes with their HTTP status.
ERROR_STATUS = {
    "AccessDenied": 403, "BadDigest": 400, "BucketAlreadyExists": 409, "BucketAlreadyOwnedByYou": 409, "BucketNotEmpty": 409, "EntityTooLarge": 400,
    "EntityTooSmall": 400, "IncompleteBody": 400, "InternalError": 500, "InvalidAccessKeyId": 403, "InvalidArgument": 400, "InvalidBucketName": 400,
    "InvalidBucketState": 409, "InvalidDigest": 400, "InvalidPart": 400, "InvalidPartOrder": 400, "InvalidPolicyDocument": 403, "InvalidRange": 416,
    "InvalidRequest": 400, "InvalidWriteOffset": 409, "MalformedPOSTRequest": 400, "MalformedXML": 400, "MethodNotAllowed": 405, "MissingContentLength": 411,
    "MissingRequestBodyError": 411, "MissingSecurityHeader": 400, "NoSuchBucket": 404, "NoSuchBucketPolicy": 404, "NoSuchCORSConfiguration": 404,
    "NoSuchKey": 404, "NoSuchLifecycleConfiguration": 404, "NoSuchTagSet": 404, "NoSuchUpload": 404, "NoSuchWebsiteConfiguration": 404, "NotImplemented": 501,
    "ObjectLockConfigurationNotFoundError": 404, "PreconditionFailed": 412, "QuotaExceeded": 403, "RequestTimeTooSkewed": 403, "ServerReadOnly": 503,
    "SignatureDoesNotMatch": 403, "SlowDown": 503,
}

# Backend outcomes and the error codes that clients see.
OUTCOME_CODES = {
    "bucket_not_found": "NoSuchBucket", "bucket_exists": "BucketAlreadyOwnedByYou", "bucket_not_empty": "BucketNotEmpty", "bucket_name_invalid": "InvalidBucketName",
    "object_not_found": "NoSuchKey", "object_name_invalid": "InvalidArgument", "object_exists_as_dir": "InvalidArgument", "precondition_failed": "PreconditionFailed",
    "invalid_range": "InvalidRange", "incomplete_body": "IncompleteBody", "entity_too_large": "EntityTooLarge", "invalid_upload_id": "NoSuchUpload",
    "invalid_part": "InvalidPart", "invalid_part_order": "InvalidPartOrder", "part_too_small": "EntityTooSmall", "object_locked": "AccessDenied",
    "not_versioned": "InvalidBucketState", "not_implemented": "NotImplemented", "storage_full": "SlowDown",
}


def error_table(spark: SparkSession) -> DataFrame:
    """outcome, code, status: a fixed, small lookup table."""
    return spark.createDataFrame([(o, c, ERROR_STATUS[c]) for o, c in OUTCOME_CODES.items()], "outcome string, code string, status int")


def with_error(rows: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    """Adds code and status; unknown outcomes are internal errors."""
    table = error_table(rows.sparkSession).withColumnRenamed("outcome", outcome_col)
    out = rows.join(F.broadcast(table), outcome_col, "left")
    known = F.col(outcome_col).isNotNull()
    return out.withColumn("code", F.when(known, F.coalesce("code", F.lit("InternalError")))).withColumn("status", F.when(known, F.coalesce("status", F.lit(500))).otherwise(200))


def status_class(status: Column) -> Column:
    """2xx and so on; a status that was never written counts as 200."""
    s = F.when(status <= 0, 200).otherwise(status)
    return F.concat(F.floor(s / 100).cast("string"), F.lit("xx"))


# Permissions by scope, methods (none: any) and query parameters (any of them; none: whatever there is). The
# first row that fits counts.
ACTIONS = (
    ("bucket", "GET HEAD", "location", "GetBucketLocation"), ("bucket", "GET HEAD", "uploads", "ListBucketMultipartUploads"), ("bucket", "GET HEAD", "versioning", "GetBucketVersioning"),
    ("bucket", "GET HEAD", "policy", "GetBucketPolicy"), ("bucket", "GET HEAD", "tagging", "GetBucketTagging"), ("bucket", "PUT", "versioning", "PutBucketVersioning"),
    ("bucket", "PUT", "policy", "PutBucketPolicy"), ("bucket", "PUT", "tagging", "PutBucketTagging"), ("bucket", "PUT", "", "CreateBucket"), ("bucket", "DELETE", "policy", "DeleteBucketPolicy"),
    ("bucket", "DELETE", "tagging", "PutBucketTagging"), ("bucket", "DELETE", "", "DeleteBucket"), ("bucket", "POST", "delete", "DeleteObject"), ("bucket", "", "", "ListBucket"),
    ("object", "GET", "uploadId", "ListMultipartUploadParts"), ("object", "GET", "tagging", "GetObjectTagging"), ("object", "PUT", "tagging", "PutObjectTagging"), ("object", "PUT", "", "PutObject"),
    ("object", "POST", "uploads uploadId", "PutObject"), ("object", "DELETE", "uploadId", "AbortMultipartUpload"), ("object", "DELETE", "", "DeleteObject"), ("object", "", "", "GetObject"),
)


def action_name(method: Column, bucket: Column, obj: Column, query: Column) -> Column:
    """The permission that a request needs. ``query`` is an array of the query's parameter names."""
    out = F.when(bucket == "", "s3:ListAllMyBuckets")
    for scope, methods, names, action in ACTIONS:
        fits = (obj == "") if scope == "bucket" else (obj != "")
        if methods:
            fits = fits & method.isin(*methods.split())
        if names:
            fits = fits & F.coalesce(F.arrays_overlap(query, F.lit(names.split())), F.lit(False))
        out = out.when(fits, f"s3:{action}")
    return out


def operation_name(method: Column, bucket: Column, obj: Column, query: Column, copies: Column) -> Column:
    """The operation that a request is dispatched to, for statistics. ``copies``: a copy source is given."""
    has = lambda k: F.coalesce(F.array_contains(query, k), F.lit(False))

    def first(names: dict[str, str], otherwise: str) -> Column:
        out = F.when(F.lit(False), "")
        for k, v in names.items():
            out = out.when(has(k), v)
        return out.otherwise(otherwise)

    config = {k: k for k in ("policy", "tagging", "cors", "replication", "lifecycle", "website", "quota")}
    more = {k: k for k in ("object-lock", "notification", "compression")}
    subs = {"location": "location", "uploads": "list-uploads", "versioning": "versioning", "versions": "list-versions"} | config | more
    on_bucket = (
        F.when(method == "GET", F.concat(F.lit("get-bucket:"), first(subs, "list")))
        .when(method == "PUT", F.concat(F.lit("put-bucket:"), first(config | more | {"versioning": "versioning", "acl": "acl"}, "create")))
        .when(method == "DELETE", F.concat(F.lit("delete-bucket:"), first(config, "bucket"))).when(method == "HEAD", "head-bucket")
        .when((method == "POST") & has("delete"), "delete-objects").otherwise("method-not-allowed")
    )
    preview = dict.fromkeys(("preview", "img", "w", "h"), "preview-object")
    own = {"tagging": "tagging", "retention": "retention", "legal-hold": "legal-hold"}
    part = has("uploadId") & has("partNumber")
    on_object = (
        F.when(method == "GET", first({"uploadId": "list-parts"} | preview | {k: f"get-object:{k}" for k in own} | {"acl": "not-implemented"}, "get-object"))
        .when(method == "HEAD", "head-object")
        .when((method == "PUT") & part, F.when(copies, "copy-part").otherwise("put-part")).when((method == "PUT") & copies, "copy-object")
        .when(method == "PUT", first({k: f"put-object:{k}" for k in own} | {"acl": "put-object:acl"}, "put-object"))
        .when(method == "POST", first({"uploads": "new-upload", "uploadId": "complete-upload"}, "method-not-allowed"))
        .when(method == "DELETE", first({"uploadId": "abort-upload", "tagging": "delete-object:tagging"}, "delete-object")).otherwise("method-not-allowed")
    )
    return F.when(bucket == "", F.when(method == "GET", "list-buckets").otherwise("method-not-allowed")).when(obj == "", on_bucket).otherwise(on_object)


def is_mutating(method: Column, query: Column, content_type: Column) -> Column:
    """Whether a request would change what is stored."""
    has = lambda k: F.coalesce(F.array_contains(query, k), F.lit(False))
    form = F.coalesce(F.startswith(content_type, F.lit("multipart/form-data")), F.lit(False))
    return F.when(method.isin("GET", "HEAD", "OPTIONS"), False).when(method == "POST", has("delete") | has("uploads") | has("uploadId") | form).otherwise(True)


def byte_range(header: Column, size: Column) -> Column:
    """struct<start, length> of a bytes= range against a size; null if malformed, of several ranges, or absent.

    A start at or beyond the end gives a length of zero or less: not satisfiable.
    """
    first, last = (F.regexp_extract(header, "^bytes=([0-9]*)-([0-9]*)$", i).try_cast("bigint") for i in (1, 2))
    suffix = F.least(last, size)
    end = F.when(last.isNull() | (last >= size), size - 1).otherwise(last)
    out = lambda s, n: F.struct(s.alias("start"), n.alias("length"))
    shaped = header.rlike("^bytes=[0-9]*-[0-9]*$")
    return F.when(shaped & first.isNull() & (last > 0), out(size - suffix, suffix)).when(shaped & first.isNotNull() & (last.isNull() | (last >= first)), out(first, end - first + 1))


def get_conditions(etag: Column, modified: Column, none_match: Column, modified_since: Column, match: Column, unmodified_since: Column) -> Column:
    """0 to go on, 304 or 412. Times are compared by whole seconds; an unset header is null or empty."""
    second = F.date_trunc("second", modified).cast("timestamp_ntz")
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    not_modified = F.when(given(none_match), (none_match == "*") | etag_in(none_match, etag)).otherwise(F.coalesce(second <= modified_since, F.lit(False)))
    failed = F.when(given(match), (match != "*") & ~etag_in(match, etag)).otherwise(F.lit(False)) | F.coalesce(second > unmodified_since, F.lit(False))
    return F.when(not_modified, 304).when(failed, 412).otherwise(0)


def put_condition(head_etag: Column, match: Column, none_match: Column) -> Column:
    """Whether a conditional put may go on. Without a head, only If-Match fails (on anything)."""
    exists = head_etag.isNotNull()
    if_match = F.when(match.isNull(), True).when(~exists, False).otherwise((match == "*") | etag_in(match, head_etag))
    if_none = F.when(none_match.isNull() | ~exists, True).otherwise(~((none_match == "*") | etag_in(none_match, head_etag)))
    return if_match & if_none


def append_outcome(head_size: Column, offset: Column, add: Column, most: int = 64 << 20) -> Column:
    """An append must start at the object's end (0 for a new one) and stay within the cap."""
    at = F.coalesce(head_size, F.lit(0))
    return F.when(offset != at, "InvalidWriteOffset").when(at + add > most, "EntityTooLarge").otherwise("ok")


def presign_valid(expires: Column, signed_at: Column, now: Column, skew_seconds: int = 900) -> Column:
    """A presigned request lives 1 second to 7 days, and may not come from the future."""
    age = F.timestamp_diff("SECOND", signed_at, now)
    return expires.between(1, 604_800) & (age <= expires) & (age >= -skew_seconds)
