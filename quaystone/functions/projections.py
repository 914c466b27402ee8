"""Rows as clients and logs see them: objects, headers, admission filters, secrets."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaystone.functions.meta import USER_PREFIX, lower_names
from quaystone.functions.requests import is_mutating


def storage_class(given: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), F.lit("STANDARD"))


def data_location(bucket: Column, key: Column, data_ref: Column) -> Column:
    """Shared content lies under its hash, other content under its own name."""
    return F.when(F.coalesce(data_ref, F.lit("")) != "", F.concat(F.lit("cas/"), F.substring(data_ref, 1, 2), F.lit("/"), data_ref)).otherwise(F.concat_ws("/", bucket, key))


def stored_metadata(options: Column) -> Column:
    """Upload options split into struct<content_type, content_encoding, user>."""
    lower = lower_names(options)
    user = F.map_filter(lower, lambda k, _: ~k.isin("content-type", "content-encoding"))
    get = lambda k: F.try_element_at(lower, F.lit(k))
    return F.struct(get("content-type").alias("content_type"), get("content-encoding").alias("content_encoding"), user.alias("user"))


def response_headers(user_meta: Column, etag: Column, tags: Column) -> Column:
    """Headers of a read: user metadata with its prefix, the quoted etag, and the number of tags if there are any."""
    user = F.transform_keys(user_meta, lambda k, _: F.concat(F.lit(USER_PREFIX), k))
    count = F.size(F.filter(F.split(F.coalesce(tags, F.lit("")), "&"), lambda t: t != ""))
    own = F.create_map(F.lit("ETag"), F.concat(F.lit('"'), etag, F.lit('"')))
    return F.map_concat(user, own, F.when(count > 0, F.create_map(F.lit("x-amz-tagging-count"), count.cast("string"))).otherwise(F.create_map().cast("map<string,string>")))


def bucket_of_host(host: Column, base: str) -> Column:
    """The bucket of a virtual-host request; null for the base domain itself or another one."""
    bare = F.regexp_replace(host, r":\d+$", "")
    return F.when(F.endswith(bare, F.lit("." + base)), F.substring_index(bare, "." + base, 1))


def internal_path(path: Column, root: str = "/-") -> Column:
    """Requests of the server's own pages and probes, below ``root``, which statistics leave out."""
    folders = [F.startswith(path, F.lit(f"{root}/{x}")) for x in ("health/", "console", "internal/")]
    return (path == f"{root}/metrics") | folders[0] | folders[1] | folders[2]


def audited(status: Column, method: Column, query: Column, content_type: Column, path: Column) -> Column:
    """Successful changes, other than those of the audit log's own pages."""
    return (status < 400) & is_mutating(method, query, content_type) & ~F.contains(path, F.lit("/audit"))


def website_request(configured: Column, query: Column) -> Column:
    return configured & (F.size(query) == 0)


def ingest_allowed(token: Column, token_hash: Column, key: Column, scope: Column) -> Column:
    """An ingest token matches by its hash, and only for keys in its scope."""
    return (F.sha2(token, 256) == token_hash) & F.startswith(key, F.coalesce(scope, F.lit("")))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed hash (hex) under a key known to the driver: two nested hashes over padded keys."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signing_key(secret: str, date: str, region: str, service: str) -> bytes:
    """The day's key of a signed request."""
    import hmac

    key = ("AWS4" + secret).encode()
    for part in (date, region, service, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return key


def signature(secret: str, date: str, region: str, service: str, string_to_sign: Column) -> Column:
    return hmac_sha256(signing_key(secret, date, region, service), string_to_sign)
