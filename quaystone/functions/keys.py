"""Keys, prefixes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_prefix(key: Column, prefix: str, delimiter: str) -> Column:
    """The key up to and with the first delimiter behind ``prefix``; null if there is none."""
    rest = F.substring(key, len(prefix) + 1, 1 << 30)
    if not delimiter:
        return F.lit(None).cast("string")
    return F.when(F.contains(rest, F.lit(delimiter)), F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter)))


def listing_item(key: Column, prefix: str, delimiter: str) -> Column:
    """What a listing shows for a key: its common prefix or itself."""
    return F.coalesce(common_prefix(key, prefix, delimiter), key)


def ancestors(key: Column) -> Column:
    """The root ("") and every folder above the key, each with its closing slash."""
    parts = F.split(key, "/")
    inner = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.concat(F.array_join(F.slice(parts, 1, i + 1), "/"), F.lit("/")))
    return F.concat(F.array(F.lit("")), inner)


def is_ip_like(name: Column) -> Column:
    return name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def valid_bucket_name(name: Column) -> Column:
    ok = name.rlike(r"^[a-z0-9.\-]{3,63}$") & ~name.rlike(r"^[.\-]|[.\-]$") & ~name.rlike(r"\.\.|\.-|-\.")
    return F.coalesce(ok & ~is_ip_like(name), F.lit(False))


def valid_key(key: Column) -> Column:
    bad = key.rlike(r"^/|\\|\x00") | key.rlike(r"(^|/)\.{1,2}(/|$)")
    return F.coalesce((key != "") & (F.octet_length(key) <= 1024) & ~bad, F.lit(False))


def extension(key: Column) -> Column:
    """The last path element's suffix from its last dot, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(key, r"(\.[^./]*)$", 1))


def search_hit(key: Column, term: str) -> Column:
    """Case-insensitive substring search."""
    return F.contains(F.lower(key), F.lit(term.lower()))


def template_name(template: Column, filename: Column) -> Column:
    return F.replace(template, F.lit("${filename}"), filename)


def dated_key(prefix: Column, at: Column) -> Column:
    """A key from the time, for uploads that name none."""
    return F.concat(prefix, F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def website_key(path: Column, index: str = "index.html") -> Column:
    """The key that a website request reads first: folders and the root get the index document."""
    key = F.regexp_replace(path, "^/", "")
    return F.when((key == "") | key.endswith("/"), F.concat(key, F.lit(index))).otherwise(key)


def split_path(path: Column) -> tuple[Column, Column]:
    """Bucket and object of a path-style request; empty where there is none."""
    bare = F.regexp_replace(path, "^/", "")
    bucket = F.substring_index(bare, "/", 1)
    return bucket, F.substring(bare, F.length(bucket) + 2, 1 << 30)


def copy_source(header: Column) -> tuple[Column, Column]:
    """Bucket and key of a copy-source header: no query, unescaped, split at the first slash."""
    return split_path(F.try_url_decode(F.substring_index(header, "?", 1)))
