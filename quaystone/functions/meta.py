"""Metadata maps, tags, entity tags, sizes and content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaystone.functions.keys import extension

USER_PREFIX = "x-amz-meta-"
#: How the name of an object's own expiry header ends; stores put their own name before it.
EXPIRY_SUFFIX = "-expires"

# Content types by extension.
CONTENT_TYPES = {
    ".mp4": "video/mp4", ".m4v": "video/mp4", ".mov": "video/quicktime", ".webm": "video/webm", ".mkv": "video/x-matroska", ".avi": "video/x-msvideo",
    ".mp3": "audio/mpeg", ".m4a": "audio/mp4", ".aac": "audio/aac", ".flac": "audio/flac", ".wav": "audio/wav", ".ogg": "audio/ogg", ".oga": "audio/ogg",
    ".webp": "image/webp", ".avif": "image/avif", ".svg": "image/svg+xml", ".pdf": "application/pdf", ".json": "application/json", ".wasm": "application/wasm",
    ".txt": "text/plain; charset=utf-8", ".csv": "text/csv; charset=utf-8", ".md": "text/markdown; charset=utf-8",
    ".html": "text/html; charset=utf-8", ".htm": "text/html; charset=utf-8", ".css": "text/css; charset=utf-8", ".js": "text/javascript; charset=utf-8",
    ".xml": "text/xml; charset=utf-8", ".gif": "image/gif", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png",
}

# Content types that are not worth compressing again, by prefix.
COMPRESSED_TYPES = (
    "image/jpeg", "image/png", "image/gif", "image/webp", "image/avif", "video/", "audio/", "application/zip", "application/gzip", "application/x-gzip",
    "application/x-7z-compressed", "application/x-rar-compressed", "application/x-bzip2", "application/x-xz", "application/zstd", "application/x-compressed", "application/octet-stream",
)


def last_map(entries: Column) -> Column:
    """A map from array<struct<key, value>>; of entries with one key the last one stays."""
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def lower_names(m: Column) -> Column:
    """A map with its keys in lower case; where two become one the last stays."""
    return last_map(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def user_metadata(headers: Column) -> Column:
    """Only user headers, without their prefix, names in lower case."""
    own = F.map_filter(lower_names(headers), lambda k, _: F.startswith(k, F.lit(USER_PREFIX)))
    return F.transform_keys(own, lambda k, _: F.substring(k, len(USER_PREFIX) + 1, 1 << 20))


def without_reserved(meta: Column, reserved: tuple[str, ...] = ("content-type", "content-encoding", "etag")) -> Column:
    return F.map_filter(meta, lambda k, _: ~F.lower(k).isin(*reserved))


def expiry_text(meta: Column, suffix: str = EXPIRY_SUFFIX) -> Column:
    """The expiry header's value, found by the end of its name; null without one."""
    entries = F.filter(F.map_entries(meta), lambda e: F.endswith(F.lower(e["key"]), F.lit(suffix)))
    return F.try_element_at(F.transform(entries, lambda e: e["value"]), F.lit(1))


def copied_metadata(directive: Column, source: Column, request: Column) -> Column:
    """Metadata of a copy: the request's under REPLACE, the source's otherwise."""
    return F.when(F.upper(directive) == "REPLACE", request).otherwise(source)


def content_type(key: Column, given: Column | None = None) -> Column:
    """The given type, or the one that the extension stands for."""
    table = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    guess = F.try_element_at(table, extension(key))
    return guess if given is None else F.coalesce(F.nullif(given, F.lit("")), guess)


def compressible(want: Column, encrypted: Column, kind: Column, size: Column) -> Column:
    """Asked for, not encrypted, 512 bytes or more (or of unknown size), not of a packed type."""
    kind = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    packed = F.lit(False)
    for p in COMPRESSED_TYPES:
        packed = packed | F.startswith(kind, F.lit(p))
    return want & ~encrypted & ((size < 0) | (size >= 512)) & ~packed


def logical_size(size: Column, plain_size: Column, sse: Column, compressed: Column) -> Column:
    """What the client stored, whatever lies on disk."""
    altered = (F.coalesce(sse, F.lit("")) != "") | (F.coalesce(compressed, F.lit("")) != "")
    return F.when(altered, plain_size).otherwise(size)


def etag_normalised(etag: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(etag), '^"+|"+$', ""))


def etag_quoted(etag: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(etag, '^"+|"+$', ""), F.lit('"'))


def etag_in(header: Column, etag: Column) -> Column:
    """Whether a list of entity tags, weak and quoted ones too, holds this one."""
    bare = lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), "^W/", ""), '^"+|"+$', "")
    return F.exists(F.split(header, ","), lambda p: bare(p) == etag)


def verifiable_etag(etag: Column, sse: Column, compressed: Column) -> Column:
    """A plain md5 of bytes that lie on disk as they are."""
    plain = (F.coalesce(sse, F.lit("")) == "") & (F.coalesce(compressed, F.lit("")) == "")
    return plain & etag.rlike("^[0-9a-f]{32}$")


def tags(text: Column) -> Column:
    """k1=v1&k2=v2 as a map, unescaped; of a name that comes again the last value stays."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), "&"), lambda p: p != "")
    part = lambda p, i: F.coalesce(F.try_url_decode(F.coalesce(F.get(F.split(p, "=", 2), F.lit(i)), F.lit(""))), F.lit(""))
    return last_map(F.transform(pairs, lambda p: F.struct(part(p, 0).alias("key"), part(p, 1).alias("value"))))


def tag_text(m: Column) -> Column:
    """A map as k1=v1&k2=v2, sorted by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(uri_encode(e["key"]), F.lit("="), uri_encode(e["value"]))), "&")


def uri_encode(text: Column, keep_slash: bool = False) -> Column:
    """RFC 3986: only letters, digits and -._~ stay."""
    out = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def canonical_query(pairs: Column) -> Column:
    """array<struct<key, value>> as a sorted, encoded query."""
    return F.array_join(F.array_sort(F.transform(pairs, lambda p: F.concat(uri_encode(p["key"]), F.lit("="), uri_encode(p["value"])))), "&")


def header_value(text: Column) -> Column:
    """Trimmed, inner runs of blanks made one."""
    return F.regexp_replace(F.trim(text), "[ \t]+", " ")


def size_bytes(text: Column) -> Column:
    """Bytes of 1MiB, 64k or 512; null if malformed."""
    n = F.regexp_extract(text, r"^\s*([0-9]+)", 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(text, r"^\s*[0-9]+\s*([A-Za-z]*)\s*$", 1))
    good = text.rlike(r"(?i)^\s*[0-9]+\s*(|b|k|kb|kib|m|mb|mib|g|gb|gib)\s*$")
    return F.when(good, n * F.when(F.startswith(unit, F.lit("k")), 1 << 10).when(F.startswith(unit, F.lit("m")), 1 << 20).when(F.startswith(unit, F.lit("g")), 1 << 30).otherwise(1))


def human_size(n: Column) -> Column:
    """A size in words, with one decimal from KiB on."""
    say = lambda unit, size: F.concat(F.format_string("%.1f", n / size), F.lit(unit))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, say(" KiB", 1 << 10)).when(n < 1 << 30, say(" MiB", 1 << 20)).otherwise(say(" GiB", 1 << 30))


def clamp(text: Column, low: int, high: int, default: int = 0) -> Column:
    """A whole number within bounds; anything else is the default, clamped too."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")), F.lit(default))))


def client_ip(forwarded: Column, address: Column) -> Column:
    """The first hop of the forwarding header, else the host of the peer's address."""
    return F.coalesce(F.nullif(F.trim(F.substring_index(forwarded, ",", 1)), F.lit("")), F.regexp_replace(address, r":\d+$", ""))


def preview_size(width: Column, height: Column, want_w: Column, want_h: Column, mode: Column) -> Column:
    """Size of a scaled picture as struct<w, h>: contain never scales up, cover always fills. 0 means not asked for."""
    sx, sy = want_w / width, want_h / height
    contain = F.least(F.when(want_w > 0, sx).otherwise(1e9), F.when(want_h > 0, sy).otherwise(1e9), F.lit(1.0))
    fit = lambda n, s: F.greatest(F.lit(1), F.floor(n * s + 0.5)).cast("int")
    cover = (mode == "cover") & (want_w > 0) & (want_h > 0)
    return F.when(cover, F.struct(want_w.cast("int").alias("w"), want_h.cast("int").alias("h"))).otherwise(F.struct(fit(width, contain).alias("w"), fit(height, contain).alias("h")))
