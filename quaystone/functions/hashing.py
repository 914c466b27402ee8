"""Hashes, placement and shard arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of 32-bit FNV-1a.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619

BLOCK_SIZE = 1 << 20
INLINE_LIMIT = 128 << 10


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as bigint."""
    data = F.hex(F.encode(text, "UTF-8"))
    octets = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(data, i, F.lit(2)), 16, 10).cast("bigint")
    step = lambda h, i: F.pmod(h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME), F.lit(1 << 32))
    return F.aggregate(octets, F.lit(FNV_OFFSET).cast("bigint"), step)


def placement(key: Column, n_sets: int) -> Column:
    """The set that owns a key."""
    return F.pmod(fnv1a(key), F.lit(n_sets)).cast("int")


def active_placement(key: Column, active_sets: list[int]) -> Column:
    """The owner while other sets drain: the hash picks among the active ones."""
    return F.element_at(F.lit(active_sets), placement(key, len(active_sets)) + 1)


def distribution(key: Column, n_disks: int) -> Column:
    """Shard numbers by disk: the identity, rotated by the key's hash."""
    turn = placement(key, n_disks)
    return F.transform(F.sequence(F.lit(0), F.lit(n_disks - 1)), lambda j: F.pmod(j + turn, F.lit(n_disks)).cast("int"))


def shard_of_disk(dist: Column, disk: Column) -> Column:
    """The position of a disk in a distribution, from 0; -1 if it is not there."""
    return (F.array_position(dist, disk) - 1).cast("int")


def heal_sample(bucket: Column, key: Column, pass_no: int, rate: int = 128) -> Column:
    """Whether a scan pass checks an object: one in ``rate``, another one each pass."""
    return F.pmod(fnv1a(F.concat(bucket, F.lit("/"), key)) + F.lit(pass_no), F.lit(rate)) == 0


def shard_size(size: Column, data: int, block: int = BLOCK_SIZE) -> Column:
    """Bytes that each disk stores for an object cut into stripes of data * block."""
    stripe = data * block
    full = F.floor(size / stripe) * block
    rest = F.pmod(size, F.lit(stripe))
    return (full + F.ceil(rest / data)).cast("bigint")


def quorums(n_disks: Column) -> tuple[Column, Column, Column]:
    """Parity, read and write quorum of n disks."""
    parity = F.floor(n_disks / 2).cast("int")
    data = (n_disks - parity).cast("int")
    return parity, data, (data + 1).cast("int")


def inline_eligible(parts: Column, size: Column) -> Column:
    """Small objects in one part live inside their metadata."""
    return (parts == 1) & size.between(0, INLINE_LIMIT)


def content_hash(*columns: Column) -> Column:
    """What replicas vote on; only equality matters."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def encrypted_size(plain: Column, chunk: int = 64 << 10, overhead: int = 16, header: int = 0) -> Column:
    """Stored size of a chunk-wise sealed stream: each chunk grows by its tag."""
    return (plain + F.ceil(plain / chunk) * overhead + header).cast("bigint")


@F.pandas_udf(T.BinaryType())
def _crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C (reflected polynomial 0x82F63B78), big-endian bytes; Spark has no expression for it."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0x82F63B78), table >> 1)
    steps = table.tolist()

    def one(b: bytes | None) -> bytes | None:
        if b is None:
            return None
        crc = 0xFFFFFFFF
        for x in bytes(b):
            crc = steps[(crc ^ x) & 255] ^ crc >> 8
        return (crc ^ 0xFFFFFFFF).to_bytes(4, "big")

    return pd.Series([one(b) for b in data])


def checksum(kind: str, data: Column) -> Column:
    """Base64 of crc32, crc32c, sha1 or sha256 over the bytes, as upload headers carry it."""
    if kind == "crc32c":
        return F.base64(_crc32c(data.cast("binary")))
    if kind == "crc32":
        return F.base64(F.unhex(F.lpad(F.hex(F.crc32(data)), 8, "0")))
    return F.base64(F.unhex(F.sha1(data) if kind == "sha1" else F.sha2(data, 256)))
