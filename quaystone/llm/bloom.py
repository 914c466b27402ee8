"""Bloom filters: built by aggregation, tested inside generated code, no Python on the way.

A filter of few keys is a column; its words are part of the plan. A filter of as many keys as the data has is a table
(``thin``), which only the executors see whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.llm._common import fresh_name


@dataclass(frozen=True)
class Bloom:
    """A filter of 64-bit words. Its size is fixed when it is made, whatever is added."""

    words: list[int]
    hashes: int
    salt: int

    def contains(self, key: Column) -> Column:
        """True for every added key, and for few others; null for null."""
        n = len(self.words)
        if not any(self.words):
            return F.when(key.isNotNull(), F.lit(False))
        table = F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")
        test = None
        for at in _bits(key, n, self.hashes, self.salt):
            hit = F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1
            test = hit if test is None else test & hit
        return test


def _bits(key: Column, n_words: int, hashes: int, salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt * 64 + i)), F.lit(n_words * 64)) for i in range(hashes)]


def size_for(n: int, rate: float, max_words: int) -> tuple[int, int]:
    """Words and hash functions for n keys at a false-positive rate, within max_words."""
    bits = max(64.0, -max(n, 1) * math.log(rate) / math.log(2) ** 2)
    words = min(max_words, math.ceil(bits / 64))
    return words, max(1, min(16, round(words * 64 / max(n, 1) * math.log(2))))


def build(keys: DataFrame, key: str, n: int, rate: float, salt: int, max_words: int = 1 << 18) -> Bloom:
    """A filter of the keys. Only its words, ``max_words`` at most (2 MiB), reach the driver."""
    words, hashes = size_for(n, rate, max_words)
    rows = (
        keys.where(F.col(key).isNotNull())
        .select(F.explode(F.array(*_bits(F.col(key), words, hashes, salt))).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("bits"))
        .collect()
    )
    table = [0] * words
    for r in rows:
        table[r["word"]] = r["bits"]
    return Bloom(table, hashes, salt)


def thin(rows: DataFrame, keys: DataFrame, key: str, n: int, bits: int = 12, max_words: int = 1 << 18) -> DataFrame:
    """All rows whose ``key`` is among n keys, and few others; rows with a null key go.

    All bits of a key lie in one word of 64, so the words are a table that is broadcast and joined: plans hold none of
    them, and ``max_words`` (4 MiB) is the most that is sent. More keys than that make the filter weaker, not larger.
    """
    words = max(1, min(max_words, -(-n * bits // 64)))
    cell, mask = fresh_name(rows, "cell"), fresh_name(rows, "mask")
    at = F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(words))
    bits_of = [F.shiftrightunsigned(F.xxhash64(key, F.lit(-2)), 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4)]
    added = keys.where(F.col(key).isNotNull()).select(at.alias(cell), F.explode(F.array(*bits_of)).alias("bit"))
    table = added.groupBy(cell).agg(F.expr("bit_or(shiftleft(1L, bit))").alias(mask))
    held = rows.where(F.col(key).isNotNull()).withColumn(cell, at).join(F.broadcast(table), cell)
    for bit in bits_of:
        held = held.where(F.getbit(F.col(mask), bit) == 1)
    return held.select(*rows.columns)
