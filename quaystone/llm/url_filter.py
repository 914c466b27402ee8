"""URL rules by a Bloom filter cascade: exact membership without joins, in generated code throughout.

Level 0 encodes the listed keys; level 1 those other keys of the corpus that level 0 lets through; level 2
the listed keys that level 1 lets through; and so on until none are left. A key's answer is the parity of
the first level that turns it away. Over the complete universe of keys that the corpus holds, from which
the odd levels are made, every answer is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import bloom
from quaystone.llm._common import stash


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the start of a path."""

    verdict: str
    host: str
    path: str = ""

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Cascade:
    levels: tuple[bloom.Bloom, ...]

    def contains(self, key: Column) -> Column:
        """Exact for all keys of the universe that the cascade was built over; false for null."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(self.levels[i].contains(key), answer).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(answer, F.lit(False))


def build_cascade(listed: DataFrame, universe: DataFrame, key: str = "key", first_rate: float = 0.001, max_levels: int = 40) -> Cascade:
    """listed and universe have a string column ``key``; null keys are left out, repeats do no harm.

    The first filter's size follows the listed keys; later ones halve from level to level. The universe is read
    once, for level 0; what that lets through, a small share, is kept as a table for the others.
    """
    listed = stash(listed.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct())
    n = listed.count()
    levels = [bloom.build(listed, "key", n, first_rate, salt=0)]
    passed = universe.select(F.col(key).alias("key")).where(levels[0].contains(F.col("key"))).distinct()
    others = stash(passed.join(listed, "key", "left_anti"))
    inside = listed
    while (n := others.count()) and len(levels) < max_levels:
        level = bloom.build(others, "key", n, 0.5 if len(levels) > 1 else 0.25, salt=len(levels))
        levels.append(level)
        inside, others = others, stash(inside.where(level.contains(F.col("key"))))
    if n:
        raise RuntimeError("the cascade did not end; are keys both listed and not?")
    return Cascade(tuple(levels))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """All keys that a fitting rule could have: each suffix of the host at a dot, with each path start of a rule's length."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array(*[F.substring(path, 1, n) for n in sorted(set(path_lengths))])
    starts = F.filter(F.array_distinct(starts), lambda p: F.length(p).isin(sorted(set(path_lengths))))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def _hits(cascade: Cascade, verdict: str) -> Column:
    listed = F.filter("keys", lambda k: cascade.contains(k))
    return F.transform(listed, lambda k: F.struct(F.length(k).alias("size"), k.alias("key"), F.lit(verdict).alias("verdict")))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict.

    The longest fitting rule decides (of two equally long ones that fit a url, the one with the longer host;
    both can only fit if their text differs). A rule listed twice keeps its last verdict. Urls that no rule
    fits, null and without ``://`` included, get ``default``. The rules are part of the plan: their number is a
    parameter, not data. Other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    by_key = {(r.host.lower(), r.path): Rule(r.verdict, r.host.lower(), r.path) for r in rules}
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not by_key:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    rows = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), [len(r.path) for r in by_key.values()]))
    universe = rows.select(F.explode("keys").alias("key"))
    verdicts = sorted({r.verdict for r in by_key.values()})
    found = F.array().cast("array<struct<size:int,key:string,verdict:string>>")
    for v in verdicts:
        listed = spark.createDataFrame([(r.key,) for r in by_key.values() if r.verdict == v], "key string")
        found = F.concat(found, _hits(build_cascade(listed, universe), v))
    best = F.array_max(found)
    return rows.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
