"""Mixing sources to target weights by hierarchical budgeting.

Weights live on a tree of domains, languages and sources. The token budget flows down from the root in
proportion to the weights, but no node gets more than its leaves can give (their tokens times
``max_epochs``). What a node cannot take goes to its siblings by their weights, again and again; only what all
siblings together cannot take reaches the ancestors' siblings, because a parent's own limit is its
children's sum.

A leaf's share is whole passes over its documents plus a prefix of one more pass. Every pass (epoch) has its
own order, seeded by md5; the prefix is as long as its tokens stay within what is left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaystone.llm._common import n_words, stash

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order key by which a leaf is cut into slices: 4096 for each leaf.
SLICE_DIGITS = 3


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("bigint")


def allocate(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], budget: int) -> DataFrame:
    """Adds ``given`` (tokens, bigint) to leaves of domain, lang, source and cap. All arithmetic is in integers.

    Siblings are taken in the order of cap / weight. One is full if its cap is at most its part of what the
    fuller ones before it leave over; the rest share what the full ones leave, by weight, rounded down.
    """
    out = leaves.withColumn("given", F.lit(budget).cast("bigint"))
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = out.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first("given").alias("pool"))
        nodes = nodes.withColumn("w", _weight(level, weights)).withColumn("r", F.col("cap").cast("double") / F.col("w"))
        parent = path[:-1]
        among = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
        order = among.orderBy("r", level)
        before = order.rowsBetween(W.unboundedPreceding, -1)
        nodes = nodes.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("gone", F.coalesce(F.sum("w").over(before), F.lit(0)))
        nodes = nodes.withColumn("all_w", F.sum("w").over(among))
        nodes = nodes.withColumn("full", F.col("cap") * (F.col("all_w") - F.col("gone")) <= F.col("w") * (F.col("pool") - F.col("used")))
        full_cap = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(among)
        open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(among)
        nodes = nodes.withColumn("full_cap", full_cap).withColumn("open_w", open_w)
        share = F.expr("CASE WHEN full THEN cap ELSE least(cap, (w * greatest(0L, pool - full_cap)) div open_w) END")
        out = out.drop("given").join(nodes.select(*path, share.alias("given")), path)
    return out


def mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]],
    domain: Column,
    budget_tokens: int | None = None,
    budget_share: float = 1.0,
    max_epochs: int = 4,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    tokens: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row for each row of docs: doc_id, domain, lang, source, n_tokens, leaf_tokens, given, copies, and ``carry``.

    ``domain`` is an expression over docs. ``weights`` maps domain, lang and source names to whole weights of 1
    or more; names left out weigh 1. The budget is ``budget_tokens``, or ``budget_share`` of all tokens.
    ``copies`` is how often a row is taken: 0 for none. Null domains, languages and sources form leaves named
    ``(none)``; null texts have 0 tokens. Rows of one leaf with equal ids are ordered by tokens, then by ``carry``
    (columns of docs that come along; their names must not be those of the result). Other columns are ignored. No
    rows give no rows.

    Leaf tables are as long as there are sources; no leaf's rows are ever held by one task. Siblings are ranked together:
    one task holds the domains, one the languages of a domain, one the sources of a language, one row each, so the
    names of one level under one node should number millions at most (hosts belong into ``source``).
    """
    named = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    kept = [F.col(c) for c in carry]
    rows = docs.select(
        *kept, F.col(id_col).alias("doc_id"),
        named(domain).alias("domain"),
        named(F.col(lang_col)).alias("lang"),
        named(F.col(source_col)).alias("source"),
        (n_words(F.col(text_col)) if tokens is None else tokens).alias("n_tokens"),
    )
    rows = stash(rows)
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens")).withColumn("cap", F.col("leaf_tokens") * max_epochs)
    leaves = stash(leaves)
    if budget_tokens is None:
        share = Fraction(str(budget_share))
        budget_tokens = (leaves.agg(F.sum("leaf_tokens")).first()[0] or 0) * share.numerator // share.denominator
    plan = allocate(leaves, weights, budget_tokens)
    plan = plan.withColumn("passes", F.expr("CASE WHEN leaf_tokens = 0 THEN 0 ELSE int(given div leaf_tokens) END"))
    plan = stash(plan.withColumn("rest", F.col("given") - F.col("passes") * F.col("leaf_tokens")).drop("cap"))
    # leaves are as many as sources; AQE picks broadcast or shuffle by their real size and splits hot leaves
    rows = rows.join(plan, list(LEVELS))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("passes").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = stash(rows.withColumn("key", key).withColumn("slice", F.substring("key", 1, SLICE_DIGITS)))
    leaf = list(LEVELS)
    sums = rows.groupBy(*leaf, "slice").agg(F.sum("n_tokens").alias("in_slice"))
    earlier = W.partitionBy(*leaf).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = stash(sums.withColumn("before", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0))))
    rows = rows.join(sums, [*leaf, "slice"])
    # only the slice in which a leaf's prefix ends needs an order of its rows
    inside = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("in_slice") > F.col("rest"))
    running = F.sum("n_tokens").over(W.partitionBy(*leaf, "slice").orderBy("key", "doc_id", "n_tokens", *carry).rowsBetween(W.unboundedPreceding, 0))
    cut = rows.where(inside).withColumn("more", (F.col("before") + running <= F.col("rest")).cast("int"))
    rest = rows.where(~inside).withColumn("more", (F.col("before") + F.col("in_slice") <= F.col("rest")).cast("int"))
    both = cut.unionByName(rest)
    return both.select(*carry, "doc_id", *LEVELS, "n_tokens", "leaf_tokens", "given", (F.col("passes") + F.col("more")).cast("int").alias("copies"))
