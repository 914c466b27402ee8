"""Search, packing, mixing and the pipeline against brute force."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaystone.llm import ann, mixing, packing, queries

SMALL = "/root/testdata/sf0.01"


def test_ann_recall_and_order(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    found = {}
    for r in queries.op5_ann(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = found[int(q)]
        assert [m[2] for m in mine] == list(range(1, 11)) and all(abs(s - d[ids == v][0]) < 1e-12 for v, s, _ in mine)
        assert [(s, v) for v, s, _ in mine] == sorted((s, v) for v, s, _ in mine)
        hits += len(set(order) & {m[0] for m in mine})
    assert hits / (10 * len(found)) >= 0.9


@pytest.mark.parametrize("spread", [1e-3, 0.3])
def test_ann_recall_with_a_tight_cluster(spark, spread):
    """A third of all rows lies close together, in lists of thousands; another sixth is one vector."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12_000, 16)).astype(np.float32)
    x[:4000] = rng.normal(size=16) + spread * rng.normal(size=(4000, 16))
    x[4000:6000] = x[4000]
    order = rng.permutation(len(x))
    x = x[order]
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id bigint, embedding array<float>")
    indexes = ann.fit(table, sample_rows=2048)
    assert indexes[16].probes < len(indexes[16].centroids)
    asked = table.where("vec_id % 100 = 0")
    found = {}
    for r in ann.search(table, asked, indexes, block_rows=2048).collect():
        found.setdefault(r.query_id, []).append(r.score)
    hits = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
        tenth = np.partition(np.delete(d, q), 9)[9]
        assert len(found[q]) == 10
        hits += sum(s <= tenth for s in found[q])
    assert hits / (10 * len(found)) >= 0.9


def test_ann_edges(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 6)).round(3).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[3]) for i in range(60)]
    rows += [(300, None), (301, [0.0] * 6), (302, [float("nan")] * 6), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, [float("inf")] * 6), (305, []), (None, base[0])]
    short = [(310, [1.0, 2.0]), (311, [1.0, 4.0]), (312, [2.0, 2.0])]
    again = [(5, base[7]), (5, base[8])]
    table = spark.createDataFrame([(i, v, "x") for i, v in [*rows, *short, *again]], "vec_id bigint, embedding array<double>, raw string")
    index = ann.fit(table, lists=4, subspaces=4)
    out = ann.search(table, table.where("vec_id IN (0, 3, 100, 300, 301, 310)"), index, probes=4, block_rows=16, batch_rows=2).orderBy("query_id", "rank").collect()
    x = [(i, np.array(v)) for i, v in [*rows, *again] if i is not None and i < 300]
    for q in (0, 3, 100):
        at = dict(rows)[q]
        least = {}
        for i, v in x:
            if i != q:
                least[i] = min(least.get(i, np.inf), float(np.sqrt(((at - v) ** 2).sum())))
        assert [(r.score, r.vec_id) for r in out if r.query_id == q] == sorted((s, i) for i, s in least.items())[:10]
    assert [(r.score, r.vec_id, r["rank"]) for r in out if r.query_id == 310] == [(1.0, 312, 1), (2.0, 311, 2)]
    assert {r.query_id for r in out} == {0, 3, 100, 310}
    assert ann.search(table, table, ann.fit(table.limit(0))).count() == 0
    few = table.where("vec_id < 4")
    assert ann.search(few, few, ann.fit(few), probes=500).count() == 12


def padding(histogram, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in histogram)


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(0, 60), rng.randrange(1, 10))
    histogram = [(x, rng.randrange(1, 9)) for x in lengths]
    for k in (1, 2, 3, 12):
        bounds = packing.best_boundaries(histogram, k)
        least = min(padding(histogram, [*c, max(lengths)]) for n in range(min(k, len(lengths))) for c in itertools.combinations(lengths, n))
        assert padding(histogram, bounds) == least and bounds == sorted(bounds) and len(bounds) <= k
    assert packing.best_boundaries([], 3) == []


def test_packing(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    out = packing.pack(table.withColumn("bucket", F.lit("clash")), slice_rows=64).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    batches = {}
    for r in out:
        assert r.n_tokens == len(re.findall(r"[^\x20\x09-\x0d]+", texts[r.doc_id])) and r.padding == r.bucket_max - r.n_tokens >= 0
        batches.setdefault(r.batch, []).append(r)
    assert all(len({r.bucket for r in b}) == 1 and (len(b) == 1 or sum(r.bucket_max for r in b) <= 65_536) for b in batches.values())
    histogram = {}
    for r in out:
        histogram[r.n_tokens] = histogram.get(r.n_tokens, 0) + 1
    bounds = sorted({r.bucket_max for r in out})
    assert sum(r.padding for r in out) == padding(histogram.items(), packing.best_boundaries(list(histogram.items()), 16)) == padding(histogram.items(), bounds)


def test_packing_edges(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a"), (4, "w " * 200_000)], "doc_id bigint, text string")
    out = packing.pack(rows, buckets=2, token_budget=10).collect()
    assert sorted(r.n_tokens for r in out) == [0, 0, 1, 2, 2, 200_000]
    alone = next(r for r in out if r.doc_id == 4)
    assert alone.bucket_max >= 200_000 and sum(r.batch == alone.batch for r in out) == 1
    assert packing.pack(rows.limit(0)).count() == 0


def fill(nodes, pool):
    """Water filling by hand: name -> (cap, weight)."""
    given, left = {}, dict(nodes)
    while left:
        total = sum(w for _, w in left.values())
        full = {n for n, (c, w) in left.items() if c * total <= w * pool}
        if not full:
            return given | {n: min(c, w * max(0, pool) // total) for n, (c, w) in left.items()}
        for n in full:
            given[n] = left.pop(n)[0]
            pool -= given[n]
    return given


def expected_shares(leaves, weights, budget):
    def down(prefix, depth, pool):
        if depth == 3:
            return {prefix: pool}
        kids = {}
        for leaf, cap in leaves.items():
            if leaf[:depth] == prefix:
                kids[leaf[: depth + 1]] = kids.get(leaf[: depth + 1], 0) + cap
        level = mixing.LEVELS[depth]
        shares = fill({k: (c, weights.get(level, {}).get(k[-1], 1)) for k, c in kids.items()}, pool)
        return {leaf: n for k, share in shares.items() for leaf, n in down(k, depth + 1, share).items()}

    return down((), 0, budget)


@pytest.mark.parametrize(("share", "epochs"), [(1.0, 4), (0.3, 1), (5.0, 2)])
def test_mixing(spark, share, epochs):
    import hashlib

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = mixing.mix(table.withColumn("copies", F.lit("clash")), queries.MIX_WEIGHTS, F.expr(queries.DOMAIN_SQL), budget_share=share, max_epochs=epochs).collect()
    leaves, rows = {}, {}
    for r in out:
        leaf = (r.domain, r.lang, r.source)
        leaves[leaf] = leaves.get(leaf, 0) + r.n_tokens
        rows.setdefault(leaf, []).append(r)
    given = expected_shares({k: n * epochs for k, n in leaves.items()}, queries.MIX_WEIGHTS, int(sum(leaves.values()) * share))
    for leaf, group in rows.items():
        assert {r.given for r in group} == {given[leaf]} and {r.leaf_tokens for r in group} == {leaves[leaf]}
        passes, rest = divmod(given[leaf], leaves[leaf])
        run = 0
        for r in sorted(group, key=lambda r: (hashlib.md5(f"mix:{passes}:{r.doc_id}".encode()).hexdigest(), r.doc_id)):
            run += r.n_tokens
            assert r.copies == passes + (run <= rest)
    assert len(out) == table.count()


def test_mixing_edges(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, "", "en", "s"), (3, "a b c", "en", "s"), (3, "a b c", "en", "s"), (None, "x", "en", "t")], "doc_id bigint, text string, lang string, source string")
    out = mixing.mix(rows, {}, F.lit("d"), budget_share=10.0, max_epochs=2).collect()
    assert len(out) == 5 and {r.copies for r in out if r.n_tokens} == {2}
    assert mixing.mix(rows, {}, F.lit("d"), budget_tokens=0).agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0] == 0
    assert mixing.mix(rows.limit(0), {}, F.lit("d")).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaf = "domain string, lang string, source string, cap bigint"
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 500), ("a", "y", "s3", 500), ("b", "x", "s4", 500)], leaf)
    given = {r.source: r.given for r in mixing.allocate(leaves, {}, 400).collect()}
    assert given == {"s1": 10, "s2": 90, "s3": 100, "s4": 200}
