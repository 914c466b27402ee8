"""Faults of the second round: each test failed before its repair."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaystone.llm import ann, bloom, line_dedup, near_copies


def test_plans_hold_no_filter_words(spark):
    """The filter of line ids once lay in the plan as text, which grew with the lines until the driver's heap was full."""
    ids = spark.range(20_000).select(F.xxhash64("id").alias("id"))
    rows = spark.range(60_000).select(F.xxhash64("id").alias("id"), F.lit(1).alias("cell")).unionByName(spark.createDataFrame([(None, 1)], "id bigint, cell int"))
    out = bloom.thin(rows, ids, "id", 20_000)
    assert out.columns == rows.columns and len(out._jdf.queryExecution().toString()) < 50_000
    left = out.select("id").distinct()
    assert left.join(ids, "id").count() == 20_000 and left.count() < 22_000 and left.where("id IS NULL").count() == 0
    # a filter that is too small lets more through and loses none
    assert bloom.thin(rows, ids, "id", 20_000, max_words=64).join(ids, "id").count() == 20_000


def test_line_dedup_plans_do_not_grow(spark, monkeypatch):
    sizes = []

    def measured(df, stash=line_dedup.stash):
        sizes.append(len(df._jdf.queryExecution().toString()))
        return stash(df)

    monkeypatch.setattr(line_dedup, "stash", measured)
    lines = spark.range(4000).select("id", F.concat(F.lit("the same line but for its number "), F.format_string("%08d", F.col("id") * 7919)).alias("line"))
    assert line_dedup.similar_lines(lines).count() > 0
    assert max(sizes) < 100_000


@pytest.mark.parametrize("kind", ["far", "heavy"])
def test_ann_recall_on_other_rows(spark, kind):
    """Vectors far from the origin, and vectors whose lengths differ by orders of magnitude."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    x = (x + 1e4 if kind == "far" else x * np.exp(2 * rng.normal(size=(6000, 1)))).astype(np.float32)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id bigint, embedding array<float>")
    found = {}
    for r in ann.search(table, table.where("vec_id % 100 = 0"), ann.fit(table)).collect():
        found.setdefault(r.query_id, []).append(r.score)
    x, hits = x.astype(float), 0
    for q in range(0, len(x), 100):
        tenth = np.partition(np.delete(np.sqrt(((x - x[q]) ** 2).sum(1)), q), 9)[9]
        hits += sum(s <= tenth for s in found[q])
    assert hits / (10 * len(found)) >= 0.9


def test_few_texts_meet_on_a_passage(spark, monkeypatch):
    """Other texts with one passage in common: a sample that misses it once left it in their prefixes, and all were paired."""
    monkeypatch.setattr(near_copies, "SAMPLE", 2)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    passage = " ".join(rng.choices(words, k=30))
    rows = [(i, " ".join(rng.choices(words, k=40)) + " " + passage) for i in range(120)]
    rows += [(200 + i, t + " more") for i, t in rows[:20]]
    met = []

    def counted(sets, of=near_copies._met):
        met.append(of(sets))
        return met[-1]

    monkeypatch.setattr(near_copies, "_met", counted)
    out = {r.doc_id: r.component_id for r in near_copies.copy_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {i: i % 200 for i, _ in rows}
    assert met[0].agg(F.max("c")).first()[0] <= near_copies.MEETING


def test_fingerprints_link_near_copies_first(spark, monkeypatch):
    """The stage once had no fingerprints; what they link is found without the join, and the join leaves it out."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    base = [" ".join(rng.choices(words, k=1500)) for _ in range(6)]
    rows = [*enumerate(base), *((10 + i, t + " more") for i, t in enumerate(base))]
    prints = [near_copies.of_hashes(near_copies.shingles(t, 5)) for _, t in rows]
    close = [i for i in range(6) if (prints[i] ^ prints[6 + i]).bit_count() <= 2]
    assert len(close) >= 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")

    def groups():
        return {r.doc_id: r.component_id for r in near_copies.copy_groups(docs).collect()}

    assert groups() == {i: i % 10 for i, _ in rows}
    monkeypatch.setattr(near_copies, "_met", lambda sets, of=near_copies._met: of(sets).where("false"))
    assert groups() == {i: i - 10 if i - 10 in close else i for i, _ in rows}


def test_pairs_in_a_large_group_follow_its_size(spark, monkeypatch):
    """Near copies of one text, many of them not linked directly: all their pairs were once measured."""

    def counted(df, of=near_copies.stash):
        out = of(df)
        if out.columns == ["a", "b"]:
            pairs[-1] += out.count()
        return out

    # without parities all pairs that meet are measured
    monkeypatch.setattr(near_copies, "_flips", lambda a, b: F.lit(0))
    monkeypatch.setattr(near_copies, "stash", counted)
    rng, pairs = random.Random(9), []
    base = [f"w{i}" for i in range(300)]
    for copies in (60, 180):
        pairs.append(0)
        rows = [(i, " ".join(f"x{i}_{k}" if k in gone else w for k, w in enumerate(base))) for i in range(copies) for gone in [set(rng.sample(range(300), 1 + i % 4))]]
        out = near_copies.copy_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        sets, least = [set(near_copies.shingles(t, 5).tolist()) for _, t in rows], list(range(copies))
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if 5 * len(x & y) >= 4 * len(x | y) and least[i] != least[j]:
                    one, two = sorted((least[i], least[j]))
                    least = [one if g == two else g for g in least]
        assert {r.doc_id: r.component_id for r in out} == dict(enumerate(least))
    assert pairs[1] <= 4 * pairs[0]


def test_signatures_travel_in_blocks(spark, monkeypatch):
    """Each signature of a line was once a row of the shuffle: some 12 rows for each line, nearly all of which meet nothing."""
    rows, frame = [], type(spark.range(0))

    def counted(self, *cols, of=frame.repartition):
        rows.append(self.count())
        return of(self, *cols)

    monkeypatch.setattr(frame, "repartition", counted)
    lines = spark.range(3000).select("id", F.concat(F.lit("line "), F.sha2(F.col("id").cast("string"), 256)).alias("line"))
    twins = spark.createDataFrame([(5000, "the one line that has a twin"), (5001, "the one line that has a twin!")], "id bigint, line string")
    assert [tuple(r) for r in line_dedup.similar_lines(lines.unionByName(twins)).collect()] == [(5000, 5001)]
    assert rows and max(rows) < 1000


@pytest.mark.parametrize("of", [["id"], ["id", "grp", "text"]])
def test_buckets_settle_as_they_come(monkeypatch, of):
    """A task that has no room for a bucket lets out keys that have met, and those on which many wait; it loses none."""
    monkeypatch.setattr(line_dedup, "HELD", 300)
    monkeypatch.setattr(line_dedup, "OPEN", 40)
    rng = np.random.default_rng(8)
    # key, role, id: keys that meet, keys of one line that comes again, keys on which only probes wait, a key of all lines
    rows = [(k * 4, r, i) for k, r, i in zip(rng.integers(0, 900, 3000).tolist(), rng.choice([1, 2, 3], 3000).tolist(), rng.integers(0, 500, 3000).tolist(), strict=True)]
    rows += [(4000, 3, 7)] * 800 + [(4004, 2, i) for i in range(600)] + [(4008, 1 + i % 2, i) for i in range(900)] + [(4012, 2, i) for i in range(30)]
    rng.shuffle(rows)
    table = pd.DataFrame(rows, columns=["key", "role", "id"]).assign(grp=lambda x: x["id"] * 3, text=lambda x: x["id"] * 5)
    packed = [(table["key"] | table["role"]).to_numpy(np.int64), *(table[c].to_numpy(np.int64) for c in of)]
    blocks = [(b, *(c[b * 2665 : (b + 1) * 2665][k : k + 90].tobytes() for c in packed)) for b in range(2) for k in range(0, 2665, 90)]
    frames = [pd.DataFrame(blocks[k : k + 7], columns=["bucket", "key", *of]) for k in range(0, len(blocks), 7)]
    found = list(line_dedup._met(of)(iter(frames)))
    assert max(map(len, found)) < 1500
    found, given = pd.concat(found), set()
    for b in range(2):
        part = table[b * 2665 : (b + 1) * 2665]
        for key, group in part.groupby("key"):
            if group["id"].nunique() > 1 and np.bitwise_or.reduce(group["role"]) == 3:
                given |= set(zip(group["key"], group["role"], group["id"], strict=True))
    out = set(zip(found["key"], found["role"].astype(int), found["id"], strict=True))
    assert given and given <= out and {k for k, _, _ in out - given} <= {4004}
    if len(of) > 1:
        assert (found["grp"] == found["id"] * 3).all() and (found["text"] == found["id"] * 5).all()


def test_trimmed_and_short_lines(spark):
    """Lines are trimmed of ASCII white space only, and shortness is counted in characters, not bytes."""
    rows = [(1, "\t\x0b one\r\n\x0c two \x0c\n three \n \r\t\n" + "é" * 9 + "\n" + "é" * 8 + "\n" + "😀" * 2 + "\n" + "a" * 8 + " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lines = {n: [r.line for r in line_dedup.lines_of(docs, "text", n).orderBy("line_no").collect()] for n in (1, 9)}
    assert lines[1] == ["one", "two", " three ", "é" * 9, "é" * 8, "😀" * 2, "a" * 8]
    assert lines[9] == ["é" * 9]
