"""Exact, near and line deduplication against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quaystone.llm import exact_dedup, line_dedup, simhash
from quaystone.llm.components import connected_components

DOC = "doc_id bigint, text string, sha binary, fp bigint, component string"


def docs(spark, texts):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, b"x", 1, "y") for i, t in texts], DOC)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    parent = {x: x for p in pairs for x in p}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    out = connected_components(spark.createDataFrame([*pairs, *pairs[:5]], "a long, b long"))
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert sorted(map(tuple, out.collect())) == sorted((x, find(parent, x)) for x in linked)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = [(1, "a b"), (2, "ab "), (3, "a\tb  "), (4, None), (5, ""), (6, "\n"), (7, "é"), (8, "e\u0301"), (9, "a\u00a0b"), (None, "zz"), (11, "zz"), (12, "long " * 30000), (12, "long " * 30000)]


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        k = hashlib.sha256(re.sub(r"[\x20\x09-\x0d]", "", t or "").encode()).hexdigest()
        groups.setdefault(k, []).append((i, t or ""))
    out = []
    for k, members in groups.items():
        at = min(range(len(members)), key=lambda m: (-len(members[m][1]), members[m][0] is None, members[m][0] or 0))
        out += [(i, members[at][0], len(members), n == at, k) for n, (i, _) in enumerate(members)]
    return sorted(out, key=repr)


def test_exact_edges(spark):
    out = exact_dedup.exact_dedup(docs(spark, TEXTS))
    assert sorted(map(tuple, out.collect()), key=repr) == expected_exact(TEXTS)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_rows_with_one_id(spark):
    """Equal texts under one id: the longer original stays, of full ties one row."""
    out = exact_dedup.exact_dedup(docs(spark, [(1, "a b"), (1, "a  b"), (2, "a  b"), (3, "c"), (3, "c"), (3, "c")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out) == [(1, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False), (3, 3, 3, False), (3, 3, 3, False), (3, 3, 3, True)]


@pytest.mark.parametrize(("max_bits", "slice_rows"), [(256, 16), (1 << 28, 1 << 21)])
def test_exact_on_documents(spark, data, max_bits, slice_rows):
    """Also over many slices and filters."""
    table = spark.read.parquet(f"{data}/documents.parquet")
    out = exact_dedup.exact_dedup(table, max_bits=max_bits, slice_rows=slice_rows)
    assert sorted(map(tuple, out.collect()), key=repr) == expected_exact([(r.doc_id, r.text) for r in table.collect()])


def test_bloom_passes_find_all_repeats(spark):
    words = [int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:8], "big", signed=True) for i in range(3000)]
    rows = words + words[:200] + [words[7]] * 500
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(w,) for w in rows], "word bigint").repartition(7)
    for slice_rows in (64, 1 << 20):
        again = {r.word for r in exact_dedup.repeated_words(df, len(rows), slice_rows).collect()}
        assert set(words[:200]) <= again and len(again) < 260
    found = spark.createDataFrame([(w,) for w in words[:200]], "word bigint")
    for max_bits in (600, 1 << 28):
        tested = exact_dedup.may_repeat(df, found, max_bits)
        let = {r.word for r in tested.where("_again").collect()}
        assert set(words[:200]) <= let and len(let) < 300 and tested.count() == len(rows)


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def expected_simhash(rows):
    prints = [plain_print(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        root = find(parent, i)
        if doc is not None:
            least[root] = min(least.get(root, doc), doc)
    return sorted(((doc, f"{prints[i]:016x}", least.get(find(parent, i))) for i, (doc, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("hot_cell", [1, 256])
def test_simhash_on_documents(spark, data, hot_cell):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").limit(150).collect()]
    rows = [*table, *TEXTS, (900, "One TWO"), (901, "one two"), (902, "x"), (903, " \t"), *[(1000 + i, table[0][1] + f" w{i}") for i in range(40)]]
    out = simhash.simhash_groups(docs(spark, rows), hot_cell=hot_cell)
    assert sorted(map(tuple, out.collect()), key=repr) == expected_simhash(rows)


@pytest.mark.parametrize("hot_cell", [0, 3, 10_000])
def test_simhash_links_are_exact(spark, hot_cell):
    """Random fingerprints with dense neighbourhoods: the same components by cells and by words between."""
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for base in list(prints):
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))) for _ in range(6)}
    table = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp bigint")
    out = {r.node: r.component for r in connected_components(simhash.links(table, hot_cell)).collect()}
    parent = {p: p for p in prints}
    order = sorted(prints, key=simhash.signed)
    for i, p in enumerate(order):
        for q in order[:i]:
            if bin(p ^ q).count("1") <= 2:
                a, b = find(parent, p), find(parent, q)
                parent[max(a, b, key=simhash.signed)] = min(a, b, key=simhash.signed)
    assert {simhash.signed(p): out.get(simhash.signed(p), simhash.signed(p)) for p in prints} == {simhash.signed(p): simhash.signed(find(parent, p)) for p in prints}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line, n):
    chars = list(line)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcé😀")
        elif kind == 1:
            chars.insert(at, rng.choice("abc"))
        elif len(chars) > 1:
            del chars[at]
    return "".join(chars)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(most):
    rng = random.Random(most)
    a = ["".join(rng.choice("ab é") for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    b = [edited(rng, x, rng.randrange(0, most + 3)) for x in a]
    found = line_dedup._within(pd.Series(a), pd.Series(b), most)
    assert found.tolist() == [distance(x, y) <= most for x, y in zip(a, b, strict=True)]


def line_rows(rng, n):
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(30, 60))).strip() + "." for _ in range(n)]
    lines += [edited(rng, x, rng.randrange(1, 4)) for x in lines[: n // 2]] + ["the very same beginning of a line that many lines share " + str(i) for i in range(25)]
    return lines


@pytest.mark.parametrize("hot_pairs", [3, 40_000])
def test_similar_lines(spark, hot_pairs):
    lines = sorted(set(line_rows(random.Random(11), 80)))
    table = spark.createDataFrame(list(enumerate(lines)), "id bigint, line string")
    found = {tuple(r) for r in line_dedup.similar_lines(table, 2, hot_pairs).collect()}
    assert found == {(i, j) for j in range(len(lines)) for i in range(j) if distance(lines[i], lines[j]) <= 2}


def edits(a, b):
    return min(8, 2 + min(len(a), len(b)) // 512)


def expected_classes(rows, least=1):
    """rows in the order of the table."""
    places = [((d is None, d or 0, r), n, x.strip(" \t\r\x0b\x0c")) for r, (d, t) in enumerate(rows) if t is not None for n, x in enumerate(t.split("\n"))]
    places = [p for p in places if len(p[2]) >= least]
    lines = sorted({p[2] for p in places})
    parent, links = {x: x for x in lines}, dict.fromkeys(lines, 0)
    for j, b in enumerate(lines):
        for a in lines[:j]:
            if min(len(a), len(b)) >= 9 and abs(len(a) - len(b)) <= edits(a, b) and distance(a, b) <= edits(a, b):
                links[a] += 1
                links[b] += 1
                parent[find(parent, b)] = find(parent, a)
    members = {}
    for p in places:
        members.setdefault(find(parent, p[2]), []).append(p)
    out = []
    for group in members.values():
        first = min(group)[:2]
        named = rows[first[0][2]][0]
        out += [(rows[d[2]][0], n, named, first[1], len(group), links[x], (d, n) == first) for d, n, x in group]
    return sorted(out, key=repr)


def test_line_classes(spark):
    """Lines of every length from one character on, null ids, rows that repeat."""
    rng = random.Random(2)
    lines = line_rows(rng, 40)
    short = ["".join(rng.choice("ab") for _ in range(n)) for n in range(1, 33)]
    rows = [(i, "\n".join([*rng.sample(lines, 4), *rng.sample(short, 2), "short", "  " + lines[0] + "\r"])) for i in range(1, 30)] + [(40, None), (41, ""), (None, lines[0]), (42, "\n\n")]
    rows += [(5, rows[4][1]), (5, rows[4][1] + "\na line that the other row of this id lacks"), (None, "nobody else has this line"), (None, "nobody else has this linE")]
    out = line_dedup.line_classes(docs(spark, rows).coalesce(1))
    assert sorted(map(tuple, out.collect()), key=repr) == expected_classes(rows)
    assert line_dedup.line_classes(docs(spark, [])).count() == 0


def test_threshold_follows_the_length(spark):
    """One to eight edits in lines of 300 to 1600 characters, and one too many."""
    rng = random.Random(12)
    lines = []
    for n in (300, 511, 512, 1030, 1600):
        base = "".join(rng.choice("abcdefghij klm") for _ in range(n))
        most = min(8, 2 + n // 512)
        for k in (1, most, most + 1, most + 4):
            x = list(base)
            for at in sorted(rng.sample(range(0, n - 2, 3), k), reverse=True):
                x[at : at + 1] = rng.choice([["X"], ["X", base[at]], []])
            lines.append("".join(x))
        lines.append(base)
    table = spark.createDataFrame(list(enumerate(lines)), "id bigint, line string")
    expected = {(i, j) for j, b in enumerate(lines) for i, a in enumerate(lines[:j]) if abs(len(a) - len(b)) <= edits(a, b) and distance(a, b) <= edits(a, b)}
    for hot_pairs in (1, 1 << 26):
        assert {tuple(r) for r in line_dedup.similar_lines(table, 2, hot_pairs).collect()} == expected
    assert len(expected) >= 8


def test_dedup_lines_keeps_first_and_clean(spark):
    a, b = "this line is long enough to be looked at, one", "this line is long enough to be looked at, two!"
    assert distance(a, a + "!") == 1
    rows = [(1, f"{a}\nkeep me"), (2, f"short\n{a}!\n{b}"), (3, a), (4, "clean text that nobody else has in this table"), (5, None), (None, a), (6, ""), (None, "the only one"), (2, f"{b}\nof the same id")]
    table = docs(spark, rows).withColumn("_row", F.lit(1)).withColumn("gone", F.lit(2)).coalesce(1)
    out = line_dedup.dedup_lines(table)
    assert out.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(
        [(1, f"{a}\nkeep me"), (2, f"short\n{b}"), (4, rows[3][1]), (5, None), (6, ""), (None, "the only one"), (2, "of the same id")], key=repr
    )


def test_hot_line_is_one_class(spark):
    line = "one line that a third of all documents hold in this corpus"
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, line).otherwise(F.concat(F.lit("a line of its own, number "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    out = line_dedup.line_classes(rows)
    assert out.where("kept").count() == 401 and out.agg(F.max("class_size")).first()[0] == 200


def test_numbers_stay_whole():
    assert np.uint64(simhash.fingerprint("a b c d")) == plain_print("a b c d")
