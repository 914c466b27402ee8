"""Near copies against a brute-force Jaccard grouping, and the pipeline's stage that drops them."""

import random

import pytest

import corpus_pipeline
from quaystone.llm import near_copies

WORDS = [f"w{i}" for i in range(400)]


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def sets_of(texts, size=5):
    out = []
    for t in texts:
        words = (t or "").lower().split()
        out.append({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return out


def expected(rows):
    sets, parent = sets_of(t for _, t in rows), list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            root = find(parent, i)
            least[root] = min(least.get(root, doc), doc)
    return sorted(((doc, least.get(find(parent, i))) for i, (doc, _) in enumerate(rows)), key=repr)


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(["x", "y", "z"])
    return " ".join(words)


def texts(rng):
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(3, 200))) for _ in range(40)]
    passage = " ".join(rng.choices(WORDS, k=30))
    out = base + [changed(rng, t, rng.randrange(1, 6)) for t in base for _ in range(3)]
    # a chain of copies of copies, texts that only share a passage, and short ones
    for _ in range(25):
        out.append(changed(rng, out[-1] if len(out[-1].split()) > 90 else " ".join(rng.choices(WORDS, k=120)), 2))
    out += [passage + " " + " ".join(rng.choices(WORDS, k=rng.randrange(2, 40))) for _ in range(30)]
    return [*out, None, "", " \t", "one", "ONE", "one two", "a b c d e", "A b  c d e", "a b c d e f"]


@pytest.mark.parametrize("hot", [1, 4, 256])
def test_copy_groups(spark, hot):
    rng = random.Random(3)
    rows = [*enumerate(texts(rng)), (None, "one"), (None, "nobody else"), (7, "the same id")]
    out = near_copies.copy_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), hot=hot)
    assert sorted(((r.doc_id, r.component_id) for r in out.collect()), key=repr) == expected(rows)
    assert near_copies.copy_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_copy_groups_on_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    out = near_copies.copy_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(((r.doc_id, r.component_id) for r in out.collect()), key=repr) == expected(rows)


def test_stage_drops_a_copy_with_a_few_words_changed(spark):
    """Some bits of the fingerprint differ, more than two."""
    rng = random.Random(8)
    text = " ".join(rng.choices(WORDS, k=150))
    words = text.split()
    for k in (30, 75, 120):
        words[k] = "other"
    docs = spark.createDataFrame([(1, text), (2, " ".join(words)), (3, " ".join(rng.choices(WORDS, k=150)))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]
