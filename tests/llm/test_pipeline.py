"""Each stage of the pipeline against a version in plain Python, on what the stage before it kept."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quaystone.llm import packing, queries, toxicity

from test_batches import expected_shares, padding
from test_dedup import distance, edits, find
from test_near_copies import expected as near_groups

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, row_number int, gone int, first int"


def fixture_rows(spark, data):
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(110).collect()]
    rows = [r for r in rows if len(r[1] or "") < 9000]
    rows += [(None, "nobody else has this text, you idiot", "en", None, 3), (None, None, None, "src1", None), (5, "", "en", "src2", 0), (rows[3][0], rows[3][1], "de", "src0", 9), (rows[3][0], "another text of the same id", "de", "src0", 9)]
    return [(*r, "x", 1, 2, 3) for r in rows]


def plain_tokens(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def plain_lines(rows):
    """Rows after line deduplication: all pairs of lines, with a count of letters to rule most of them out."""
    places = [((d is None, d or 0, r), n, x.strip(" \t\r\x0b\x0c")) for r, (d, t, *_) in enumerate(rows) if t is not None for n, x in enumerate(t.split("\n"))]
    places = sorted(p for p in places if p[2])
    lines = sorted({p[2] for p in places}, key=len)
    bags, parent = [Counter(x) for x in lines], {x: x for x in lines}
    for j, b in enumerate(lines):
        for i in range(j - 1, -1, -1):
            a = lines[i]
            if len(b) - len(a) > 8:
                break
            most = edits(a, b)
            if len(a) >= 9 and len(b) - len(a) <= most and sum(((bags[i] - bags[j]) | (bags[j] - bags[i])).values()) <= 2 * most and distance(a, b) <= most:
                parent[find(parent, b)] = find(parent, a)
    seen, gone = set(), {}
    for (_, _, r), n, x in places:
        if (root := find(parent, x)) in seen:
            gone.setdefault(r, set()).add(n)
        seen.add(root)
    out = []
    for r, row in enumerate(rows):
        text = row[1]
        if r in gone:
            text = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[r])
            if not re.search(r"[^\x20\x09-\x0d]", text):
                continue
        out.append((row[0], text, *row[2:4], len(text) if text is not None else row[4], *row[5:]))
    return out


def plain_copies(rows):
    groups, out, taken = near_groups_in_order(rows), [], set()
    for row, group in sorted(zip(rows, groups, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)):  # ids that repeat here have different texts in different groups
        if group not in taken:
            out.append(row)
        taken.add(group)
    return out


def near_groups_in_order(rows):
    """A group number for each row: the brute-force grouping, with row numbers for ids."""
    named = dict(near_groups([(i, r[1]) for i, r in enumerate(rows)]))
    return [named[i] for i in range(len(rows))]


def domain(source):
    return "(none)" if source is None else "web" if source[-1] in "01234" else "books" if source[-1] in "567" else "news"


def plain_mix(rows):
    leaves = {}
    for r in rows:
        leaves.setdefault((domain(r[3]), r[2] or "(none)", r[3] or "(none)"), []).append(r)
    caps = {k: sum(plain_tokens(r[1]) for r in v) for k, v in leaves.items()}
    given = expected_shares(caps, queries.MIX_WEIGHTS, sum(caps.values()) * 9 // 10)
    out = []
    for leaf, group in leaves.items():
        passes, rest = divmod(given[leaf], caps[leaf]) if caps[leaf] else (0, given[leaf])
        run = 0
        for r in sorted(group, key=lambda r: (hashlib.md5(f"mix:{passes}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, plain_tokens(r[1]))):
            run += plain_tokens(r[1])
            if passes + (run <= rest):
                out.append(r)
    return out


def by_repr(rows):
    return sorted(map(tuple, rows), key=repr)


def test_stages_equal_plain_versions(spark, data, tmp_path):
    rows = fixture_rows(spark, data)
    docs = spark.createDataFrame(rows, COLUMNS).coalesce(1)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]

    def step(name, docs):
        out = stages[name](spark, docs, data)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet").where(~queries.held_out(5, 0)))
    rows = [r for r in rows if model.score(r[1]) < corpus_pipeline.TOXIC]
    docs = step("toxicity", docs)
    assert by_repr(docs.collect()) == by_repr(rows)
    for name, plain in (("line_dedup", plain_lines), ("simhash", plain_copies), ("mixing", plain_mix)):
        expected = plain([tuple(r) for r in docs.collect()])
        docs = step(name, docs)
        assert by_repr(docs.collect()) == by_repr(expected), name
        assert 0 < len(expected) <= len(rows)
    rows = docs.collect()
    out = step("packing", docs).collect()
    histogram = Counter(plain_tokens(r.text) for r in rows)
    assert Counter(r.n_tokens for r in out) == histogram
    assert sum(r.padding for r in out) == padding(histogram.items(), packing.best_boundaries(list(histogram.items()), 16))
    batches = {}
    for r in out:
        batches.setdefault(r.batch, []).append(r)
    assert all(len(b) == 1 or sum(r.bucket_max for r in b) <= 65_536 for b in batches.values())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, data, name):
    docs = spark.createDataFrame([], COLUMNS)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, data)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_run_leaves_only_its_result(spark, data, tmp_path, monkeypatch):
    import os

    from quaystone.llm import _common

    for module in (_common, corpus_pipeline):
        monkeypatch.setattr(module, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    out = corpus_pipeline.run(spark, data)
    left = [os.listdir(f"{tmp_path}/shared/{d}") for d in os.listdir(f"{tmp_path}/shared")]
    assert out.count() > 50 and left == [["4-packing"]]
    assert out.join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "left_anti").count() == 0


def test_a_run_folder_goes(spark, tmp_path):
    from quaystone.llm import _common

    with _common.run_folder(spark) as path:
        assert _common.stash(spark.range(5)).where(F.col("id") > 2).count() == 2
        assert path in _common.stash(spark.range(1)).inputFiles()[0]
    assert not (tmp_path / path.removeprefix("file://")).exists()
