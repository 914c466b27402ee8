"""Line links that were once left out: shared segments on several levels, short lines."""

import random

import corpus_pipeline
import pytest

from quaystone.llm import line_dedup

from test_dedup import distance


def template_lines(rng):
    """Lines that share a beginning and an end, with characters put in or taken out before, between and behind."""
    out = set()
    for _ in range(70):
        base = "ab" + "same start of it " + "".join(rng.choice("xyz") for _ in range(6)) + " and the same end too" + rng.choice("pqr")
        for _ in range(3):
            line = base
            for _ in range(2):
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice(["", "k"]) + line[at + rng.randrange(2) :]
            out.add(line)
    return sorted(out)


@pytest.mark.parametrize("hot_pairs", [1, 3])
def test_hot_levels_lose_no_link(spark, hot_pairs):
    lines = template_lines(random.Random(4))
    table = spark.createDataFrame(list(enumerate(lines)), "id bigint, line string")
    found = {tuple(r) for r in line_dedup.similar_lines(table, 2, hot_pairs).collect()}
    assert found == {(i, j) for j in range(len(lines)) for i in range(j) if abs(len(lines[i]) - len(lines[j])) <= 2 and distance(lines[i], lines[j]) <= 2}


def test_short_lines_are_grouped(spark):
    """Lines of nine characters and more by edits, shorter ones by equality; no blank line."""
    rows = [(1, "Un.\nAll rights\n\nonce", 0), (2, " Un.\nAll right\n \t", 0), (3, "Um.\nUn.", 0)]
    out = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint"), "")
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 3: "Um."}
