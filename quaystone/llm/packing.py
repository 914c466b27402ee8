"""Packing by optimal length buckets.

The corpus's length histogram is global; dynamic programming over it chooses the bucket boundaries for which
padding every document to its bucket's boundary costs least. Inside a bucket, documents form batches whose
padded tokens stay within a budget.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaystone.llm._common import n_words


def best_boundaries(histogram: Sequence[tuple[int, int]], buckets: int) -> list[int]:
    """Upper boundaries (inclusive) of at most ``buckets`` buckets with the least total padding.

    For bucket (i, j] the padding is x_j * (C_j - C_i) - (S_j - S_i), with C the documents and S the tokens
    up to a length; for a fixed i that is a line in x_j, and slopes fall with i, so each layer is one pass over
    the lower hull of lines. Of equally good choices the one with the smaller boundaries from the last
    bucket backwards is taken.
    """
    points = sorted((x, c) for x, c in histogram if c > 0)
    n = len(points)
    if not n:
        return []
    xs = [x for x, _ in points]
    count, tokens = [0], [0]
    for x, c in points:
        count.append(count[-1] + c)
        tokens.append(tokens[-1] + x * c)
    best = [0] + [None] * n
    came: list[list[int]] = []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        at, layer, back = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                line = (-count[i], best[i] + tokens[i], i)
                while len(hull) - at >= 2 and _useless(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            if at < len(hull):
                x = xs[j - 1]
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                    at += 1
                layer[j] = hull[at][0] * x + hull[at][1] + x * count[j] - tokens[j]
                back[j] = hull[at][2]
        came.append(back)
        best = layer
    out, j = [], n
    for back in reversed(came):
        out.append(xs[j - 1])
        j = back[j]
    return out[::-1]


def _useless(a: tuple, b: tuple, c: tuple) -> bool:
    """b is nowhere below both a and c (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 16,
    token_budget: int = 65_536,
    slice_rows: int = 8_192,
    tokens: Column | None = None,
) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, bucket (from 0), bucket_max, batch, padding.

    Tokens are runs without white space unless ``tokens`` says otherwise; null and empty texts have 0. A batch
    holds ``token_budget`` // bucket_max rows at most, one at least, so a document longer than the budget is
    alone in its batch. A bucket of many rows is cut by a hash of id and text into slices of about ``slice_rows``;
    batches form inside slices, so no task holds a whole bucket, at the cost of one partly filled batch in each.
    ``batch`` reads bucket-slice-number. Rows with null or equal ids are packed one by one, apart from one another if
    their texts differ; ties are in any order. Other columns are ignored. No rows give no rows.

    The histogram that reaches the driver has a row for each length that occurs: not more than the square root of twice
    the corpus's tokens, and as a rule some ten thousands.
    """
    mark = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.coalesce(text_col, F.lit("")))))
    hashed = F.conv(F.substring(mark, 1, 8), 16, 10).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), (n_words(F.col(text_col)) if tokens is None else tokens).alias("n_tokens"), hashed.alias("hashed"))
    histogram = rows.groupBy(F.col("n_tokens").alias("x")).count().collect()
    bounds = best_boundaries([(r["x"], r["count"]) for r in histogram], buckets)
    if not bounds:
        empty = {"bucket": F.lit(0), "bucket_max": F.lit(0).cast("bigint"), "batch": F.lit(""), "padding": F.lit(0).cast("bigint")}
        return rows.drop("hashed").withColumns(empty)
    filled = [0] * len(bounds)
    for r in histogram:
        filled[bisect_left(bounds, r["x"])] += r["count"]
    top = F.lit(bounds)
    bucket = F.size(F.filter(top, lambda b: b < F.col("n_tokens")))
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_max", F.get(top, F.col("bucket")).cast("bigint"))
    slices = F.get(F.lit([max(1, -(-c // slice_rows)) for c in filled]), F.col("bucket"))
    rows = rows.withColumn("slice", F.pmod("hashed", slices).cast("int"))
    place = F.row_number().over(W.partitionBy("bucket", "slice").orderBy("doc_id", "n_tokens")) - 1
    room = F.greatest(F.lit(1), (F.lit(token_budget) / F.greatest("bucket_max", F.lit(1))).cast("int"))
    batch = F.concat_ws("-", F.col("bucket").cast("string"), F.col("slice").cast("string"), (place / room).cast("int").cast("string"))
    return rows.withColumn("batch", batch).select("doc_id", "n_tokens", "bucket", "bucket_max", "batch", (F.col("bucket_max") - F.col("n_tokens")).alias("padding"))
