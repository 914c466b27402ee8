"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking.

Coarse centroids and the sub-quantisers' codebooks are fitted on a bounded sample; the number of lists follows
the square root of the rows. A query's distance to the nearest of some sampled rows bounds how far its nearest rows
can be, and so which lists can hold any. How many of these it has to read, nearest first, is measured on the sample,
apart for queries with few and with many such lists: tight and wide parts of one table do not share a number.

Every vector is indexed: it goes to the list of its nearest centroid, and its residual is written as one byte
for each subspace. Neighbouring lists share a block of bounded size, a list that is larger is cut into several.
A query is sent once to each block that holds one of its lists, whatever the number of lists there; asymmetric
distance tables rank the codes of its lists, the best are measured exactly, and the nearest over all blocks remain.
A code is off by the length of what it leaves out, so every vector that could still be among the nearest is measured:
in the lists that are read, the codes lose nothing, whatever the spread of the vectors.

Equal vectors of a block count as one candidate, so copies cannot crowd out others. Vectors are taken from their mean,
so tables far from the origin lose no digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaystone.llm._common import stash

CODES = 256
#: Queries that a scan ranks at a time.
STEP = 64
#: Sampled rows that bound a query's distance to its nearest, and sampled queries by which the lists to read are measured.
ANCHORS, MEASURED = 4096, 1024
#: Classes of queries, by the power of two of the lists that can hold their nearest, and the fewest queries that tell a class' share.
CLASSES, FEWEST = 16, 32


@dataclass
class Index:
    """centroids: lists x dims, neighbours beside each other. books: subspaces x codes x dims of a subspace (padded
    with zeros). probes: lists that a query reads at least, as far as they can hold any of its nearest. origin: the mean, from
    which all else is taken. anchors: some rows. shares: the part of the lists that can hold any of its nearest which a
    query reads, by class."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int
    origin: np.ndarray
    anchors: np.ndarray
    shares: np.ndarray

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    def split(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centroids, less each vector's own length."""
        return (self.centroids**2).sum(1) - 2 * x @ self.centroids.T

    def lists_in_reach(self, x: np.ndarray, k: int, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the lists in the order of their distances, and how many there are, first of all, that can hold any of
        its k nearest rows: the k + 1 nearest anchors, one of which may be the row itself, are rows too. An empty list has a
        negative radius."""
        own = (x**2).sum(1)[:, None]
        far = np.sqrt(np.maximum(self.distances(x) + own, 0))
        if len(self.anchors) > k:
            near = own + (self.anchors**2).sum(1) - 2 * x @ self.anchors.T
            bound = np.sqrt(np.maximum(np.partition(near, k, axis=1)[:, k], 0)) + 1e-6 * np.sqrt(own[:, 0] + (self.anchors**2).sum(1).max())
        else:
            bound = np.full(len(x), np.inf)
        reach = (far - radii <= bound[:, None]) & (radii >= 0)
        return np.argsort(np.where(reach, far, np.inf), axis=1, kind="stable"), reach.sum(1)

    def reads(self, n: np.ndarray, probes: int) -> np.ndarray:
        """How many of n lists in reach a query reads."""
        return np.minimum(n, np.maximum(probes, np.ceil(self.shares[_class(n)] * n).astype(np.int64)))

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        parts = self.split(residuals)
        out = np.empty(parts.shape[:2], np.uint8)
        for j, book in enumerate(self.books):
            out[:, j] = ((book**2).sum(1) - 2 * parts[:, j] @ book.T).argmin(1)
        return out

    def tables(self, residuals: np.ndarray) -> np.ndarray:
        """Asymmetric distances: residuals x subspaces x codes."""
        parts = self.split(residuals)
        squares = (self.books**2).sum(2)
        return (parts**2).sum(2)[:, :, None] + squares[None] - 2 * np.einsum("qmw,mcw->qmc", parts, self.books, optimize=True)


def _class(n: np.ndarray) -> np.ndarray:
    return np.minimum(CLASSES - 1, np.log2(np.maximum(n, 1)).astype(np.int64))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    points = np.unique(x, axis=0)
    k = min(k, len(points))
    centers = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)
        order = np.argsort(near, kind="stable")
        filled, starts = np.unique(near[order], return_index=True)
        centers[filled] = np.add.reduceat(x[order], starts, axis=0) / np.diff(np.append(starts, len(x)))[:, None]
    return centers


def usable(vec: Column) -> Column:
    """Not null or empty, all components finite, at least one not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _clean(df: DataFrame, name: str, id_col: str, vec_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("bigint").alias(name), F.col(vec_col).alias("v"))
    return rows.where(F.col(name).isNotNull() & usable(F.col("v")))


def fit(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, subspaces: int = 16, sample_rows: int = 16_384, recall: float = 0.95, seed: int = 7
) -> dict[int, Index]:
    """An index for each length that usable vectors have (tables have one, or very few).

    Each is fitted on the ``sample_rows`` vectors whose hashed id is smallest (that many reach the driver). There are
    four times the square root of the rows in ``lists``, if none are given, and a sixteenth of the sample at most; a
    query reads as many of those in its reach as hold the ``recall`` of the ten nearest rows of the sample's queries of its
    class, and all where they are too few to tell. No usable vector: no index.
    """
    rows = _clean(vectors, "vec_id", id_col, vec_col)
    counts = {r["n"]: r["count"] for r in rows.groupBy(F.size("v").alias("n")).count().collect()}
    return {dims: _fit(rows.where(F.size("v") == dims), n, lists, subspaces, sample_rows, recall, seed) for dims, n in sorted(counts.items())}


def _fit(rows: DataFrame, n: int, lists: int | None, subspaces: int, sample_rows: int, recall: float, seed: int) -> Index:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec_id", "v").toPandas()
    # of rows that share an id one, as the nearest are told apart by their ids
    x = np.array(sample.drop_duplicates("vec_id")["v"].tolist(), np.float64)
    origin = x.mean(0)
    x -= origin
    rng = np.random.default_rng(seed)
    lists = lists or max(16, min(math.ceil(4 * math.sqrt(n)), len(x) // 16))
    centroids = _kmeans(x, lists, rng).astype(np.float64)
    # along the direction in which they differ most, so that near lists get into one block
    centroids = centroids[np.argsort(centroids @ np.linalg.svd(centroids - centroids.mean(0), full_matrices=False)[2][0], kind="stable")]
    m = min(subspaces, x.shape[1])
    index = Index(centroids, np.zeros((m, CODES, math.ceil(x.shape[1] / m))), len(centroids), origin, x[:ANCHORS], np.ones(CLASSES))
    distances = index.distances(x)
    nearest = distances.argmin(1)
    parts = index.split(x - centroids[nearest])
    for j in range(m):
        book = _kmeans(parts[:, j], CODES, rng)
        index.books[j, : len(book)] = book
        index.books[j, len(book) :] = book[0]
    radii = np.full(len(centroids), -1.0)
    np.maximum.at(radii, nearest, np.sqrt(((x - centroids[nearest]) ** 2).sum(1)))
    some = min(MEASURED, len(x))
    exact = (x**2).sum(1) - 2 * x[:some] @ x.T
    exact[np.arange(some), np.arange(some)] = np.inf
    k = min(10, len(x) - 1)
    if k:
        found = np.argpartition(exact, k - 1, axis=1)[:, :k]
        order, reach = index.lists_in_reach(x[:some], k, radii * (1 + 1e-9))
        # the place of each true neighbour's list in the query's order of lists
        place = np.take_along_axis(np.argsort(order, axis=1), nearest[found], 1)
        flat = np.sort(place.ravel())
        index.probes = int(flat[min(len(flat) - 1, math.ceil(recall * len(flat)))]) + 1
        for c in range(CLASSES):
            of = _class(reach) == c
            if of.sum() >= FEWEST:
                parts_read = np.sort(((place[of] + 1) / reach[of, None]).ravel())
                index.shares[c] = min(1.0, parts_read[min(len(parts_read) - 1, math.ceil(recall * len(parts_read)))])
    return index


def _bytes(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(x)]


def search(
    vectors: DataFrame,
    queries: DataFrame,
    indexes: dict[int, Index],
    k: int = 10,
    probes: int | None = None,
    rerank: int = 64,
    block_rows: int = 16_384,
    batch_rows: int = 16_384,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, by Euclidean distance in double precision.

    Ties go to the smaller vec_id. A query's own id is no candidate. Only vectors of a query's own length have a
    distance to it. Of rows that share a vec_id the nearest counts; queries that share an id are one query with the
    nearest of what each finds. Vectors that are null, empty, zero, or that hold null or non-finite components take no
    part, nor do null ids, nor lengths that ``indexes`` lacks; a query none of whose candidates are found has no rows.
    Other columns are ignored. No rows give no rows.
    """
    found = vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    for dims, index in indexes.items():
        v, q = (_clean(df, name, id_col, vec_col).where(F.size("v") == dims) for df, name in ((vectors, "vec_id"), (queries, "query_id")))
        found = found.unionByName(_search(v, q, index, k, min(probes, len(index.centroids)) if probes else None, rerank, block_rows, batch_rows))
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(vectors: DataFrame, queries: DataFrame, index: Index, k: int, probes: int | None, rerank: int, block_rows: int, batch_rows: int) -> DataFrame:
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(index)
    # vectors travel as they came: four bytes a component for floats, eight for all else
    single = all(df.schema["v"].dataType.elementType.typeName() == "float" for df in (vectors, queries))
    raw_type = np.dtype("<f4" if single else "<f8")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), np.float64)
                raw, x = _bytes(x.astype(raw_type)), x - ix.origin
                near = ix.distances(x).argmin(1)
                rest = x - ix.centroids[near]
                yield pd.DataFrame({"list": near.astype(np.int32), "vec_id": pdf["vec_id"], "codes": _bytes(ix.encode(rest)), "raw": raw, "away": np.sqrt((rest**2).sum(1))})

    coded = stash(vectors.mapInPandas(encode, "list int, vec_id bigint, codes binary, raw binary, away double"))
    # blocks: neighbouring lists together up to block_rows, a larger list cut into as many blocks as it needs
    sizes = np.zeros(len(index.centroids), np.int64)
    radii = np.full(len(sizes), -1.0)
    for r in coded.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():
        sizes[r["list"]], radii[r["list"]] = r["n"], r["away"] * (1 + 1e-9)
    first, cut, blocks, room = [0] * len(sizes), [1] * len(sizes), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if n > room:
            cut[i] = max(1, -(-n // block_rows))
            blocks, room = blocks + cut[i], 0 if cut[i] > 1 else block_rows
        first[i] = blocks - cut[i]
        room -= min(n, room)
    place = F.get(F.lit(first), F.col("list")) + F.pmod(F.xxhash64("vec_id"), F.get(F.lit(cut), F.col("list"))).cast("int")
    placed = coded.drop("away").withColumn("block", place)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        begin, parts = np.array(first), np.array(cut)
        for pdf in batches:
            out: dict[str, list] = {"block": [], "query_id": [], "lists": [], "q": []}
            if len(pdf):
                x = np.array(pdf["v"].tolist(), np.float64)
                raws, x = _bytes(x.astype(raw_type)), x - ix.origin
                if probes:
                    read, some = np.argsort(ix.distances(x), axis=1, kind="stable"), np.full(len(x), probes)
                else:
                    read, some = ix.lists_in_reach(x, k, radii)
                    some = ix.reads(some, ix.probes)
                for i, raw, row in zip(pdf["query_id"], raws, (np.sort(r[:n]) for r, n in zip(read, some, strict=True)), strict=True):
                    row = row[sizes[row] > 0]
                    # each list with each block that it is cut into, then the lists of one block together
                    of = np.repeat(row, parts[row])
                    at = np.concatenate([begin[c] + np.arange(parts[c]) for c in row]) if len(row) else row
                    order = np.argsort(at, kind="stable")
                    names, starts = np.unique(at[order], return_index=True)
                    for b, lists in zip(names, np.split(of[order], starts[1:]), strict=True):
                        out["block"].append(b)
                        out["query_id"].append(i)
                        out["lists"].append(lists.astype(np.int32).tobytes())
                        out["q"].append(raw)
            yield pd.DataFrame(out)

    asked = stash(queries.mapInPandas(probe, "block int, query_id bigint, lists binary, q binary"))
    counts = {r["block"]: r["count"] for r in asked.groupBy("block").count().collect()}
    batches_ = F.get(F.lit([max(1, -(-counts.get(b, 0) // batch_rows)) for b in range(max(1, blocks))]), F.col("block"))
    left = placed.withColumn("batch", F.explode(F.sequence(F.lit(0), batches_ - 1)))
    right = asked.withColumn("batch", F.pmod(F.xxhash64("query_id"), batches_).cast("int"))

    def scan(vecs: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(vecs) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ix = shared.value
        vecs = vecs.sort_values(["list", "vec_id"], kind="stable")
        ids, raws = vecs["vec_id"].to_numpy(), vecs["raw"].to_numpy()
        # rows that share an id are one of the k, and the query's own are none
        want = (k + 1) * int(vecs["vec_id"].value_counts().iloc[0])
        # copies of one vector: one candidate, with its smallest ids
        members: dict[bytes, list[int]] = {}
        for i, raw in enumerate(raws):
            if len(same := members.setdefault(raw, [])) <= k:
                same.append(i)
        heads = np.array([m[0] for m in members.values()])
        more = {n: m for n, m in enumerate(members.values()) if len(m) > 1}
        lists = vecs["list"].to_numpy()[heads]
        codes = np.frombuffer(b"".join(vecs["codes"].iloc[heads]), np.uint8).reshape(len(heads), -1)
        x = np.frombuffer(b"".join(members), raw_type).reshape(len(heads), -1).astype(np.float64)
        named, starts = np.unique(lists, return_index=True)
        ends = np.append(starts[1:], len(lists))
        asked_ids = asks["query_id"].to_numpy()
        q = np.frombuffer(b"".join(asks["q"]), raw_type).reshape(len(asks), -1).astype(np.float64)
        reads = [np.frombuffer(b, np.int32) for b in asks["lists"]]
        # |q - c - code|^2 = |q|^2 - 2 q.(c + code) + |c + code|^2: the last term belongs to a vector, the middle
        # one is a table of the query by subspace and a product with its list's centroid
        cells = ix.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, : ix.dims]
        coded_as = ix.centroids[lists] + cells
        norms = (coded_as**2).sum(1)
        # what a code leaves out, and what rounding may add
        off = np.sqrt(((x - ix.origin - coded_as) ** 2).sum(1))
        columns = [np.ascontiguousarray(c) for c in codes.T]
        out: list[tuple[int, int, float]] = []
        for begin in range(0, len(q), STEP):
            part = q[begin : begin + STEP]
            moved = part - ix.origin
            tables = np.einsum("qmw,mcw->qmc", ix.split(moved), ix.books, optimize=True)
            to_lists, own = moved @ ix.centroids[named].T, (moved**2).sum(1)
            for a in range(len(part)):
                wanted = np.flatnonzero(np.isin(named, reads[begin + a], assume_unique=True))
                if not len(wanted):
                    continue
                spans = [slice(starts[w], ends[w]) for w in wanted]
                at = np.concatenate([np.arange(s.start, s.stop) for s in spans])
                dot = np.repeat(to_lists[a, wanted], ends[wanted] - starts[wanted])
                table = tables[a]
                for j, column in enumerate(columns):
                    dot += table[j].take(column.take(at))
                if len(at) > max(rerank, want):
                    # the best codes, and all that can be nearer than the nearest of these for certain
                    guess, left_out = norms.take(at) - 2 * dot, off.take(at)
                    guess = np.sqrt(np.maximum(guess + own[a], 0))
                    room = 1e-7 * math.sqrt(own[a] + norms.max())
                    bound = np.partition(guess + left_out, want - 1)[want - 1] + room
                    at = at[(guess - left_out <= bound) | (guess <= np.partition(guess, rerank - 1)[rerank - 1])]
                score = np.sqrt(((x[at] - part[a]) ** 2).sum(1))
                query = int(asked_ids[begin + a])
                # all that tie with the last
                best = np.flatnonzero(score <= np.partition(score, want - 1)[want - 1]) if len(score) > want else np.arange(len(score))
                least: dict[int, float] = {}
                for s, i in sorted((float(score[b]), int(ids[i])) for b in best for i in more.get(int(at[b]), (heads[at[b]],)) if ids[i] != query):
                    least.setdefault(i, s)
                out += [(query, v, s) for v, s in list(least.items())[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["block", "batch"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "query_id bigint, vec_id bigint, score double")
