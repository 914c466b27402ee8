"""Near copies by SimHash and an exact Jaccard join: all texts of which four fifths of the word shingles are shared.

A text is the set of the 64-bit hashes of its shingles. Fingerprints of these sets are linked first, within two bits, and
each link is measured exactly; that finds most of a large group of copies in work that grows only with its texts. Near
copies differ in some ten bits too, for which fingerprints are not selective, so a join completes them and leaves out
what the fingerprints have linked.

For the join all sets are sorted in one order; two sets with a
similarity of 0.8 or more then share an element among the first n - ceil(0.8 n) + 1 of each, so these prefixes are
indexed and texts that meet on an element are measured exactly. Any order is right; as shingles that are frequent
in a sample come last, they are seldom in a prefix and few texts meet on them. A sample of a fixed size sees less of
a larger table, so elements on which many texts still meet are counted over all prefixes and come last as well, the most
frequent at the very end. Nothing that two sets share lies before the first element that they share, so its places in
both sets rule out most of the pairs that meet by chance.

Keys on which the same texts meet count once. Where few meet all pairs are measured, a bounded number for each text and
key. Where more meet, which are large groups of near copies as a rule, what these pairs and the fingerprints have
connected is not measured again; one of the texts is measured against all the others a few times, and pairs of texts
that this leaves in different groups are all measured.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import bloom
from quaystone.llm._common import fresh_name, lookup, stash
from quaystone.llm.components import connected_components
from quaystone.llm.simhash import LOWER, SEED, of_hashes, signed
from quaystone.llm.simhash import links as print_links

#: Texts in the sample that finds frequent shingles, how often these occur in it, and how many are kept at most.
SAMPLE, OFTEN, MOST = 8192, 4, 1 << 16
#: Passes over keys on which many texts meet, before all that is left is paired.
ROUNDS = 4
#: An element on which more sets meet than this comes last, and how often prefixes are made again for that.
MEETING, PASSES = 16, 2
#: What is known of each set.
SET = ["sid", "n", "prefix", "parity", "fp", "tid"]


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``size`` words; of the whole text where it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: 1 - size]
    spans = zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, len(starts)).view(np.int64))


def _among(s: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """Which of s are in the sorted elements, in time that hardly grows with their number."""
    if not len(elements):
        return np.zeros(len(s), bool)
    return elements[np.minimum(np.searchsorted(elements, s), len(elements) - 1)] == s


def _sets(size: int):
    @F.pandas_udf("array<bigint>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, size) for t in texts])

    return sets


def _prefixes(size: int, late: np.ndarray):
    """sid (hash of the set), n (its size), prefix (its first elements in the common order), parity and fp (fingerprint) of each text.

    The elements of ``late`` come last, in its order; all others come first, by their value.
    """
    ranks = np.argsort(late)
    elements = late[ranks]

    @F.pandas_udf("sid bigint, n int, prefix array<bigint>, parity binary, fp bigint")
    def prefixes(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            s = shingles(t, size)
            n = len(s)
            last = _among(s, elements)
            ends = late[np.sort(ranks[np.searchsorted(elements, s[last])])]
            keep = n - (4 * n + 4) // 5 + 1 if n else 0
            out.append((int(np.array([xxhash.xxh64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0]), n, np.concatenate((s[~last], ends))[:keep], _parity(s), signed(of_hashes(s))))
        return pd.DataFrame(out, columns=["sid", "n", "prefix", "parity", "fp"])

    return prefixes


def _parity(s: np.ndarray) -> bytes:
    """How many elements fall on each of as many places as the set has elements or up to twice as many (a power of two, 64 at
    least), as parities; every element that only one of two sets has flips one."""
    width = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits((np.bincount((s & (width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """On how many places two sets differ; the wider parities are folded to the width of the others."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


@F.pandas_udf(T.IntegerType())
def _flips(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_differ(x, y) for x, y in zip(a, b, strict=True)], dtype=np.int32)


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether sets of distinct numbers share four fifths of their union or more, in whole numbers."""
    out = []
    for x, y in zip(a, b, strict=True):
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(5 * both >= 4 * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


def _often(elements: DataFrame, least: int, most: int) -> np.ndarray:
    """The most frequent of the elements (key) that occur so often at least, as an array of element and count."""
    top = elements.groupBy("key").count().where(F.col("count") >= least).orderBy(F.desc("count"), "key").limit(most)
    return np.array([tuple(r) for r in top.collect()], np.int64).reshape(-1, 2)


def _last(found: np.ndarray, late: np.ndarray) -> np.ndarray:
    """late with those of the found elements that it lacks before it, the rarest first; the order of all others stays."""
    found = found[~np.isin(found[:, 0], late)]
    return np.concatenate((found[np.lexsort((found[:, 0], found[:, 1])), 0], late))


def _frequent(texts: DataFrame, size: int, n: int) -> np.ndarray:
    share = max(1, n // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(share)) == 0).select(F.explode(_sets(size)("text")).alias("key"))
    return _last(_often(some, OFTEN, MOST), np.zeros(0, np.int64))


def _rows(texts: DataFrame, size: int, late: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """All rows (row, doc_id, tid, sid, n, prefix, parity, fp), and one of them for each set.

    Rows whose set comes before are few as a rule, so that the prefixes of all others are not shuffled for them.
    """
    rows = texts.select("doc_id", "tid", _prefixes(size, late)("text").alias("s")).select("doc_id", "tid", "s.*")
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()))
    first = rows.groupBy("sid").agg(F.min("row").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = stash(lookup(rows.select("sid", "row"), stash(first), "sid", "copies").where("row <> first").select("row"))
    return rows, rows.join(again, "row", "left_anti").select(*SET)


def _holds(elements: np.ndarray):
    elements = np.sort(elements)

    @F.pandas_udf("boolean")
    def holds(prefixes: pd.Series) -> pd.Series:
        return pd.Series([bool(_among(p, elements).any()) for p in prefixes], dtype=bool)

    return holds


def _rarer(texts: DataFrame, sets: DataFrame, size: int, late: np.ndarray) -> DataFrame:
    """sets with prefixes made of elements that few sets have in theirs, as far as MOST elements for each pass reach.

    Only sets whose prefix holds an element that now comes last are made again; the prefixes of all others stay as they
    are in the new order. A filter finds the texts of the former where they lie, so that the other texts are not shuffled.
    """
    for _ in range(PASSES):
        n = len(late)
        late = _last(_often(sets.select(F.explode("prefix").alias("key")), MEETING + 1, MOST + n), late)
        if len(late) == n:
            break
        moved = _holds(late[: len(late) - n])("prefix")
        ids = stash(sets.where(moved).select("tid"))
        held = bloom.thin(texts.select("tid", "text"), ids, "tid", ids.count())
        # an inner join, as a semi-join would be moved before the filter
        held = held.join(ids, "tid").groupBy("tid").agg(F.first("text").alias("text"))
        again = stash(held.select("tid", _prefixes(size, late)("text").alias("s")).select("tid", "s.*").select(*SET))
        sets = sets.where(~moved).unionByName(again)
    return sets


def _reach(n: Column, at: Column, m: Column, other_at: Column) -> Column:
    """Whether sets of n and m elements can share four fifths if the first element that they share has these places in them."""
    return F.least(n - at, m - other_at) * 9 >= (n + m) * 4


def _met(sets: DataFrame) -> DataFrame:
    """key, sid, at, c: keys on which c > 1 sets meet, and their places in the sets.

    Of all keys that have the same sets the first in the common order stays: all of the sets have it before the others.
    """
    on = W.partitionBy("key")
    keys = sets.select("sid", F.posexplode("prefix").alias("at", "key")).repartition("key")
    keys = keys.withColumn("c", F.count("*").over(on)).withColumn("mark", F.expr("bit_xor(xxhash64(sid, 7)) OVER (PARTITION BY key)"))
    keys = stash(keys.withColumn("place", F.sum("at").over(on)).where("c > 1"))
    one = keys.groupBy("c", "mark").agg(F.min(F.struct("place", "key")).alias("one")).select("one.key")
    return stash(keys.join(one, "key", "left_semi").drop("mark", "place"))


def _near_prints(sets: DataFrame) -> DataFrame:
    """Pairs a, b of sets (sid, fp) that connect all whose fingerprints are equal or linked by SimHash: one for each set and link."""
    prints = stash(sets.groupBy("fp").agg(F.min("sid").alias("least"), F.count("*").alias("copies")))
    same = lookup(sets, prints.where("copies > 1"), "fp", "copies").where("sid <> least").select(F.col("sid").alias("a"), F.col("least").alias("b"))
    one, two = (prints.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_least")) for x in "ab")
    linked = print_links(prints.select("fp")).join(one, "a").join(two, "b")
    return same.unionByName(linked.select(F.col("a_least").alias("a"), F.col("b_least").alias("b")))


def links(texts: DataFrame, sets: DataFrame, size: int = 5, hot: int = MEETING) -> DataFrame:
    """Links a < b that connect exactly the sets (sid, n, prefix, tid) with similarity 0.8 or more, directly or by way of others. Sets have a parity and fp too.

    ``texts`` has tid and text, each tid once or more.
    """
    known = stash(sets.drop("prefix"))
    names, marks = known.select("sid", "tid"), known.select("sid", "n", "parity")

    def near(pairs: DataFrame) -> DataFrame:
        """Sets that share four fifths differ in a ninth of both sizes at most. Parities rule out most pairs that differ in more;
        only the sets of those that are left are made again from their texts, each once."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        one, two = (marks.select(F.col("sid").alias(x), F.col("parity").alias(f"{x}_parity"), F.col("n").alias(f"{x}_n")) for x in "ab")
        pairs = stash(pairs.join(one, "a").join(two, "b").where(_flips("a_parity", "b_parity") * 9 <= F.col("a_n") + F.col("b_n")).select("a", "b"))
        if not pairs.head(1):
            return pairs
        ids = names.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi")
        ids = stash(ids)
        held = texts.join(ids.select("tid"), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text")).join(ids, "tid")
        held = stash(held.select("sid", _sets(size)("text").alias("set")))
        left = held.select(F.col("sid").alias("a"), F.col("set").alias("x"))
        right = held.select(F.col("sid").alias("b"), F.col("set").alias("y"))
        return stash(pairs.join(left, "a").join(right, "b").where(_similar("x", "y")).select("a", "b"))

    def grouped(pairs: DataFrame) -> DataFrame:
        """sid, n, part: the sets that pairs connect, which are not measured again."""
        parts = connected_components(pairs).select(F.col("node").alias("sid"), F.col("component").alias("part"))
        return known.select("sid", "n").join(parts, "sid", "left").select("sid", "n", F.coalesce("part", "sid").alias("part"))

    def other(rows: DataFrame) -> DataFrame:
        return rows.select("key", F.col("sid").alias("b"), F.col("n").alias("m"), *(F.col(c).alias(f"other_{c}") for c in rows.columns if c in ("at", "part")))

    by_print = near(_near_prints(known.select("sid", "fp")))
    met = _met(sets)
    reach = _reach(*map(F.col, ("n", "at", "m", "other_at")))

    cold = stash(met.where(F.col("c") <= hot).join(grouped(by_print), "sid").select("key", "sid", "n", "at", "part"))
    first = cold.select("key", F.col("sid").alias("a"), "n", "at", "part")
    pairs = first.join(other(cold), "key").where((F.col("a") < F.col("b")) & (F.col("part") != F.col("other_part")) & reach)
    found = by_print.unionByName(near(pairs))
    rows = met.where(F.col("c") > hot)
    if not rows.head(1):
        return found
    # label: the set that a set was linked to in this key; null as long as there is none
    rows = stash(rows.join(grouped(found), "sid").select("key", "sid", "n", "at", "part", F.lit(None).cast("bigint").alias("label")))
    for _ in range(ROUNDS):
        centres = rows.where("label IS NULL").groupBy("key").agg(F.min_by(F.struct("sid", "n", "at", "part"), F.struct(F.xxhash64("sid", "key"), "sid")).alias("one"))
        centres = stash(centres.select("key", F.col("one.sid").alias("a"), F.col("one.n").alias("m"), F.col("one.at").alias("other_at"), F.col("one.part").alias("own")))
        if not centres.head(1):
            break
        pairs = rows.where("label IS NULL").join(centres, "key").where(F.col("sid") != F.col("a"))
        linked = near(pairs.where((F.col("part") != F.col("own")) & reach).select("a", F.col("sid").alias("b")))
        found = found.unionByName(linked)
        both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        named = centres.join(both.distinct(), "a").select("key", F.col("b").alias("sid"), F.col("a").alias("_new"))
        named = named.unionByName(rows.join(centres, "key").where("part = own").select("key", "sid", F.col("a").alias("_new"))).distinct()
        rows = stash(rows.join(named, ["key", "sid"], "left").select("key", "sid", "n", "at", "part", F.coalesce("label", "_new").alias("label")))
    # what is outside of a key's largest group is measured against all but its own group; groups that have met elsewhere are one
    rows = stash(rows.select("key", "sid", "at").join(grouped(found), "sid"))
    sizes = rows.groupBy("key", "part").count().groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("large"))
    outside = rows.join(sizes, "key").where("part <> large").select("key", F.col("sid").alias("a"), "n", "at", "part")
    rest = outside.join(other(rows), "key").where((F.col("part") != F.col("other_part")) & reach)
    return found.unionByName(near(rest))


def _groups(docs: DataFrame, id_col: str, text_col: str, size: int, hot: int) -> DataFrame:
    """doc_id, tid, and first of the group (struct of none, doc_id, tid: null ids last)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("text"))
    late = _frequent(texts, size, docs.count())
    rows, sets = _rows(texts, size, late)
    parts = connected_components(links(texts, _rarer(texts, sets, size, late), size, hot))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("least")
    sets = rows.groupBy("sid").agg(least, F.count("*").alias("copies"))
    named = sets.join(parts.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", "copies", F.coalesce("component", "sid").alias("component"))
    named = stash(named)
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    groups = stash(named.join(first, "component").select("sid", "first", "copies"))
    return lookup(rows.select("doc_id", "tid", "sid"), groups, "sid", "copies").select("doc_id", "tid", "first")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, hot: int = MEETING) -> DataFrame:
    """One row for each row of docs: doc_id, tid (hash of the text), component_id.

    Texts are linked if the Jaccard similarity of their sets of ``size``-word shingles (ASCII case and white
    space aside) is 0.8 or more; component_id is the smallest doc_id reachable over links. A text with fewer
    words is one shingle; texts that are null, empty or without words are one group. Rows with a null id take
    part and carry the id of their group (null if no member has one). Other columns are ignored. No rows give
    no rows. Shingles and sets are told apart by 64-bit hashes.
    """
    return _groups(docs, id_col, text_col, size, hot).select("doc_id", "tid", F.col("first.doc_id").alias("component_id"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, hot: int = MEETING) -> DataFrame:
    """docs with one row of each group of copies: the one with the smallest id, a null id last; of rows that share it, the
    one whose text has the smallest hash, and of full repeats any one. All columns stay, whatever their names."""
    rows = _groups(docs, id_col, text_col, size, hot).withColumn("stays", F.expr("first.doc_id <=> doc_id AND first.tid = tid"))
    name, mark, own = (fresh_name(docs, c) for c in ("judged_id", "judged_text", "text_hash"))
    judged = rows.groupBy(F.col("doc_id").alias(name), F.col("tid").alias(mark)).agg(F.first("stays").alias("stays"), F.count("*").alias("times"))
    # rows that go or are repeated are few as a rule, so that the texts of all others are not shuffled for them
    some = stash(judged.where("NOT stays OR times > 1").select(name, mark, "stays"))
    held = docs.withColumn(own, F.xxhash64(text_col))
    same = held[id_col].eqNullSafe(F.col(name)) & (held[own] == F.col(mark))
    once = held.join(some.where("stays"), same, "left_semi").dropDuplicates([id_col, own])
    return held.join(some, same, "left_anti").unionByName(once).select(*docs.columns)
