"""Near-duplicate lines by a segment-partition edit join.

The threshold follows the length: two edits, and one more for each 512 characters, eight at most. A line is cut into
threshold + 1 segments. Two lines within the threshold of the shorter one share at least one of its segments, at a
place that the lengths allow; so segments are indexed by line length and number, and each line probes the
substrings at those places (the narrow windows in which the edits before and behind a segment still fit), for every
length that could be its partner's. A substring's hash is a difference of two prefix hashes, so a signature costs the
same whatever its length. Pairs that meet are verified by a banded bit-parallel edit distance.

Signatures travel as blocks of numbers, one for each bucket of keys and block of lines; the task that gets a bucket's
blocks sorts the numbers and keeps the few keys on which lines meet.

Before that, 256 parities of neighbouring characters, of which an edit flips few, rule out most pairs inside
the join. A key on which very many lines meet is not paired at all. Its lines, without the segment that they
share, go through the same join once more among themselves, as the edits must lie in the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import bloom
from quaystone.llm._common import fresh_name, stash
from quaystone.llm.components import connected_components

INDEX, PROBE = 1, 2
LEVELS = 6
#: Tasks over which the probes of a key are dealt on the last level, where all that meets is paired.
SALTS = 16
#: One edit more for so many characters, and the most edits of all (31 is what a band of 64 bits could hold).
PER_EDIT, MOST_EDITS = 512, 8
#: Lines of a key that a task holds together, and pairs that it looks at together.
HOT_LINES, PAIRS = 1 << 14, 1 << 18
#: Characters that pairs and signatures are made of at a time, and ids that a task remembers as seen again.
CHUNK, SIGNED, REMEMBERED = 1 << 20, 1 << 19, 1 << 16
#: Signatures that a bucket of keys holds on average, that are dealt to buckets at a time, that a block holds at most (ten
#: thousand blocks reach a task at once), and that a task holds before it settles them; a key with so many lines that hold no
#: pair yet is not held any longer.
BUCKET, DEALT, BLOCK, HELD, OPEN = 1 << 19, 1 << 18, 1 << 6, 1 << 21, 1 << 10
#: The white space that lines are trimmed of.
BLANK = " \t\r\x0b\x0c"

#: Words of 64 parities by which pairs are ruled out.
PARITIES = 4
BASE = 0x5851F42D4C957F2D


def threshold(length, distance: int):
    """Edits that lines of this length (of the shorter one of two) may differ by; for numbers, arrays and columns."""
    most = max(distance, MOST_EDITS)
    if isinstance(length, Column):
        return F.least(F.lit(most), F.floor(length / PER_EDIT).cast("int") + distance)
    return np.minimum(most, distance + np.asarray(length) // PER_EDIT)


def lines_of(docs: DataFrame, text_col: str, min_chars: int, *others: Column) -> DataFrame:
    """line_no (from 0), id (hash of the trimmed line) and line, for lines of min_chars or more, beside other columns."""
    rows = docs.select(*others, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    # few lines have something to trim, and few are so short that their characters must be counted (four bytes each at most)
    line = F.col("line")
    ends = reduce(or_, [test for c in BLANK for test in (line.endswith(c), line.startswith(c))])
    rows = rows.withColumn("line", F.when(ends, F.trim(line, F.lit(BLANK))).otherwise(line))
    size = F.octet_length("line")
    rows = rows.where((size >= 4 * min_chars) | ((size >= min_chars) & (F.length("line") >= min_chars)))
    return rows.withColumn("id", F.xxhash64("line"))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (from 0) and size of segment i; the last ones are longer by one if the length doesn't divide."""
    base, short = length // parts, parts - length % parts
    return base * i + np.maximum(0, i - short), base + (i >= short)


@cache
def _powers(bits: int) -> tuple[np.ndarray, ...]:
    """Powers of the base and of its inverse, from 0 to 2 ** bits."""
    return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(1 << bits, b, np.uint64)))) for b in (BASE, pow(BASE, -1, 1 << 64)))


class _Hashes:
    """Hashes of all substrings of some texts, from one pass over their characters."""

    def __init__(self, texts: list[str]) -> None:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        powers, self.back = _powers(max(0, len(codes) - 1).bit_length())
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(_mixed(codes + np.uint64(1)) * powers[: len(codes)])))

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.back[start]


def signatures(texts: list[str], groups: np.ndarray, removed: np.ndarray, distance: int) -> tuple[np.ndarray, ...]:
    """All signatures of texts as arrays: text number, key (its two lowest bits are 0), place, size, role, hash of what lies there.

    ``groups`` keeps texts of different groups apart. ``removed`` says how many characters a text has lost on earlier levels,
    as the threshold belongs to the whole line.
    """
    hashes = _Hashes(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    mixed_groups = _mixed(groups.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    most = int(threshold(int((lengths + removed).max()), distance))
    for longer in range(most + 1):
        target = lengths - longer
        edits = np.where(target >= 1, threshold(np.maximum(target + removed, 0), distance), -1)
        for t in np.unique(edits[edits >= longer]).tolist():
            rows = np.flatnonzero(edits == t)
            goal = target[rows]
            for i in range(t + 1):
                start, size = _segment(goal, i, t + 1)
                name = mixed_groups[rows] + _mixed(goal.astype(np.uint64) * np.uint64(64) + np.uint64(i))
                low, high = max(-i, longer - (t - i)), min(i, longer + (t - i))
                for shift in range(low, high + 1):
                    at = start + shift
                    # a line's own segment, unshifted, is both an index entry and the probe for lines of equal length
                    role = PROBE if longer or shift else INDEX | PROBE
                    inside = hashes.of(begins[rows] + at, size)
                    key = _mixed(inside ^ name) & ~np.uint64(3)
                    for column, values in zip(out, (rows, key.view(np.int64), at, size, np.full(len(rows), role, np.int8), inside), strict=True):
                        column.append(values)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def _windows(edits: int) -> int:
    """Signatures of a line all of whose partners are within so many edits."""
    return sum(min(i, longer + edits - i) - max(-i, longer - edits + i) + 1 for longer in range(edits + 1) for i in range(edits + 1))


def signature_count(size: Column, distance: int) -> Column:
    """About how many signatures a line has, by its size in characters or bytes."""
    return F.get(F.array(*[F.lit(_windows(t)) for t in range(max(distance, MOST_EDITS) + 1)]), threshold(size, distance))


def _total(lines: DataFrame, distance: int) -> int:
    return lines.agg(F.sum(signature_count(F.octet_length("line"), distance))).first()[0] or 0


def _chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows in order, cut before they hold more than SIGNED characters; a longer line is alone."""
    ends = np.cumsum(pdf["line"].str.len().to_numpy(np.int64))
    k = 0
    while k < len(pdf):
        end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + SIGNED, side="right")))
        yield pdf.iloc[k:end]
        k = end


def _keys(distance: int, buckets: int, of: list[str]):
    """All signatures, in blocks of those that belong to the same bucket of keys: bucket, key and the columns ``of`` as numbers in a row.

    A key's two lowest bits hold the role. A line that comes again is left out as far as a task remembers it.
    """

    def dealt(held: list[list[np.ndarray]]) -> pd.DataFrame:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        bucket = ((columns[0].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.min_scalar_type(buckets))
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
        starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        spans = list(zip((8 * starts).tolist(), (8 * np.append(starts[1:], len(bucket))).tolist(), strict=True))
        out = {name: [x[a:b] for x in [c[order].tobytes()] for a, b in spans] for name, c in zip(["key", *of], columns, strict=True)}
        return pd.DataFrame({"bucket": bucket[starts].astype(np.int32), **out})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again, held, n = np.zeros(0, np.int64), [], 0
        for pdf in batches:
            ids = _mixed(pdf["id"].to_numpy(np.int64).view(np.uint64) ^ _mixed(pdf["grp"].to_numpy(np.int64).view(np.uint64)) ^ pdf["text"].to_numpy(np.int64).view(np.uint64)).view(np.int64)
            _, first, counts = np.unique(ids, return_index=True, return_counts=True)
            fresh = ~np.isin(ids[first], again)
            again = np.union1d(again, ids[first][(counts > 1) & fresh])[-REMEMBERED:]
            for part in _chunks(pdf.iloc[np.sort(first[fresh])]):
                rows, key, _, _, role, _ = signatures(part["line"].tolist(), part["grp"].to_numpy(np.int64), part["removed"].to_numpy(np.int64), distance)
                held.append([key | role, *(part[c].to_numpy(np.int64)[rows] for c in of)])
                n += len(key)
                if n >= DEALT:
                    yield dealt(held)
                    held, n = [], 0
        if n:
            yield dealt(held)

    return run


def _settled(rows: np.ndarray, known: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's rows (key with role, id, and what else tells lines apart): those that go out, those to hold, and all keys known by now.

    Rows of a known key go out. A key is known once an index entry and a probe of different lines have met on it, or once OPEN
    lines wait on it without a pair, which else might fill the task.
    """
    hit = np.isin(rows[0] >> 2, known)
    out, rows = [rows[:, hit]], rows[:, ~hit]
    order = np.argsort(rows[0] >> 2)
    key = rows[0, order] >> 2
    several = np.zeros(len(key), bool)
    several[1:] = key[1:] == key[:-1]
    several[:-1] |= several[1:]
    held = [rows[:, :0] if last else rows[:, order[~several]]]
    key, rows = key[several], rows[:, order[several]]
    if len(key):
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        met = np.minimum.reduceat(rows[1], starts) < np.maximum.reduceat(rows[1], starts)
        met &= np.bitwise_or.reduceat(rows[0] & 3, starts) == INDEX | PROBE
        known = np.union1d(known, key[starts[met]])
        hit = np.repeat(met, np.diff([*starts, len(key)]))
        out.append(rows[:, hit])
        if not last:
            rest = pd.DataFrame(rows[:, ~hit].T).drop_duplicates().to_numpy().T
            keys, place, waiting = np.unique(rest[0] >> 2, return_inverse=True, return_counts=True)
            known = np.union1d(known, keys[waiting >= OPEN])
            hit = (waiting >= OPEN)[place]
            out.append(rest[:, hit])
            held.append(rest[:, ~hit])
    return np.concatenate(out, axis=1), np.concatenate(held, axis=1), known


def _met(of: list[str]):
    """key, role, id, grp, text of all keys on which lines meet, and of few others, from blocks that come bucket by bucket."""
    nothing = np.zeros((1 + len(of), 0), np.int64)

    def frame(rows: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": rows[0] & -4, "role": (rows[0] & 3).astype(np.int8), "grp": np.int64(0), "text": np.int64(0), **dict(zip(of, rows[1:], strict=True))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, held, n, most, known = None, [nothing], 0, HELD, nothing[0]
        for pdf in batches:
            cuts = [0, *(np.flatnonzero(np.diff(pdf["bucket"])) + 1).tolist(), len(pdf)]
            for k, end in zip(cuts, cuts[1:], strict=False):
                if (b := pdf["bucket"].iloc[k]) != bucket:
                    yield frame(_settled(np.concatenate(held, axis=1), known, True)[0])
                    bucket, held, n, most, known = b, [], 0, HELD, nothing[0]
                held.append(np.stack([np.frombuffer(b"".join(pdf[c].iloc[k:end]), np.int64) for c in ("key", *of)]))
                n += held[-1].shape[1]
                if n > most:
                    out, rest, known = _settled(np.concatenate(held, axis=1), known, False)
                    yield frame(out)
                    held, n, most = [rest], rest.shape[1], max(HELD, 2 * rest.shape[1])
        yield frame(_settled(np.concatenate(held, axis=1), known, True)[0])

    return run


def _cut(distance: int):
    """Lines that meet on hot keys, without the segments that they share there.

    What has been cut out, in whichever order, makes their group from then on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _chunks(pdf):
                lines, hot, removed = part["line"].tolist(), part["hot_key"].to_numpy(np.int64), part["removed"].to_numpy(np.int64)
                groups = part["grp"].to_numpy(np.int64)
                rows, key, at, size, _, inside = signatures(lines, groups, removed, distance)
                hit = np.flatnonzero(key == hot[rows])
                shorter = [lines[r][:a] + "\0" + lines[r][a + s :] for r, a, s in zip(rows[hit].tolist(), at[hit].tolist(), size[hit].tolist(), strict=True)]
                yield pd.DataFrame({"id": part["id"].to_numpy()[rows[hit]], "line": shorter, "grp": groups[rows[hit]] + _mixed(inside[hit]).view(np.int64), "removed": (removed[rows[hit]] + size[hit] - 1).astype(np.int32)})

    return run


def _within(a: pd.Series, b: pd.Series, most: int) -> np.ndarray:
    """Whether the edit distance of each pair is ``most`` or less: banded bit-parallel, all pairs at a time.

    A 64-bit word holds, for each pair, the vertical differences of the band of 2 * most + 1 cells around the
    diagonal; one step of the loop moves all bands down by one character. A common start of ``most`` characters,
    which changes no distance, lets the band begin inside the shortest texts.
    """
    la, lb = a.str.len().to_numpy() + most, b.str.len().to_numpy() + most
    n, width = len(a), int(max(la.max(), lb.max())) + 2 * most + 2
    codes = [np.full((width, n), fill, np.int32) for fill in (-1, -2)]
    for grid, texts in zip(codes, (a, b), strict=True):
        grid[:most] = 0
        for k, t in enumerate(texts):
            grid[most : most + len(t), k] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    sa, sb = codes
    one, top = np.uint64(1), np.uint64(1 << 63)
    vp = np.full(n, ((1 << 64) - 1) << (64 - most - 1) & (1 << 64) - 1, np.uint64)
    vn = np.zeros(n, np.uint64)
    dist = np.full(n, most, np.int64)
    side = np.full(n, 1 << 62, np.uint64)
    for i in range(int(lb.max())):
        x = np.zeros(n, np.uint64)
        for k in range(2 * most + 1):
            if (at := i + most - k) >= 0:
                x |= (sa[at] == sb[i]).astype(np.uint64) << np.uint64(63 - k)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        live, down = i < lb, i < la - most
        dist += live & down & ((d0 & top) == 0)
        flat = live & ~down
        dist += (flat & ((hp & side) != 0)).astype(np.int64) - (flat & ((hn & side) != 0))
        side = np.where(flat, side >> one, side)
        vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
    return (np.abs(la - lb) <= most) & (dist <= most)


def within_threshold(a: pd.Series, b: pd.Series, distance: int) -> np.ndarray:
    """Whether two lines are within the threshold of the shorter one, pair by pair."""
    out = np.zeros(len(a), bool)
    la, lb = a.str.len().to_numpy(np.int64), b.str.len().to_numpy(np.int64)
    edits = threshold(np.minimum(la, lb), distance)
    for most in np.unique(edits).tolist():
        order = np.flatnonzero((edits == most) & (np.abs(la - lb) <= most))
        order = order[np.argsort(la[order], kind="stable")]
        k = 0
        while k < len(order):
            # as many pairs at a time as CHUNK characters hold, one at least
            part = order[k : k + 1024]
            part = part[: max(1, int(np.searchsorted(np.arange(1, len(part) + 1) * la[part], CHUNK)))]
            out[part] = _within(a.iloc[part], b.iloc[part], most)
            k += len(part)
    return out


def _links_of_keys(distance: int):
    """Links a < b of rows that come sorted by key: an index entry and a probe of the same key that are within the threshold.

    Only one key's rows are held at a time; pairs are formed, ruled out by length and parities, and verified in
    blocks, so only links leave the task.
    """

    def links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, n, role = (rows[c].to_numpy(np.int64) for c in ("id", "n", "role"))
        parity = np.stack([rows[f"p{i}"].to_numpy(np.int64).view(np.uint64) for i in range(PARITIES)])
        key = rows["key"].to_numpy(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        left, right, waiting = [], [], 0

        def verified() -> pd.DataFrame:
            i, j = np.concatenate(left), np.concatenate(right)
            edits = threshold(np.minimum(n[i], n[j]), distance)
            keep = (ids[i] != ids[j]) & (np.abs(n[i] - n[j]) <= edits)
            i, j, edits = i[keep], j[keep], edits[keep]
            keep = np.bitwise_count(parity[:, i] ^ parity[:, j]).sum(axis=0) <= 4 * edits
            i, j = i[keep], j[keep]
            pairs = pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "i": i, "j": j}).drop_duplicates(["a", "b"])
            near = within_threshold(rows["line"].iloc[pairs["i"]], rows["line"].iloc[pairs["j"]], distance)
            return pairs.loc[near, ["a", "b"]]

        for begin, end in zip(starts, starts[1:], strict=False):
            at = np.arange(begin, end)
            entries, probes = at[role[begin:end] & INDEX > 0], at[role[begin:end] & PROBE > 0]
            step = max(1, PAIRS // max(1, len(probes)))
            for k in range(0, len(entries), step):
                some = entries[k : k + step]
                left.append(np.repeat(some, len(probes)))
                right.append(np.tile(probes, len(some)))
                waiting += len(some) * len(probes)
                if waiting >= PAIRS:
                    yield verified()
                    left, right, waiting = [], [], 0
        if waiting:
            yield verified()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            if held and (pdf["key"] != held[0]["key"].iloc[0]).any():
                pdf, held = pd.concat([*held, pdf], ignore_index=True), []
                last = pdf["key"] == pdf["key"].iloc[-1]
                yield from links(pdf[~last].reset_index(drop=True))
                pdf = pdf[last].reset_index(drop=True)
            elif not held:
                last = pdf["key"] == pdf["key"].iloc[-1]
                yield from links(pdf[~last].reset_index(drop=True))
                pdf = pdf[last].reset_index(drop=True)
            held.append(pdf)
        if held:
            yield from links(pd.concat(held, ignore_index=True))

    return run


def _meeting(items: DataFrame, distance: int, hot_pairs: int | None, of: list[str], total: int) -> DataFrame:
    """id, grp, text, key, role, hot for keys on which an index entry and a probe of another line meet; one shuffle.

    ``of`` names the columns that tell apart what a line was shortened to, on the first level id alone. There are about
    ``total`` signatures. A key is hot beyond ``hot_pairs`` pairs or HOT_LINES lines, none is without a limit.
    """
    blocks = items.mapInPandas(_keys(distance, max(1, -(-total // BUCKET)), of), ", ".join(["bucket int", "key binary", *(f"{c} binary" for c in of)]))
    met = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_met(of), "key bigint, role tinyint, id bigint, grp bigint, text bigint")
    # few keys are left; only now repeats of a line are taken out and those that meet counted
    met = stash(met.groupBy("key", "id", "grp", "text").agg(F.bit_or("role").alias("role")))
    sizes = met.groupBy("key").agg(F.sum(F.col("role").bitwiseAND(F.lit(INDEX)).cast("bigint")).alias("entries"), F.sum(F.shiftright(F.col("role").cast("int"), 1).cast("bigint")).alias("probes"))
    if hot_pairs is None:
        return met.withColumn("hot", F.lit(False))
    hot = stash(sizes.where((F.col("entries") * F.col("probes") > hot_pairs) | ((F.col("entries") > 0) & (F.col("probes") > HOT_LINES))).select("key", F.lit(True).alias("hot")))
    return met.join(hot, "key", "left").fillna(False, ["hot"])


@F.pandas_udf(T.StructType([T.StructField(f"p{i}", T.LongType()) for i in range(PARITIES)]))
def _pair_parity(texts: pd.Series) -> pd.DataFrame:
    """64 parities for each field of how often hashed pairs of neighbouring characters occur; one edit flips four of all at most."""
    out = np.zeros((len(texts), PARITIES), np.uint64)
    for k, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        at = (codes[:-1] * np.uint64(0x9E3779B1) + codes[1:] * np.uint64(0x85EBCA77)) >> np.uint64(13) & np.uint64(64 * PARITIES - 1)
        out[k] = np.packbits((np.bincount(at.astype(np.int64), minlength=64 * PARITIES) & 1).astype(np.uint8)).view(">u8")
    return pd.DataFrame(out.view(np.int64), columns=[f"p{i}" for i in range(PARITIES)])


def similar_lines(lines: DataFrame, distance: int = 2, hot_pairs: int = 1 << 22, total: int | None = None) -> DataFrame:
    """Links a < b between ids of lines (columns id, line, repeats do no harm) within the threshold of the shorter one.

    ``total`` is about how many signatures there are, if that is known.
    """
    if total is None:
        total = _total(lines, distance)
    zero = F.lit(0).cast("bigint")
    items = lines.select("id", "line", zero.alias("grp"), zero.alias("text"), F.lit(0).alias("removed"))
    met = stash(_meeting(items, distance, hot_pairs, ["id"], total))
    n = met.select(F.approx_count_distinct("id")).first()[0]
    if not n:
        return met.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    # texts of lines that met: a filter drops most others before the shuffle, the join drops the rest
    ids = met.select("id").distinct()
    texts = bloom.thin(lines.select("id", "line"), ids, "id", n).groupBy("id").agg(F.first("line").alias("line")).join(ids, "id", "left_semi")
    texts = stash(texts.withColumn("parity", _pair_parity("line")).withColumn("n", F.length("line")))
    found, level = _links(met.where("NOT hot"), texts, distance), 1
    items = texts.select("id", "line", zero.alias("grp"), zero.alias("text"), F.lit(0).alias("removed"))
    while (hot := met.where("hot")).head(1):
        # each level cuts what the level before left of a line, which is what its places refer to
        cut = hot.select("id", "grp", "text", F.col("key").alias("hot_key")).join(items, ["id", "grp", "text"])
        cut = cut.mapInPandas(_cut(distance), "id bigint, line string, grp bigint, removed int")
        items = stash(cut.withColumn("text", F.xxhash64("line")).distinct())
        level += 1
        met = stash(_meeting(items, distance, hot_pairs if level < LEVELS else None, ["id", "grp", "text"], _total(items, distance)))
        found = found.unionByName(_links(met.where("NOT hot"), texts, distance, 1 if level < LEVELS else SALTS))
    return found.distinct()


def _links(met: DataFrame, texts: DataFrame, distance: int, salts: int = 1) -> DataFrame:
    """Links a < b, each once or more, between lines that meet on a key.

    With ``salts``, a key's probes are dealt over so many tasks, each of which gets all its entries.
    """
    rows = met.select("key", "role", "id")
    if salts > 1:
        entry = rows.where(F.col("role").bitwiseAND(F.lit(INDEX)) > 0).withColumn("role", F.lit(INDEX).cast("tinyint")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        probe = rows.where(F.col("role").bitwiseAND(F.lit(PROBE)) > 0).withColumn("role", F.lit(PROBE).cast("tinyint")).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(salts)).cast("int"))
        rows = entry.unionByName(probe).select(F.xxhash64("key", "salt").alias("key"), "role", "id")
    rows = rows.join(texts.select("id", "line", "n", "parity.*"), "id").repartition("key").sortWithinPartitions("key")
    return rows.mapInPandas(_links_of_keys(distance), "a bigint, b bigint")


def _classes(docs: DataFrame, row: Column, id_col: str, text_col: str, distance: int, min_chars: int) -> DataFrame:
    """line_classes with the number of the row, ``row``, which tells rows with equal ids apart."""
    lines = lines_of(docs, text_col, max(min_chars, 1), F.col(id_col).alias("doc_id"), row.alias("row"))
    places = stash(lines.select("id", "doc_id", "row", "line_no", signature_count(F.octet_length("line"), distance).alias("signatures")))
    total = places.agg(F.sum("signatures")).first()[0] or 0
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line_no")).alias("first")
    distinct = stash(places.groupBy("id").agg(first, F.count("*").alias("copies")))
    # segments of three characters at least; shorter lines are in a class only with equal ones
    links = stash(similar_lines(lines_of(docs, text_col, 3 * (distance + 1)).select("id", "line"), distance, total=total))
    degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    parts = connected_components(links).withColumnRenamed("node", "id").join(degrees, "id", "left")
    named = distinct.join(parts, "id", "left").withColumn("single", F.col("component").isNull())
    named = named.withColumn("component", F.coalesce("component", "id")).fillna(0, ["links"])
    # lines that are alone need no further work
    alone = named.where("copies = 1 AND single")
    several = stash(named.where("copies > 1 OR NOT single"))
    classes = several.groupBy("component").agg(F.min("first").alias("class_first"), F.sum("copies").alias("class_size"))
    several = stash(several.join(classes, "component").select("id", "class_first", "class_size", "links"))
    shared = places.join(several, "id").select("doc_id", "row", "line_no", "class_first", "class_size", "links")
    single = alone.select("first.doc_id", "first.row", "first.line_no", F.col("first").alias("class_first"), F.col("copies").alias("class_size"), "links")
    kept = (F.col("row") == F.col("class_first.row")) & (F.col("line_no") == F.col("class_first.line_no"))
    return shared.unionByName(single).withColumn("kept", kept)


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, min_chars: int = 1) -> DataFrame:
    """One row for each line of at least ``min_chars`` characters (trimmed of ASCII white space): doc_id, line_no,
    class_doc_id, class_line_no, class_size, links, kept.

    Lines are linked within ``distance`` edits (case and marks count), and one more for each 512 characters of the
    shorter one, eight at most; a class is all lines reachable over links. It is named by its first line, by doc_id (a
    null one last), the row's place in the table, and number, which alone is kept. class_size counts all lines of the
    class with repeats, links the other distinct lines within the threshold. Lines of fewer than 3 * (distance + 1)
    characters have no links and are in a class with equal ones. Null texts and blank lines have no rows. Rows with
    equal ids are told apart. Other columns are ignored. No rows give no rows. Distinct lines are told apart by a
    64-bit hash.
    """
    out = _classes(docs, F.monotonically_increasing_id(), id_col, text_col, distance, min_chars)
    return out.select("doc_id", "line_no", F.col("class_first.doc_id").alias("class_doc_id"), F.col("class_first.line_no").alias("class_line_no"), "class_size", "links", "kept")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, min_chars: int = 1) -> DataFrame:
    """docs with near-duplicate lines removed from the text, all but the first of each class.

    Rows whose text loses no line are unchanged, all columns included, whatever their names. A document of which only
    white space is left goes. Rows with null ids come last in the order, rows with equal ids are told apart by their
    place in the table; a null or blank text is unchanged.
    """
    row = fresh_name(docs, "row")
    held = stash(docs.withColumn(row, F.monotonically_increasing_id()))
    classes = _classes(held, F.col(row), id_col, text_col, distance, min_chars)
    gone = classes.where(~F.col("kept")).groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias(fresh_name(docs, "gone")))
    gone_col = F.col(fresh_name(docs, "gone"))
    joined = held.join(stash(gone), row, "left")
    left = F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains(gone_col, i))
    text = F.when(gone_col.isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    out = joined.withColumn(text_col, text).where(gone_col.isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*docs.columns)
