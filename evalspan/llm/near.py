"""Near-duplicates with small edits: groups of texts whose word shingles overlap by a threshold or more.

1. Each text becomes the set of its shingles (40-bit hashes), which are shuffled once, into buckets of their id. Of equal
   sets (by a hash of 128 bits) one stands for all. Its signature has ``COORDINATES`` min-hash values: two sets agree in
   one with a chance that equals their similarity.
2. Stars: texts are posted under the first coordinate-value pairs. Under each pair a text collides with the list's first
   text and with the one before it, so a list of any length costs its length. Collisions are counted per pair of texts;
   those with ``STAR_HITS`` or more are compared exactly, and their links give first groups.
3. Counted join: texts are posted under their coordinate-value pairs but for the most frequent ones (prefix), in an
   order by a frequency sketch. Lists whose texts are of one group are skipped; the others are kept. Stars over them, as
   in step 2, join most of the groups that belong together, at a cost of the lists' length. Under what is still mixed
   then, members of a group are skipped against each other (skip merging), collisions are counted, and pairs of
   different groups with ``HITS`` or more are retained: a pair over the threshold agrees in ``match_threshold``
   coordinates, of which the skipped ones can hide all but ``HITS``. Those are compared exactly.
4. Connected components of all links are the groups.

A link is lost only if its two signatures agree in fewer coordinates than the match threshold, which is set so that
the chance is ``LOSS`` at most for a pair right at the similarity, and far less above it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Workspace
from .components import connected_components

WORD = re.compile(r"[A-Za-z0-9_]+")
#: Bits of a shingle's hash. Two different shingles of two texts agree by chance once in 10^8 pairs of texts.
BITS = 40
_MASK = np.uint64((1 << BITS) - 1)
#: Coordinates of the min-hash signature, those of step 2, and collisions from which a pair is compared: of stars, and of
#: all texts under a key.
COORDINATES, STARS, STAR_HITS, HITS = 96, 16, 2, 4
#: The chance at most that two sets right at the threshold agree in fewer coordinates than the match threshold.
LOSS = 1e-8
#: Counters of the frequency sketch for each coordinate: one for LOAD texts, within bounds (12 MB in all at most).
COUNTERS, LOAD = (1 << 14, 1 << 17), 32
#: Rows under one key that one task pairs in memory; keys with more go through a join.
KEY_ROWS = 4_000
#: Values of sets whose signatures are made together, and pairs.
PART_VALUES, PART_PAIRS = 1_000_000, 2_000_000
#: Characters whose shingles are made together.
PART_CHARS = 4_000_000
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], "uint64")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words in lower case, remembered up to a number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.lower())
        return h


def shingle_arrays(texts: list[str], size: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the runs of ``size`` successive words of all texts, one after the other, and how many
    each text has: none for texts of fewer words."""
    flat: list[int] = []
    lengths = np.empty(len(texts), "int64")
    for k, text in enumerate(texts):
        found = WORD.findall(text)
        lengths[k] = len(found)
        flat.extend(map(hashes.__getitem__, found))
    h = np.array(flat, "uint64")
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, "uint64")
    for k in range(size):
        out = _mix(out * _P[0] + h[k : k + n])
    of = np.repeat(np.arange(len(texts)), lengths)
    within = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    whole = (within <= np.repeat(lengths, lengths) - size)[:n]
    keyed = of[:n][whole].astype("uint64") << np.uint64(BITS) | (out[whole] & _MASK)
    keyed.sort()
    keyed = keyed[np.r_[True, keyed[1:] != keyed[:-1]]] if len(keyed) else keyed
    return keyed & _MASK, np.bincount((keyed >> np.uint64(BITS)).astype("int64"), minlength=len(texts))


def pack_set(values: np.ndarray) -> bytes:
    return values.astype("<u8").view("u1").reshape(-1, 8)[:, : BITS // 8].tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    short = np.frombuffer(data, "u1").reshape(-1, BITS // 8)
    out = np.zeros((len(short), 8), "u1")
    out[:, : BITS // 8] = short
    return out.view("<u8").ravel()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def needed(na: int, nb: int, threshold: float) -> int:
    """The overlap from which two sets of these sizes have the similarity."""
    return int(np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9))


def match_threshold(threshold: float, coordinates: int = COORDINATES, loss: float = LOSS) -> int:
    """The number of agreeing coordinates that two sets of the similarity miss with a chance of ``loss`` at most."""
    below, m = 0.0, 0
    while m < coordinates:
        below += comb(coordinates, m) * threshold**m * (1 - threshold) ** (coordinates - m)
        if below > loss:
            break
        m += 1
    return m


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    na, nb = len(a), len(b)
    return min(na, nb) >= threshold * max(na, nb) - 1e-9 and overlap(a, b) >= needed(na, nb, threshold)


_SET_SCHEMA = T.StructType(
    [
        T.StructField("record_set", T.StringType()), T.StructField("id", T.LongType()), T.StructField("root", T.LongType()),
        *(T.StructField(c, T.LongType()) for c in ("t1", "t2", "h1", "h2")), T.StructField("set", T.BinaryType()),
    ]
)
_LINK_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b")])
_POSTING_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "comp", "id")] + [T.StructField("n", T.IntegerType())])
_COLLISION_SCHEMA = T.StructType(
    [T.StructField("kind", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("key", "a", "b")] + [T.StructField("n", T.IntegerType())]
)
#: Ids times the number of record sets stay below this power of 2.
ID_BITS = 53


#: Odd multipliers, one for each coordinate: a set's least product is its value there.
_FACTORS = _mix(np.arange(1, 129, dtype="uint64") * _P[0]) | np.uint64(1)


def signatures(values: np.ndarray, starts: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The coordinates of sets that lie one after the other in ``values``: an array of coordinates by sets."""
    high = values << np.uint64(64 - BITS)
    return np.stack([np.minimum.reduceat(high * s, starts) for s in _FACTORS[:coordinates]]) >> np.uint64(64 - BITS)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of a batch of sets with about PART_VALUES values each: rows, values, starts and sizes."""
    data = batch.column("set").to_pylist()
    sizes = np.array([len(d) for d in data], "int64") // (BITS // 8)
    part = np.cumsum(sizes) // PART_VALUES
    edges = np.r_[0, np.nonzero(part[1:] != part[:-1])[0] + 1, len(data)] if len(data) else [0]
    for s, e in zip(edges[:-1], edges[1:]):
        n = sizes[s:e]
        yield slice(s, e), unpack_set(b"".join(data[s:e])), np.cumsum(n) - n, n


def _keys(kind: np.ndarray, coordinates: np.ndarray, values: np.ndarray) -> np.ndarray:
    return kind.astype("int64") << np.int64(BITS + 7) | coordinates.astype("int64") << np.int64(BITS) | values.astype("int64")


def _batch(schema: T.StructType, columns: list) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrays = [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema.fields)]
    return pa.RecordBatch.from_arrays(arrays, schema.names)


def _halves(x: int) -> tuple[int, int]:
    """127 bits of a hash as two numbers that aren't negative."""
    return x & ((1 << 63) - 1), x >> 65


def shingle_sets(df: DataFrame, size: int) -> DataFrame:
    """``record_set, id, text`` to sets, with hashes of text and set; texts with fewer words than ``size`` are left out.

    ``root`` is the id of the row that carries the set: of equal sets within one task only the first does.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), {}

        def sets_of(part):
            values, counts = shingle_arrays([text for _, _, text in part], size, hashes)
            data, ends = pack_set(values), np.cumsum(counts)
            full = np.nonzero(counts)[0]
            if not len(full):
                return
            rows = []
            for k in full:
                record_set, key, text = part[k]
                own, t = data[BITS // 8 * (ends[k] - counts[k]) : BITS // 8 * ends[k]], xxhash.xxh3_128_intdigest(text)
                if len(seen) > 200_000:
                    seen.clear()
                h = xxhash.xxh3_128_intdigest(own)
                root = seen.setdefault((record_set, h), key)
                rows.append((record_set, key, root, *_halves(t), *_halves(h), own if root == key else None))
            yield _batch(_SET_SCHEMA, list(zip(*rows)))

        for batch in batches:
            part, chars = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("record_set", "id", "text"))):
                part.append(row)
                chars += len(row[2])
                if chars > PART_CHARS:  # bounds the arrays, whatever the lengths of the texts
                    yield from sets_of(part)
                    part, chars = [], 0
            if part:
                yield from sets_of(part)

    return df.where("text is not null").select("record_set", "id", "text").mapInArrow(run, _SET_SCHEMA)


def _star_postings(sets: DataFrame) -> DataFrame:
    """Each set under its first coordinate-value pairs, as ``key, comp, id, n``, a group (``comp``) of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, ids = (batch.column(c).to_numpy() for c in ("kind", "id"))
            for rows, values, starts, n in _parts(batch):
                s = signatures(values, starts, STARS)
                keys = _keys(kind[rows], np.arange(STARS)[:, None], s).ravel()
                own, sizes = pa.array(np.tile(ids[rows], STARS)), pa.array(np.tile(n.astype("int32"), STARS))
                yield pa.RecordBatch.from_arrays([pa.array(keys), own, own, sizes], _POSTING_SCHEMA.names)

    return sets.select("kind", "id", "set").mapInArrow(run, _POSTING_SCHEMA)


def _star_pairs(postings: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` with STAR_HITS collisions or more, of each text with the first one under its key and with the one before
    it in order of size, where these are of other groups and the sizes allow a link. A hot key may be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = last = None  # key, group, id and size of the list's first text and of the last one read
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("key", "comp", "id", "n")]
            if not len(columns[0]):
                continue
            old = 0 if head is None else 2
            if head is not None:
                columns = [np.r_[[h, x], y] for h, x, y in zip(head, last, columns)]
            key, comp, ids, n = columns
            at = np.arange(len(key))
            fresh = np.r_[True, key[1:] != key[:-1]]
            first = np.maximum.accumulate(np.where(fresh, at, 0))
            one = np.nonzero(~fresh & (at >= old))[0]
            two = one[ids[first[one]] != ids[one - 1]]
            a, b = np.r_[one, two], np.r_[first[one], two - 1]
            ok = (comp[a] != comp[b]) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9)
            head, last = ([x[k] for x in columns] for k in (first[-1], len(key) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[x[ok]].astype("int64")) for x in (a, b)], _LINK_SCHEMA.names)

    listed = postings.select("key", "comp", "id", "n").hint("rebalance", "key").sortWithinPartitions("key", "n", "id")
    counted = listed.mapInArrow(run, _LINK_SCHEMA).groupBy("a", "b").agg(F.count("*").alias("k"))
    return counted.where(F.col("k") >= STAR_HITS).select("a", "b")


def frequency_sketch(sets: DataFrame, width: int) -> np.ndarray:
    """Counts of the values of each coordinate in ``width`` counters, as 8-bit logarithms (8 steps to a doubling)."""
    schema = "coordinate int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((COORDINATES, width), "int32")
        for batch in batches:
            for _, values, starts, _ in _parts(batch):
                for k, s in enumerate(signatures(values, starts)):
                    total[k] += np.bincount((s & np.uint64(width - 1)).astype("int64"), minlength=width).astype("int32")
        yield pa.RecordBatch.from_arrays([pa.array(range(COORDINATES), pa.int32()), pa.array([t.tobytes() for t in total])], ["coordinate", "counts"])

    def add(f):
        total = np.zeros(width, "int64")
        for data in f["counts"]:
            total += np.frombuffer(data, "int32")
        return f.iloc[:1].assign(counts=[level_of(total).astype("u1").tobytes()])[["coordinate", "counts"]]

    rows = sets.select("set").mapInArrow(count, schema).groupBy("coordinate").applyInPandas(add, schema).collect()
    out = np.zeros((COORDINATES, width), "u1")
    for r in rows:
        out[r["coordinate"]] = np.frombuffer(r["counts"], "u1")
    return out


def level_of(count):
    return np.minimum(255, np.floor(8 * np.log2(np.asarray(count) + 1.0)))


def _postings(grouped: DataFrame, sketch, width: int, skip: int, hot_level: int, hot: bool) -> DataFrame:
    """Each set under its coordinate-value pairs but for the ``skip`` most frequent ones, as ``key, comp, id, n``: those
    whose counter is at ``hot_level`` or above, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(sketch.value, "u1").reshape(COORDINATES, width)
        every = np.arange(COORDINATES)[:, None]
        for batch in batches:
            kind, comp, ids = (batch.column(c).to_numpy() for c in ("kind", "comp", "id"))
            for rows, values, starts, n in _parts(batch):
                s = signatures(values, starts)
                level = levels[every, (s & np.uint64(width - 1)).astype("int64")]
                # one order of all pairs, by level and then by coordinate: what two texts share is skipped alike
                prefix = np.argsort(level, axis=0, kind="stable")[: COORDINATES - skip]
                k, doc = np.nonzero((np.take_along_axis(level, prefix, 0) >= hot_level) == hot)
                at = prefix[k, doc]
                columns = (_keys(kind[rows][doc], at, s[at, doc]), comp[rows][doc], ids[rows][doc], n[doc].astype("int32"))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _POSTING_SCHEMA.names)

    return grouped.mapInArrow(run, _POSTING_SCHEMA)


def _ranges(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the rows with every number of its range."""
    sizes = hi - lo
    before = np.cumsum(sizes) - sizes
    return np.repeat(rows, sizes), np.arange(sizes.sum()) + np.repeat(lo - before, sizes)


def _cross_pairs(key, comp) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key and different groups, with at least one side outside the key's largest group, about
    PART_PAIRS at a time; the rows are sorted by key and group."""
    fresh = np.r_[True, key[1:] != key[:-1]]
    runs = np.nonzero(fresh | np.r_[True, comp[1:] != comp[:-1]])[0]  # of one group under one key
    size = np.diff(np.r_[runs, len(key)])
    first = np.nonzero(fresh[runs])[0]  # run of each key
    most = np.repeat(np.maximum.reduceat(size, first), np.diff(np.r_[first, len(runs)]))
    of_key = np.cumsum(fresh[runs]) - 1
    largest = np.nonzero(size == most)[0]
    largest = largest[np.unique(of_key[largest], return_index=True)[1]]  # the first of equally large ones
    major = np.zeros(len(runs), bool)
    major[largest] = True
    run_of = np.repeat(np.arange(len(runs)), size)
    minor = np.nonzero(~major[run_of])[0]
    own = run_of[minor]
    lo, end = runs[largest][of_key[own]], np.r_[runs[first], len(key)][of_key[own] + 1]
    hi, after = lo + most[own], runs[own] + size[own]
    part = np.cumsum(hi - lo + end - after) // PART_PAIRS
    edges = np.r_[0, np.nonzero(part[1:] != part[:-1])[0] + 1, len(minor)] if len(minor) else np.zeros(1, "int64")
    for s, e in zip(edges[:-1], edges[1:]):
        i, j = _ranges(minor[s:e], lo[s:e], hi[s:e])
        k, m = _ranges(minor[s:e], after[s:e], end[s:e])
        other = ~major[run_of[m]]
        yield np.r_[i, k[other]], np.r_[j, m[other]]


def _whole_keys(postings: DataFrame, key_rows: int, schema: T.StructType, whole, large) -> DataFrame:
    """``whole`` of the arrays of whole keys, many at a time, and ``large`` of the rows of keys with more than
    ``key_rows``, as they come; ``postings`` is partitioned and sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        passing = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("key", "comp", "id", "n")]
            if passing is not None and len(cols[0]):  # the rest of a key that was given up
                same = cols[0] == passing
                if same.any():
                    yield from large(*(x[same] for x in cols))
                    cols = [x[~same] for x in cols]
            if not len(cols[0]):
                continue
            passing = None
            cols = [np.r_[x, y] for x, y in zip(held, cols)] if held else cols
            starts = np.nonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])[0]
            sizes = np.diff(np.r_[starts, len(cols[0])])
            big = np.repeat(sizes > key_rows, sizes)
            ended = np.arange(len(big)) < starts[-1]  # the last key may go on in the next batch
            if big.any():
                yield from large(*(x[big] for x in cols))
                passing = cols[0][-1] if big[-1] else None
            if (small := ended & ~big).any():
                yield from whole(*(x[small] for x in cols))
            held = [x[~ended & ~big] for x in cols]
            held = held if len(held[0]) else []
        if held:
            yield from whole(*held)

    return postings.select("key", "comp", "id", "n").repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _mixed_lists(postings: DataFrame, key_rows: int) -> DataFrame:
    """The postings of keys with texts of several groups, and of keys too large for one task."""

    def kept(*cols):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], _POSTING_SCHEMA.names)

    def mixed(key, comp, ids, n):
        starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
        several = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
        rows = np.repeat(several, np.diff(np.r_[starts, len(key)]))
        return kept(key[rows], comp[rows], ids[rows], n[rows])

    return _whole_keys(postings, key_rows, _POSTING_SCHEMA, mixed, kept)


def _collisions(postings: DataFrame, threshold: float, key_rows: int) -> DataFrame:
    """Collisions of texts of different groups (kind 0), counted in ``n`` within a batch; and the rows of keys too large for one task (kind 1), with group and size in ``b`` and ``n``."""

    def emit(kind, key, a, b, n):
        arrays = (np.full(len(a), kind, "int32"), key, a.astype("int64"), b.astype("int64"), n.astype("int32"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], _COLLISION_SCHEMA.names)

    def passed_on(key, comp, ids, n):
        yield emit(1, key, ids, comp, n)

    def pairs(key, comp, ids, n):
        order = np.lexsort((comp, key))
        ids, n = ids[order], n[order]
        for i, j in _cross_pairs(key[order], comp[order]):
            near = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
            i, j = ids[i[near]], ids[j[near]]
            a, b = np.minimum(i, j), np.maximum(i, j)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            at = np.nonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[0] if len(a) else np.empty(0, "int64")
            yield emit(0, np.zeros(len(at), "int64"), a[at], b[at], np.diff(np.r_[at, len(a)]))

    return _whole_keys(postings, key_rows, _COLLISION_SCHEMA, pairs, passed_on)


def _mixed(rows: DataFrame) -> DataFrame:
    """Keys with texts of more than one group, as ``key``: two extremes per key and task before the shuffle."""
    ends = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return ends.where("lo <> hi").select("key")


def _heavy_collisions(rows: DataFrame, threshold: float) -> DataFrame:
    """Collisions ``a, b`` under keys with very many rows, as a join that adaptive execution splits where it is skewed.

    ``rows`` holds ``key, comp, id, n`` of keys with texts of several groups. Members of a key's largest group are
    skipped against each other, so the join is linear in it.
    """
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("m"))
    major = sizes.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("major"))
    rows = rows.join(major, "key")
    x, y = rows.where("comp <> major").alias("x"), rows.alias("y")
    either = (F.col("y.comp") == F.col("y.major")) | (F.col("x.id") < F.col("y.id"))
    sizes_ok = F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & either & sizes_ok)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.lit(1).alias("n"))


def near_groups(
    df: DataFrame, work: Workspace, threshold: float = 0.8, size: int = 5, key_rows: int = KEY_ROWS, hot_rows: int | None = None,
    hot_pairs: int = 100_000,
) -> DataFrame:
    """``record_set, id, group`` of every distinct text with at least ``size`` words: the smallest id of its group.

    ``df`` has ``record_set, id, text``; ids are unique within a set, at least 0 and below 2^53 over the number of sets
    (else it fails), and there are 1,000 sets at most; rows without an id are left out. Of equal texts only the smallest id appears.
    Null texts and texts of fewer words are left out; an empty table gives an empty result. Groups are linked, directly
    or through others, by Jaccard similarities of word shingles of at least ``threshold``. Keys that the sketch counts
    ``hot_rows`` times or more (by default ``key_rows``, or eight times a counter's average where that is more) are
    joined apart from the others; the set of a text with more than ``hot_pairs`` pairs is copied to several tasks.
    """
    spark = work.spark
    least = match_threshold(threshold)
    if least < HITS:
        raise ValueError("the threshold is too low for the signature")
    names = [r[0] for r in df.select("record_set").distinct().orderBy("record_set").limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1,000 record sets")
    code = F.lit(None).cast("long")
    for i, name in enumerate(names):  # an id of both sets and a small number for each set
        code = F.when(F.col("record_set").eqNullSafe(F.lit(name)), F.lit(i).cast("long")).otherwise(code)
    fits = F.col("id").between(0, (1 << ID_BITS) // max(1, len(names)))
    safe = F.when(fits, F.col("id")).otherwise(F.raise_error(F.lit("an id is negative or too large")).cast("long"))
    rows = df.where("id is not null")
    coded = rows.select("record_set", (safe * len(names) + code).alias("id"), "text") if names else rows
    rows = work.write_bucketed(shingle_sets(coded, size), "sets", "id")
    sets = rows.where("set is not null").select("id", "set")
    own = rows.where("set is not null").groupBy("record_set", "h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    own = work.write(own, "different")
    many = own.where("copies > 1").select("record_set", "h1", "h2", "first")
    copies = rows.where("set is not null").select("record_set", "h1", "h2", F.col("id").alias("a")).join(many, ["record_set", "h1", "h2"])
    kind = (F.col("id") % max(1, len(names))).cast("int").alias("kind")
    unique = sets.join(own.select(F.col("first").alias("id")).hint("merge"), "id").select(kind, "id", "set")
    stars = _star_pairs(_star_postings(unique), threshold)
    same = rows.where("id <> root").selectExpr("id as a", "root as b").unionByName(copies.where("a <> first").selectExpr("a", "first as b"))
    links = work.write(same.unionByName(_verify(stars, sets, threshold, work, "first", hot_pairs)), "links")
    found = work.write(connected_components(links, "a", "b", work, "first"), "first")
    work.drop("links")
    work.release()
    count = own.count()
    width = min(max(COUNTERS[0], 1 << (count // LOAD).bit_length()), COUNTERS[1])
    levels = frequency_sketch(unique, width)
    sketch = spark.sparkContext.broadcast(levels.tobytes())
    hot_rows = max(key_rows, 8 * count // width) if hot_rows is None else hot_rows
    hot_level, skip = int(level_of(hot_rows)), least - HITS
    grouped = _with_groups(unique, found)
    has_hot = bool((levels >= hot_level).any())
    lists = work.write(_mixed_lists(_postings(grouped, sketch, width, skip, hot_level, False), key_rows), "lists")
    hot = None
    if has_hot:  # rows of hot keys stay where they are, but for those that texts of several groups have
        hot = work.write(_postings(grouped, sketch, width, skip, hot_level, True), "hot")
        hot = work.write(hot.join(_mixed(hot), "key", "left_semi"), "mixed")
        work.drop("hot")
    work.release()
    stars = _star_pairs(lists.unionByName(hot) if has_hot else lists, threshold)
    found, changed = _merge(found, work.write(_verify(stars, sets, threshold, work, "second", hot_pairs), "star-links"), work, "second")
    collisions = work.write(_collisions(_renamed(lists, changed), threshold, key_rows), "collisions")
    work.drop("lists")
    heavy = collisions.where("kind = 1").select("key", F.col("b").alias("comp"), F.col("a").alias("id"), "n")
    heavy = heavy.unionByName(_renamed(hot, changed)) if has_hot else heavy
    heavy = work.write(heavy.join(_mixed(heavy), "key", "left_semi"), "heavy")
    pairs = collisions.where("kind = 0").select("a", "b", "n").unionByName(_heavy_collisions(heavy, threshold))
    retained = pairs.groupBy("a", "b").agg(F.sum("n").alias("k")).where(F.col("k") >= HITS).select("a", "b")
    found, _ = _merge(found, work.write(_verify(retained, sets, threshold, work, "third", hot_pairs), "verified"), work, "third")
    texts = rows.groupBy("record_set", "t1", "t2").agg(F.min("id").alias("id"))
    # the component is named by any of its rows; its smallest text is what counts
    named = _with_groups(texts, found)
    smallest = named.groupBy("comp").agg(F.min("id").alias("least"))
    sets_ = max(1, len(names))
    return named.join(smallest, "comp").select(
        "record_set", F.floor(F.col("id") / sets_).cast("long").alias("id"), F.floor(F.col("least") / sets_).cast("long").alias("group")
    )


def _with_groups(df: DataFrame, found: DataFrame) -> DataFrame:
    """``df`` with ``comp``, the group of its ``id``; the id itself where it isn't linked."""
    # the groups grow with the input: no broadcast
    joined = df.join(found.hint("merge"), F.col("id") == F.col("node"), "left")
    return joined.select(*df.columns, F.coalesce("component", "id").alias("comp"))


def _merge(found: DataFrame, links: DataFrame, work: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """``node, component`` after further links, which tie groups together, and ``old, new`` of the groups concerned."""
    ties = _with_groups(links.withColumnRenamed("a", "id"), found).select(F.col("comp").alias("a"), F.col("b").alias("id"))
    ties = _with_groups(ties, found).select("a", F.col("comp").alias("b"))
    groups = connected_components(ties, "a", "b", work, name)
    changed = groups.select(F.col("node").alias("old"), F.col("component").alias("new"))
    tied = found.join(changed, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    return work.write(tied.unionByName(groups.join(found, "node", "left_anti").select("node", "component")), name), changed


def _renamed(postings: DataFrame, changed: DataFrame) -> DataFrame:
    joined = postings.join(changed, F.col("comp") == F.col("old"), "left")
    return joined.select("key", F.coalesce("new", "comp").alias("comp"), "id", "n")


#: Tasks to which the set of a text with very many pairs is copied.
COPIES = 64


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float, work: Workspace, name: str, hot_pairs: int) -> DataFrame:
    """Those of the pairs whose sets have the similarity, compared exactly: ``a, b``.

    ``sets`` lies in buckets of the id, so that pairs go to their first set, and take it along to their second one. The
    set of a text with more than ``hot_pairs`` pairs is copied to several tasks first.
    """
    pairs = work.write(pairs, f"{name}-pairs")
    known = sets.select("id", "set").hint("merge")  # pairs grow with the input: no broadcast
    hot = pairs.groupBy("b").agg(F.count("*").alias("m")).where(F.col("m") > hot_pairs).select("b")
    hot = work.write(hot, f"{name}-hot")  # at most one in hot_pairs of the pairs
    normal = pairs
    some = not hot.isEmpty()
    if some:
        normal = pairs.join(hot, "b", "left_anti").select("a", "b")
    first = normal.join(known.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sb")
    if some:
        salt = F.pmod(F.xxhash64("a"), F.lit(COPIES)).cast("int").alias("salt")
        many = hot.join(known.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        many = many.select("b", "sb", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("salt"))
        apart = pairs.join(hot, "b", "left_semi").select("a", "b", salt)
        first = first.unionByName(apart.join(many.hint("merge"), ["b", "salt"]).select("a", "b", "sb"))
    both = first.join(known.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "sa", "sb"))
            ok = [k for k in range(len(a)) if similar(unpack_set(x[k]), unpack_set(y[k]), threshold)]
            yield _batch(_LINK_SCHEMA, [[a[k] for k in ok], [b[k] for k in ok]])

    return both.mapInArrow(run, _LINK_SCHEMA)
