"""MinHash near-dedup (1) with odd sketches.

A document's set is its distinct five-word shingles.  128 MinHash samples of the set make 32 band keys of four
samples (160 make 40 where pairs at 0.80 are asked for), and the first 128 samples are folded into an odd sketch: a bitmap in which each sample toggles one bit, so that the
population count of two sketches' XOR estimates how many samples differ, most precisely at high similarity.

1. Documents with equal sets are one class, found by grouping on a fingerprint; its smallest id stands for it.
2. Band buckets propose pairs of each member and the bucket's smallest id (a star, not all pairs).  Pairs whose
   sketches differ in too many bits go (a pair at the threshold passes but for about one in 10^8), the rest are
   confirmed on the full sets.
3. Confirmed links give components: lots of links are contracted by union-find, and what several lots leave is joined
   by alternating large-star and small-star steps.
4. What stars cannot see: within a bucket, members outside its main component are compared, sketch against sketch,
   with the members of other components, in blocks of ``BLOCK`` by ``BLOCK`` dealt over many tasks.  ``ROUNDS`` times,
   each such member proposes only its closest ``BEST`` partners of other components in a block, if close; their confirmed
   links join most components, which spares the pairs inside them.  A bucket that has become whole is left out of
   the next round.  A last pass proposes every pair left whose sketches are close, by then also by a wide odd sketch
   (1024 samples in 4096 bits, made for these members only), and a pair that shares several buckets only in the
   first.  It gives a member's partners as one list, and the lists are confirmed cell by cell (``confirm_lists``): a
   cell gets the texts of two blocks of documents once, so what is joined and shuffled grows with the documents and
   their blocks, not with the pairs.  So every pair that shares a bucket is linked, within one component, or compared.  A pair at similarity 0.85
   shares no bucket with a chance of 5 in 10^11, one at 0.80 with 7 in 10^10.

The number of bands and what counts as close follow from ``percent`` (``limits``).

Nothing about all documents reaches the driver.  Texts of candidates are read again; a bitmap of at most one MB
(proven by its construction) keeps most other texts out of that join.  Intermediate tables lie in the shared
checkpoint folder.

Cases: null and empty texts, and texts of white space, have empty sets and are linked with nothing; texts of fewer
than five words are one shingle; rows without an id are linked with nothing and stay; repeated rows fall into one
component; texts of any length are read whole; clashing extra columns are kept aside; an empty table gives none.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrowtext import NOT_SPACE, U64, column, hashed_words, mix, saved, ship

SHINGLE = 5
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH = 512                # bits
SIGMA, STEP = 6, 20         # a pair at the threshold may show its mean of differing bits and so many deviations, rounded up
MISS = 1e-9                 # chance at most that a pair at the threshold shares no bucket
BLOCK = 512                 # documents of a side compared at once
SALTED = 256                # pairs of one document confirmed at once
ROUNDS, BEST = 2, 2
NEAR_SIGMA = 1.25           # deviations beyond the mean within which a round's partners are proposed
WIDE_SAMPLES, WIDE = 1024, 4096
BITMAP = 1 << 23
LOT = 250_000               # links contracted by one task
CELL = 1 << 21              # shingles of a side confirmed at once

_rng = np.random.Generator(np.random.PCG64(77))
MULTIPLY = _rng.integers(0, 1 << 31, WIDE_SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 1 << 32, WIDE_SAMPLES, dtype=np.uint32)
MINGLE = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * U64(2) + U64(1)
PLACES = np.array([3, 5, 7, 11, 13], np.uint64) * U64(0x9E3779B97F4A7C15)


class Limits(NamedTuple):
    bands: int
    sketch: int                 # differing bits that a pair may show
    near: int                   # differing bits within which a round's partners are proposed
    wide: int                   # differing bits of wide sketches that a pair may show


def differing(samples: int, bits: int, same: float) -> tuple[float, float]:
    """Mean and deviation of the differing bits of two odd sketches, of samples that agree with the chance ``same``: a
    sample that does not toggles two bits of the XOR."""
    one = (same + (1 - same) * (1 - 2 / bits) ** 2) ** samples
    two = (same + (1 - same) * (1 - 4 / bits) ** 2) ** samples
    return bits / 2 * (1 - one), math.sqrt(max(0.0, bits + bits * (bits - 1) * two - (bits * one) ** 2)) / 2


def limits(percent: int) -> Limits:
    """What lets a pair at ``percent`` pass."""
    same = percent / 100
    bands = BANDS if same >= 1 else max(BANDS, math.ceil(math.log(MISS) / math.log1p(-same ** ROWS)))
    if bands * ROWS > WIDE_SAMPLES:
        raise ValueError(f"{percent} percent needs {bands} bands, more than {WIDE_SAMPLES // ROWS}")
    mean, deviation = differing(SAMPLES, SKETCH, same)
    wide_mean, wide_deviation = differing(WIDE_SAMPLES, WIDE, same)
    up = lambda x: math.ceil(x / STEP) * STEP
    return Limits(bands, min(SKETCH, up(mean + SIGMA * deviation)), math.ceil(mean + NEAR_SIGMA * deviation),
                  min(WIDE, up(wide_mean + SIGMA * wide_deviation)))


def shingle_sets(arr: pa.Array):
    """For each run of texts: (first row, end row, the texts' sorted distinct shingle hashes on end, offsets)."""
    for i, j, _, _, _, h, first in hashed_words(arr, NOT_SPACE):
        n = len(h) - SHINGLE + 1
        whole = np.zeros(max(n, 0), np.uint64)
        for k in range(SHINGLE):
            whole += h[k:k + n] * PLACES[k] if n > 0 else U64(0)
        whole = mix(whole)
        sets = []
        for r in range(j - i):
            s, e = int(first[r]), int(first[r + 1])
            if e - s >= SHINGLE:
                x = np.sort(whole[s:e - SHINGLE + 1])
                if len(x) > 1:
                    x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            elif e > s:
                x = mix((h[s:e] * PLACES[:e - s]).sum(keepdims=True, dtype=np.uint64) + U64(e - s))
            else:
                x = whole[:0]
            sets.append(x)
        off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        yield i, j, np.concatenate(sets), off


def samples_of(values: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """MinHash samples of sets that are not empty, a row each."""
    x = (values >> U64(32)).astype(np.uint32)
    out = np.empty((len(off) - 1, count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(x * MULTIPLY[k] + ADD[k], off[:-1])
    return out


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Rows of 64-bit words in which each sample has toggled one bit."""
    n, count = samples.shape
    bit = (mix(samples.astype(np.uint64) + (np.arange(count, dtype=np.uint64) << U64(32))) % U64(bits)).astype(np.int64)
    toggles = np.bincount((bit + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(toggles.astype(np.uint8), axis=1).view(np.uint64)


def sketches(values: np.ndarray, off: np.ndarray, bands: int):
    """Band keys and odd sketches of sets that are not empty."""
    samples = samples_of(values, off, bands * ROWS)
    keys = np.zeros((len(samples), bands), np.uint64)
    for k in range(ROWS):
        keys += samples[:, k::ROWS].astype(np.uint64) * MINGLE[k]
    keys = mix(keys + np.arange(bands, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
    return keys, odd_sketch(samples[:, :SAMPLES], SKETCH)


def signatures(src: DataFrame, bands: int) -> DataFrame:
    """``src`` (id, text) -> id, n (set size), f1 and f2 (fingerprint of the set), keys, sketch; null where empty."""
    def run(batches):
        for b in batches:
            ids = column(b, "id")
            for i, j, values, off in shingle_sets(column(b, "text")):
                n = np.diff(off)
                full = np.flatnonzero(n)
                f1, f2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                keys, sketch = [None] * (j - i), [None] * (j - i)
                if len(full):
                    cuts = off[:-1][full]
                    f1[full] = np.add.reduceat(values * U64(0xC2B2AE3D27D4EB4F), cuts).view(np.int64)
                    f2[full] = np.add.reduceat(mix(values), cuts).view(np.int64)
                    k, s = sketches(values, np.append(cuts, len(values)), bands)
                    for r, a, c in zip(full.tolist(), k.view(np.int64), s.view(np.int64)):
                        keys[r], sketch[r] = a, c
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(f1, mask=empty), pa.array(f2, mask=empty),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                    ["id", "n", "f1", "f2", "keys", "sketch"])

    return src.mapInArrow(run, "id long, n long, f1 long, f2 long, keys array<long>, sketch array<long>")


def differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def grouped(batches, key: tuple[str, ...]):
    """Rows of sorted batches, a group of equal ``key`` at a time: (start of a group?, one-group slices)."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [column(b, k).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            now = tuple(c[s] for c in cols)
            yield now != last, b.slice(s, e - s)
            last = now


def only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``texts`` (id, text) joined to ``ids`` (id, ...).  A bitmap of the wanted ids, of at most BITMAP bits, keeps
    most other texts from being shuffled; the join then is exact."""
    spot = F.pmod(F.xxhash64("id"), F.lit(BITMAP))
    bits = (ids.select(spot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")))
    set_here = F.expr("shiftright(cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) & 1")
    wanted = (texts.withColumn("s", spot).withColumn("bucket", F.bitmap_bucket_number("s"))
              .withColumn("at", F.bitmap_bit_position("s")).join(F.broadcast(bits), "bucket").where(set_here == 1).select("id", "text"))
    return ids.join(wanted, "id")


def spotted(src: DataFrame, ids: DataFrame) -> DataFrame:
    """``src`` (id, ...) with ``seen``: false only if the id is not among ``ids``, by a bitmap of BITMAP bits."""
    spot = F.pmod(F.xxhash64("id"), F.lit(BITMAP))
    bits = (ids.select(spot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")))
    is_set = F.expr("shiftright(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1") == 1
    return (src.withColumn("s", spot).withColumn("bucket", F.bitmap_bucket_number("s")).withColumn("bit", F.bitmap_bit_position("s"))
            .join(F.broadcast(bits), "bucket", "left").withColumn("seen", F.coalesce(is_set, F.lit(False))).drop("s", "bucket", "bit", "bits"))


def wide_sketches(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """Id -> wide odd sketch, for ids of texts whose sets are not empty."""
    def run(batches):
        for b in batches:
            for i, j, values, off in shingle_sets(column(b, "text")):
                full = np.flatnonzero(np.diff(off))
                if len(full):
                    w = odd_sketch(samples_of(values, np.append(off[:-1][full], len(values)), WIDE_SAMPLES), WIDE)
                    yield pa.RecordBatch.from_arrays(
                        [column(b, "id").slice(i, j - i).take(pa.array(full)), pa.array(list(w.view(np.int64)), pa.list_(pa.int64()))], ["rep", "wide"])

    return only(texts, ids).select("id", "text").mapInArrow(run, "rep long, wide array<long>").dropDuplicates(["rep"])


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full sets have 100 * intersection >= percent * union; ``texts``: id, text.

    The pairs of a document are dealt in lots of ``SALTED``; a lot gets the document's own text once and each
    partner's, side by side in one sorted stream."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    lots = saved(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SALTED)).alias("lot")), "lots")
    asked = lots.select("a", "lot", F.col("b").alias("id"), F.lit(1).alias("role")).unionByName(
        lots.select("a", "lot").distinct().withColumn("id", F.col("a")).withColumn("role", F.lit(0)))
    rows = only(texts, saved(asked, "asked")).select("a", "lot", "role", "id", "text")
    stream = rows.repartition("a", "lot").sortWithinPartitions("a", "lot", "role")

    def run(batches):
        own = None
        for fresh, b in grouped(batches, ("a", "lot")):
            role, ids = column(b, "role").to_numpy(), column(b, "id").to_numpy()
            a = column(b, "a")[0].as_py()
            out = []
            if fresh:
                own = None
            for i, j, values, off in shingle_sets(column(b, "text")):
                for r in range(j - i):
                    s = values[off[r]:off[r + 1]]
                    if role[i + r] == 0:
                        own = s
                        continue
                    both = np.concatenate([own, s])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(own) + len(s) - shared):
                        out.append(int(ids[i + r]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(out), pa.int64()), pa.array(out, pa.int64())], ["a", "b"])

    return stream.mapInArrow(run, "a long, b long")


def confirm_lists(lists: DataFrame, blocks: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """As ``confirm``, of ``lists`` (main, a, partners).  ``blocks``: main, blocks, into which its documents are dealt.
    A cell is two blocks: it gets each document's text that its lists name once."""
    def deal(batches):
        for b in batches:
            main, a, n = (column(b, k).to_numpy(zero_copy_only=False) for k in ("main", "a", "blocks"))
            size = np.diff(column(b, "partners").offsets.to_numpy())
            partner = column(b, "partners").flatten().to_numpy()
            row = np.repeat(np.arange(len(a)), size)
            x, y = (mix(k.view(np.uint64)) % n[row].astype(np.uint64) for k in (a[row], partner))
            x, y = np.minimum(x, y).astype(np.int32), np.maximum(x, y).astype(np.int32)
            order = np.lexsort((y, x, row))
            row, x, y, partner = row[order], x[order], y[order], partner[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            at = np.flatnonzero(first)
            named = np.unique(np.stack([np.tile(main[row], 2), np.tile(x, 2).astype(np.int64), np.tile(y, 2).astype(np.int64),
                                        np.concatenate([a[row], partner])], 1), axis=0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), pa.array(partner))
            names = ["main", "x", "y", "id", "partners"]
            yield pa.RecordBatch.from_arrays([pa.array(main[row[at]]), pa.array(x[at]), pa.array(y[at]), pa.array(a[row[at]]), lists], names)
            yield pa.RecordBatch.from_arrays([pa.array(named[:, 0]), pa.array(named[:, 1].astype(np.int32)), pa.array(named[:, 2].astype(np.int32)),
                                              pa.array(named[:, 3]), pa.nulls(len(named), pa.list_(pa.int64()))], names)

    cells = saved(lists.join(blocks, "main").mapInArrow(deal, "main long, x int, y int, id long, partners array<long>"), "cells")
    asked = saved(cells.where("partners is null").select("main", "x", "y", "id").distinct(), "asked")
    rows = only(texts, asked).select("main", "x", "y", F.lit(0).alias("role"), "id", "text", F.lit(None).cast("array<long>").alias("partners")).unionByName(
        cells.where("partners is not null").select("main", "x", "y", F.lit(1).alias("role"), "id", F.lit(None).cast("string").alias("text"), "partners"))
    stream = rows.repartition("main", "x", "y").sortWithinPartitions("main", "x", "y", "role")

    def run(batches):
        sets: dict[int, list[np.ndarray]] = {}
        for fresh, b in grouped(batches, ("main", "x", "y")):
            if fresh:
                sets = {}
            ids, partners = column(b, "id").to_pylist(), column(b, "partners")
            named = int((column(b, "role").to_numpy() == 0).sum())          # these come first
            for i, j, values, off in shingle_sets(column(b, "text").slice(0, named)):
                for r in range(j - i):
                    if off[r] < off[r + 1]:
                        sets.setdefault(ids[i + r], []).append(values[off[r]:off[r + 1]].copy())
            out = []
            for r in range(named, len(ids)):
                others = [(k, s) for k in partners[r].as_py() for s in sets.get(k, ())]
                if not others:
                    continue
                sizes = np.array([len(s) for _, s in others])
                values, cuts = np.concatenate([s for _, s in others]), np.cumsum(sizes) - sizes
                for own in sets.get(ids[r], ()):
                    held = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
                    shared = np.add.reduceat(held, cuts, dtype=np.int64)
                    out += [(ids[r], others[k][0]) for k in np.flatnonzero(100 * shared >= percent * (len(own) + sizes - shared))]
            if out:
                a, c = (np.array(k, np.int64) for k in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    return stream.mapInArrow(run, "a long, b long")


def contracted(e: DataFrame, lots: int) -> DataFrame:
    """Edges (u, v), v the smaller, with each lot of them replaced by stars around its components' smallest nodes."""
    def run(batches):
        parent: dict[int, int] = {}
        for b in batches:
            for u, v in zip(column(b, "u").to_pylist(), column(b, "v").to_pylist()):
                while (p := parent.setdefault(u, u)) != u:
                    parent[u] = u = parent[p]
                while (p := parent.setdefault(v, v)) != v:
                    parent[v] = v = parent[p]
                if u != v:
                    parent[max(u, v)] = min(u, v)
        out = []
        for u in parent:
            r = u
            while parent[r] != r:
                r = parent[r]
            if r != u:
                out.append((u, r))
        for k in range(0, len(out), 10_000):
            us, vs = zip(*out[k:k + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return e.coalesce(lots).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """Node and the smallest node of its component, for nodes of ``edges`` (a, b).  Lots of at most ``LOT`` edges are
    contracted by union-find, a task each; more lots than one are joined by large-star and small-star."""
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    lots = -(-e.count() // LOT)
    if lots:
        e = saved(contracted(e, lots), "edges")
    while lots > 1:
        # done when every node has one parent and no parent has one itself
        roles = e.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
            e.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        if roles.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or c > 0 and p > 0").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            e.join(least, "u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = saved(small.where("u <> v").distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def across_components(rows: DataFrame, nodes: DataFrame, most: Limits, best: int | None = None) -> DataFrame:
    """Pairs (a, b) that share a bucket, lie in different components and have close sketches.  ``rows``: key, rep,
    component; ``nodes``: rep, sketch and, without ``best``, keys and wide.  Members outside the bucket's largest
    component meet all others block by block; with ``best``, each proposes at most so many partners in a block, else
    all that are close, a pair in the first of its buckets: lists (main, a, partners) then."""
    near = rows.join(nodes, "rep")
    wide = best is None
    more = ["rep", "component", "sketch", *(["keys", "wide", "main"] if wide else [])]
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("rep"), blocks(n)).cast("int")
    others = F.col("members") - F.col("largest")
    left = near.where("component <> main").select(
        "key", block(others).alias("x"), F.explode(F.sequence(F.lit(0), blocks(F.col("members")) - 1)).alias("y"), F.lit(0).alias("role"), *more)
    right = near.select(
        "key", F.explode(F.sequence(F.lit(0), blocks(others) - 1)).alias("x"), block(F.col("members")).alias("y"), F.lit(1).alias("role"), *more)
    stream = left.unionByName(right).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "role")

    def words(b, name, size):
        return column(b, name).flatten().to_numpy().view(np.uint64).reshape(-1, size // 64)

    def close_here(own, other, i, j, key):
        """Whether wide sketches are close and the pair's first shared bucket is ``key``."""
        same = own[4][i] == other[4][j]
        here = own[4][i, same.argmax(1)] == key
        here[here] &= np.bitwise_count(own[3][i[here]] ^ other[3][j[here]]).sum(1, dtype=np.int32) <= most.wide
        return here

    def run(batches):
        own: list = []
        for fresh, b in grouped(batches, ("key", "x", "y")):
            role = column(b, "role").to_numpy()
            got = [column(b, "rep").to_numpy(), column(b, "component").to_numpy(), words(b, "sketch", SKETCH)]
            if wide:
                got += [words(b, "wide", WIDE), words(b, "keys", 64 * most.bands)]
                key, main = column(b, "key").to_numpy()[:1].view(np.uint64)[0], column(b, "main").to_numpy()[0]
            first = role == 0
            own = [x[first] for x in got] if fresh else [np.concatenate([o, x[first]]) for o, x in zip(own, got)]
            other = [x[~first] for x in got]
            for k in range(0, len(other[0]), BLOCK):
                rep, comp, sk = (x[k:k + BLOCK] for x in other[:3])
                bits = np.bitwise_count(own[2][:, None] ^ sk[None]).sum(2, dtype=np.int32)
                bits[own[1][:, None] == comp[None]] = SKETCH + 1
                if best:
                    j = np.argsort(bits, axis=1, kind="stable")[:, :best]
                    i = np.repeat(np.arange(len(j)), j.shape[1])
                    j = j.ravel()
                    ok = bits[i, j] <= most.near
                    i, j = i[ok], j[ok]
                else:
                    i, j = np.nonzero(bits <= most.sketch)
                    if len(i):
                        ok = np.concatenate([close_here(own, other, i[m:m + 4096], k + j[m:m + 4096], key) for m in range(0, len(i), 4096)])
                        i, j = i[ok], j[ok]
                    once = (comp[j] == main) | (own[0][i] < rep[j])     # two members outside the main component meet twice
                    i, j = i[once], j[once]
                if wide and len(i):
                    at = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), main)), pa.array(own[0][i[at]]),
                         pa.ListArray.from_arrays(pa.array(np.append(at, len(i)), pa.int32()), pa.array(rep[j]))], ["main", "a", "partners"])
                elif len(i):
                    a, c = own[0][i], rep[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    return stream.mapInArrow(run, "main long, a long, partners array<long>") if wide else stream.mapInArrow(run, "a long, b long").distinct()


def split_buckets(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (key, rep, component, main, members, largest) of buckets whose members lie in several components."""
    placed = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = (sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("members"),
                                     F.max("n").alias("largest"), F.count("*").alias("parts")).where("parts > 1").drop("parts"))
    return saved(placed.join(main, "key"), "split")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), kept (id is that)."""
    ship(docs.sparkSession)
    bounds = limits(percent)
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    sig = saved(signatures(src, bounds.bands), "signatures")
    named = sig.where((F.col("n") > 0) & F.col("id").isNotNull())
    reps = saved(named.groupBy("f1", "f2").agg(F.min(F.struct("id", "keys", "sketch", "n")).alias("s"))
                 .select("f1", "f2", F.col("s.id").alias("rep"), "s.keys", "s.sketch", "s.n"), "classes")

    bands = reps.select("rep", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("members")).where("members > 1")
    rows = saved(bands.join(shared.hint("shuffle_hash"), "key").where("rep <> center").select("key", "rep", "center"), "buckets")

    sketch = reps.select(F.col("rep"), "sketch")
    pairs = rows.select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    close = (pairs.join(sketch.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a")
             .join(sketch.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
             .where(differing_bits(F.col("sa"), F.col("sb")) <= bounds.sketch).select("a", "b"))
    texts = src.where(F.col("id").isNotNull())
    tested = saved(close, "pairs")
    links = saved(confirm(tested, texts, percent), "links")
    found = components(links)
    nodes = reps.select("rep", "sketch")
    for nth in range(ROUNDS + 1):
        split = split_buckets(rows, found)
        if split.isEmpty():
            break
        rows = split.select("key", "rep")           # a bucket once whole stays whole
        if nth == ROUNDS:
            nodes = reps.select("rep", "sketch", "keys").join(wide_sketches(split.select(F.col("rep").alias("id")).distinct(), texts), "rep")
            lists = saved(across_components(split, nodes, bounds), "lists")
            if not lists.isEmpty():
                blocks = (split.select("main", "rep").distinct().join(reps.select("rep", "n"), "rep").groupBy("main")
                          .agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / CELL)).alias("blocks")))
                found = components(links.unionByName(saved(confirm_lists(lists, blocks, texts, percent), "links")))
            break
        pairs = saved(across_components(split, nodes, bounds, BEST).join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tested = tested.unionByName(pairs)
        links = links.unionByName(saved(confirm(pairs, texts, percent), "links"))
        found = components(links)

    classes = reps.select("f1", "f2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "f1", "f2", F.coalesce("component", "rep").alias("component"))
    return sig.select("id", "n", "f1", "f2").join(classes, ["f1", "f2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The documents with one of each group (the smallest id), same columns; a row that repeats another's id and
    text goes too."""
    result = saved(near_duplicates(docs, id_col, text_col, percent).select(F.col(id_col).alias("found"), "kept"), "kept")
    gone = result.where("not kept").select(F.col("found").alias("id")).distinct()
    # a bitmap tells most documents that stay: those are not shuffled
    marked = spotted(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id")), gone)
    kept = marked.where("not seen").select("row").unionByName(marked.where("seen").join(gone, "id", "left_anti").select("row"))
    left = kept.select("row.*")
    repeated = result.where("kept and found is not null").groupBy("found").count().where("count > 1").select("found")
    if repeated.isEmpty():
        return left
    same = left[id_col].cast("long") == repeated["found"]
    return left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))
