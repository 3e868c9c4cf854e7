"""Exact top-k search (9): MaxScore over shards of quantised vectors.

A vector's components become integers, and each component is a term with its weight.  For a query, a term's
contribution to any candidate of a shard lies between two bounds (the query's weight times the shard's least and
greatest component); taken above its lower bound it is never negative, so MaxScore's bounds hold.  Terms are sorted
by bound.  The trailing terms whose bounds together cannot lift a candidate into the current top k are
non-essential; the essential terms are traversed for the candidates first, then the others are probed one block of
terms at a time, and a candidate goes as soon as its partial score plus the bounds of its unread terms is below the
k-th best score so far.  Each shard starts from the k-th best of a few fully scored candidates.  The shards' top k
are merged by rank.

Shards hold at most ``SHARD`` candidates (a random split, so that equal vectors spread) and query blocks at most
``BLOCK`` queries; each pair of shard and block is one row of work, joined on the shard, so that neither side is
held whole anywhere.  Ties go to the smaller id.

Cases: null vectors, and vectors with null or non-finite components, take no part, nor do rows without an id; an
empty vector scores 0; of vectors of different lengths, missing components count as 0; rows that share an id are
candidates each, but never of their own id; clashing extra columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrowtext import column, ship

SHARD = 4096        # candidates
BLOCK = 1024        # queries
TERMS = 8           # terms read at a time
LOW = -(1 << 62)


def top_of_shard(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query number, id, score) of the k best candidates of each query within a shard; ids ascending."""
    n, dims = vectors.shape
    least, most = vectors.min(0), vectors.max(0)
    by_term = np.ascontiguousarray(vectors.T)                         # a term's postings: its weight in each candidate
    out_q, out_id, out_score = [], [], []
    seed = min(n, 16 * k)
    first = vectors[:seed] @ queries.T                               # seeds of the threshold, fully scored
    for i, q in enumerate(queries):
        own = ids == query_ids[i]
        start = first[:, i][~own[:seed]]
        bar = int(np.partition(start, len(start) - k)[len(start) - k]) if len(start) >= k else LOW
        a, b = q * least, q * most
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.argsort(low - high, kind="stable")               # widest range first
        order = order[q[order] != 0]
        spread = (high - low)[order]
        rest = np.concatenate([np.cumsum(spread[::-1])[::-1], [0]])  # what the terms from each place on can add
        floor = int(low.sum())
        # non-essential: the longest tail of terms that cannot reach the bar by itself
        essential = int(np.searchsorted(-(floor + rest), -bar, "right"))
        at = np.arange(n)
        score = np.zeros(n, np.int64)
        remaining_low = floor
        done = 0
        while done < len(order) and len(at):
            size = max(TERMS, essential // 2) if done < essential else TERMS
            terms = order[done:done + size]
            part = by_term[terms] if len(at) == n else by_term[np.ix_(terms, at)]
            score = score + q[terms] @ part
            remaining_low -= int(low[terms].sum())
            done += len(terms)
            if done < len(order):
                keep = score + (remaining_low + int(rest[done])) >= bar
                if not keep.all():
                    at, score = at[keep], score[keep]
        mine = ids[at] != query_ids[i]
        at, score = at[mine], score[mine]
        if len(at) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= cut
            at, score = at[keep], score[keep]
        best = np.lexsort((ids[at], -score))[:k]
        out_q.append(np.full(len(best), i))
        out_id.append(ids[at[best]])
        out_score.append(score[best])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(out_q), join(out_id), join(out_score)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * component) of a vector whose components are all finite, else null."""
    wide = vector.cast("array<double>")
    ok = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(ok, F.transform(wide, lambda x: F.floor(x * scale)))


def _packed(df: DataFrame, group: str) -> DataFrame:
    """One row per group: ids and vectors as arrays of the group's rows (bounded by the group's size)."""
    return df.groupBy(group).agg(F.collect_list(F.struct("id", "vec")).alias("rows"))


def _matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids (ascending) and the matrix of one packed group; short vectors are filled with zeros."""
    flat = rows.flatten()
    ids = flat.field("id").to_numpy(zero_copy_only=False).astype(np.int64)
    vec = flat.field("vec")
    size = np.diff(vec.offsets.to_numpy())
    out = np.zeros((len(ids), int(size.max()) if len(size) else 0), np.int64)
    values = vec.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(ids)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
           scale: int = 256) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), ``id_col``, score.  ``is_query`` picks the
    queries by the column ``id``."""
    spark = vectors.sparkSession
    ship(spark)
    src = (vectors.select(vectors[id_col].cast("long").alias("id"), quantised(vectors[vector_col], scale).alias("vec"))
           .where(F.col("id").isNotNull() & F.col("vec").isNotNull()))
    queries = src.where(is_query)
    n, m = src.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    # a group's size varies about its mean; half the limit on average keeps it below in practice
    shards, blocks = (2 * shards if shards > 1 else 1), (2 * blocks if blocks > 1 else 1)
    spread = lambda seed, parts: F.pmod(F.xxhash64("id", F.monotonically_increasing_id(), F.lit(seed)), F.lit(parts))
    candidates = _packed(src.withColumn("shard", spread(1, shards)), "shard")
    asked = (_packed(queries.withColumn("block", spread(2, blocks)), "block")
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))
    work = candidates.withColumnRenamed("rows", "candidates").join(asked.withColumnRenamed("rows", "asked"), "shard").select("candidates", "asked")

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, mat = _matrix(column(b, "candidates").slice(r, 1))
                qids, qs = _matrix(column(b, "asked").slice(r, 1))
                width = max(mat.shape[1], qs.shape[1])
                mat, qs = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (mat, qs))
                if not width:
                    mat, qs = np.zeros((len(ids), 1), np.int64), np.zeros((len(qids), 1), np.int64)
                i, found, score = top_of_shard(qs, qids, mat, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(found), pa.array(score)], ["query_id", "id", "score"])

    from pyspark.sql import Window as W

    parts = max(1, min(shards * blocks, 4 * spark.sparkContext.defaultParallelism))
    found = work.repartition(parts).mapInArrow(run, "query_id long, id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
