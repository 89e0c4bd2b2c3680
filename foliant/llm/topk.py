"""Exact top-k by inner product, pruned with segment means and deviations from coarse to fine.

|a - b|^2 >= sum over segments of n ((mean_a - mean_b)^2 + (dev_a - dev_b)^2); with 2<a,b> = |a|^2 + |b|^2 - |a - b|^2 the same
bound says <a,b> <= sum of n (mean_a mean_b + dev_a dev_b). Splitting segments only tightens it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.shared import materialise

K, SCALE, QUERY_BLOCK, LEVELS, ROWS, PAIRS = 10, 1024, 4096, (4, 16), 512, 50_000
_LONG = 2**63 - 1


class Block:
    """Vectors of one dimension as integers, with the statistics of each level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: tuple[int, ...]):
        self.ids = ids
        self.whole = np.floor(SCALE * vectors)
        self.most = float(np.abs(self.whole).max(initial=0))
        self.stats = []
        for n in levels:
            parts = np.array_split(self.whole, min(n, max(1, vectors.shape[1])), axis=1)
            mean = np.stack([p.mean(1) for p in parts], 1)
            dev = np.stack([p.std(1) for p in parts], 1)
            root = np.sqrt([p.shape[1] for p in parts])
            self.stats.append(np.concatenate([mean * root, dev * root], 1))
        self.norm = np.sqrt((self.whole**2).sum(1))


def products(a: Block, i: np.ndarray, b: Block, j: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs; beyond the range of long they are set to its end."""
    dim = a.whole.shape[1]
    out = np.empty(len(i), np.int64)
    small = a.most * b.most * dim < 2**53
    for s in range(0, len(i), PAIRS):
        x, y = a.whole[i[s : s + PAIRS]], b.whole[j[s : s + PAIRS]]
        if small:
            out[s : s + PAIRS] = np.einsum("nd,nd->n", x, y)
        else:
            out[s : s + PAIRS] = [max(-_LONG - 1, min(_LONG, sum(int(p) * int(q) for p, q in zip(u, v)))) for u, v in zip(x, y)]
    return out


def best_of(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score.astype(object) if (score == -_LONG - 1).any() else -score, q))
    q, score, ids = q[order], score[order], ids[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else q
    return q[rank < k], score[rank < k], ids[rank < k]


class Search:
    """The best k + 1 so far of each query, its own row included, against blocks of vectors of the same dimension.

    The queries are rows themselves, so the scores among them bound what a query's best are at least before the first block
    is read. ``left``: pairs met, and those that each level left.
    """

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k + 1
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        n = len(queries.ids)
        self.left = np.zeros(1 + len(queries.stats), np.int64)
        self.least = np.full(n, -np.inf)
        if n >= self.k:
            for a in range(0, n, 256):
                own = queries.whole[a : a + 256] @ queries.whole.T
                worst = np.partition(own, n - self.k, axis=1)[:, n - self.k]
                self.least[a : a + 256] = worst - 1 - 1e-9 * np.abs(own).max(axis=1)

    def add(self, block: Block) -> None:
        n = len(self.queries.ids)
        i, j = np.divmod(np.arange(n * len(block.ids)), len(block.ids))
        self.left[0] += len(i)
        for level, (a, b) in enumerate(zip(self.queries.stats, block.stats), 1):
            # the coarse level for all pairs at once, the finer ones only for what is left
            bound = (a @ b.T).ravel() if level == 1 else np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", a[i[s : s + PAIRS]], b[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS))])
            stay = bound + 1e-9 * self.queries.norm[i] * block.norm[j] + 1 >= self.least[i]
            i, j = i[stay], j[stay]
            self.left[level] += len(i)
        score = products(self.queries, i, block, j)
        good = score >= self.least[i]
        q, s, v = (np.concatenate(x) for x in zip(self.held, (i[good], score[good], block.ids[j[good]])))
        self.held = best_of(q, s, v, self.k)
        count = np.bincount(self.held[0], minlength=n)
        worst = np.full(n, np.inf)
        np.minimum.at(worst, self.held[0], self.held[1].astype(float))
        self.least = np.maximum(self.least, np.where(count >= self.k, np.nextafter(worst, -np.inf), -np.inf))


def _by_dimension(ids: np.ndarray, vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.diff(np.r_[0, ends])
    out = {}
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        out[int(dim)] = ids[own], flat[(ends[own] - dim)[:, None] + np.arange(dim)]
    return out


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = K, query_block: int = QUERY_BLOCK, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query, ties to the smaller id.

    Queries are the rows whose integer id is divisible by ``every``; candidates are all rows but the query's own.
    Each component is floor(1024 x) and the score the integer inner product. Rows with a null id, a null vector or a null or
    non-finite component take no part; vectors of another length than the query's aren't compared; fewer than k
    candidates are all returned. Repeated rows are candidates each and queries each: rows that share an id get a list each,
    in which the others take part. An empty table gives no rows; further columns aren't read.

    Queries go out in blocks of about ``query_block``, whatever their number, each against all rows; each task keeps k + 1 rows a
    query. Of these one that has the query's id and its score with itself is the query's own.
    """
    spark = vectors.sparkSession
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias(vector_col)).where(sound).withColumnRenamed(vector_col, "v")
    queries = rows.where(F.col("id") % every == 0)
    blocks = max(1, math.ceil(queries.count() / query_block))
    parts = []
    for block in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block).toArrow()
        ids = asked.column("id").to_numpy()
        shared = spark.sparkContext.broadcast((ids, pa.chunked_array(asked.column("v")).combine_chunks() if len(ids) else None))

        def work(batches, shared=shared):
            ids, v = shared.value
            searches = {d: Search(Block(*x, levels), k) for d, x in _by_dimension(ids, v).items()} if len(ids) else {}
            first = dict(zip(searches, np.cumsum([0, *(len(x.queries.ids) for x in searches.values())])))
            for batch in batches:
                for start in range(0, len(batch), ROWS):
                    part = batch.slice(start, ROWS)
                    for d, x in _by_dimension(part.column("id").to_numpy(), part.column("v")).items():
                        if d in searches:
                            searches[d].add(Block(*x, levels))
            for d, search in searches.items():
                q, score, v = search.held
                every_own = np.arange(len(search.queries.ids))
                own = products(search.queries, every_own, search.queries, every_own)
                self_like = (v == search.queries.ids[q]) & (score == own[q])
                yield pa.RecordBatch.from_arrays([pa.array(q + first[d]), pa.array(search.queries.ids[q]), pa.array(v), pa.array(score), pa.array(self_like)], ["q", "query_id", "vec_id", "score", "own"])

        got = rows.mapInArrow(work, "q long, query_id long, vec_id long, score long, own boolean")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
        # without the first of the rows like the query's own, which is itself; where none is held, the k + 1 best are others
        itself = F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("q"))
        got = got.withColumn("_self", itself).where("_self is null or rank <> _self").withColumn("rank", F.col("rank") - F.coalesce((F.col("rank") > F.col("_self")).cast("int"), F.lit(0)))
        got = got.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(materialise(got, "topk") if blocks > 1 else got)
        if blocks > 1:
            shared.unpersist()
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r
), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10
"""
