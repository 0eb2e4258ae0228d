"""Exact top-k search by inner product with the threshold algorithm over sorted per-dimension lists.

Vectors are filed in blocks. In a block each dimension is a list of its vectors in order of the component. A query goes
down all lists at once, from the end that its component favours; what it meets is scored in full. No vector further down can beat
the sum of the query's components times the current entries, so it stops when that bound is below the kth score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

BLOCK, QUERIES, TOGETHER, FIRST_DEPTH = 4096, 512, 16, 32


def integer_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 1024) -> DataFrame:
    """``id, v``: floor(scale x) of every component as a long. Vectors that are null or hold null or non-finite components go."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col(key).alias("id"), x.alias("x")).where(F.col("x").isNotNull() & fine.alias("fine")).select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


class Lists:
    """A block of vectors with its sorted lists: ``rows`` by ascending component and ``values`` there, one line for each dimension.

    Scores are taken in ``kind``, which :func:`exact_kind` finds; ``values`` and bounds are wider, as no vector need be there.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kind: type):
        self.ids, self.vectors = ids, vectors.astype(kind)
        self.rows = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        self.values = np.take_along_axis(vectors.T, self.rows, axis=1).astype(np.int64 if kind is np.int64 else np.float64)


def exact_kind(m: np.ndarray, qs: np.ndarray) -> type:
    """The fastest type in which all inner products are exact: sums of absolute products stay under 2^24, 2^53 or else are integers."""
    long = [float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) for x in (m, qs)]
    big = float(np.abs(m).max(initial=0)) * float(np.abs(qs).max(initial=0)) * max(m.shape[1], 1)
    return np.float32 if long[0] * long[1] < 2**23 else np.float64 if big < 2**52 else np.int64


def threshold_search(lists: Lists, query: np.ndarray, own, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best of a block, ties to the smaller id; ``own`` is left out."""
    ids, vectors = lists.ids, lists.vectors
    n = len(ids)
    depth, step, left = 0, FIRST_DEPTH, n
    unseen = np.ones(n, bool)
    best_scores, best_ids = np.empty(0, vectors.dtype), np.empty(0, np.int64)
    wide, query, rising = query, query.astype(vectors.dtype), query < 0
    up, down = np.flatnonzero(rising), np.flatnonzero(~rising)
    while depth < n and left:
        to = min(n, depth + step)
        met = np.zeros(n, bool)
        met[lists.rows[up, depth:to]] = True
        met[lists.rows[down, n - to:n - depth]] = True
        fresh = np.flatnonzero(met & unseen)
        unseen[fresh] = False
        left -= len(fresh)
        scores = vectors[fresh] @ query
        if len(best_scores) == k:  # at a tie a smaller id may still come in
            fresh, scores = fresh[scores >= best_scores[-1]], scores[scores >= best_scores[-1]]
        elif len(scores) > 4 * k:  # one more than k, as the own row may be among them
            good = scores >= np.partition(scores, -k - 1)[-k - 1] if own is None or (ids[fresh] == own).sum() < 2 else slice(None)
            fresh, scores = fresh[good], scores[good]
        names = ids[fresh]
        if own is not None:
            scores, names = scores[names != own], names[names != own]
        scores, names = np.concatenate([best_scores, scores]), np.concatenate([best_ids, names])
        order = np.lexsort((names, -scores))[:k]
        best_scores, best_ids = scores[order], names[order]
        depth, step = to, step * 2
        if len(best_scores) == k and depth < n:
            bound = lists.values[up, depth - 1] @ wide[up] + lists.values[down, n - depth] @ wide[down]
            if bound < best_scores[-1]:  # at a tie a smaller id may still come
                break
    return best_scores, best_ids


def _packed(vectors: DataFrame, blocks, name: str) -> DataFrame:
    """Blocks of vectors of one dimension: ``d, <name>, ids, matrix``; a block is a hash range of ids."""
    dealt = vectors.select("id", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("id", "v"), blocks).cast("int").alias(name))
    return dealt.groupBy("d", name).agg(F.collect_list(F.struct("id", "v")).alias("rows")).select("d", name, F.col("rows.id").alias("ids"), F.flatten(F.col("rows.v")).alias("matrix"))


def _searched(k: int):
    """For one block of vectors and some blocks of queries the best of that block: ``query_id, vec_id, score``."""

    def run(key, filed: pa.Table, sought: pa.Table) -> pa.Table:
        d, out = key[0].as_py(), []
        for b in range(filed.num_rows if sought.num_rows else 0):
            whole = [np.array(filed.column(c)[b].values) for c in ("ids", "matrix")]
            m, exact = whole[1].reshape(-1, d), None
            for i in range(sought.num_rows):
                query_ids, flat = (np.array(sought.column(c)[i].values) for c in ("ids", "matrix"))
                qs = flat.reshape(-1, d)
                kind = exact_kind(m, qs)
                if exact is None or exact.vectors.dtype != kind:
                    exact = Lists(whole[0], m, kind)
                for own, x in zip(query_ids.tolist(), qs.astype(exact.values.dtype)):
                    scores, names = threshold_search(exact, x, own, k)
                    out.append((np.full(len(names), own), names, scores.astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out)] or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, block: int = BLOCK, queries: int = QUERIES, together: int = TOGETHER) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its k best other vectors (all, if fewer), ties to the smaller id.

    ``vectors`` has ``id`` and ``v`` (array of long); ``is_query`` is a condition on them. Blocks hold about ``block``
    vectors or ``queries`` queries whatever the table's size, and a block of vectors meets ``together`` blocks of queries at a
    time, so each task's memory is bounded. Both are copied to where they meet and grouped there by shuffles; no side can be
    broadcast, as the copies of few queries are as many as the vectors. Vectors of another dimension than the query's are not
    compared. A null id takes no part; an id that repeats is a candidate for each of its rows, but not for a query of the same id.
    """
    vectors = vectors.where("id is not null")
    asked = vectors.where(is_query)
    count, wanted = vectors.agg(F.count("id"), F.count_if(F.expr(is_query) if isinstance(is_query, str) else is_query)).first()
    n, q = -(-count // block) or 1, -(-wanted // queries) or 1
    each = lambda name, to: F.explode(F.sequence(F.lit(0), F.lit(to - 1))).alias(name)
    filed = _packed(vectors, n, "c").select("d", "c", each("g", -(-q // together)), "ids", "matrix")
    sought = _packed(asked, q, "q").select("d", each("c", n), F.floor(F.col("q") / together).cast("int").alias("g"), "ids", "matrix")
    # Few bytes are much work here, so the tasks are not left to the size of the data.
    filed, sought = (df.repartition(2 * n * -(-q // together), "d", "c", "g") for df in (filed, sought))
    groups = filed.groupBy("d", "c", "g").cogroup(sought.groupBy("d", "c", "g"))
    found = groups.applyInArrow(_searched(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
