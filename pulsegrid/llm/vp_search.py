"""Nearest neighbours by vantage-point trees, one per shard.

Nearness is the inner product.  With ``sqrt(M^2 - |x|^2)`` as one more
component (M: the largest length of all vectors) a larger inner product is a
smaller Euclidean distance, which has the triangle inequality that the trees
prune by.  A subtree is skipped when its distance from the query is at least
``best / factor``, where ``best`` is the query's k-th distance so far: factor
1 is exact, larger factors prune more.

Rows are dealt to shards of bounded size by a hash of their id, so copies of
one vector spread over all shards.  In a shard equal vectors are one point
with its sorted ids.  Queries go to the shards in blocks; each shard answers
with its k best, and the k best of those are kept.

Vectors that are null, zero or hold null or non-finite components take no
part.  Rows without an id take no part either; equal ids are separate
candidates, none of which is found for a query of that id.  All vectors must
be of the commonest length; others take no part.  Ties go to the smaller id,
among different vectors too: all points as near as the k-th, up to rounding,
are ordered by their exact scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import cut_lineage

SHARD_ROWS = 8192
BLOCK_QUERIES = 32_768
STEP_QUERIES = 512
LEAF = 256
FACTOR = 1.0
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (array<double>) of the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (size["n"] if size else 0))


class VantageTree:
    """A tree over distinct points; inner nodes hold (point, radius), leaves ranges of points."""

    def __init__(self, points, leaf: int = LEAF):
        import numpy as np

        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        self.root = self._build(0, len(points))

    def _distances(self, rows, point):
        import numpy as np

        return np.sqrt(((self.points[rows] - self.points[point]) ** 2).sum(1))

    def _build(self, a: int, b: int):
        import numpy as np

        rows = self.order[a:b]
        if b - a <= self.leaf:
            return (a, b)
        # the point farthest from an arbitrary one separates better than that one
        vantage = rows[int(self._distances(rows, rows[0]).argmax())]
        far = self._distances(rows, vantage)
        middle = (b - a) // 2
        ranked = np.argpartition(far, middle)
        radius = far[ranked[middle]]
        self.order[a:b] = rows[ranked]
        inner, outer = far[ranked[:middle]].max(), far[ranked[middle:]].max()
        return (vantage, radius, inner, outer, self._build(a, a + middle), self._build(a + middle, b))

    def search(self, queries, k: int, factor: float, visit):
        """Calls ``visit(query rows, point rows, squared distances)``, which returns the squared distance that still matters to those queries."""
        import numpy as np

        best = np.full(len(queries), np.inf)
        square_q, square_p = (queries**2).sum(1), (self.points**2).sum(1)

        def walk(node, active):
            if len(active) == 0:
                return
            if len(node) == 2:
                rows = self.order[node[0] : node[1]]
                far = square_q[active, None] + square_p[rows] - 2 * queries[active] @ self.points[rows].T
                best[active] = np.sqrt(visit(active, rows, np.maximum(far, 0)))
                return
            vantage, radius, inner, outer, near_node, far_node = node
            away = np.sqrt(np.maximum(((queries[active] - self.points[vantage]) ** 2).sum(1), 0))
            inside = away < radius
            # the least distance that any point of the part can have
            low_near, low_far = np.maximum(away - inner, 0), np.maximum(np.maximum(radius - away, away - outer), 0)
            slack = 1e-9 * (1 + away)
            for first in (True, False):
                pick = inside if first else ~inside & (low_near - slack <= best[active] / factor)
                walk(near_node, active[pick])
                pick = ~inside if first else inside & (low_far - slack <= best[active] / factor)
                walk(far_node, active[pick])

        walk(self.root, np.arange(len(queries)))


def search_shard(ids, vectors, query_ids, queries, limit: float, k: int, factor: float):
    """The k best of one shard for each query: query ids, ids and exact scores."""
    import numpy as np

    distinct, owner = np.unique(vectors, axis=0, return_inverse=True)
    by_owner = ids[np.lexsort((ids, owner.ravel()))]
    first = np.concatenate([[0], np.cumsum(np.bincount(owner.ravel(), minlength=len(distinct)))])
    tree = VantageTree(np.c_[distinct, np.sqrt(np.maximum(limit**2 - (distinct**2).sum(1), 0))])
    wide = min(k + 1, len(distinct))  # one more: the query's own vector
    out = ([], [], [])
    for a in range(0, len(queries), STEP_QUERIES):
        asked, own = queries[a : a + STEP_QUERIES], query_ids[a : a + STEP_QUERIES]
        distance = np.full((len(asked), wide), np.inf)
        # rounding of squared distances: within it, points are as near as the k-th
        margin = 1e-11 * (limit**2 + (asked**2).sum(1))
        kept: list[tuple] = []

        def visit(active, rows, far, distance=distance, margin=margin, kept=kept):
            d = np.concatenate([distance[active], far], 1)
            distance[active] = np.partition(d, wide - 1, 1)[:, :wide]
            reach = distance[active].max(1) + margin[active]
            q, p = np.nonzero(far <= reach[:, None])
            kept.append((active[q], rows[p], far[q, p]))
            return reach

        tree.search(np.c_[asked, np.zeros(len(asked))], k, factor, visit)
        by, point, far = (np.concatenate(x) for x in zip(*kept, strict=True))
        near = far <= distance.max(1)[by] + margin[by]
        by, point = by[near], point[near]
        order = np.argsort(by, kind="stable")
        point, bounds = point[order], np.searchsorted(by[order], np.arange(len(asked) + 1))
        for q in range(len(asked)):
            found = point[bounds[q] : bounds[q + 1]]
            # row sums: the same figure for equal vectors in every shard
            score = (distinct[found] * asked[q]).sum(1)
            # k + 1 copies of a point are enough for the k best but the query's own
            rows = np.concatenate([by_owner[first[p] : min(first[p + 1], first[p] + k + 1)] for p in found])
            score = np.repeat(score, np.minimum(first[found + 1] - first[found], k + 1))
            other = rows != own[q]
            rows, score = rows[other], score[other]
            top = np.lexsort((rows, -score))[:k]
            out[0].append(np.full(len(top), own[q]))
            out[1].append(rows[top])
            out[2].append(score[top])
    return [np.concatenate(x) if x else np.zeros(0) for x in out]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """For each query row its ``k`` nearest rows of ``vectors`` but its own: ``query_id, rank, vec_id, score``.

    Both frames have ``vec_id`` and ``v`` (see :func:`usable`).
    """
    vectors, queries = cut_lineage(vectors), cut_lineage(queries)
    size = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    shards = max(1, -(-size["n"] // shard_rows))
    blocks = max(1, -(-queries.count() // block_queries))
    limit = float(size["m"] or 0.0) ** 0.5

    def search(key, left, right):
        import numpy as np
        import pyarrow as pa

        def matrix(t):
            flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(t.num_rows, -1)

        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pydict({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = search_shard(left.column("vec_id").to_numpy(), matrix(left), right.column("vec_id").to_numpy(), matrix(right), limit, k, factor)
        return pa.Table.from_arrays([pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int64)), pa.array(found[2].astype(float))], ["query_id", "vec_id", "score"])

    # a unit of work is one shard and one block of queries
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
