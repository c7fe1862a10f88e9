"""Hard negatives by a vertical scan of vector components (BOND).

Components are whole numbers ``floor(256 x)``; a score is the inner product
with the anchor, exact.  An anchor's positives are its best other rows of the
same label; a negative of a positive is a row of another label whose score is
between 0.5 and 0.95 of the positive's (both included, in whole numbers).

*Vertical scan.*  A shard holds its vectors by component.  For each anchor the
components are read in order of the anchor's magnitude, largest first.  After
each step a row's score lies between its partial sum plus the least and plus
the greatest that the components still to come can add (from the shard's
minimum and maximum of each).  Rows that cannot be among the k best, or in any
window that still has a place, leave the candidates; those that remain at the
end have exact scores.  Ties are never pruned, so ties to the smaller id hold.

Two passes: positives of all shards are merged first, since the windows depend
on them; then negatives.  The unit of work is a shard of rows and a block of
anchors, both of bounded size; a shard answers with at most ``k`` rows an
anchor or window, so copies of one vector never pile up.

Rows with a null label, id or vector, or a null or non-finite component take
no part, neither do empty vectors.  Vectors of different lengths have no inner
product and are not compared.  Repeated rows are rows of their own; a row is
never its own positive, but a copy of it can be.  Equal ids are ordered
arbitrarily.  Scores must fit 64 bits: an overflow raises an error.  An anchor
without positives, and an empty table, give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.memory import released
from pulsegrid.session import cut_lineage

POSITIVES, NEGATIVES = 5, 3
SCALE, LOW, HIGH = 256, 50, 95
SHARD_VALUES, SMALL_SHARD, BLOCK_ANCHORS, STEPS = 1 << 23, 2048, 32_768, 8
BEST = "anchor_row long, anchor_id long, row long, vec_id long, score long"
WINDOWED = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, vec_id long, row long, score long"


def usable(vectors: DataFrame, label=None) -> DataFrame:
    """``row, vec_id, label, v`` (array<long>) of the rows that take part; ``label`` replaces the label column."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), x.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("v", lambda c: F.floor(c * SCALE)).alias("v"))


class Shard:
    """Vectors by component, with the least and greatest value of each."""

    def __init__(self, ids, rows, labels, matrix):
        import numpy as np

        self.ids, self.rows, self.labels = ids, rows, labels
        self.by = np.ascontiguousarray(matrix.T)
        self.low, self.high = self.by.min(1), self.by.max(1)
        self.reach = np.maximum(np.abs(self.low), np.abs(self.high))

    def scan(self, anchor, allowed, keep):
        """Rows (of ``allowed``) with their exact scores that ``keep(least, greatest)`` leaves after every step."""
        import numpy as np

        order = np.argsort(-np.abs(anchor), kind="stable")
        # sums below 2**53 are exact in doubles; others are added as Python's whole numbers
        exact = float(np.abs(anchor.astype(float)) @ self.reach.astype(float)) < 2.0**53
        kind = float if exact else object
        q = anchor.astype(kind)
        ends = np.stack([q * self.low.astype(kind), q * self.high.astype(kind)])
        least = np.concatenate([np.cumsum(ends.min(0)[order][::-1])[::-1], [0]])
        most = np.concatenate([np.cumsum(ends.max(0)[order][::-1])[::-1], [0]])
        candidates, partial = allowed, np.zeros(len(allowed), kind)
        width = -(-len(order) // STEPS)
        for a in range(0, len(order), width):
            some = order[a : a + width]
            block = self.by[some] if len(candidates) == self.by.shape[1] else self.by[np.ix_(some, candidates)]
            partial = partial + q[some] @ block.astype(kind)
            b = min(a + width, len(order))
            stay = keep(partial + least[b], partial + most[b])
            candidates, partial = candidates[stay], partial[stay]
            if not len(candidates):
                break
        return candidates, partial


def _kth(values, k: int):
    """The k-th largest value; below everything if there are fewer."""
    import numpy as np

    if len(values) < k:
        return -float("inf")
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


def best_of(shard: Shard, anchor, allowed, k: int):
    """The k best rows of ``allowed``, ties to the smaller id: positions and scores."""
    import numpy as np

    found, score = shard.scan(anchor, allowed, lambda least, most: most >= _kth(least, k))
    order = np.lexsort((shard.ids[found], -score.astype(float))) if score.dtype != object else np.array(sorted(range(len(found)), key=lambda i: (-score[i], shard.ids[found[i]])), int)
    return found[order[:k]], score[order[:k]]


def in_windows(shard: Shard, anchor, allowed, windows, k: int):
    """For each window (least, greatest score) its k best rows of ``allowed``."""
    import numpy as np

    distinct = sorted({w for w in windows if w[0] <= w[1]})

    def keep(least, most):
        stay = np.zeros(len(least), bool)
        for low, high in distinct:
            sure = least[(least >= low) & (most <= high)]
            stay |= (most >= max(low, _kth(sure, k))) & (least <= high)
        return stay

    if not distinct:
        return [(np.zeros(0, int), np.zeros(0))] * len(windows)
    found, score = shard.scan(anchor, allowed, keep)
    order = np.array(sorted(range(len(found)), key=lambda i: (-score[i], shard.ids[found[i]])), int) if score.dtype == object else np.lexsort((shard.ids[found], -score))
    found, score = found[order], score[order]
    out = []
    for low, high in windows:
        inside = np.flatnonzero((score >= low) & (score <= high))[:k]
        out.append((found[inside], score[inside]))
    return out


def window_of(positive: int) -> tuple[int, int]:
    """Scores s with ``LOW * positive <= 100 * s <= HIGH * positive``."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def _matrix(t):
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(t.num_rows, -1)


def _units(rows: DataFrame, anchors: DataFrame):
    """Rows and anchors dealt to units (length of vectors, shard, block), each with all others once."""
    spark = rows.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    sizes = {r["size"]: r for r in rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()}
    asked = {r["size"]: r["n"] for r in anchors.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()}
    # shards of bounded size; smaller ones while there are fewer than tasks
    shards = {s: max(-(-r["n"] * s // SHARD_VALUES), min(tasks, -(-r["n"] // SMALL_SHARD))) for s, r in sizes.items()}
    blocks = {s: max(1, -(-n // BLOCK_ANCHORS)) for s, n in asked.items()}
    pick = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("size")] if d else F.lit(1)
    both = [s for s in sizes if s in asked]
    shard_of, block_of = pick({s: shards[s] for s in both}), pick({s: blocks[s] for s in both})
    sized = lambda d: d.withColumn("size", F.size("v")).filter(F.col("size").isin(both) if both else F.lit(False))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = sized(rows).withColumn("shard", F.pmod(F.xxhash64("row"), shard_of).cast("int")).withColumn("block", spread(block_of))
    right = sized(anchors).withColumn("block", F.pmod(F.xxhash64("row"), block_of).cast("int")).withColumn("shard", spread(shard_of))
    keys = ["size", "shard", "block"]
    return left.groupBy(*keys), right.groupBy(*keys)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``rows`` as from :func:`usable`, stored; ``anchors`` some of them."""
    import pyarrow as pa

    def table_of(columns, names):
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32() if n == "place" else pa.int64() for n in names], strict=True)], names)

    names = [f.split()[0] for f in BEST.split(", ")]
    windowed = [f.split()[0] for f in WINDOWED.split(", ")]

    def shard_and_anchors(left, right):
        shard = Shard(left.column("vec_id").to_numpy(), left.column("row").to_numpy(), left.column("label").to_numpy(), _matrix(left))
        return shard, right.drop_columns(["v"]).to_pylist(), _matrix(right)

    def positive(left, right):
        import numpy as np

        out = [[] for _ in names]
        if left.num_rows and right.num_rows:
            shard, asked, vectors = shard_and_anchors(left, right)
            for a, v in zip(asked, vectors, strict=True):
                found, score = best_of(shard, v, np.flatnonzero((shard.labels == a["label"]) & (shard.rows != a["row"])), positives)
                for i, s in zip(found.tolist(), score.tolist(), strict=True):
                    for column, value in zip(out, (a["row"], a["vec_id"], int(shard.rows[i]), int(shard.ids[i]), int(s)), strict=True):
                        column.append(value)
        return table_of(out, names)

    def negative(left, right):
        import numpy as np

        out = [[] for _ in windowed]
        if left.num_rows and right.num_rows:
            shard, asked, vectors = shard_and_anchors(left, right)
            for a, v in zip(asked, vectors, strict=True):
                found = in_windows(shard, v, np.flatnonzero(shard.labels != a["label"]), [window_of(p["score"]) for p in a["positives"]], negatives)
                for p, (at, score) in zip(a["positives"], found, strict=True):
                    for i, s in zip(at.tolist(), score.tolist(), strict=True):
                        values = (a["row"], a["vec_id"], p["place"], p["vec_id"], p["score"], int(shard.ids[i]), int(shard.rows[i]), int(s))
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
        return table_of(out, windowed)

    anchors = cut_lineage(anchors)  # a table of its own: both sides of a cogroup must not share columns
    left, right = _units(rows, anchors)
    near = left.cogroup(right).applyInArrow(positive, BEST)
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id", "row")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    chosen = near.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"))
    asked = cut_lineage(anchors.join(chosen, "row"))
    left, right = _units(rows, asked)
    far = left.cogroup(right).applyInArrow(negative, WINDOWED)
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "vec_id", "row")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
