"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

Turns of a conversation are ordered by ``turn``, null first; equal turns by a
digest of role and text (``md5(md5(role) || text)``), equal rows are turns of
their own.  Null role or text is empty.  Rows without ``conv_id`` take no part.

*Rebuilding* (:func:`rebuilt`).  Conversation c gets the first h turns of
conversation ``c - c % 20`` (all if fewer, none if absent), then its own turns
after its first h; h is ``crc32(decimal c) % 4``.

*Nodes* (:func:`trie`).  A node is a distinct sequence of first turns, known by
its depth and 128 bits: running sums of hashes of (turn, position).  Texts are
hashed in the scan and never moved.  Positions come from one sort by ranges
that cuts long conversations too, running sums from chunks of positions.

*Contraction* (:func:`subtree_totals`).  Each round rakes all leaves into their
parents, then compresses chains: a node with one child whose coin is 1 and
whose parent's coin is 0 is taken out, and its child remembers its sum.  After
about log n rounds only the root is left.  Nodes taken out get their totals
back in reverse order, from the child they were joined to.

Parents that hold at least a two-thousandth of all (conversation, depth) pairs
are at most two thousand rows, so they are broadcast; the rest is joined by a
shuffle in which no key is hotter than that.  The members that end in a node
are hashed as a stream of strings for 4096 ids each, in one task per node, as
the hash demands.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.memory import released
from pulsegrid.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
GROUP, HEADS, CHUNK_BITS, END_BITS, HOT = 20, 3, 12, 12, 2000
KEY = ["k1", "k2", "k3", "k4"]
PARENT_KEY = ["q1", "q2", "q3", "q4"]


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, d, digest, words, size`` of all rebuilt conversations, and ``conv_id, size`` of each."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.md5(role), text)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("salt"),
    )
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest"), F.col("salt")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt", "turn")
    # numbers rise inside a task and from task to task
    turns = cut_lineage(ranged.withColumn("number", F.monotonically_increasing_id())).withColumn("part", F.shiftright("number", 33))
    parts = cut_lineage(turns.groupBy("conv_id", "part").agg(F.min("number").alias("first"), F.count("*").alias("n")))

    sizes = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumns(
        {"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, "base": F.col("conv_id") - F.col("conv_id") % GROUP}
    )
    bases = sizes.select(F.col("conv_id").alias("base"), F.least("n", F.lit(HEADS)).alias("there"))
    given = F.least("h", F.coalesce("there", F.lit(0)))
    known = sizes.join(bases, "base", "left").select("conv_id", "base", "h", given.alias("given"), (given + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    known = cut_lineage(known)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = turns.join(starts.join(known, "conv_id"), ["conv_id", "part"])
    placed = cut_lineage(placed.withColumn("p", F.col("start") + F.col("number") - F.col("first") + 1).select("conv_id", "p", "h", "given", "size", "digest", "words"))

    own = placed.filter("p > h").select("conv_id", (F.col("p") - F.col("h") + F.col("given")).alias("d"), "digest", "words", "size")
    heads = placed.filter((F.col("p") <= HEADS) & (F.col("conv_id") % GROUP == 0)).select(F.col("conv_id").alias("base"), F.col("p").alias("d"), "digest", "words")
    taken = known.filter("given > 0").select("conv_id", "base", "given", "size").join(heads, "base").filter("d <= given")
    return own.unionByName(taken.select("conv_id", "d", "digest", "words", "size")), known.select("conv_id", "size")


def _pieces(d: Column) -> list[Column]:
    """Four hashes of 32 bits of a turn at its position; sums of two thousand million of them fit 64 bits."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    one, two = F.xxhash64("digest", d), F.xxhash64(F.lit(7), d, F.col("digest"))
    return [low(one), F.shiftrightunsigned(one, 32), low(two), F.shiftrightunsigned(two, 32)]


def members(turns: DataFrame) -> DataFrame:
    """``conv_id, d, words, last`` and the node keys of every first part of every conversation, and of the one before."""
    hashed = turns.select("conv_id", "d", "words", (F.col("d") == F.col("size")).alias("last"), F.shiftright("d", CHUNK_BITS).alias("chunk"), *(c.alias(f"t{i}") for i, c in enumerate(_pieces(F.col("d")), 1)))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    hashed = hashed.select("*", *(F.sum(f"t{i}").over(inside).alias(f"s{i}") for i in range(1, 5)))
    # what earlier chunks of a long conversation add up to
    sums = turns.filter(F.col("size") >= 1 << CHUNK_BITS).select("conv_id", F.shiftright("d", CHUNK_BITS).alias("chunk"), *(c.alias(f"t{i}") for i, c in enumerate(_pieces(F.col("d")), 1)))
    sums = sums.groupBy("conv_id", "chunk").agg(*(F.sum(f"t{i}").alias(f"t{i}") for i in range(1, 5)))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("conv_id", "chunk", *(F.sum(f"t{i}").over(before).alias(f"c{i}") for i in range(1, 5)))
    keyed = hashed.join(carry, ["conv_id", "chunk"], "left")
    total = [F.col(f"s{i}") + F.coalesce(f"c{i}", F.lit(0)) for i in range(1, 5)]
    return keyed.select("conv_id", "d", "words", "last", *(t.alias(k) for t, k in zip(total, KEY, strict=True)), *((t - F.col(f"t{i}")).alias(q) for i, (t, q) in enumerate(zip(total, PARENT_KEY, strict=True), 1)))


def ends(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """``d, k1..k4, ends_sha256`` of the nodes in which conversations end."""
    last = found.filter("last").select("conv_id", "d", *KEY)
    none = sizes.filter("size = 0").select("conv_id", F.lit(0).cast("long").alias("d"), *(F.lit(0).cast("long").alias(k) for k in KEY))
    some = last.unionByName(none).withColumn("chunk", F.shiftright("conv_id", END_BITS))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    strings = some.groupBy("d", *KEY, "chunk").agg(text.alias("ids"))

    def digest(batches):
        import hashlib

        import pyarrow as pa

        now, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("d", *KEY, "ids")), strict=True):
                if key == now:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield _digests(out, pa)
        if state is not None:
            yield _digests([(*now, state.hexdigest())], pa)

    ordered = strings.repartition("d", *KEY).sortWithinPartitions("d", *KEY, "chunk")
    return ordered.mapInArrow(released(digest), "d long, k1 long, k2 long, k3 long, k4 long, ends_sha256 string")


def _digests(rows, pa):
    types = [pa.int64()] * 5 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["d", *KEY, "ends_sha256"])


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent`` and ``parent_conv_id``; the root has none."""
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    keys = ["pd", *PARENT_KEY]
    parents = nodes.select(F.col("d").alias("pd"), *(F.col(k).alias(q) for k, q in zip(KEY, PARENT_KEY, strict=True)), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_convs") * HOT >= total).alias("hot"))
    hot, cold = F.broadcast(parents.filter("hot").drop("hot")), parents.filter("not hot").drop("hot")
    below = nodes.filter("d > 0").withColumn("pd", F.col("d") - 1)
    out = below.join(hot, keys).unionByName(below.join(hot, keys, "left_anti").join(cold, keys)).drop("pd", *PARENT_KEY)
    root = nodes.filter("d = 0").drop(*PARENT_KEY).withColumns({"parent": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    return out.unionByName(root)


def subtree_totals(tree: DataFrame, values: Sequence[str]) -> DataFrame:
    """``node`` and the sums of ``values`` (longs) over its subtree, for a forest of unique ``node``, ``parent`` (null: root).

    Every parent must be a node; the values must not be null.
    """
    link = [f"_link_{v}" for v in values]
    kids = tree.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("_kids"), F.min("node").alias("_child")).withColumnRenamed("_child", "child")
    live = tree.select("node", "parent", *values, *(F.lit(0).cast("long").alias(x) for x in link)).join(kids, "node", "left")
    live = cut_lineage(live.withColumn("_kids", F.coalesce("_kids", F.lit(0))))
    done, spliced, step = [], [], 0
    while True:
        done.append(live.filter("_kids = 0").select("node", *values))
        inner = live.filter("_kids > 0")
        if inner.isEmpty():
            break
        leaf = F.col("_kids") == 0
        raked = live.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            *(F.sum(F.when(leaf, F.col(v) + F.col(x)).otherwise(0)).alias(f"_raked_{v}") for v, x in zip(values, link, strict=True)),
            F.count_if(leaf).alias("_gone"), F.min(F.when(~leaf, F.col("node"))).alias("child"),
        )
        after = inner.drop("child").join(raked, "node").select(
            "node", "parent", "child", (F.col("_kids") - F.col("_gone")).alias("_kids"), *((F.col(v) + F.col(f"_raked_{v}")).alias(v) for v in values), *link
        )
        coin = lambda c, k=step: F.pmod(F.xxhash64(F.lit(k), F.col(c)), F.lit(2)) == 1
        pick = (F.col("_kids") == 1) & F.col("parent").isNotNull() & coin("node") & ~F.coalesce(coin("parent"), F.lit(False))
        out = after.filter(pick).select(F.col("child").alias("node"), F.col("node").alias("_out"), F.col("parent").alias("_up"), *(F.col(v).alias(f"_out_{v}") for v in values), *(F.col(x).alias(f"_out{x}") for x in link))
        joined = after.filter(~pick).join(out, "node", "left")
        live = cut_lineage(joined.select(
            "node", F.coalesce("_up", "parent").alias("parent"), "child", "_kids", *values, "_out",
            # a node's total is its child's, the sum between them and its own
            *((F.col(x) + F.col(f"_out_{v}")).alias(f"_rest_{v}") for v, x in zip(values, link, strict=True)),
            *((F.col(x) + F.coalesce(F.col(f"_out_{v}") + F.col(f"_out{x}"), F.lit(0))).alias(x) for v, x in zip(values, link, strict=True)),
        ))
        spliced.append(live.filter("_out is not null").select("_out", "node", *(f"_rest_{v}" for v in values)))
        live = live.drop("_out", *(f"_rest_{v}" for v in values))
        step += 1
    totals = done[0]
    for more in done[1:]:
        totals = totals.unionByName(more)
    for gone in reversed(spliced):
        if not gone.isEmpty():
            back = gone.join(totals, "node").select(F.col("_out").alias("node"), *((F.col(v) + F.col(f"_rest_{v}")).alias(v) for v in values))
            totals = totals.unionByName(cut_lineage(back))
    return totals


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns, sizes = rebuilt(conversations)
    found = cut_lineage(members(turns))
    inner = found.groupBy("d", *KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), *(F.min(q).alias(q) for q in PARENT_KEY))
    zero = F.lit(0).cast("long")
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        "conv_id", "n_convs", zero.alias("d"), zero.alias("words"), *(zero.alias(k) for k in [*KEY, *PARENT_KEY])
    )
    nodes = cut_lineage(inner.unionByName(root).withColumn("node", F.monotonically_increasing_id()))
    tree = cut_lineage(_with_parents(nodes).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")))
    children = cut_lineage(tree.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")))
    tree = tree.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    totals = subtree_totals(tree.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).select("node", "parent", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    out = tree.drop("saved_tokens").join(totals, "node").join(ends(found, sizes), ["d", *KEY], "left")
    return out.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")
    )
