"""Similarity join on sets of word n-grams by chosen paths.

A document is its set of five-word shingles; two documents are linked when
the Jaccard similarity of their sets is at least ``SIMILARITY``.  Equal sets
are one representative with a number of copies.

*Chosen paths.*  In each of ``RUNS`` runs a set x enters the bucket of every
shingle whose hash falls below ``SHARE / |x|``: two linked sets share
0.8 x SHARE buckets on average.  A bucket with more than ``BUCKET``
members is cut by size, which parts no linked pair, and what stays that large
is split again by hashes that depend on the bucket, at most ``DEPTH`` - 1
times, unless its members are alike on average.  Whether the chain of shared
buckets of a linked pair lives on is a branching process with mean 2; it dies
out with probability 0.203 in a run, hence in all nine runs with 6e-7: the
target recall is 0.999999 for each pair.

*Brute force.*  The members of a bucket are compared by size and by 128-bit
one-permutation sketches, then exactly.  Sets of fewer than 128 shingles are
compared without the sketches, which would lose 1e-4 of the links of such short
texts; from 90 shingles on a simulation of them saw no loss.  What stays large is compared block by
block, each pair of blocks a unit of work of its own.  A pair counts only in
its first common bucket, so numbers of links are exact, and a unit returns
numbers and component labels, never pairs.

Documents without words (null or empty texts among them) have no links and
are classes of their own.  Shorter texts than five words are one shingle.
Repeated rows are copies.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.components import component_labels
from pulsegrid.llm.memory import released
from pulsegrid.llm.numbered import numbered
from pulsegrid.operators.groups import by_key, whole_groups
from pulsegrid.llm.words import mix, shingles, split_words, text_blocks
from pulsegrid.session import cut_lineage

WIDTH, SIMILARITY = 5, 0.8
RUNS, SHARE, DEPTH = 9, 2.5, 5
BUCKET, BLOCK, FEW = 1024, 512, 48
BITS, LEAST_AGREEING, LEAST_SKETCHED = 128, 88, 128
# a class of sizes spans a little more than a quarter
SIZES = math.log(1.26)
# mean similarity from which a large bucket is compared as it is
ALIKE = 0.4
FEATURES = "row long, doc_id long, size long, sig1 long, sig2 long, sketch1 long, sketch2 long, buckets array<long>"


def _sets(texts):
    """The sorted shingle set of each text."""
    import numpy as np

    hashes, first = shingles(split_words(texts), WIDTH)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(hashes[a:b])


def _chosen(values, seeds):
    """Buckets that a set enters: shingles whose seeded hash is below the share, for each seed."""
    import numpy as np

    if not len(values):
        return np.zeros(0, np.uint64)
    limit = np.uint64(min(SHARE / len(values), 1.0) * ((1 << 64) - 2048))
    out = []
    for seed in seeds:
        h = mix(values ^ seed)
        out.append(mix(h[h <= limit] + seed))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sketch(values):
    """One bit for each of 128 classes of hashes: that of the least hash, or of the next class that has one."""
    import numpy as np

    if not len(values):
        return np.zeros(2, np.uint64)
    h = np.sort(mix(values ^ np.uint64(0xA5A5)))[::-1]
    least = np.zeros(BITS, np.uint64)
    taken = np.zeros(BITS, bool)
    place = (h & np.uint64(BITS - 1)).astype(np.int64)
    least[place], taken[place] = h, True
    there = np.flatnonzero(taken)
    source = there[np.searchsorted(there, np.arange(BITS)) % len(there)]
    return np.packbits((least[source] >> np.uint64(20)).astype(np.uint8) & 1).view(np.uint64)


def features(docs: DataFrame) -> DataFrame:
    """Size, signature, sketch and first buckets of each document (``__row``, ``doc_id``, ``text``)."""

    def describe(batches):
        import numpy as np
        import pyarrow as pa

        seeds = mix(np.arange(1, RUNS + 1, dtype=np.uint64))
        for batch in batches:
            for part in text_blocks(batch, "text"):
                rows = []
                for values in _sets(part.column("text")):
                    mixed = mix(values ^ np.uint64(77))
                    rows.append((len(values), mixed.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed, initial=np.uint64(0)), *_sketch(values), np.unique(_chosen(values, seeds))))
                numbers = np.array([r[1:5] for r in rows], np.uint64).reshape(-1, 4).view(np.int64)
                bounds = np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])]).astype(np.int32)
                buckets = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([r[5] for r in rows]).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("__row"), part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), *(pa.array(numbers[:, i]) for i in range(4)), buckets],
                    ["row", "doc_id", "size", "sig1", "sig2", "sketch1", "sketch2", "buckets"],
                )

    return docs.select("__row", "doc_id", "text").mapInArrow(released(describe), FEATURES)


def _split(docs: DataFrame, large: DataFrame) -> DataFrame:
    """The next buckets of the members of large ones: ``rep, sketch1, bucket``."""

    def choose(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in text_blocks(batch, "text"):
                reps, sketches, chosen = [], [], []
                for rep, sketch, seeds, values in zip(part.column("rep").to_pylist(), part.column("sketch1").to_pylist(), part.column("paths").to_pylist(), _sets(part.column("text")), strict=True):
                    got = np.unique(_chosen(values, mix(np.array(seeds, np.int64).view(np.uint64) + np.uint64(9))))
                    reps.append(np.full(len(got), rep))
                    sketches.append(np.full(len(got), sketch))
                    chosen.append(got)
                if reps:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps)), pa.array(np.concatenate(sketches)), pa.array(np.concatenate(chosen).view(np.int64))], ["rep", "sketch1", "bucket"])

    paths = large.groupBy("rep").agg(F.min("sketch1").alias("sketch1"), F.collect_list("bucket").alias("paths"))
    return docs.select(F.col("__row").alias("rep"), "text").join(paths, "rep").mapInArrow(released(choose), "rep long, sketch1 long, bucket long")


def _by_size(large: DataFrame) -> DataFrame:
    """Large buckets cut by the size of their members: ``rep, sketch1, bucket``.

    Linked sets differ by a quarter in size at most, so they are in one class
    or in two neighbouring ones; a part holds two neighbouring classes.
    """
    own = F.floor(F.log("size") / F.lit(SIZES))
    part = F.explode(F.array(own, own + 1))
    return large.select("rep", "sketch1", "bucket", part.alias("part")).select("rep", "sketch1", F.xxhash64("bucket", "part").alias("bucket"))


def _agreement(n: str = "members"):
    """Mean similarity of all pairs of a bucket, from the counts of set sketch bits."""
    agree = [F.col(f"b{k}") / F.col(n) for k in range(32)]
    same = sum((p * p + (1 - p) * (1 - p) for p in agree), F.lit(0.0)) / 32
    return 2 * same - 1


def leaf_buckets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``rep, bucket, members`` of all buckets that are compared."""
    leaves = []
    entries = reps.select("rep", "size", "sketch1", F.explode("buckets").alias("bucket"))
    for depth in range(DEPTH + 1):
        counts = cut_lineage(entries.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"))
        shared = cut_lineage(entries.join(counts, "bucket"))
        small, large = shared.filter(F.col("members") <= BUCKET), shared.filter(F.col("members") > BUCKET)
        leaves.append(small.select("rep", "bucket", "members"))
        if depth == DEPTH or counts.filter(F.col("members") > BUCKET).isEmpty():
            leaves.append(large.select("rep", "bucket", "members"))
            break
        bits = large.groupBy("bucket", "members").agg(
            *(F.sum(F.shiftrightunsigned("sketch1", 2 * k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(32))
        )
        alike = cut_lineage(bits.select("bucket", (_agreement() >= ALIKE).alias("alike")))
        marked = large.join(alike, "bucket")
        leaves.append(marked.filter("alike").select("rep", "bucket", "members"))
        mixed = marked.filter(~F.col("alike"))
        entries = cut_lineage(_split(docs, mixed) if depth else _by_size(mixed))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def _units(entries: DataFrame) -> DataFrame:
    """Units of work: a bucket, or a pair of blocks of a larger one."""
    n = F.ceil(F.col("members") / BLOCK).cast("int")
    blocks = F.when(F.col("members") <= BUCKET, F.lit(1)).otherwise(n)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = entries.withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "blocks")


def _flat(column):
    """Values and bounds of a list column."""
    import numpy as np

    return column.combine_chunks().flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.combine_chunks().value_lengths().to_numpy())])


def _share_earlier(values, bounds, i, j, bucket):
    """For pairs (i, j) of rows: do their lists share a bucket before the given one?"""
    import numpy as np

    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 100_000):
        part = slice(a, a + 100_000)
        keys = []
        for side in (i[part], j[part]):
            n = bounds[side + 1] - bounds[side]
            pair = np.repeat(np.arange(len(side)), n)
            flat = values[np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[side], n)]
            keep = flat < np.repeat(bucket[part], n)
            keys.append((pair[keep], flat[keep]))
        pair, flat = (np.concatenate([k[x] for k in keys]) for x in (0, 1))
        order = np.lexsort((flat, pair))
        pair, flat = pair[order], flat[order]
        out[a + pair[1:][(pair[1:] == pair[:-1]) & (flat[1:] == flat[:-1])]] = True
    return out


def _earlier_matrix(values, bounds, a, b, bucket):
    """The same for all pairs of the rows a to b."""
    import numpy as np

    flat, n = values[bounds[a] : bounds[b]], np.diff(bounds[a : b + 1])
    owner = np.repeat(np.arange(b - a), n)
    keep = flat < bucket
    names, place = np.unique(flat[keep], return_inverse=True)
    matrix = np.zeros((b - a, len(names)), np.float32)
    matrix[owner[keep], place] = 1
    return matrix @ matrix.T > 0


def _common(sets):
    """Sizes of all pairwise intersections, from columns for the shingles that two members share."""
    import numpy as np

    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    name = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
    keep = np.bincount(name)[name] > 1
    owner, name = owner[keep], np.unique(name[keep], return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, 4_000_000 // len(sets))
    for a in range(0, int(name[-1]) + 1 if len(name) else 0, width):
        i, j = np.searchsorted(name, [a, a + width])
        block = np.zeros((len(sets), min(width, int(name[-1]) + 1 - a)), np.float32)
        block[owner[i:j], name[i:j] - a] = 1
        total += block @ block.T
    return total.astype(np.int64)


def _similar(size, sketch1, sketch2, i, j):
    """May these pairs be linked, by size and sketch?"""
    import numpy as np

    a, b = size[i], size[j]
    differing = np.bitwise_count(sketch1[i] ^ sketch1[j]).astype(np.int16) + np.bitwise_count(sketch2[i] ^ sketch2[j])
    return (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & ((differing <= BITS - LEAST_AGREEING) | (np.minimum(a, b) < LEAST_SKETCHED))


KEYS = ["bucket", "low", "high"]


def candidates(units: DataFrame) -> DataFrame:
    """``bucket, low, high, own, rep`` of the members that have a new candidate in a unit, by size and sketch."""

    def screen(batches):
        import numpy as np

        for table, bounds in whole_groups(batches, KEYS):
            size, own, bucket, low, high = (table.column(c).to_numpy() for c in ("size", "own", "bucket", "low", "high"))
            sketch = [table.column(c).to_numpy().view(np.uint64) for c in ("sketch1", "sketch2")]
            values, at = _flat(table.column("lists"))
            some = np.zeros(table.num_rows, bool)
            members = np.diff(bounds)
            # small units all at once, by lists of pairs
            few = members <= FEW
            row = np.flatnonzero(np.repeat(few, members))
            later = np.repeat(bounds[1:], members)[row] - row - 1
            i = np.repeat(row, later)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
            near = _similar(size, *sketch, i, j)
            i, j = i[near], j[near]
            new = ~_share_earlier(values, at, i, j, bucket[i])
            some[i[new]] = some[j[new]] = True
            for a, b in zip(bounds[:-1][~few], bounds[1:][~few], strict=True):
                i, j = np.arange(a, b)[:, None], np.arange(a, b)[None, :]
                near = _similar(size, *sketch, i, j) & (i != j)
                if low[a] != high[a]:
                    near &= own[i] != own[j]
                if near.any():
                    near &= ~_earlier_matrix(values, at, a, b, bucket[a])
                some[a:b] = near.any(1)
            yield from table.select([*KEYS, "own", "rep"]).filter(some).to_batches()

    return by_key(units, *KEYS).mapInArrow(released(screen), "bucket long, low int, high int, own int, rep long")


def verified(docs: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact links of each unit: ``rep, label, links`` (label: least member of its component there)."""
    asked = wanted.groupBy("rep").agg(F.collect_list(F.struct("bucket", "low", "high", "own")).alias("units"))
    texts = docs.select(F.col("__row").alias("rep"), "text").join(asked.join(members, "rep"), "rep")
    kept = ["rep", "copies", "lists", "units"]

    def attach(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_blocks(batch, "text"):
                sets = [s.tobytes() for s in _sets(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(sets, pa.binary())], [*kept, "hashes"])

    schema = "rep long, copies long, lists array<long>, units array<struct<bucket:long,low:int,high:int,own:int>>, hashes binary"
    sets = texts.select(*kept, "text").mapInArrow(released(attach), schema)
    dealt = sets.withColumn("u", F.explode("units")).select("rep", "copies", "lists", "hashes", "u.*")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for table, bounds in whole_groups(batches, KEYS):
            rep, copies, own, bucket, low, high = (table.column(c).to_numpy() for c in ("rep", "copies", "own", "bucket", "low", "high"))
            hashes = table.column("hashes")
            values, at = _flat(table.column("lists"))
            out = ([], [], [])
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in hashes.slice(a, b - a).to_pylist()]
                size = np.array([len(s) for s in sets])
                # at least 0.8, in whole numbers: 5 common >= 4 (a + b - common)
                linked = (9 * _common(sets) >= 4 * (size[:, None] + size[None, :])) & ~np.eye(b - a, dtype=bool)
                if low[a] != high[a]:
                    linked &= own[a:b, None] != own[None, a:b]
                if not linked.any():
                    continue
                label, before = rep[a:b].copy(), None
                while before is None or (label != before).any():
                    before = label
                    label = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
                counted = linked & ~_earlier_matrix(values, at, a, b, bucket[a])
                some = linked.any(1)
                for column, value in zip(out, (rep[a:b], label, counted @ copies[a:b]), strict=True):
                    column.append(value[some])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["rep", "label", "links"])

    return by_key(dealt, *KEYS).mapInArrow(released(compare), "rep long, label long, links long")


def similar_documents(docs: DataFrame) -> DataFrame:
    """``__row``, ``doc_id``, ``class_row`` and ``class_id`` (row and id of the class's first document), ``n_links``.

    ``docs`` needs ``__row`` (a number of its own for each row, stored so that it never changes), ``doc_id`` and ``text``.
    """
    known = cut_lineage(features(docs))
    some = known.filter("size > 0")
    reps = some.groupBy("sig1", "sig2").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    owners = cut_lineage(some.select("row", "doc_id", "sig1", "sig2").join(reps, ["sig1", "sig2"]).select("row", "doc_id", "rep", "copies"))
    chosen = cut_lineage(known.join(owners.filter("row = rep").select("row", "copies"), "row").withColumnRenamed("row", "rep"))

    leaves = leaf_buckets(docs, chosen)
    lists = leaves.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("bucket", "members"))).alias("leaves"))
    members = cut_lineage(chosen.select("rep", "copies", "size", "sketch1", "sketch2").join(lists, "rep").withColumn("lists", F.col("leaves.bucket")))
    entries = members.select("rep", "size", "sketch1", "sketch2", "lists", F.explode("leaves").alias("l")).select("*", "l.*").drop("l")
    wanted = cut_lineage(candidates(_units(entries)))
    links = cut_lineage(verified(docs, members.select("rep", "copies", "lists"), wanted))

    labels = component_labels(links.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    linked = links.groupBy("rep").agg(F.sum("links").alias("links")).join(labels.withColumnRenamed("node", "rep"), "rep")
    found = owners.join(linked, "rep", "left").select("row", "doc_id", F.coalesce("label", "rep").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = found.unionByName(known.filter("size = 0").select("row", "doc_id", F.col("row").alias("label"), F.lit(0).cast("long").alias("n_links")))
    found = cut_lineage(found)
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("f"))
    return found.join(first, "label").select(F.col("row").alias("__row"), "doc_id", F.col("f.row").alias("class_row"), F.col("f.doc_id").alias("class_id"), "n_links")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The first document of each class, with all its columns."""
    rows = numbered(docs)
    found = similar_documents(rows)
    return rows.join(found.filter("__row = class_row").select("__row"), "__row").select(*docs.columns)
