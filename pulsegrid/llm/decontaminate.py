"""Benchmark decontamination by broadcast sets of normalised word windows.

A window is 13 consecutive words of a benchmark item (an item with fewer
words, but not none, is one shorter window).  Their hashes go to every task in
blocks of at most ``BLOCK_WINDOWS``: one block is one scan of the documents,
and a larger benchmark takes more scans, never a larger broadcast.  A hash hit
is verified on the words themselves.

Null texts have no words.  An item without an id marks words but is not
listed.  Repeated items count once, repeated documents each for themselves.
Other columns of the documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.llm.memory import released
from pulsegrid.llm.words import shingles, split_words, text_blocks
from pulsegrid.session import cut_lineage

WIDTH = 13
BLOCK_WINDOWS = 500_000
WINDOWS = "hash long, n_words int, words binary, item_id long"
FOUND = "__words long, __hits array<struct<first:int,last:int>>, __items array<long>"


def benchmark_windows(bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each distinct window with the sorted ids of its items."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in text_blocks(batch, "text"):
                words = split_words(part.column("text"))
                hashes, first = shingles(words, width)
                item = part.column("item_id").to_pylist()
                for i in range(part.num_rows):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    n = min(width, b - a)
                    k = int(first[i + 1] - first[i])
                    if k:
                        yield pa.RecordBatch.from_pydict({
                            "hash": pa.array(hashes[first[i] : first[i + 1]].view(np.int64)), "n_words": pa.array([n] * k, pa.int32()),
                            "words": pa.array([words.text(j, j + n) for j in range(a, a + k)], pa.binary()), "item_id": pa.array([item[i]] * k, pa.int64()),
                        })

    rows = bench.select("item_id", "text").mapInArrow(released(cut), WINDOWS)
    return rows.groupBy("hash", "n_words", "words").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


class WindowSet:
    """Windows of one block, by length, ready to be searched."""

    def __init__(self, rows):
        import numpy as np

        by_length: dict[int, dict[int, list]] = {}
        for r in rows:
            by_length.setdefault(r["n_words"], {}).setdefault(r["hash"] & (1 << 64) - 1, []).append((bytes(r["words"]), list(r["item_ids"])))
        self.by_length = {n: (np.array(sorted(w), np.uint64), w) for n, w in by_length.items()}


def _scan(words, sought: WindowSet):
    """For each text: merged word ranges that windows cover, and the items of those windows."""
    import numpy as np

    n = len(words.first) - 1
    ranges, items = [[] for _ in range(n)], [set() for _ in range(n)]
    for width, (keys, windows) in sought.by_length.items():
        hashes, first = shingles(words, width)
        place = np.searchsorted(keys, hashes)
        place[place == len(keys)] = 0
        for at in np.flatnonzero(keys[place] == hashes):
            i = int(np.searchsorted(first, at, "right")) - 1
            j = int(at - first[i])
            a = int(words.first[i]) + j
            if a + width > words.first[i + 1]:
                continue  # a shorter text's own hash
            text = words.text(a, a + width)
            for known, ids in windows[int(hashes[at])]:
                if known == text:
                    ranges[i].append((j, j + width - 1))
                    items[i].update(x for x in ids if x is not None)
    return ranges, items


def _merged(ranges):
    out = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]["last"] + 1:
            out[-1]["last"] = max(b, out[-1]["last"])
        else:
            out.append({"first": a, "last": b})
    return out


def contaminated_spans(docs: DataFrame, bench: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with ``__words`` (their number), ``__hits`` (merged ranges of word positions) and ``__items`` (sorted item ids)."""
    import pyarrow as pa

    spark = docs.sparkSession
    windows = cut_lineage(benchmark_windows(bench, width))
    blocks = max(1, -(-windows.count() // block_windows))
    keep = docs.columns
    schema = StructType(docs.schema.fields + StructType.fromDDL(FOUND).fields)
    found_types = [pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.int64())]
    frame, started = docs, False
    for block in range(blocks):
        rows = windows.filter(F.pmod("hash", F.lit(blocks)) == block).collect()
        sought = spark.sparkContext.broadcast(WindowSet(rows))

        def scan(batches, sought=sought, started=started):
            for batch in batches:
                for part in text_blocks(batch, "text"):
                    words = split_words(part.column("text"))
                    ranges, items = _scan(words, sought.value)
                    if started:
                        ranges = [r + [(x["first"], x["last"]) for x in old] for r, old in zip(ranges, part.column("__hits").to_pylist(), strict=True)]
                        items = [s.union(old) for s, old in zip(items, part.column("__items").to_pylist(), strict=True)]
                    number = (words.first[1:] - words.first[:-1]).tolist()
                    values = (number, [_merged(r) for r in ranges], [sorted(s) for s in items])
                    found = [pa.array(v, t) for v, t in zip(values, found_types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *found], [*keep, "__words", "__hits", "__items"])

        frame, started = frame.mapInArrow(released(scan), schema), True
        if block < blocks - 1:
            frame = cut_lineage(frame)
    return frame


def judged(found: DataFrame) -> DataFrame:
    """Per document the numbers of words, hit words and items, the items' digest, and the verdict."""
    hit = F.aggregate("__hits", F.lit(0).cast("long"), lambda n, h: n + (h["last"] - h["first"] + 1).cast("long"))
    names = F.array_join(F.array_sort(F.transform("__items", lambda i: i.cast("string"))), ",")
    counted = found.select("doc_id", F.col("__words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def without_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents of which benchmark windows cover less than one word in twenty."""
    found = contaminated_spans(docs, bench)
    hit = F.aggregate("__hits", F.lit(0).cast("long"), lambda n, h: n + (h["last"] - h["first"] + 1).cast("long"))
    return found.filter((hit == 0) | (20 * hit < F.col("__words"))).select(*docs.columns)
