"""Best-fit packing of documents into token sequences of one length.

A document is its ids and an end id.  Longer ones than a sequence are cut so
that only the first piece may be shorter.  Pieces are dealt at random into
groups of bounded size, and each group is packed by the sum-of-squares rule:
a piece goes to the open sequence for which the squared counts of open
sequences per residual gap sum to the least afterwards.  Two choices keep the
waste near none: pieces come longest first, and a new sequence is opened only
when no open one has room.

A null or empty text is one end id, a piece of length 1.  Ties go to the
smallest gap, equal pieces in the order of their document ids.  Repeated
rows are packed each for themselves.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.memory import released
from pulsegrid.llm.tokens import encoder
from pulsegrid.session import cut_lineage

SEQUENCE = 2048
GROUP_PIECES = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, limit: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; with their ids (little-endian 32-bit) where asked for."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(tokenizer, spaces)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, coded in zip(batch.column(0).to_pylist(), enc.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.frombuffer(coded, enc.dtype).astype("<u4").tobytes() + tail
                n = len(ids) // 4
                first = (n - 1) % limit + 1
                a = 0
                for k, b in enumerate(range(first, n + 1, limit)):
                    part = ids[4 * a : 4 * b]
                    for name, value in zip(out, (doc, k, a, b - a, zlib.crc32(part), part if with_ids else None), strict=True):
                        out[name].append(value)
                    a = b
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_pydict({name: pa.array(v, t) for (name, v), t in zip(list(out.items())[: 5 + with_ids], types, strict=False)})

    return docs.select("doc_id", "text").mapInArrow(released(cut), PIECES + ", ids binary" * with_ids)


def sum_of_squares(lengths, limit: int):
    """Sequence number and offset of each piece, in the given order."""
    import numpy as np

    count = np.zeros(limit + 1, np.int64)  # open sequences by residual gap
    waiting: list[list[int]] = [[] for _ in range(limit + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for k, size in enumerate(lengths):
        before = count[size:limit]  # counts of the gaps that have room
        change = count[: limit - size] - before
        if len(change):
            change = 2 * change + 2
            change[0] = 1 - 2 * before[0]  # a full sequence is no longer open
            change[before == 0] = np.iinfo(np.int64).max
            at = int(change.argmin())
        if len(change) and before[at]:
            gap = size + at
            number = waiting[gap].pop()
            count[gap] -= 1
        else:
            gap, number = limit, opened
            opened += 1
        sequence[k], offset[k] = number, limit - gap
        if gap > size:
            waiting[gap - size].append(number)
            count[gap - size] += 1
    return sequence, offset


def pack(parts: DataFrame, limit: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``parts`` (``doc_id``, ``piece``, ``start``, ``length`` of 1 to ``limit``, others) with ``sequence_id`` and ``offset``."""
    parts = cut_lineage(parts.withColumn("__row", F.monotonically_increasing_id()))
    groups = max(1, -(-parts.count() // group_pieces))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in parts.drop('__row').schema.fields)}, sequence_id long, `offset` long"

    def place(group):
        import pyarrow as pa

        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("__row", "ascending")])
        sequence, offset = sum_of_squares(group.column("length").to_pylist(), limit)
        key = group.column("__group")[0].as_py()
        return group.drop_columns(["__row", "__group"]).append_column("sequence_id", pa.array((key << 32) + sequence)).append_column("offset", pa.array(offset))

    dealt = parts.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "__row"), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(place, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves (pieces need their ``ids``): ids joined in place order."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("p")).select(
        "sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
