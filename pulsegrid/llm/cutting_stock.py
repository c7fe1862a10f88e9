"""Packing of documents by cutting stock with column generation.

A document is its ids and an end id.  Full sequences of ``limit`` tokens are
taken from its front; what remains (its rest) is an item of 1 to ``limit - 1``
tokens.  A sequence needs no padding when it holds ``limit`` tokens or a power
of two, so only such *exact* sequences are formed:

*Linear program.*  A column is a pattern: how many rests of each length make
up one exact sequence.  The program covers the histogram of rest lengths and
minimises the tokens that no pattern covers (sequences shorter than ``limit``
cost a tenth of their tokens, so that full ones come first).
*Pricing.*  A knapsack dynamic program over the dual values of the lengths
finds the best pattern for every sum; those with a gain enter the basis.  It
stops when no pattern gains, when a thousandth of the tokens is left uncovered,
or after ``ROUNDS`` prices: what is not covered by then is cut, never dropped.
*Rounding.*  Patterns are used a whole number of times.  The few rests over
are filled up exactly by subset sums where possible; the others are laid end
to end and cut at sequence ends, the last stretch into powers of two.  No
token of padding is left, and only that last group of documents is cut.
*Assignment.*  The rests of each length are ranked over all partitions; a rank
tells pattern, sequence and offset.

The program sees one number for each length, at most ``limit - 1``, however
many documents there are.  A null or empty text is one end id.  Repeated rows
and equal document ids are packed each for themselves; which of equally long
documents goes where is arbitrary.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.memory import released
from pulsegrid.llm.tokens import encoder
from pulsegrid.llm.words import text_blocks
from pulsegrid.session import cut_lineage

SEQUENCE = 2048
SHORT_COST, UNCOVERED, ROUNDS, COLUMNS = 0.1, 1e-3, 200, 256
RESTS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, block int, rank long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, block int, rank long, at long"


def stretches(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, limit: int = SEQUENCE) -> DataFrame:
    """Full sequences and rests of all documents with their ids (little-endian, 16 or 32 bit), ranked by length inside their ``block``."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(tokenizer, spaces)
        tail = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        block = TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in batches:
            for part in text_blocks(batch, "text"):
                out = ([], [], [], [], [], [])
                for doc, coded in zip(part.column(0).to_pylist(), enc.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = coded + tail
                    n = len(ids) // width
                    for a in range(0, n, limit):
                        piece = ids[width * a : width * min(a + limit, n)]
                        crc = zlib.crc32(np.frombuffer(piece, enc.dtype).astype("<u4").tobytes())
                        for column, value in zip(out, (doc, a, len(piece) // width, crc, n, piece), strict=True):
                            column.append(value)
                length = np.array(out[2], np.int64)
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                rank = np.empty(len(length), np.int64)
                rank[order] = seen[length[order]] + np.arange(len(length)) - first
                seen += np.bincount(length, minlength=limit + 1)
                columns = [*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.binary()), pa.array(np.full(len(length), block, np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "block", "rank"])

    return docs.select("doc_id", "text").mapInArrow(released(cut), RESTS)


def exact_sums(limit: int) -> list[int]:
    """Sequence lengths that need no padding, longest first."""
    return [limit, *(1 << k for k in range(limit.bit_length(), -1, -1) if 1 << k < limit)]


def knapsack(values, limit: int):
    """Best value for every sum of lengths, and the length that reaches it; ``values[l - 1]`` is that of length l (-inf: none)."""
    import numpy as np

    best, last = np.full(limit + 1, -np.inf), np.zeros(limit + 1, np.int64)
    best[0] = 0.0
    for s in range(1, limit + 1):
        reach = best[s - 1 :: -1] if s <= limit else best
        total = reach[:s] + values[:s]
        k = int(total.argmax())
        best[s], last[s] = total[k], k + 1
    return best, last


def column_generation(lengths, demand, limit: int = SEQUENCE, uncovered: float = UNCOVERED):
    """Patterns (length index, copies) of exact sequences and how often each is used, as fractions.

    Revised simplex on ``min uncovered tokens``; a rest that no pattern of the
    first basis takes is uncovered there, so that basis is always feasible.
    """
    import numpy as np

    m = len(lengths)
    rng = np.random.default_rng(0)
    basis: list[tuple] = [()] * m
    matrix, cost_of = np.eye(m), lengths.astype(float)
    # the first basis: patterns that each use up one length, so that the matrix is triangular
    left = demand.astype(float)
    sums = np.array(exact_sums(limit))
    cost = np.where(sums == limit, 0.0, SHORT_COST * sums)
    for rows, count, times in exact_fill(lengths, left, limit, whole=False):
        r = rows[int(np.argmin(np.abs(left[rows])))]
        left[r] = 0.0
        matrix[:, r] = 0.0
        matrix[rows, r] = count
        basis[r] = (rows, count)
        size = int(count @ lengths[rows])
        cost_of[r] = 0.0 if size == limit else SHORT_COST * size
    inverse = np.linalg.inv(matrix)
    use = np.maximum(inverse @ (demand + rng.random(m) * 1e-4), 0)  # a small disturbance keeps the simplex from cycling
    dual = cost_of @ inverse
    index = np.full(limit + 1, -1)
    index[lengths] = np.arange(m)
    total = float(demand @ lengths)
    for _ in range(ROUNDS):
        left = sum(float(use[i] * lengths[i]) for i in range(m) if not basis[i])
        if left <= uncovered * total:
            break
        values = np.full(limit, -np.inf)
        # a little noise varies the patterns while many are equally good
        values[lengths - 1] = dual * (1 + 1e-7 * rng.random(m))
        best, last = knapsack(values, limit)
        gain = best[np.maximum(sums[:, None] - lengths, 0)] + values[lengths - 1] - cost[:, None]
        gain[sums[:, None] < lengths] = -np.inf
        top = np.argsort(-gain, axis=None)[:COLUMNS]
        entered = 0
        for flat in top[gain.ravel()[top] > 1e-4]:
            t, i = divmod(int(flat), m)
            copies: dict[int, int] = {i: 1}
            s = int(sums[t] - lengths[i])
            while s > 0:
                k = int(index[last[s]])
                copies[k] = copies.get(k, 0) + 1
                s -= int(last[s])
            rows, count = np.fromiter(copies, np.int64), np.fromiter(copies.values(), float)
            reduced = cost[t] - float(dual[rows] @ count)
            if reduced >= -1e-4:
                continue
            step = inverse[:, rows] @ count
            up = np.flatnonzero(step > 1e-9)
            r = up[int((use[up] / step[up]).argmin())]
            amount = use[r] / step[r]
            row = inverse[r] / step[r]
            dual = dual + reduced * row
            changed = np.flatnonzero(np.abs(step) > 1e-12)
            inverse[changed] -= step[changed, None] * row
            inverse[r] = row
            use = np.maximum(use - amount * step, 0)
            use[r] = amount
            basis[r] = (rows, count.astype(np.int64))
            entered += 1
        if not entered:
            break
    return [(b, float(x)) for b, x in zip(basis, use, strict=True) if b]


def exact_fill(lengths, left, limit: int, whole: bool = True):
    """Yields (length index, copies, times): exact sequences of what is left, the longest rest first; ``left`` is used up in place.

    ``whole``: whole numbers of times; otherwise each pattern uses one of its lengths up.
    """
    import numpy as np

    for top in range(len(lengths) - 1, -1, -1):
        while left[top] > 1e-9:
            for goal in exact_sums(limit):
                if goal < lengths[top]:
                    left_over = True
                    break
                found = _subset(lengths, left, top, goal - int(lengths[top]), whole)
                if found is not None:
                    left_over = False
                    found[top] = found.get(top, 0) + 1
                    rows, count = np.fromiter(found, np.int64), np.fromiter(found.values(), np.int64)
                    times = int((left[rows] // count).min()) if whole else float((left[rows] / count).min())
                    left[rows] -= times * count
                    if not whole:
                        left[rows[np.abs(left[rows]) < 1e-9]] = 0
                    yield rows, count, times
                    break
            if left_over:
                break


def _subset(lengths, left, top: int, goal: int, whole: bool):
    """Copies of lengths up to index ``top`` that sum to ``goal``, one of ``top`` being taken already; None if there are none."""
    if goal == 0:
        return {}
    reach, steps, mask = 1, [], (1 << (goal + 1)) - 1
    for k in range(top, -1, -1):
        size = int(lengths[k])
        n = min(int(left[k]) - (k == top), goal // size) if whole else goal // size * int(left[k] > 1e-9)
        part = 1
        while n > 0:  # 1, 2, 4, ... copies at once reach every number of copies
            part = min(part, n)
            steps.append((k, part, reach))
            reach |= (reach << (part * size)) & mask
            n -= part
            part *= 2
        if reach >> goal & 1:
            break
    else:
        return None
    found: dict[int, int] = {}
    for k, part, before in reversed(steps):
        if not before >> goal & 1:
            found[k] = found.get(k, 0) + part
            goal -= part * int(lengths[k])
    return found


@dataclass
class Plan:
    """Where each rank of each length goes: ``key`` (length and first rank) sorted, then one row of numbers each."""

    key: object
    copies: object
    sequence: object
    offset: object  # in the sequence, or in the stretch that is cut (copies 0)
    full: int  # cut sequences of whole length
    ends: object  # ends of all cut sequences
    first_cut: int
    sequences: int


RANK_BITS = 48


def plan(histogram: dict[int, int], limit: int = SEQUENCE) -> Plan:
    import numpy as np

    lengths = np.array(sorted(k for k in histogram if k < limit), np.int64)
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    taken = np.zeros(len(lengths), np.int64)
    slots, sequence = [(limit, 0, 1, 0, 0)], histogram.get(limit, 0)

    def take(rows, count, times):
        nonlocal sequence
        at = 0
        for k, n in zip(rows.tolist(), count.tolist(), strict=True):
            slots.append((int(lengths[k]), int(taken[k]), n, sequence, at))
            taken[k] += n * times
            at += n * int(lengths[k])
        sequence += times

    patterns = column_generation(lengths, left.astype(float), limit) if len(lengths) else []
    # whole uses first, then one more of the patterns that were cut off most, while there are rests for it
    for (rows, count), use in sorted(patterns, key=lambda p: p[1] % 1, reverse=True):
        times = min(int(use + 1e-3), int((left[rows] // count).min()))
        if times:
            left[rows] -= times * count
            take(rows, count, times)
    for (rows, count), use in sorted(patterns, key=lambda p: p[1] % 1, reverse=True):
        if use % 1 > 0.05 and (left[rows] >= count).all():
            left[rows] -= count
            take(rows, count, 1)
    for rows, count, times in exact_fill(lengths, left, limit):
        take(rows, count, times)
    first_cut, at = sequence, 0
    for k in np.flatnonzero(left)[::-1]:
        slots.append((int(lengths[k]), int(taken[k]), 0, 0, at))
        at += int(left[k] * lengths[k])
    full, tail = divmod(at, limit)
    ends, end = [], full * limit
    for k in range(limit.bit_length(), -1, -1):
        if tail >> k & 1:
            end += 1 << k
            ends.append(end)
    table = np.array(sorted(slots), np.int64)
    return Plan((table[:, 0] << RANK_BITS) + table[:, 1], table[:, 2], table[:, 3], table[:, 4], full, np.array(ends, np.int64), first_cut, first_cut + full + len(ends))


def cuts(p: Plan, at, length, limit: int):
    """Parts of a stretch of the cut sequences: lengths, sequences and offsets."""
    import numpy as np

    parts = []
    while length:
        if at < p.full * limit:
            number, begin = divmod(at, limit)
            end = (number + 1) * limit
        else:
            k = int(np.searchsorted(p.ends, at, "right"))
            number, end = p.full + k, int(p.ends[k])
            begin = at - (int(p.ends[k - 1]) if k else p.full * limit)
        n = min(length, end - at)
        parts.append((n, p.first_cut + number, begin))
        at, length = at + n, length - n
    return parts


def pack_patterns(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, limit: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents in exact sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are the piece's ids, little-endian, 16 bits each where the vocabulary allows it, else 32.
    """
    rests = cut_lineage(stretches(docs, tokenizer, spaces, end_id, limit))
    counts = cut_lineage(rests.groupBy("length", "block").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = plan(histogram, limit)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rests.drop("ids").join(bases, ["length", "block"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "block", "rank", "base"]

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            length, rank, base = (batch.column(c).to_numpy() for c in ("length", "rank", "base"))
            place = rank + base
            slot = np.searchsorted(found.key, (length << RANK_BITS) + place, "right") - 1
            nth = place - (found.key[slot] & ((1 << RANK_BITS) - 1))
            copies = np.maximum(found.copies[slot], 1)
            sequence, offset = found.sequence[slot] + nth // copies, found.offset[slot] + nth % copies * length
            # the others lie in the stretch that is cut
            at = np.where(found.copies[slot] > 0, -1, found.offset[slot] + nth * length)
            for k in np.flatnonzero(at >= 0):
                parts = cuts(found, int(at[k]), int(length[k]), limit)
                if len(parts) == 1:
                    _, sequence[k], offset[k] = parts[0]
                    at[k] = -1
            named = dict(zip(columns[:5], batch.columns[:5], strict=True)) | {"sequence_id": pa.array(sequence), "offset": pa.array(offset), "block": batch.column("block"), "rank": batch.column("rank"), "at": pa.array(at)}
            yield pa.RecordBatch.from_pydict(named)

    placed = cut_lineage(ranked.select(*columns).mapInArrow(released(place), PLACED))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def divide(batches):
        import numpy as np
        import pyarrow as pa

        dtype = encoder(tokenizer, spaces).dtype
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids, start = np.frombuffer(r["ids"], dtype), 0
                for n, sequence, offset in cuts(found, r["at"], r["length"], limit):
                    part = ids[start : start + n]
                    rows.append((r["doc_id"], r["start"] + start, n, zlib.crc32(part.astype("<u4").tobytes()), r["doc_tokens"], sequence, offset, part.tobytes()))
                    start += n
            types = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [*kept, "ids"])

    ids = rests.select("length", "block", "rank", "ids")
    whole = placed.filter("at < 0").join(ids, ["length", "block", "rank"]).select(*kept, "ids")
    divided = placed.filter("at >= 0").join(ids, ["length", "block", "rank"]).select("doc_id", "start", "length", "doc_tokens", "at", "ids")
    return whole.unionByName(divided.mapInArrow(released(divide), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids binary"))
