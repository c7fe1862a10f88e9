"""Near-duplicate passages by compact windows.

A text is its sequence of five-word shingles; a passage is a run of at least
``PASSAGE`` words.  For each of ``HASHES`` hash functions the nodes of the
text's Cartesian tree (least hash at the root) that span a passage are its
compact windows: all passages inside a window and over its least position
share that least hash.  Texts have about two windows per passage length and
function, so windows grow in proportion to the words.

Windows with one signature are linked to the group's first row, never to each
other.  That row may share a few words only, such as a line that many texts
have, and hide the real copy.  So windows whose signatures other rows share are
also joined inside their row: the least hashes that a run of passage length has
by all functions form a key of their own, whose windows are linked to the first
row of that key.  Equal passages always share such a key.  Windows that no
passage found so explains are linked again, now also to the nearest row before
theirs in each of their groups.
Where windows of at least ``ENOUGH`` functions link the same two rows and overlap, the shingles themselves decide: a passage is reported where at
least 0.8 of its shingles lie in the earlier text and the Jaccard similarity
with the place there is at least 0.8.

Texts under ``PASSAGE`` words (null and empty ones among them) have no
passages.  Repeats inside one text are not looked for.  Of two rows the one
with the smaller row number keeps the passage; repeated rows are texts like
any others.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.memory import released
from pulsegrid.operators.groups import by_key, whole_groups
from pulsegrid.llm.words import mix, shingles, split_words, text_blocks
from pulsegrid.session import cut_lineage, delete_stored, stored_into

WIDTH, PASSAGE, SIMILARITY = 5, 50, 0.8
HASHES, ENOUGH = 5, 2
JOINT = HASHES  # marks keys by all functions in a signature's last bits
KNOWN = HASHES + 1  # marks passages among windows
# a signature with more than this share of a sample's windows is frequent; there are at most 1 / FREQUENT of them
FREQUENT, SAMPLED, SPREAD = 1e-5, 64, 64
PLACES, GAP = 8, 15
SPANS = "row long, first int, last int, of long, of_first int, of_last int"


def _window_minima(values, length: int):
    """Least value of each run of ``length`` values, by doubling."""
    import numpy as np

    out, done = values, 1
    while done * 2 <= length:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = length - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def compact_windows(hashes, first, length: int):
    """Compact windows of at least ``length`` positions for one hash function: (text, left, least, right), positions over all texts.

    ``first`` has the first position of each text.  A position is the least of
    some run of that length exactly if its window is long enough, and so are
    the next smaller positions on both sides of it.
    """
    import numpy as np

    n = len(hashes)
    bits = max(1, int(n - 1).bit_length()) if n else 1
    low = np.uint64((1 << bits) - 1)
    ranked = (hashes & ~low) | np.arange(n, dtype=np.uint64)  # ties go to the earlier position
    starts, sizes = first[:-1], np.diff(first)
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    minima = _window_minima(ranked, length)
    runs = np.maximum(sizes - length + 1, 0)
    inside = np.repeat(starts - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
    chosen = np.unique((minima[inside] & low).astype(np.int64))
    text = np.searchsorted(first, chosen, "right") - 1
    left, right = np.empty(len(chosen), np.int64), np.empty(len(chosen), np.int64)
    stack: list[int] = []
    value, place, owner, bounds = ranked[chosen].tolist(), chosen.tolist(), text.tolist(), first.tolist()
    now = -1
    for k, v in enumerate(value):
        if owner[k] != now:
            if stack:
                right[stack] = bounds[now + 1] - 1
            stack, now = [], owner[k]
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = place[k] - 1
        left[k] = place[stack[-1]] + 1 if stack else bounds[now]
        stack.append(k)
    if stack:
        right[stack] = bounds[now + 1] - 1
    return text, left, chosen, right


def windows(docs: DataFrame) -> DataFrame:
    """``signature, row, span``; span holds the first and last shingle of a window, 32 bits each, and the
    last three bits of a signature tell the hash functions apart."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        seeds = mix(np.arange(101, 101 + HASHES, dtype=np.uint64))
        for batch in batches:
            for part in text_blocks(batch, "text"):
                values, first = shingles(split_words(part.column("text")), WIDTH)
                row = part.column("__row").to_numpy()
                for fn, seed in enumerate(seeds):
                    hashed = (mix(values ^ seed) & ~np.uint64(7)) | np.uint64(fn)
                    text, left, least, right = compact_windows(hashed, first, PASSAGE - WIDTH + 1)
                    span = ((left - first[text]) << 32) | (right - first[text])
                    yield pa.RecordBatch.from_arrays([pa.array(hashed[least].view(np.int64)), pa.array(row[text]), pa.array(span)], ["signature", "row", "span"])

    return docs.select("__row", "text").mapInArrow(released(cut), "signature long, row long, span long")


def joint_windows(linked: DataFrame) -> DataFrame:
    """``signature, row, span`` of the runs of passage length in a row that have one key by all functions.

    The least hash of a run belongs to the smallest window around it.  A row
    comes as a whole; it has no more windows than its text gives.
    """

    def join(batches):
        import numpy as np
        import pyarrow as pa

        size = PASSAGE - WIDTH + 1
        for table, bounds in whole_groups(batches, ["row"]):
            signature, row, span = (table.column(c).to_numpy() for c in ("signature", "row", "span"))
            low, stop = span >> 32, (span & 0xFFFFFFFF) - size + 2  # places where a run may begin inside the window
            begin, owner = bounds[:-1], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            left, right = np.minimum.reduceat(low, begin), np.maximum.reduceat(stop, begin)
            # rows side by side, each with an empty place behind it
            offset = np.cumsum(np.r_[0, right - left + 1])
            low, stop = low - left[owner] + offset[owner], stop - left[owner] + offset[owner]
            least = np.zeros((HASHES, offset[-1]), np.int64)
            order = np.argsort(low - stop, kind="stable")
            for f, a, b, v in zip((signature & 7)[order].tolist(), low[order].tolist(), stop[order].tolist(), signature[order].tolist(), strict=True):
                least[f, a:b] = v
            moved = np.ones(offset[-1], bool)
            moved[1:] = (least[:, 1:] != least[:, :-1]).any(0)
            change = np.flatnonzero(moved)
            known = (least[:, change] != 0).all(0)
            first, last = change[known], np.r_[change[1:], offset[-1]][known] - 1
            key = np.zeros(len(first), np.uint64)
            for f in range(HASHES):
                key = mix(key ^ least[f, first].view(np.uint64))
            k = np.searchsorted(offset, first, "right") - 1
            place = left[k] - offset[k]
            spans = ((first + place) << 32) | (last + place + size - 1)
            yield pa.RecordBatch.from_arrays([pa.array(((key & ~np.uint64(7)) | np.uint64(JOINT)).view(np.int64)), pa.array(row[begin][k]), pa.array(spans)], ["signature", "row", "span"])

    return by_key(linked.select("signature", "row", "span"), "row").mapInArrow(released(join), "signature long, row long, span long")


def _met(span, of_span, fn):
    """Where windows of enough functions link two rows: (first, last, there first, there last)."""
    import numpy as np

    low, high = span >> 32, (span & 0xFFFFFFFF) + 1
    # cover[p]: of how many functions a window covers position p, counted at the ends of windows
    edges = np.unique(np.concatenate([low, high]))
    cover = np.zeros(len(edges), np.int64)
    for f in np.unique(fn):
        weight, own = ENOUGH if f == JOINT else 1, fn == f
        depth = np.zeros(len(edges) + 1, np.int64)
        np.add.at(depth, np.searchsorted(edges, low[own]), 1)
        np.add.at(depth, np.searchsorted(edges, high[own]), -1)
        cover += weight * (np.cumsum(depth)[:-1] > 0)
    good = np.concatenate([[False], cover >= ENOUGH, [False]])
    begin, end = np.flatnonzero(good[1:] & ~good[:-1]), np.flatnonzero(~good[1:] & good[:-1])
    for i, j in zip(edges[begin], edges[end], strict=True):
        if j - i >= PASSAGE - WIDTH + 1:
            met = of_span[(low < j) & (high > i)]
            yield i, j - 1, (met >> 32).min(), (met & 0xFFFFFFFF).max()


def candidate_places(found: DataFrame) -> DataFrame:
    """``row, first, last, of, of_first, of_last`` (shingles) where windows of enough functions link two rows."""

    def join(batches):
        import numpy as np
        import pyarrow as pa

        for table, bounds in whole_groups(batches, ["row", "of"]):
            row, of, span, of_span, fn = (table.column(c).to_numpy() for c in ("row", "of", "span", "of_span", "fn"))
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                out += [(row[a], i, j, of[a], k, m) for i, j, k, m in _met(span[a:b], of_span[a:b], fn[a:b])]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c), pa.int64() if k in (0, 3) else pa.int32()) for k, c in enumerate(columns)], ["row", "first", "last", "of", "of_first", "of_last"])

    return by_key(found, "row", "of").mapInArrow(released(join), SPANS)


def _slices(docs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``wanted`` rows with the shingles first..last of their row as ``hashes``."""
    texts = docs.select(F.col("__row").alias(key), "text").join(wanted, key)
    kept = wanted.columns

    def attach(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in text_blocks(batch, "text"):
                values, first = shingles(split_words(part.column("text")), WIDTH)
                raw = [
                    [values[a + i : a + j + 1].tobytes() for i, j in zip(lo, hi, strict=True)]
                    for a, lo, hi in zip(first[:-1], part.column("firsts").to_pylist(), part.column("lasts").to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(raw, pa.list_(pa.binary()))], [*kept, "hashes"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return texts.select(*kept, "text").mapInArrow(released(attach), f"{schema}, hashes array<binary>")


def passages(mine, theirs):
    """Ranges of ``mine`` (shingle hashes) that are like a place in ``theirs``: (first, last, there first, there last).

    Matches that stand too far apart to lie in one passage are taken apart at once.  A part without a place is split at its largest gap.
    """
    import numpy as np

    order = np.argsort(theirs, kind="stable")
    place = np.minimum(np.searchsorted(theirs[order], mine), len(theirs) - 1)
    there = order[place]
    match = theirs[there] == mine
    at = np.flatnonzero(match)
    gaps = np.diff(at) - 1
    # at similarity 0.8 a passage has four matches for each miss
    far = np.flatnonzero(gaps > max(GAP, len(at) // 4))
    todo = [(i, j, True) for i, j in zip([0, *(far + 1).tolist()], [*far.tolist(), len(at) - 1], strict=True)]
    while todo:
        i, j, edited = todo.pop()
        if j - i + 1 < (PASSAGE - WIDTH + 1) * 4 // 5:
            continue
        found = _edited_place(at[i : j + 1], there) if edited else None
        edited = found is not None  # a part has no ranges but those of the whole
        if not edited or not _alike(mine[found[0] : found[1]], theirs[found[2] : found[3]]):
            found = _shifted_place(mine, theirs, at[i : j + 1], there)
        if found:
            a, b, c, d = found
            yield a, b - 1, c, d - 1
            todo += [(i, int(np.searchsorted(at, a)) - 1, edited), (int(np.searchsorted(at, b)), j, edited)]
        elif gaps[i:j].any():
            k = i + int(gaps[i:j].argmax())
            todo += [(i, k, edited), (k + 1, j, edited)]
        else:
            yield from _equal_stretches(match, there, int(at[i]), int(at[j]) + 1)


def _alike(x, y) -> bool:
    import numpy as np

    x, y = np.unique(x), np.unique(y)
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def _edited_place(at, there):
    """Longest range from a run of matches to a run of matches with enough of them for the place between them there, which may be longer or shorter."""
    import numpy as np

    new = np.flatnonzero((np.diff(at) != 1) | (np.diff(there[at]) != 1)) + 1
    begin, end = np.r_[0, new], np.r_[new, len(at)]
    low, high = at[begin], at[end - 1] + 1
    there_low, there_high = there[low], there[high - 1] + 1
    best = None
    step = max(1, 200_000 // len(begin))  # some first runs at a time, each with all last runs
    for k in range(0, len(begin), step):
        some = slice(k, k + step)
        n, length, length_there = end - begin[some, None], high - low[some, None], there_high - there_low[some, None]
        good = (9 * n >= 4 * (length + length_there)) & (5 * n >= 4 * length) & (length >= PASSAGE - WIDTH + 1) & (length_there > 0)
        length[~good] = 0
        p, q = divmod(int(length.argmax()), len(begin))
        if length[p, q] > (best[1] - best[0] if best else 0):
            best = int(low[k + p]), int(high[q]), int(there_low[k + p]), int(there_high[q])
    return best


def _shifted_place(mine, theirs, at, there):
    """A dense range and an equally long place; texts that repeat themselves offer several."""
    import numpy as np

    a, b = int(at[0]), int(at[-1]) + 1
    if b - a < PASSAGE - WIDTH + 1 or 5 * len(at) < 4 * (b - a):
        return None
    shifts, n = np.unique(there[at] - at, return_counts=True)
    for shift in shifts[np.argsort(-n, kind="stable")][:PLACES].tolist():
        c, d = max(0, a + shift), min(len(theirs), b + shift)
        if _alike(mine[a:b], theirs[c:d]):
            return a, b, c, d
    return None


def _equal_stretches(match, there, a: int, b: int):
    """Stretches of a..b that are equal word for word."""
    import numpy as np

    steady = match[a + 1 : b] & match[a : b - 1] & (there[a + 1 : b] - there[a : b - 1] == 1)
    breaks = np.concatenate([[a], np.flatnonzero(~steady) + a + 1, [b]])
    for i, j in zip(breaks[:-1].tolist(), breaks[1:].tolist(), strict=True):
        if j - i >= PASSAGE - WIDTH + 1:
            yield i, j - 1, int(there[i]), int(there[j - 1])


def _shingles_of(docs: DataFrame, places: DataFrame, key: str, first: str, last: str, name: str) -> DataFrame:
    """``key, first, last`` of the distinct places, each with its shingles as ``name``."""
    spans = places.select(key, first, last).distinct().groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(first).alias("f"), F.col(last).alias("l")))).alias("p"))
    found = _slices(docs, spans.select(key, F.col("p.f").alias("firsts"), F.col("p.l").alias("lasts")), key)
    each = found.select(key, F.explode(F.arrays_zip("firsts", "lasts", "hashes")).alias("z"))
    return each.select(key, F.col("z.firsts").alias(first), F.col("z.lasts").alias(last), F.col("z.hashes").alias(name))


def verified(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Reported passages, in words."""
    mine = _shingles_of(docs, places, "row", "first", "last", "mine")
    theirs = _shingles_of(docs, places, "of", "of_first", "of_last", "theirs")
    both = places.join(mine, ["row", "first", "last"]).join(theirs, ["of", "of_first", "of_last"])

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for part in text_blocks(batch, "mine"):
                for r in part.to_pylist():
                    a, b = np.frombuffer(r["mine"], np.uint64), np.frombuffer(r["theirs"], np.uint64)
                    for i, j, c, d in passages(a, b):
                        out.append((r["row"], r["first"] + i, r["first"] + j + WIDTH - 1, r["of"], r["of_first"] + c, r["of_first"] + d + WIDTH - 1))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k in (0, 3) else pa.int32()) for k, c in enumerate(columns)], ["row", "first", "last", "of", "of_first", "of_last"])

    return both.select("row", "first", "mine", "of", "of_first", "theirs").mapInArrow(released(compare), SPANS)


def shared_windows(found: DataFrame) -> DataFrame:
    """Stored windows whose signature several rows have, each with the first of these rows and its first window (``of, of_span``)."""
    return grouped_windows(found).drop("before", "before_span")


def grouped_windows(found: DataFrame) -> DataFrame:
    """:func:`shared_windows` with the nearest row before, where it is not the first, and its last window (``before, before_span``).

    A signature that very many rows have is dealt over ``SPREAD`` tasks, and
    the first rows of its parts give the whole one's; which signatures these
    are is estimated from the windows of a sample of the rows.  It decides the
    way only; the row before is then the nearest one of the same part.  All windows are gathered once, sorted by row.
    No join makes more rows than there are windows.
    """
    stored: list[str] = []
    with stored_into(stored):
        kept = cut_lineage(found)
        counts = cut_lineage(kept.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0).groupBy("signature").count())
        total = counts.agg(F.sum("count")).first()[0] or 0
        frequent = cut_lineage(counts.filter(F.col("count") > max(20.0, FREQUENT * total)).select("signature", F.lit(True).alias("often")))
    # one row for each window: those of a frequent signature are dealt over SPREAD tasks
    dealt = kept.join(F.broadcast(frequent), "signature", "left")
    dealt = dealt.withColumn("_part", F.when(F.col("often"), F.pmod(F.xxhash64("row"), F.lit(SPREAD))).otherwise(0))
    w = Window.partitionBy("signature", "_part").orderBy("row", "span").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = dealt.withColumns({"of": F.first("row").over(w), "of_span": F.first("span").over(w), "last": F.last("row").over(w)})
    earlier = F.last(F.struct("row", "span")).over(Window.partitionBy("signature", "_part").orderBy("row").rangeBetween(Window.unboundedPreceding, -1))
    dealt = dealt.withColumn("_b", earlier).withColumn("_b", F.when(F.col("_b.row") > F.col("of"), F.col("_b")))
    parts = cut_lineage(dealt.filter("often or of < last").select("signature", "row", "span", "of", "of_span", "_b.row", "_b.span", F.when(F.col("often"), F.col("last")).alias("last")).toDF("signature", "row", "span", "of", "of_span", "before", "before_span", "last"))
    delete_stored(parts.sparkSession, stored)
    firsts = parts.filter("last is not null and row = of and span = of_span")
    whole = firsts.groupBy("signature").agg(F.min(F.struct("of", "of_span")).alias("f"), F.max("last").alias("l"))
    linked = parts.join(F.broadcast(whole), "signature", "left").filter("l is null or f.of < l")
    # the first row of a later part stands before the others of that part too
    near, near_span = (F.coalesce(b, F.when((F.col("of") < F.col("row")) & (F.col("of") > F.col("f.of")), F.col(o))) for b, o in (("before", "of"), ("before_span", "of_span")))
    return linked.select("signature", "row", "span", F.coalesce("f.of", "of").alias("of"), F.coalesce("f.of_span", "of_span").alias("of_span"), near.alias("before"), near_span.alias("before_span"))


def first_links(linked: DataFrame) -> DataFrame:
    """``row, of, span, of_span, fn`` of each window of a later row."""
    fn = F.col("signature").bitwiseAND(F.lit(7)).cast("int").alias("fn")
    return linked.filter("row <> of").select("row", "of", "span", "of_span", fn)


def nearest_places(linked: DataFrame, found: DataFrame) -> DataFrame:
    """As :func:`candidate_places`, by the windows that lie in no passage ``found``, which link to the first row and to the nearest one before.

    Only places in rows that are the nearest somewhere.  A row comes as a
    whole, its passages as windows of function ``KNOWN``.
    """
    fn = F.col("signature").bitwiseAND(F.lit(7)).cast("int").alias("fn")
    none = F.lit(-1).cast("long")
    open_ = linked.filter("row <> of").select("row", fn, "span", "of", "of_span", F.coalesce("before", none).alias("before"), F.coalesce("before_span", none).alias("before_span"))
    known = F.shiftleft(F.col("first").cast("long"), 32) + F.col("last") - (WIDTH - 1)
    marks = found.select("row", F.lit(KNOWN).alias("fn"), known.alias("span"), none.alias("of"), none.alias("of_span"), none.alias("before"), none.alias("before_span"))

    def join(batches):
        import numpy as np
        import pyarrow as pa

        for table, bounds in whole_groups(batches, ["row"]):
            row, fn, span, of, of_span, before, before_span = (table.column(c).to_numpy() for c in ("row", "fn", "span", "of", "of_span", "before", "before_span"))
            some = np.flatnonzero(np.logical_or.reduceat(before >= 0, bounds[:-1]))
            out = []
            for a, b in zip(bounds[some], bounds[some + 1], strict=True):
                known = span[a:b][fn[a:b] == KNOWN]
                left = np.ones(b - a, bool)
                for k in known:
                    left &= (span[a:b] >> 32 < k >> 32) | (span[a:b] & 0xFFFFFFFF > k & 0xFFFFFFFF)
                mine = a + np.flatnonzero(left & (fn[a:b] != KNOWN))
                near = mine[before[mine] >= 0]
                if not len(near):
                    continue
                to, there = np.concatenate([of[mine], before[near]]), np.concatenate([of_span[mine], before_span[near]])
                here = np.concatenate([mine, near])
                for other in np.unique(before[near]):
                    w = to == other
                    out += [(row[a], i, j, other, k, m) for i, j, k, m in _met(span[here[w]], there[w], fn[here[w]])]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c), pa.int64() if k in (0, 3) else pa.int32()) for k, c in enumerate(columns)], ["row", "first", "last", "of", "of_first", "of_last"])

    return by_key(open_.unionByName(marks), "row").mapInArrow(released(join), SPANS)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``row, first, last, of, of_first, of_last``: words of a row that repeat words of an earlier one.

    ``docs`` needs ``__row`` (a number of its own for each row, stored so that it never changes; smaller is earlier) and ``text``.
    """
    alone = grouped_windows(windows(docs))
    joint = grouped_windows(joint_windows(alone))
    places = cut_lineage(candidate_places(first_links(alone).unionByName(first_links(joint))).distinct())
    found = cut_lineage(verified(docs, places))
    more = nearest_places(alone.unionByName(joint), found).distinct().join(places.hint("merge"), places.columns, "left_anti")
    return found.unionByName(verified(docs, cut_lineage(more))).distinct()


def without_repeats(docs: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """``docs`` (with ``__row``) whose texts have lost their repeated passages; texts left without words go."""
    spans = repeated_passages(docs) if spans is None else spans
    gone = spans.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("__gone")).withColumnRenamed("row", "__row")
    keep = docs.columns
    place = keep.index("text")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_blocks(batch, "text"):
                words = split_words(part.column("text"))
                texts = part.column("text").to_pylist()
                for i, spans in enumerate(part.column("__gone").to_pylist()):
                    if not spans:
                        continue
                    base, size = int(words.first[i]), int(words.first[i + 1] - words.first[i])
                    left = [True] * size
                    for s in spans:
                        left[s["first"] : s["last"] + 1] = [False] * (s["last"] + 1 - s["first"])
                    if not any(left):
                        texts[i] = ""
                        continue
                    raw = texts[i].encode()
                    # where the text starts among the lower-cased bytes of all texts of the part
                    origin = words.origin[i]
                    out, at = [], 0
                    for k in range(size):
                        if not left[k] and (k == 0 or left[k - 1]):
                            out.append(raw[at : words.start[base + k] - origin])
                        if left[k] and k and not left[k - 1]:
                            at = words.start[base + k] - origin
                    out.append(raw[at:] if left[-1] else b"")
                    texts[i] = b"".join(out).decode()
                columns = [part.column(c) for c in keep]
                columns[place] = pa.array(texts, part.column("text").type)
                yield pa.RecordBatch.from_arrays(columns, keep)

    return docs.join(gone, "__row", "left").select(*keep, "__gone").mapInArrow(released(cut), docs.schema).filter(F.col("text").isNull() | (F.col("text") != "") )
