"""Hidden Markov language model: distributed Baum-Welch, exact scaled forward scores.

Tokens are the words of a text between ASCII white space, A-Z lower-cased,
then one end.  Word counts cover all training documents and stay distributed.
The ``VOCABULARY`` most frequent words are symbols of their own, the end is
one, and all rarer words share one symbol; within it a word has its exact
smoothed share ``(c + 1) / (N_rare + V_rare + 1)``, found by a join.  So the
score is the exact probability of the text under one model whatever the size
of the vocabulary, and no table that grows with the corpus is broadcast.

Words are told apart by a 64-bit hash.  The training starts from a model with random preferences and makes
``WARM_PASSES + PASSES`` passes over all training documents, however many there
are.  The first goes part by part (parts by hash, of ``WARM_DOCS`` documents or
more, at most ``WARM_PASSES``): the model is improved after each part, from the
counts of all parts so far.  The others take all documents together.  A pass or
part is one Spark job that returns expected counts, whose size is fixed by the
number of states and symbols.

Null or empty texts are the end alone.  A null document id counts as the
empty text where the split is decided.  Repeated rows are scored each for
themselves; without training documents every text has base score 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.memory import released
from pulsegrid.llm.words import NON_SPACE, split_words, text_blocks
from pulsegrid.session import cut_lineage, shuffles_freed

VOCABULARY = 65_000
STATES = 8
WARM_DOCS, WARM_PASSES, PASSES = 4_000, 10, 2
PRIOR = 20.0
COUNT_BLOCK = 8 << 20
TOKEN_BLOCK = 200_000
# steps between two scalings, rows of a block of counts
SCALED, COUNT_ROWS = 8, 1024
SLOT_BITS = 20
ENCODED = "doc_id long, held_out boolean, n_words long, known long, log_counts double, symbols binary, rare array<long>"
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, log_counts double, n_rare long, log_states double"


def held_out(doc_id: str = "doc_id", parts: int = 7, part: int = 2):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts == part


def word_counts(train: DataFrame) -> DataFrame:
    """``hash``, ``n`` of every distinct training word; counted in each batch before the shuffle."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in text_blocks(batch, "text", COUNT_BLOCK):
                hashes, n = np.unique(split_words(part.column("text"), NON_SPACE).hash, return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": hashes.view(np.int64), "n": n.astype(np.int64)})

    return train.select("text").mapInArrow(released(count), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def encode(docs: DataFrame, frequent: dict[int, int]) -> DataFrame:
    """Each document as symbols: k for the k-th frequent word, then rare and end; rare words as hashes."""
    import numpy as np

    keys = np.array(list(frequent), np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    # the first key of each slot, by a hash's upper bits; a slot seldom has two
    slots = np.searchsorted(keys >> np.uint64(64 - SLOT_BITS), np.arange(1 << SLOT_BITS, dtype=np.uint64)).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((keys, slots, order.astype("<u2"), np.log10(np.array(list(frequent.values()), float) + 1)))

    def code(batches):
        import pyarrow as pa

        keys, slots, symbol_of, logs = shared.value
        rare = np.uint16(len(keys))
        logs = np.append(logs, 0.0)
        for batch in batches:
            for part in text_blocks(batch, "text"):
                words = split_words(part.column("text"), NON_SPACE)
                symbols = np.full(len(words.hash), rare, "<u2")
                if len(keys):
                    place = np.minimum(slots[words.hash >> np.uint64(64 - SLOT_BITS)], len(keys) - 1)
                    behind = np.flatnonzero(keys[place] < words.hash)
                    place[behind] = np.minimum(np.searchsorted(keys, words.hash[behind]), len(keys) - 1)
                    symbols = np.where(keys[place] == words.hash, symbol_of[place], rare).astype("<u2")
                gathered = np.concatenate([[0.0], np.cumsum(logs[symbols])])[words.first]
                odd = symbols == rare
                before = np.concatenate([[0], np.cumsum(odd)])[words.first]
                n = np.diff(words.first)
                raw = symbols.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(n - np.diff(before)), pa.array(np.diff(gathered)),
                        pa.array([raw[2 * a : 2 * b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(words.hash[odd].view(np.int64))),
                    ],
                    ["doc_id", "held_out", "n_words", "known", "log_counts", "symbols", "rare"],
                )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(released(code), ENCODED)


def _blocks(symbol_bytes: list, end: int):
    """Texts of about one length together, laid out step by step: (which texts, longest first; their lengths, symbols; start of each step)."""
    import numpy as np

    lengths = np.array([len(b) // 2 + 1 for b in symbol_bytes])
    order = np.argsort(-lengths, kind="stable")
    a = 0
    while a < len(order):
        size = np.cumsum(lengths[order[a:]])
        b = a + max(1, int(np.searchsorted(size, TOKEN_BLOCK, "right")))
        chosen = order[a:b]
        n = lengths[chosen]
        flat = np.frombuffer(b"".join(symbol_bytes[i] + int(end).to_bytes(2, "little") for i in chosen), "<u2").astype(np.int64)
        active = np.searchsorted(-n, -np.arange(n[0]), "left")  # texts longer than the step
        step = np.concatenate([[0], np.cumsum(active)])
        # symbol t of the k-th text goes to step[t] + k
        rank = np.repeat(np.arange(len(n)), n)
        t = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        laid = np.empty_like(flat)
        laid[step[t] + rank] = flat
        yield chosen, n, laid, step
        a = b


def forward(start, move, emit, laid, step, keep: bool):
    """Scaled forward recursion.  Returns the scale of each symbol, whose product over a text is its probability, and all states if asked for.

    States are scaled at every ``SCALED``-th step and where a text ends; between
    them they only grow smaller by a few powers of ten a step.
    """
    import numpy as np

    scale = np.ones(len(laid))
    states = np.take(emit, laid, 0, mode="clip")
    ones, at, before = np.ones(len(start)), step.tolist(), None
    for t, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        now = states[a:b]
        now *= start if t == 0 else before[: b - a].dot(move)
        if t % SCALED == SCALED - 1:
            scale[a:b] = now.dot(ones)
            now /= scale[a:b, None]
        before = now
    last = _last(step)
    scale[last] *= states[last].dot(ones)
    return scale, states if keep else None


def _last(step):
    """Where the texts end: at each step the shortest, which come last."""
    import numpy as np

    active = np.diff(step)
    going = np.append(active[1:], 0)
    return np.flatnonzero(np.arange(step[-1]) >= np.repeat(step[:-1] + going, active))


def _expected(model, laid, step):
    """Expected counts of one block: starts, moves, and the state weights of each symbol."""
    import numpy as np

    start, move, emit = model
    scale, states = forward(start, move, emit, laid, step, True)
    # of a symbol, by state: in ahead what comes from it on, in back what comes after it, at last its weights
    ahead, back = np.take(emit, laid, 0, mode="clip"), np.empty_like(states)
    last, turned, at = _last(step), np.ascontiguousarray(move.T), step.tolist()
    back[last] = 1 / states[last].sum(1, keepdims=True)
    moves = np.zeros_like(move)
    for t in range(len(at) - 2, 0, -1):
        a, b, c = at[t - 1 : t + 2]
        end, later, here = a + c - b, ahead[b:c], back[b:c]
        later *= here
        here *= states[b:c]
        if t % SCALED == SCALED - 1:
            later /= scale[b:c, None]
        later.dot(turned, out=back[a:end])
        moves += states[a:end].T.dot(later)
    back[: at[1]] *= states[: at[1]]
    return back[: at[1]].sum(0), moves * move, back


def expected_counts(encoded: DataFrame, model, end: int):
    """One Baum-Welch pass: starts, moves and emissions summed over all rows of ``encoded``.

    Counts move as blocks of ``COUNT_ROWS`` rows of one table: the symbols, the
    moves out of each state, the starts.
    """
    import numpy as np

    shared = encoded.sparkSession.sparkContext.broadcast(model)
    h = len(model[0])
    size = end + 1 + h + 1
    schema = "block int, counts binary"

    def gather(batches):
        import pyarrow as pa

        model = shared.value
        table = np.zeros((h, size))
        for batch in batches:
            for _, _, laid, step in _blocks(batch.column(0).to_pylist(), end):
                s, m, weights = _expected(model, laid, step)
                for i, own in enumerate(np.ascontiguousarray(weights.T)):
                    table[i, : end + 1] += np.bincount(laid, own, end + 1)
                table[:, end + 1 : -1] += m.T
                table[:, -1] += s
        table = np.ascontiguousarray(table.T)
        some = [(k, part) for k in range(0, size, COUNT_ROWS) if (part := table[k : k + COUNT_ROWS]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([k // COUNT_ROWS for k, _ in some], pa.int32()), pa.array([p.tobytes() for _, p in some], pa.binary())], ["block", "counts"])

    def add(batches):
        import pyarrow as pa

        # at most one table
        total = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0.0) + np.frombuffer(counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["block", "counts"])

    table = np.zeros((size, h))
    with shuffles_freed(encoded.sparkSession):
        parts = encoded.select("symbols").mapInArrow(released(gather), schema)
        # one row for each block
        found = parts.repartition("block").mapInArrow(released(add), schema).collect()
    for r in found:
        k = r["block"] * COUNT_ROWS
        table[k : k + COUNT_ROWS] = np.frombuffer(r["counts"]).reshape(-1, h)
    return table[-1], table[end + 1 : -1], table[: end + 1]


def _model(starts, moves, seen, prior):
    import numpy as np

    h = len(starts)
    start = (starts + 1) / (starts.sum() + h)
    move = (moves + 0.1) / (moves.sum(1, keepdims=True) + 0.1 * h)
    emit = (seen + PRIOR * prior[:, None]) / (seen.sum(0) + PRIOR)
    return start, move, np.ascontiguousarray(emit)


def train(encoded: DataFrame, frequent_counts: list[int], total: int, n_docs: int, n_rare: int, states: int, warm_docs: int, warm_passes: int, passes: int):
    """Start, move and emission probabilities; ``encoded`` holds the training documents.

    Every document counts ``warm_passes + passes`` times.
    """
    import numpy as np

    prior = np.array([*frequent_counts, n_rare + 1, n_docs], float) / (total + 1)
    noise = np.random.default_rng(7).random((len(prior), states))
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95)
    emit = prior[:, None] * (0.5 + noise)
    model = np.full(states, 1 / states), move, emit / emit.sum(0)
    end = len(prior) - 1
    if not n_docs:
        return model
    parts = max(1, min(warm_passes, n_docs // warm_docs))
    counts = None
    for k in range(parts if parts > 1 else 0):
        found = expected_counts(encoded.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == k), model, end)
        counts = found if counts is None else tuple(a + b for a, b in zip(counts, found, strict=True))
        model = _model(*counts, prior)
    for _ in range(warm_passes + passes - (parts > 1)):
        model = _model(*expected_counts(encoded, model, end), prior)
    return model


def score_states(encoded: DataFrame, model, end: int) -> DataFrame:
    """log10 probability of each document's symbols under the model."""
    import numpy as np

    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("symbols").to_pylist()
            out = np.zeros(len(texts))
            for chosen, n, laid, step in _blocks(texts, end):
                scale, _ = forward(*shared.value, laid, step, False)
                rank = np.arange(len(laid)) - np.repeat(step[:-1], np.diff(step))
                out[chosen] = np.bincount(rank, np.log10(scale), len(n))
            kept = ["row", "doc_id", "held_out", "n_tokens", "known", "log_counts", "n_rare"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out)], [*kept, "log_states"])

    source = encoded.select("row", "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), "known", "log_counts", F.size("rare").cast("long").alias("n_rare"), "symbols")
    return source.mapInArrow(released(run), SCORED)


def score_documents(docs: DataFrame, vocabulary: int = VOCABULARY, states: int = STATES, warm_docs: int = WARM_DOCS, warm_passes: int = WARM_PASSES, passes: int = PASSES) -> DataFrame:
    """Train on the documents that are not held out and score all of them."""
    training = docs.filter(~held_out())
    counts = cut_lineage(word_counts(training))
    n_docs = training.count()
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "hash").limit(min(vocabulary, 65_000)).collect()  # symbols are 16 bits
    frequent = {r["hash"]: r["n"] for r in top}
    total, distinct = totals["n"] + n_docs, totals["v"] + (n_docs > 0)
    n_rare, v_rare = totals["n"] - sum(frequent.values()), totals["v"] - len(frequent)
    end = len(frequent) + 1

    encoded = cut_lineage(encode(docs, frequent).withColumn("row", F.monotonically_increasing_id()))
    model = train(encoded.filter(~F.col("held_out")), list(frequent.values()), total, n_docs, n_rare, states, warm_docs, warm_passes, passes)
    scored = score_states(encoded, model, end)

    rare = encoded.select("row", F.explode("rare").alias("hash")).join(counts, "hash", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_logs"), F.count("n").alias("rare_known"))
    one = F.lit(float(total + distinct + 1))
    logs = F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0)) + int(n_docs > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (logs + F.log10(F.lit(float(n_docs + 1))) - F.col("n_tokens") * F.log10(one)).alias("base_score"),
        (F.col("log_states") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_rare") * F.log10(F.lit(float(n_rare + v_rare + 1)))).alias("score"),
    )
