"""Language identification by unigram pieces, summed over all segmentations.

The pieces are a fixed public vocabulary.  Each language has a probability for
each piece; a word's probability is the sum over all ways to cut it into
pieces (forward algorithm), a text's the product over its words.  The
probabilities are fitted by expectation-maximisation over all segmentations of
the words of the labelled documents.

Words are runs of letters a-z (A-Z lower-cased) and characters beyond ASCII;
in scripts without spaces a run is a whole clause.  All runs are learnt from,
those of more than 512 characters in parts.
Words with the same 64-bit hash count as one word.  A text that is null or
has no letter is ``und`` with score 0; so is every text if there is nothing to
learn from.  The score is the posterior of the language under equal priors;
ties go to the first language by name.  Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.llm.memory import released
from pulsegrid.llm.words import ALNUM, split_words, text_blocks
from pulsegrid.session import cut_lineage

TRAIN_DOCS = 2_000  # about so many labelled documents of each language are learnt from, chosen by hash
PASSES = 4
LEARNT_CHARS = 512  # longer runs are learnt from in parts of so many characters
UNKNOWN = 1e-10  # of one character that is no piece
SMOOTH = 1e-3
WORD_BLOCK = 4 << 20
REMEMBERED_WORDS = 600_000
CHUNK = 20_000
LETTERS = ALNUM.copy()
LETTERS[48:58] = False
MARK = "▁"


class Pieces:
    """The vocabulary: which substrings are pieces."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = sorted({p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (p := model.id_to_piece(i)).replace(MARK, "a").isalpha()})
        self.size, self.longest = len(names), max(map(len, names))
        hashes = np.zeros(len(names), np.uint64)
        for i, name in enumerate(names):
            h = 0
            for c in name:
                h = (h * self.BASE + ord(c)) & (1 << 64) - 1
            hashes[i] = h
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)

    BASE = 0x9E3779B97F4A7C15

    def lattice(self, words: list[str]):
        """Words of one length at a time: (their indexes, characters + 1, ids[start][length - 1] of all substrings; ``size``: no piece)."""
        import numpy as np

        lengths = np.array([len(w) for w in words])
        base = np.uint64(self.BASE)
        for n in np.unique(lengths):
            same = np.flatnonzero(lengths == n)
            step = max(1, CHUNK * 12 // (int(n) + 1))
            for a in range(0, len(same), step):
                chosen = same[a : a + step]
                chars = np.array([MARK + words[i] for i in chosen], f"U{n + 1}").view(np.uint32).reshape(len(chosen), n + 1).T.astype(np.uint64)
                ids = []
                for i in range(n + 1):
                    h = np.zeros(len(chosen), np.uint64)
                    row = []
                    for j in range(i, min(n + 1, i + self.longest)):
                        h = h * base + chars[j]
                        place = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
                        row.append(np.where(self.hashes[place] == h, self.ids[place], self.size))
                    ids.append(row)
                yield chosen, int(n) + 1, ids


def forward(ids, n: int, table):
    """Scaled sums over all segmentations of each prefix, and the log of the scale."""
    import numpy as np

    w = len(ids[0][0])
    sums = np.zeros((n + 1, w, table.shape[1]))
    sums[0] = 1
    scale = np.zeros((n + 1, w))
    for j in range(1, n + 1):
        total = sums[j - 1] * UNKNOWN
        for i in range(max(0, j - max(map(len, ids))), j):
            total += sums[i] * table[ids[i][j - i - 1]]
        sums[j] = total
        if j % 8 == 0 or n > 64:
            top = total.max(1)
            scale[j:] += np.log(top)
            sums[max(0, j - 63) : j + 1] /= top[:, None]
    return sums, scale[n]


def word_scores(pieces: Pieces, words: list[str], table):
    """log probability of each word in each language."""
    import numpy as np

    out = np.zeros((len(words), table.shape[1]))
    for chosen, n, ids in pieces.lattice(words):
        sums, scale = forward(ids, n, table)
        out[chosen] = np.log(sums[n]) + scale[:, None]
    return out


def expected_pieces(pieces: Pieces, words: list[str], counts, table):
    """Expected uses of each piece by language, given the counts of the words there."""
    import numpy as np

    total = np.zeros((pieces.size + 1, table.shape[1]))
    for chosen, n, ids in pieces.lattice(words):
        # logs of the sums over all segmentations of each prefix: words of any length keep their precision
        reach = np.zeros((n + 1, len(chosen), table.shape[1]))
        for j in range(1, n + 1):
            some = np.full(reach.shape[1:], UNKNOWN)
            for i in range(max(0, j - pieces.longest), j):
                some += table[ids[i][j - i - 1]] * np.exp(reach[i] - reach[j - 1])
            reach[j] = reach[j - 1] + np.log(some)
        # how often segmentations have a cut at each place
        cut = np.zeros_like(reach)
        cut[n] = counts[chosen]
        seen, weight = [], []
        for i in range(n - 1, -1, -1):
            cut[i] = cut[i + 1] * (UNKNOWN * np.exp(reach[i] - reach[i + 1]))
            for k, row in enumerate(ids[i]):
                use = table[row] * np.exp(reach[i] - reach[i + k + 1]) * cut[i + k + 1]
                cut[i] += use
                seen.append(row)
                weight.append(use)
            if len(seen) > 2048 or i == 0:
                at, uses = np.concatenate(seen), np.concatenate(weight)
                for lang in range(table.shape[1]):
                    total[:, lang] += np.bincount(at, uses[:, lang], pieces.size + 1)
                seen, weight = [], []
    return total[:-1]


_PIECES: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    """One vocabulary for each Python worker."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def labelled_part(doc_id: str = "doc_id", parts: int = 3, part: int = 1):
    """True for documents that are held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts == part


def train(docs: DataFrame, path: str, train_docs: int = TRAIN_DOCS, passes: int = PASSES):
    """Languages and the table of piece probabilities (a last row of zeros), from text and lang of documents not held out."""
    import numpy as np

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~labelled_part())
    numbers = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(numbers)
    if not langs:
        return [], None
    share = F.create_map(*(F.lit(x) for k, n in numbers.items() for x in (k, int(min(1.0, train_docs / n) * (1 << 30)) + 1)))
    sample = known.filter(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) < share[F.col("lang")]).select("lang", "text")
    place = {k: i for i, k in enumerate(langs)}

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_blocks(batch, "text", WORD_BLOCK):
                words = split_words(part.column("text"), LETTERS)
                lang = np.repeat([place[x] for x in part.column("lang").to_pylist()], np.diff(words.first))
                for k in np.unique(lang):
                    own = np.flatnonzero(lang == k)
                    _, at, n = np.unique(words.hash[own], return_index=True, return_counts=True)
                    texts = [words.data[words.start[i] : words.end[i]].tobytes().decode("utf-8", "replace") for i in own[at]]
                    parts = [(t[a : a + LEARNT_CHARS], m) for t, m in zip(texts, n.tolist(), strict=True) for a in range(0, len(t), LEARNT_CHARS)]
                    yield pa.RecordBatch.from_pydict({"word": [t for t, _ in parts], "k": pa.array([int(k)] * len(parts), pa.int32()), "n": pa.array([m for _, m in parts], pa.int64())})

    counts = sample.mapInArrow(released(count), "word string, k int, n long")
    sums = [F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).cast("double").alias(f"n{k}") for k in range(len(langs))]
    counts = cut_lineage(counts.groupBy("word").agg(*sums))
    names = [f"n{k}" for k in range(len(langs))]
    size = vocabulary(path).size
    table = np.r_[np.full((size, len(langs)), 1 / size), np.zeros((1, len(langs)))]
    for _ in range(passes):
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def expect(batches, shared=shared):
            import pyarrow as pa

            total = 0
            for batch in batches:
                weights = np.stack([batch.column(n).to_numpy() for n in names], 1)
                total = total + expected_pieces(vocabulary(path), batch.column("word").to_pylist(), weights, shared.value)
            if np.ndim(total):
                some = np.flatnonzero(total.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(len(names)))], ["piece", *names])

        rows = counts.mapInArrow(released(expect), f"piece long, {', '.join(f'{n} double' for n in names)}")
        table = np.full((size + 1, len(langs)), SMOOTH)
        # at most one row for each piece of the vocabulary
        for r in rows.groupBy("piece").agg(*(F.sum(n).alias(n) for n in names)).collect():
            table[r["piece"]] += r[1:]
        table[size] = 0
        table /= table.sum(0)
    return langs, table


class WordMemory:
    """Scores of words already seen by this worker, by hash."""

    def __init__(self, pieces: Pieces, table):
        import numpy as np

        self.pieces, self.table = pieces, table
        self.hashes, self.scores = np.zeros(0, np.uint64), np.zeros((0, table.shape[1]))

    def of(self, words, hashes, at):
        """Scores of distinct words: their sorted hashes, and where each stands among ``words``."""
        import numpy as np

        place = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.hashes)
        new[inside] = self.hashes[place[inside]] != hashes[inside]
        out = np.empty((len(hashes), self.table.shape[1]))
        out[~new] = self.scores[place[~new]]
        texts = [words.data[words.start[i] : words.end[i]].tobytes().decode("utf-8", "replace") for i in at[new]]
        out[new] = word_scores(self.pieces, texts, self.table)
        if len(self.hashes) > REMEMBERED_WORDS:
            self.hashes, self.scores = hashes, out.copy()
        else:
            self.scores = np.insert(self.scores, place[new], out[new], axis=0)
            self.hashes = np.insert(self.hashes, place[new], hashes[new])
        return out


FOUND = "__lang string, __score double"


def predict(docs: DataFrame, path: str, langs: list[str], table) -> DataFrame:
    """``docs`` with ``__lang`` and ``__score``; only ``text`` is looked at."""
    keep = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = StructType(docs.schema.fields + StructType.fromDDL(FOUND).fields)

    def judge(batches):
        import numpy as np
        import pyarrow as pa

        memory = WordMemory(vocabulary(path), shared.value) if langs else None
        for batch in batches:
            for part in text_blocks(batch, "text", WORD_BLOCK):
                words = split_words(part.column("text"), LETTERS)
                name, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if memory is not None and len(words.hash):
                    hashes, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
                    scores = memory.of(words, hashes, at)
                    some = np.flatnonzero(np.diff(words.first))
                    total = np.add.reduceat(scores[back], words.first[some], axis=0)
                    best = total.argmax(1)
                    share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    texts = part.column("text")
                    for i, k, s in zip(some.tolist(), best.tolist(), share.tolist(), strict=True):
                        span = words.data[words.start[words.first[i]] : words.end[words.first[i + 1] - 1]]
                        if ((span >= 97) & (span <= 122)).any() or any(c.isalpha() for c in texts[i].as_py()):
                            name[i], score[i] = langs[k], s
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(name), pa.array(score)], [*keep, "__lang", "__score"])

    return docs.mapInArrow(released(judge), schema)


def identified(docs: DataFrame, path: str) -> DataFrame:
    """Train on the documents that are not held out and judge all of them."""
    langs, table = train(docs, path)
    return predict(docs, path, langs, table)
