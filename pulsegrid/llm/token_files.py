"""Token-ID files: flat unsigned integers, 64-bit document offsets, memory-mapped.

``write_token_files`` deals documents out by ranges of their id, encodes each
range and streams the ids to one flat file.  Beside it, an index file holds
the document ids and the 64-bit offsets inside the file.  A file's base, the
ids in all files before it, is a prefix sum over one row per file; a global
offset is base plus local offset.  A failed or repeated task leaves a file
that no manifest row names, so results do not depend on lost executors.

Index file, little-endian: the 8 bytes ``TOKIDX01``, int64 number of documents
n, int64 bytes per id, n document ids (int64), n null marks of the ids
(uint8), n + 1 offsets (int64, in ids).
"""

from __future__ import annotations

import uuid
import zlib
from array import array

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.memory import released
from pulsegrid.llm.shared_files import new_folder, open_read, open_write
from pulsegrid.llm.tokens import encoder
from pulsegrid.session import cut_lineage

MAGIC = b"TOKIDX01"
BLOCK_IDS = 1 << 22
MANIFEST = "file string, first_id long, n_docs long, n_tokens long, id_bytes int"
SPANS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode all documents into files; returns the manifest, one row per file, in document order, with ``base``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null
    or empty text is one end id.  Null document ids come first; equal document
    ids stay separate documents, ordered by text.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")

    def write(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(tokenizer, spaces)
        end = np.array([end_id], enc.dtype).tobytes()
        name, out = f"{folder}/{uuid.uuid4().hex}", None
        ids, nulls, offsets = array("q"), bytearray(), array("q", [0])
        for batch in batches:
            if out is None:
                out = open_write(f"{name}.bin")
            found = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            for doc, coded in zip(batch.column(0).to_pylist(), found, strict=True):
                out.write(coded + end)
                ids.append(doc or 0)
                nulls.append(doc is None)
                offsets.append(offsets[-1] + len(coded) // enc.dtype.itemsize + 1)
        if out is None:
            return
        out.close()
        with open_write(f"{name}.idx") as index:
            for part in (MAGIC, np.array([len(ids), enc.dtype.itemsize], "<i8"), np.array(ids, "<i8"), nulls, np.array(offsets, "<i8")):
                index.write(bytes(part))
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([name]), "first_id": pa.array([None if nulls[0] else ids[0]], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()),
            "n_tokens": pa.array([offsets[-1]], pa.int64()), "id_bytes": pa.array([enc.dtype.itemsize], pa.int32()),
        })

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = cut_lineage(ranged.mapInArrow(released(write), MANIFEST))
    before = Window.orderBy(F.asc_nulls_first("first_id")).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files alone: its place, its number of ids and their crc32."""

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                with open_read(f"{row['file']}.idx") as f:
                    raw = f.read()
                if bytes(raw[:8]) != MAGIC:
                    raise ValueError(f"not an index file: {row['file']}.idx")
                n, width = (int(x) for x in np.frombuffer(raw, "<i8", 2, 8))
                doc = np.frombuffer(raw, "<i8", n, 24)
                null = np.frombuffer(raw, np.uint8, n, 24 + 8 * n).astype(bool)
                offsets = np.frombuffer(raw, "<i8", n + 1, 24 + 9 * n)
                a = 0
                with open_read(f"{row['file']}.bin") as f:
                    while a < n:
                        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_IDS, "right")) - 1)
                        f.seek(int(offsets[a]) * width)
                        ids = np.frombuffer(f.read_buffer(int(offsets[b] - offsets[a]) * width), f"<u{width}").astype("<u4")
                        cut = offsets[a : b + 1] - offsets[a]
                        crc = [zlib.crc32(ids[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(doc[a:b], pa.int64(), mask=null[a:b]), "start": pa.array(offsets[a:b] + row["base"], pa.int64()),
                            "n_tokens": pa.array(np.diff(offsets[a : b + 1]), pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                        })
                        a = b

    # one file for each task
    return manifest.repartition(max(1, manifest.count())).mapInArrow(released(read), SPANS)
