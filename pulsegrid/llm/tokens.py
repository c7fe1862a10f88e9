"""Exact encoding with the ``tokenizers`` library, by chunks that never share a token.

Encoding a text as a whole costs about one CPU second a megabyte.  Its white
space cuts it into chunks that the tokenizer's pre-tokenizer separates anyway,
so the ids of a text are the joined ids of its chunks, and each chunk is
encoded once and remembered.  Texts with other white space than the cutting
rule knows, or with the name of an added token, are encoded whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

REMEMBERED_BYTES = 112 << 20

# dropped: the tokenizer drops white space. kept: one blank or line feed before a chunk belongs to it.
CUTS = {
    "dropped": (re.compile(r"[^\S \n\t\r]"), re.compile(r"\S+")),
    "kept": (re.compile(r"[^\S \n]"), re.compile(r"[ \n]?[^ \n]+|[ \n]+(?=[ \n][^ \n])|[ \n]+")),
}
# letters that lower-case one to one and are composed, then marks that start a token of their own
PLAIN = re.compile(r"([ \n]?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!]*)")


class ChunkEncoder(dict):
    """Texts to the bytes of their ids (little-endian, ``dtype``).  As a dict, the known chunks.

    ``split_special``: the names of special tokens in a text are ordinary words; otherwise, as the library does by default, they are those tokens.
    """

    def __init__(self, path: str, spaces: str, split_special: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = split_special
        self.names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = self.dtype.char
        self.kept = spaces == "kept"
        self.odd, chunk = CUTS[spaces]
        self.split = chunk.findall if self.kept else str.split
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(32, 256)}
        self.size = 0

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        plain = PLAIN.fullmatch(chunk)
        if not plain:
            ids = self.whole(chunk)
        elif plain[3]:
            ids = self[plain[1] + plain[2]] + self[plain[3]]
        elif plain[1] == "\n":
            ids = self["\n"] + self[plain[2]]
        elif not self.kept and chunk != chunk.lower():
            ids = self[chunk.lower()]
        else:
            # the pre-tokenizer would pass this chunk on as it is
            ids = array(self.code, [t.id for t in self.model.tokenize(chunk.translate(self.letters))]).tobytes()
        self[chunk] = ids
        self.size += len(ids) + len(chunk) + 150
        return ids

    def _forget(self) -> None:
        """Short chunks are the frequent ones; they stay unless they fill half the space."""
        short = [(k, v) for k, v in self.items() if len(k) <= 9]
        self.clear()
        self.size = sum(len(k) + len(v) + 150 for k, v in short)
        if self.size > REMEMBERED_BYTES // 2:
            self.size = 0
        else:
            self.update(short)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self.size > REMEMBERED_BYTES:
                self._forget()
            out.append(self.whole(text) if self.odd.search(text) or any(n in text for n in self.names) else b"".join(map(self.__getitem__, self.split(text))))
        return out


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, spaces: str) -> ChunkEncoder:
    """One encoder for each Python worker, with the library's default for special tokens."""
    key = (path, spaces)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, spaces, split_special=False)
    return _ENCODERS[key]
