"""Token ids of whole texts from a bounded cache of pieces between which no token can reach."""

from __future__ import annotations

import base64
import re

import numpy as np

CACHE_PIECES = 300_000
#: the added token of the byte-level vocabulary of 50,257 ids, which its rank file leaves out
END_OF_TEXT = (("<|endoftext|>", 50256),)
_HELD: dict = {}


class ByteLevel:
    """Byte-level BPE ids of whole texts, equal to encoding them in one go.

    The pattern of these vocabularies begins a new piece at every space that stands before a
    character that is no white space, and on both sides of a lone line feed between such
    characters. A text is cut there and each piece is encoded once per worker. Texts with other
    white space around line feeds are encoded whole. The cache holds CACHE_PIECES pieces at most
    and starts again when it is full. Strings in special are tokens of their own wherever they stand, as the
    vocabulary's library has it; without any they are ordinary text.
    """

    def __init__(self, ranks_file: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {text: np.array([k], dtype="<u4").tobytes() for text, k in special}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None
        self.lengths = np.zeros(max([*ranks.values(), *(k for _, k in special)]) + 1, dtype=np.int64)
        for token, k in [*ranks.items(), *((text.encode(), k) for text, k in special)]:
            self.lengths[k] = len(token)
        self.cache: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}
        self.newline = self._whole("\n")

    @classmethod
    def held(cls, *made_of) -> ByteLevel:
        """One per worker process."""
        if made_of not in _HELD:
            _HELD[made_of] = cls(*made_of)
        return _HELD[made_of]

    def _whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if len(self.cache) >= CACHE_PIECES // 4:
            self.cache.clear()
        ids = self.cache[piece] = self._whole(piece)
        return ids

    def _after_space(self, piece: str) -> bytes:
        if len(self.after_space) >= CACHE_PIECES:
            self.after_space.clear()
        ids = self.after_space[piece] = self._whole(" " + piece)
        return ids

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.cut is not None and self.cut.search(text):
            return b"".join([self.special.get(part) or self._ordinary(part) for part in self.cut.split(text)])
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        get, piece, get_after, after = self.cache.get, self._piece, self.after_space.get, self._after_space
        out = []
        for k, line in enumerate(text.split("\n")):
            if not line or line[0].isspace() or line[-1].isspace():
                return self._whole(text)
            if k:
                out.append(self.newline)
            parts = line.split(" ")
            # a part that is empty or begins with white space belongs to a longer run of white space
            if "" in parts or (not line.isascii() or "\t" in line or "\r" in line or "\x0b" in line or "\x0c" in line) and any(p[0].isspace() for p in parts):
                out.append(self._whole(line))
                continue
            first = parts[0]
            out.append(get(first) or piece(first))
            out += [get_after(p) or after(p) for p in parts[1:]]
        return b"".join(out)
