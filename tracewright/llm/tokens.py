"""Byte-level BPE ids of whole texts, fast enough for a corpus.

A text is cut only at single spaces between two non-space characters, where the pre-tokenizer cuts
too; each piece is encoded once per worker and kept in a bounded table. The ids are those that the
`tokenizers` library gives for the vocabulary named, which tests hold them to.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

VOCABULARY, SPECIAL, SPECIAL_ID, NEWLINE_ID = "byte_bpe_50k.tiktoken", "<|endoftext|>", 50256, 198
#: Pieces kept per worker, about 200 bytes each.
KEPT = 1_000_000
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _pieces(text: str) -> list[str]:
    """The text cut at each space that stands between two non-space characters."""
    plain = text[:1] != " " and text[-1:] != " " and "  " not in text and not any(c in text and (c + " " in text or " " + c in text) for c in _SPACES)
    return text.split(" ") if plain else _CUT.split(text)


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 16-bit bytes."""

    def __init__(self, path: str | None = None) -> None:
        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.kept: dict[str, bytes] = {}

    def one(self, piece: str) -> bytes:
        return np.array(self.bpe.encode(piece, allowed_special="all"), dtype="<u2").tobytes()

    def _learn(self, new: set[str]) -> None:
        """Encode pieces, each with the space before it: many at once with line ends between, which are tokens of their own there."""
        odd = [p for p in new if not p or "\n" in p or SPECIAL in p or p[:1].isspace() or p[-1:].isspace()]
        for p in odd:
            self.kept[p] = self.one(" " + p)
        even = list(new.difference(odd))
        for at in range(0, len(even), 50_000):
            part = even[at : at + 50_000]
            ids = np.array(self.bpe.encode_ordinary(" " + "\n ".join(part)), dtype="<u2")
            ends = [*(np.flatnonzero(ids == NEWLINE_ID) * 2).tolist(), len(ids) * 2]
            if len(ends) != len(part):
                raise AssertionError("pieces and line ends differ")
            data, start = ids.tobytes(), 0
            for p, end in zip(part, ends):
                self.kept[p] = data[start:end]
                start = end + 2

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.kept) > KEPT:
            self.kept = {}
        kept, cut, new = self.kept, [], set()
        for t in texts:
            pieces = _pieces(t) if t else []
            new.update([p for p in pieces[1:] if p not in kept])
            cut.append(pieces)
        self._learn(new)
        kept = self.kept
        return [self.one(p[0]) + b"".join([kept[x] for x in p[1:]]) if p else b"" for p in cut]


@lru_cache(maxsize=1)
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path)
