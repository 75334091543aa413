"""Token ids of a BPE vocabulary with word ends, a word at a time.

The file's own pipeline is: NFC, white space to one blank, lower case, split by a pattern, bytes, merges within each piece. Pieces don't
affect each other, and none crosses white
space, so ids of a word are looked up in a bounded cache, and missing ones come from a rank-merging encoder. Merging the pair
whose joint string ranks lowest gives what merging listed pairs gives as long as each listed token, encoded alone, comes out whole;
`check_closed` verifies that of a vocabulary. Texts with characters from U+0300 on or U+001C to U+001F, or with a special token's string, go
through the tokenizer itself.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import numpy as np

#: The byte-to-character table of byte-level BPE keeps printable Latin-1 and moves the rest to U+0100 and on.
_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_LIMIT = 0x300
_CACHED = 600_000


def _byte_of_char() -> dict[str, int]:
    table = {chr(b): b for b in _KEPT}
    moved = (b for b in range(256) if b not in set(_KEPT))
    return table | {chr(0x100 + i): b for i, b in enumerate(moved)}


def _char_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LIMIT) if unicodedata.category(chr(c))[0] == kind)


class WordBpe(dict):
    """A cache from word to its ids as little-endian uint32 bytes. ids(text) gives those of a text."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.end = spec["model"]["end_of_word_suffix"]
        of_char = _byte_of_char()
        names = {name: self._raw(name, of_char) for name in spec["model"]["vocab"]}
        single = sorted({bytes([b]) for b in range(256)} | {b"\xff"})
        merged = [self._raw(m[0] + m[1] if isinstance(m, list) else m.replace(" ", ""), of_char) for m in spec["model"]["merges"]]
        ended = [bytes([b]) + b"\xff" for b in range(256) if b != 0xFF]
        ranks: dict[bytes, int] = {}
        for token in [*single, *ended, *merged]:
            ranks.setdefault(token, len(ranks))
        known = {raw: spec["model"]["vocab"][name] for name, raw in names.items()}
        self.raw_id = [struct.pack("<I", known[token]) if token in known else None for token in ranks]
        self.ranks = ranks
        self.encoder = tiktoken.Encoding("words", pat_str=r"(?s).", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.whole = Tokenizer.from_file(path)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        letters, numbers = _char_class("L"), _char_class("N")
        self.plain = re.compile(f"[\\x00-\\x1b\\x20-{chr(_LIMIT - 1)}]*")
        #: The split pattern of the vocabulary file, over the characters of the short way.
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+").findall

    def _raw(self, name: str, of_char: dict[str, int]) -> bytes:
        ended = name.endswith(self.end)
        return bytes(of_char[c] for c in name.removesuffix(self.end)) + b"\xff" * ended

    def __missing__(self, word: str) -> bytes:
        ids = b"".join([self.raw_id[r] for piece in self.pieces(word) for r in self.encoder(piece.encode() + b"\xff")])
        if len(self) >= _CACHED:
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not self.plain.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))

    def check_closed(self) -> list[bytes]:
        """Tokens that, encoded alone by listed pairs in order, don't come out whole."""
        return [t for t, rank in self.ranks.items() if len(t) > 1 and self.encoder(t) != [rank]]
