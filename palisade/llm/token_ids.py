"""Token ids of whole texts with a public byte-level BPE.

Text is cut at single blanks and line breaks, where the pre-tokeniser's pattern always cuts too, and the ids of each
piece are remembered. Texts with other blanks between words, or with a special string, go to a library whole.
"""

from __future__ import annotations

import base64
import json
import struct

#: Pieces remembered by a Python worker.
CACHE = 200_000


class _Irregular(Exception):
    pass


class _Pieces(dict):
    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace():
            raise _Irregular
        ids = self.encode(self.lead + piece)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHE:
            self.clear()
        self[piece] = found
        return found


class TokenIds:
    """``spec_path``: the library's file; ``ranks_path``: the same vocabulary as ranks; ``pattern``: its pre-tokens."""

    def __init__(self, spec_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = plain.encode_ordinary
        self.spec_path, self.whole = spec_path, None
        with open(spec_path, encoding="utf-8") as f:
            self.special = tuple(t["content"] for t in json.load(f)["added_tokens"])
        self.first, self.later = _Pieces(self.plain, ""), _Pieces(self.plain, " ")
        self.line = struct.pack("<I", self.plain("\n")[0])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            if self.whole is None:  # rarely needed, and large
                import tokenizers

                self.whole = tokenizers.Tokenizer.from_file(self.spec_path)
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        first, later, out = self.first, self.later.__getitem__, []
        try:
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                out.append(first[head])
                out += map(later, rest)
                out.append(self.line)
            out.pop()
            return b"".join(out)
        except _Irregular:
            ids = self.plain(text)
            return struct.pack(f"<{len(ids)}I", *ids)


_LOADED: dict[str, TokenIds] = {}


def token_ids(spec_path: str, ranks_path: str, pattern: str) -> TokenIds:
    if spec_path not in _LOADED:
        _LOADED[spec_path] = TokenIds(spec_path, ranks_path, pattern)
    return _LOADED[spec_path]


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole if it fits, else a remainder and full pieces."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]
