"""Byte-level vocabularies of ``tokenizers`` files: bytes of tokens, pieces of a text, merges.

For files with the byte-level pre-tokenizer, no normalizer and no word-end marks. Special
tokens come first, as the library finds them by default; between them a text is cut into
contractions, words, numbers, runs of other signs and white space.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import regex

# Fixed values of the format: white space, and the pieces of a text.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_PIECE = regex.compile(rf"{_SHORT}| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_ASCII_PIECE = re.compile(rf"{_SHORT}| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Contractions whose beginnings are other pieces.
LONG_SHORT = ("'re", "'ve", "'ll")


def byte_of_sign() -> dict[str, int]:
    """The byte that each printable sign of a byte-level vocabulary stands for."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {chr(b if b in own else next(spare)): b for b in range(256)}


def plain_pieces(text: str) -> list[str]:
    """Pieces of a text in which nothing counts as special; together they are the text."""
    return (_ASCII_PIECE if text.isascii() else _PIECE).findall(text)


class ByteLevel:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, sign = spec["model"], byte_of_sign()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        plain = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.token_bytes = {i: bytes(sign[c] for c in t) for t, i in plain.items()}
        self.of_byte = [0] * 256
        for i, b in self.token_bytes.items():
            if len(b) == 1:
                self.of_byte[b[0]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[plain[a], plain[b]] = (rank, plain[a + b])

    def merge(self, data: bytes) -> list[int]:
        """Ids of a piece's bytes: the pair of the lowest rank first, the leftmost of equals."""
        ids = [self.of_byte[b] for b in data]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(queue, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)
