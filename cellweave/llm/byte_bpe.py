"""A byte-level BPE vocabulary read from a tokenizer file: what token counting and packing share."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Hashable
from functools import lru_cache
from heapq import heapify, heappop, heappush

# GPT-2 style pre-token pattern of a ByteLevel pre-tokenizer with use_regex (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of a pre-token from which on its pairs are kept in a heap.
LONG = 200

_ODD_SPACE = re.compile(r" (?!\S)")
_BEFORE_WORD = re.compile(r" (?=\S)")


def chunks(text: str) -> list[str]:
    """The text cut at every space that a non-space follows; those spaces are left out.

    A pre-token holds white space only at its start or is all white space, and a space before a non-space always opens
    a pre-token. So each cut is a pre-token boundary, whatever stands around it.
    """
    return _BEFORE_WORD.split(text) if _ODD_SPACE.search(text) else text.split(" ")


@lru_cache(2)
def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """``ranks``: bytes to id, in merge order; ``special``: pattern of the added tokens, or None."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made["pre_tokenizer"]
        if made["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a plain byte-level vocabulary")
        vocab, of = made["model"]["vocab"], byte_alphabet()
        self.ranks = {bytes(of[c] for c in s): i for s, i in vocab.items()}
        ids = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in made["model"]["merges"]]
        if ids != sorted(ids) or any(len(b) == 1 and i >= ids[0] for b, i in self.ranks.items()):
            raise ValueError("the ids do not follow the order of the merges")
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        names = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def merged(self, piece: bytes) -> int:
        """How many tokens a pre-token has: the lowest-ranked pair of neighbours is merged until none is left."""
        ranks = self.ranks
        if len(piece) > LONG:
            return len(self.long(piece))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(ranks)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return len(parts)


    def long(self, piece: bytes) -> list[int]:
        """The ids of a pre-token of any length."""
        parts = heap_merged([piece[i : i + 1] for i in range(len(piece))], lambda a, b: (r, a + b) if (r := self.ranks.get(a + b)) is not None else None)
        return [self.ranks[p] for p in parts]


def heap_merged(symbols: list[Hashable], of: Callable[[Hashable, Hashable], tuple[int, Hashable] | None]) -> list:
    """The symbols after merging, lowest rank and then leftmost first; ``of``: a pair's rank and product, or None.

    A heap holds the pairs and links the neighbours, so the time grows with n log n.
    """
    n = len(symbols)
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
    heap = [(m[0], i, symbols[i], symbols[i + 1], m[1]) for i in range(n - 1) if (m := of(symbols[i], symbols[i + 1]))]
    heapify(heap)
    while heap:
        _, i, a, b, made = heappop(heap)
        j = after[i]
        if gone[i] or j >= n or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], gone[j] = made, 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if m := of(made, symbols[k]):
                heappush(heap, (m[0], i, made, symbols[k], m[1]))
        h = before[i]
        if h >= 0 and (m := of(symbols[h], made)):
            heappush(heap, (m[0], h, symbols[h], made, m[1]))
    return [s for s, x in zip(symbols, gone) if not x]


@lru_cache(4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
