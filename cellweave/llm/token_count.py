"""Token counts by the whole-token shortcut.

Before any text is read, every vocabulary string is merged from its bytes; those that end as one token are proven whole.
A pre-token that is proven whole counts one. Only the other pre-tokens are merged, each once per worker while a bounded
cache holds it. Texts are cut at spaces first, so that a repeated word costs one look-up.

Edge cases: a null text is empty and has no tokens; an added token's string inside a text is one token, as the library
has it by default; repeated rows are counted each; very long texts are counted whole, pre-tokens of any length merged by a
heap; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import PATTERN, byte_bpe, chunks
from .common import table, whole_text

#: Entries that a worker's cache of chunks or pre-tokens holds at most before it starts anew.
CACHE = 250_000


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


class Counter:
    def __init__(self, path: str):
        import regex

        self.bpe, self.pieces = byte_bpe(path), regex.compile(PATTERN).findall
        self.whole = proven_whole(path)
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.rest: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        found = self.rest.get(piece)
        if found is None:
            if len(self.rest) >= CACHE:
                self.rest.clear()
            found = self.rest[piece] = self.bpe.merged(piece.encode("utf-8", "replace"))
        return found

    def plain(self, text: str) -> int:
        whole = self.whole
        return sum(1 if p in whole else self.piece(p) for p in self.pieces(text))

    def segment(self, text: str) -> int:
        if not text:
            return 0
        first, later = self.first, self.later
        parts = chunks(text)
        head = parts[0]
        n = first.get(head)
        if n is None:
            if len(first) >= CACHE:
                first.clear()
            n = first[head] = self.plain(head)
        del parts[0]
        try:
            return n + sum(map(later.__getitem__, parts))
        except KeyError:
            if len(later) >= CACHE:
                later.clear()
            total = n
            for p in parts:
                c = later.get(p)
                if c is None:
                    c = later[p] = self.plain(" " + p)
                total += c
            return total

    def __call__(self, text: str) -> int:
        special = self.bpe.special
        if special is None or not any(s in text for s in self.bpe.added):
            return self.segment(text)
        return sum(1 if s in self.bpe.added else self.segment(s) for s in special.split(text))


@lru_cache(2)
def proven_whole(path: str) -> frozenset[str]:
    """The vocabulary strings that the merges, from their single bytes, bring back to one token."""
    bpe = byte_bpe(path)
    found = set()
    for raw in bpe.ranks:
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if bpe.merged(raw) == 1:
            found.add(text)
    return frozenset(found)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for b in batches:
            n = [count(t) for t in b["t"]]
            yield pd.DataFrame({"id": b["id"], "n_bytes": b["n_bytes"], "n_tokens": n, "over_limit": [x > limit for x in n]})

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    return rows.mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op5_token_count": op5_token_count}
