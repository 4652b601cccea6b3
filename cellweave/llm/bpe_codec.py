"""BPE encoding and decoding by batched NumPy merge rounds, for vocabularies with a word-end suffix.

The words of a batch that the bounded cache lacks lie as symbols in one flat array. Each round finds every pair's rank by
binary search over the sorted pair keys, takes the lowest rank of each word, and merges all places of that pair, leftmost
first where they overlap; words without a known pair are done and leave the array. This equals the library's order since
no pair of a merged symbol ranks before the merge that makes it, which the constructor proves for the vocabulary.

Edge cases: a null text is empty and has no ids; an added token's string inside a text is that token; texts of white space
have no ids; repeated rows are encoded each; very long texts are encoded whole, words of over ``LONG`` bytes by a heap in
place of the rounds; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_alphabet, heap_merged
from .common import table, whole_text

#: Entries that a worker's cache of chunks holds at most before it starts anew; the one before it is kept, and what is
#: still used comes back from there.
CACHE = 150_000
#: Bytes of a word from which on a heap merges it: each round rescans a word, which takes long words too long.
LONG = 1000
NONE = np.int32(2**31 - 1)


class WordBpe:
    """The codec of a tokenizer file whose pre-tokens hold no white space and end with a suffix."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        kinds = [n["type"] for n in made["normalizer"]["normalizers"]]
        split, level = made["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or level["use_regex"] or made["decoder"] or made["post_processor"]:
            raise ValueError("not a vocabulary of this kind")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        model = made["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.size = max(vocab.values()) + 1
        self.token = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in made["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in byte_alphabet().items():
            self.inner[b], self.last[b] = vocab[c], vocab[c + end]
        left, right, product = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], np.int64).T
        ranks = np.arange(len(left))
        made_by = np.full(self.size, -1)
        made_by[product] = ranks
        if (made_by[left] >= ranks).any() or (made_by[right] >= ranks).any() or len(set(product)) != len(product):
            raise ValueError("a merge uses what a later one makes")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.product = keys[order], ranks[order].astype(np.int32), product[order]
        self.pairs = None
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.old: tuple[dict[str, bytes], dict[str, str]] = {}, {}

    def long(self, word: bytes) -> np.ndarray:
        """The ids of one long word."""
        if self.pairs is None:
            self.pairs = {k: (r, p) for k, r, p in zip(self.keys.tolist(), self.ranks.tolist(), self.product.tolist())}
        raw = np.frombuffer(word, np.uint8)
        symbols = [*self.inner[raw[:-1]].tolist(), int(self.last[raw[-1]])]
        return np.array(heap_merged(symbols, lambda a, b: self.pairs.get(a * self.size + b)), np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inner[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[raw[ends]]
        done_sym, done_word = [], []
        while len(sym):
            at = np.minimum(np.searchsorted(self.keys, key := sym[:-1] * self.size + sym[1:]), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.ranks[at], NONE), NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            n = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), n)
            if (over := least == NONE).any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            hit = (rank == least) & ~over
            places = np.flatnonzero(hit)
            if len(places):  # of neighbouring places, which overlap, every second
                run = np.append(True, np.diff(places) != 1)
                place = np.arange(len(places))
                places = places[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            keep = ~over
            sym = sym.copy()
            sym[places] = self.product[at[places]]
            keep[places + 1] = False
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate([np.empty(0, np.int64), *done_sym]), np.concatenate([np.empty(0, np.int64), *done_word])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def normal(self, text: str) -> str:
        """Composed and lower-cased a character at a time: no rule looks at neighbours."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def learn(self, new: list[str]) -> None:
        """Put the chunks, texts without spaces, into the cache: their ids' bytes and their decoded text."""
        pieces = [self.words(self.normal(c)) for c in new]
        distinct = list(dict.fromkeys(w for p in pieces for w in p))
        raw = [w.encode("utf-8") for w in distinct]
        short = [k for k, w in enumerate(raw) if len(w) <= LONG]
        ids, n = self.merge([raw[k] for k in short]) if short else (np.empty(0, np.int64), np.empty(0, np.int64))
        made, stop, flat, at = ids.astype("<u4").tobytes(), np.cumsum(n).tolist(), list(map(self.token.__getitem__, ids.tolist())), 0
        own_ids, own_text = {}, {}
        for k, e in zip(short, stop):
            own_ids[distinct[k]], own_text[distinct[k]], at = made[4 * at : 4 * e], " ".join(flat[at:e]), e
        for w, r in zip(distinct, raw):
            if len(r) > LONG:
                one = self.long(r)
                own_ids[w], own_text[w] = one.astype("<u4").tobytes(), " ".join([self.token[i] for i in one.tolist()])
        for chunk, words in zip(new, pieces):
            if len(words) == 1:
                self.ids[chunk], self.text[chunk] = own_ids[words[0]], own_text[words[0]]
            else:
                self.ids[chunk], self.text[chunk] = b"".join([own_ids[w] for w in words]), " ".join([own_text[w] for w in words])

    def parts(self, text: str) -> list[str]:
        """The chunks of a text and its added tokens, in order."""
        if not any(s in text for s in self.added):
            return text.split(" ")
        return [c for s in self.special.split(text) for c in ([s] if s in self.added else s.split(" "))]

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Per text its ids, little-endian and four bytes each, and what they decode to."""
        cut = [self.parts(t) for t in texts]
        chunks = set().union(*cut)
        new = chunks.difference(self.ids)
        if len(self.ids) + len(new) > CACHE:
            self.old, self.ids, self.text, new = (self.ids, self.text), {}, {}, chunks
        old_ids, old_text = self.old
        for c in [c for c in new if c in old_ids]:
            self.ids[c], self.text[c] = old_ids[c], old_text[c]
        self.learn(sorted(c for c in new if c not in self.ids and c not in self.added))
        for s, i in self.added.items():
            self.ids[s], self.text[s] = np.array([i], "<u4").tobytes(), s
        ids, text = self.ids.__getitem__, self.text.__getitem__
        return [(b"".join(map(ids, p)), " ".join(filter(None, map(text, p)))) for p in cut]


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """(id, ids, decoded) of every row: its token ids and what they decode to, taken a few ``rows`` at a time."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = word_bpe(path)
        for b in batches:
            for k in range(0, len(b), rows):
                part = b.iloc[k : k + rows]
                done = codec.encode_batch(part["t"].tolist())
                yield pd.DataFrame({"id": part["id"], "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x, _ in done], "decoded": [s for _, s in done]})

    return docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("t")).mapInPandas(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, rows: int = 256) -> DataFrame:
    """As ``encoded``, but digests only, so that no ids leave the workers."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = word_bpe(path)
        for b in batches:
            for k in range(0, len(b), rows):
                part = b.iloc[k : k + rows]
                done = codec.encode_batch(part["t"].tolist())
                yield pd.DataFrame({
                    "doc_id": part["doc_id"],
                    "n_tokens": [len(x) // 4 for x, _ in done],
                    "ids_sha256": [sha256(x).hexdigest() for x, _ in done],
                    "decoded_sha256": [sha256(s.encode("utf-8")).hexdigest() for _, s in done],
                })

    return docs.select("doc_id", whole_text().alias("t")).mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op10_bpe_codec": op10_bpe_codec}
