"""Cross-tokenizer alignment by a label string over bytes, and corpus-wide counts of the aligned token pairs.

A text's tokens by two tokenizers label each of its bytes: neither ends there, A ends, B ends, both end. A regular
expression scans the labels and takes a span up to each byte where both end; how often each label stands in a span says
how many tokens of each side form the group. All A-B pairs of a group are linked. The texts of a batch are labelled and
scanned together. A text whose bytes a tokenizer changes has no tokens.

The texts of a task form blocks of bounded size, each one written row: a dictionary of its pairs with the number of its
rows that hold them, and per row the places in that dictionary. The dictionaries alone are summed to the corpus-wide
counts, and the counts go back to the blocks' dictionaries; a pair that stands in every block is dealt in parts.

Edge cases: null and empty texts have no tokens, zeros and an empty digest; null ids and repeated rows are rows of their
own and count each; very long texts form a block alone; a group of many different tokens has all its pairs; strings of
special tokens are plain text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import PATTERN, byte_bpe
from .common import byte_bounded, dealt, forget, parts_for, table, whole_text, with_found, written

#: Code points of texts from which on a block is full, and blocks that a file holds: readers take thousands of rows at once.
BLOCK_SIZE, BLOCKS = 2_000_000, 4
#: Code points of texts that are aligned at once, or one text, and pairs of a group from which on equal ids are counted
#: before they are paired.
CHUNK, MANY = 500_000, 1 << 14
#: Labels of a byte: no token ends, A ends, B ends, both end.
NO, A_END, B_END, BOTH = range(4)
#: Characters of a run of white space from which on it is cut out before the pattern, which goes back over such a run.
LONG_SPACE = 1000

_GROUP = re.compile(rb"[^\x03]*\x03")
MARK = "▁"


class TokensA:
    """Ids and token bytes of a byte-level vocabulary, whose bytes are those of the text."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.bpe = byte_bpe(path)
        self.lib = tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks=self.bpe.ranks, special_tokens={})
        self.size = np.zeros(max(self.bpe.ranks.values()) + 1, np.int64)
        for raw, i in self.bpe.ranks.items():
            self.size[i] = len(raw)
        self.space = regex.compile(rf"\p{{White_Space}}{{{LONG_SPACE},}}")

    def __call__(self, text: str) -> list[int]:
        """The ids of a text; a long run of white space is one pre-token, but for its last character before a word."""
        out, at = [], 0
        for run in self.space.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += [*self.lib.encode_ordinary(text[at : run.start()]), *self.bpe.long(text[run.start() : stop].encode())]
            at = stop
        return out + self.lib.encode_ordinary(text[at:])


class TokensB:
    """Ids and token bytes of a model of pieces, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.raw = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size = np.array([len(r) for r in self.raw], np.int64)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.lib.encode(texts, num_threads=1)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


@dataclass
class Aligned:
    """Of a batch of texts: how many tokens, groups and links each has, its groups written out, and its distinct linked
    pairs with their numbers, those of a text one after another up to ``stop``."""

    n: np.ndarray
    groups: list[str]
    keys: np.ndarray
    times: np.ndarray
    stop: np.ndarray


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = TokensA(path_a), TokensB(path_b)
        self.width = len(self.b.size)
        self.pairs = len(self.a.size) * self.width

    def __call__(self, texts: list[str]) -> Aligned:
        ids_b = self.b(texts)
        kept = [bool(t) and self.b.bytes_of(b) == b" " + t.encode() for t, b in zip(texts, ids_b)]
        ids_a = [self.a(" " + t) if k else [] for t, k in zip(texts, kept)]
        ids_b = [b if k else [] for b, k in zip(ids_b, kept)]
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        ends_a, ends_b = self.a.size[flat_a].cumsum(), self.b.size[flat_b].cumsum()
        labels = np.full(ends_a[-1] if len(ends_a) else 0, NO, np.uint8)
        labels[ends_a - 1] |= A_END
        labels[ends_b - 1] |= B_END

        spans = _GROUP.findall(labels.tobytes())
        last = np.fromiter(map(len, spans), np.int64, len(spans)).cumsum() - 1
        upto_a, upto_b = (np.cumsum(labels & one > 0)[last] for one in (A_END, B_END))
        m_a, m_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        from_a, from_b = upto_a - m_a, upto_b - m_b
        text_of = np.searchsorted(n_a.cumsum(), upto_a)
        n_groups = np.bincount(text_of, minlength=len(texts))

        said_a, said_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        said = [
            f"{said_a[i]}|{said_b[j]}" if m == n == 1 else f"{','.join(said_a[i : i + m])}|{','.join(said_b[j : j + n])}"
            for i, m, j, n in zip(from_a.tolist(), m_a.tolist(), from_b.tolist(), m_b.tolist())
        ]
        to = n_groups.cumsum().tolist()
        groups = [";".join(said[i:j]) for i, j in zip([0, *to], to)]

        pairs = m_a * m_b
        n_links = np.bincount(text_of, pairs, len(texts)).astype(np.int64)
        few = np.flatnonzero(pairs < MANY)
        g = np.repeat(few, pairs[few])
        k = np.arange(len(g)) - np.repeat(pairs[few].cumsum() - pairs[few], pairs[few])
        keys, times, of = [flat_a[from_a[g] + k // m_b[g]] * self.width + flat_b[from_b[g] + k % m_b[g]]], [np.ones(len(g), np.int64)], [text_of[g]]
        for g in np.flatnonzero(pairs >= MANY):
            (own_a, c_a), (own_b, c_b) = (np.unique(flat[i : i + m], return_counts=True) for flat, i, m in ((flat_a, from_a[g], m_a[g]), (flat_b, from_b[g], m_b[g])))
            keys.append((own_a[:, None] * self.width + own_b).ravel())
            times.append((c_a[:, None] * c_b).ravel())
            of.append(np.full(len(keys[-1]), text_of[g]))
        own, place = np.unique(np.concatenate(of) * self.pairs + np.concatenate(keys), return_inverse=True)
        times = np.bincount(place, np.concatenate(times), len(own)).astype(np.int64)
        return Aligned(np.stack([n_a, n_b, n_groups, n_links], axis=1), groups, own % self.pairs, times, np.searchsorted(own, (np.arange(len(texts)) + 1) * self.pairs))


@lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _block(rows: list[tuple], keys: list[np.ndarray], times: list[np.ndarray]) -> pd.DataFrame:
    pairs, place, docs = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    ids, numbers, digest = zip(*rows)
    n_a, n_b, n_groups, n_links = np.array(numbers).T
    return pd.DataFrame([{
        "block": uuid4().hex, "id": list(ids), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": list(digest),
        "n_pairs": [len(k) for k in keys], "place": place.astype(np.int32), "times": np.concatenate(times), "pair": pairs, "docs": docs.astype(np.int64),
    }])


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a block: arrays of its rows' columns, its dictionary of pairs, and each row's places in it."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        align, rows, keys, times, size = aligner(path_a, path_b), [], [], [], 0
        for b in batches:
            texts, ids, at = b["t"].tolist(), [None if x is None or x != x else x for x in b["id"].tolist()], 0
            upto = np.cumsum([len(t) for t in texts])
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
                found = align(texts[at:stop])
                rows += [(i, n, sha256(g.encode()).hexdigest() if n[2] else "") for i, n, g in zip(ids[at:stop], found.n.tolist(), found.groups)]
                for i, j in zip([0, *found.stop.tolist()], found.stop.tolist()):
                    keys.append(found.keys[i:j])
                    times.append(found.times[i:j])
                size += int(upto[stop - 1] - (upto[at - 1] if at else 0))
                at = stop
                if size > BLOCK_SIZE:
                    yield _block(rows, keys, times)
                    rows, keys, times, size = [], [], [], 0
        if rows:
            yield _block(rows, keys, times)

    texts = byte_bounded(docs).select(F.col(id_col).alias("id"), whole_text(text_col).alias("t"))
    numbers = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    return texts.mapInPandas(run, f"block string, id array<{kind}>, {numbers}, groups_sha256 array<string>, n_pairs array<long>, place array<int>, times array<long>, pair array<long>, docs array<long>")


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """(pair, count, best): in how many rows of the corpus a pair is linked, and whether no pair of its A id has more."""
    counts = blocks.select(F.explode(F.arrays_zip("pair", "docs")).alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.docs").alias("count"))
    counts = counts.withColumn("a", F.floor(F.col("pair") / width))
    return counts.join(counts.groupBy("a").agg(F.max("count").alias("most")), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    import sentencepiece

    kind = dict(docs.dtypes)[id_col]
    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    blocks = written(aligned_blocks(docs, path_a, path_b, id_col, text_col), "aligned", BLOCKS)
    counts = written(pair_counts(blocks, width), "pair-counts")
    places = blocks.select("block", F.posexplode("pair").alias("at", "pair"))
    n = blocks.count()
    known = with_found(dealt(places, ["pair"], "block", parts_for(n)), counts, ["pair"])
    known = known.select(F.col("block").alias("of"), "at", "count", F.col("best").cast("long").alias("best"))
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def run(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        made, found = [], found.sort_values("at")
        for r in block.itertuples():
            of = np.repeat(np.arange(len(r.id)), r.n_pairs)
            place, times = np.asarray(r.place, np.int64), np.asarray(r.times, np.int64)
            total = np.zeros((2, len(r.id)), np.int64)
            for into, c in zip(total, ("best", "count")):
                np.add.at(into, of, found[c].to_numpy(np.int64)[place] * times)
            made.append(pd.DataFrame({"id": list(r.id), **{c: getattr(r, c) for c in numbers}, "n_best": total[0], "count_sum": total[1], "groups_sha256": r.groups_sha256}))
        made = pd.concat(made)
        return made if kind == "string" else made.astype({"id": "Int64"})

    schema = f"id {kind}, {', '.join(f'{c} long' for c in numbers)}, n_best long, count_sum long, groups_sha256 string"
    rows = blocks.drop("pair", "docs").groupBy("block").cogroup(known.groupBy("of"))
    return rows.applyInPandas(run, schema).withColumnRenamed("id", id_col)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
