"""Quality rules by repetition coverage: characters inside n-grams and lines that a text has had before.

The words of a batch of texts are numbered and lie in one flat array. Prefix sums of their hashes, weighted by powers of
an odd base modulo 2^64, give the rolling hash of a window of any length by one subtraction and one product, so every
n-gram length is a few NumPy passes. A window equal to an earlier one of its text covers its words; the share of word
characters covered, for each length, and the share inside lines equal to earlier ones are held against one limit.

The base rules (too few words, too many words in repeated 3-word windows) fail a text before that.

Edge cases: a null or empty text has no words and fails the base rules; repeated rows are measured each; the first of
equal windows or lines is no repetition; very long texts are measured whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_bounded, table, whole_text

#: Lengths of the n-grams, in words, and the share of a text's word characters that repetitions of one length may cover.
LENGTHS, LIMIT = (5, 6, 7, 8, 9, 10), 0.2
#: Base rules: least words, words of the windows, most words in repeated windows in percent.
LEAST_WORDS, BASE_LENGTH, MOST_PERCENT = 50, 3, 50
SYMBOLS = "#*$%&|<>"
#: Code points of texts that are measured at once, or one text.
CHUNK = 1_000_000

WORD = re.compile("[^\x20\x09-\x0d]+")
SPACE = " \t\n\x0b\x0c\r"
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits, different ones to different ones."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """The word windows of several texts, by rolling hashes."""

    def __init__(self, texts: list[list[str]]):
        self.n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.of = np.repeat(np.arange(len(texts)), self.n)
        flat = [w for t in texts for w in t]
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in flat), np.int64, len(flat))
        self.chars = np.fromiter(map(len, flat), np.int64, len(flat))
        self.total = np.bincount(self.of, self.chars, len(texts)).astype(np.int64)
        powers = np.full(len(flat), BASE, np.uint64).cumprod()
        self.back = np.full(len(flat), INVERSE, np.uint64).cumprod()
        self.sums = np.concatenate([np.zeros(1, np.uint64), (mixed(ids) * powers).cumsum()])
        self.text_salt = mixed(np.arange(len(texts)) + (1 << 40))

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The starts of all windows of n words inside one text, and the hash of each together with its text."""
        starts = np.flatnonzero(self.of[: len(self.of) - n + 1] == self.of[n - 1 :]) if len(self.of) >= n else np.empty(0, np.int64)
        rolled = (self.sums[starts + n] - self.sums[starts]) * self.back[starts]
        return starts, mixed(rolled) ^ self.text_salt[self.of[starts]]

    def covered(self, n: int, first: bool) -> np.ndarray:
        """Whether a word is in a window of n words that its text has more than once; the ``first`` one included or not."""
        starts, key = self.hashes(n)
        order = np.argsort(key, kind="stable")
        again = key[order][1:] == key[order][:-1]
        hit = np.append(False, again) | (np.append(again, False) if first else False) if len(order) else np.empty(0, bool)
        at = starts[order[hit]]
        edges = np.bincount(at, minlength=len(self.of) + 1)[: len(self.of)] - np.bincount(at + n, minlength=len(self.of) + 1)[: len(self.of)]
        return edges.cumsum() > 0

    def by_text(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights, len(self.n)).astype(np.int64)


def repeated_lines(text: str) -> tuple[int, int]:
    """How many lines with a word equal an earlier one, and how many word characters they have."""
    n, chars, seen = 0, 0, set()
    for line in text.split("\n"):
        if line in seen:
            n += 1
            chars += sum(map(len, WORD.findall(line)))
        elif line.strip(SPACE):
            seen.add(line)
    return n, chars


def measured(texts: list[str]) -> pd.DataFrame:
    w = Windows([WORD.findall(t) for t in texts])
    lines = np.array([repeated_lines(t) for t in texts], np.int64).reshape(-1, 2)
    covered = np.array([w.by_text(w.chars * w.covered(n, first=False)) for n in LENGTHS])
    repeated = w.by_text(w.covered(BASE_LENGTH, first=True))
    least = np.maximum(w.total, 1)
    made = pd.DataFrame({
        "n_words": w.n,
        "word_chars": w.total,
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": lines[:, 0],
        "n_repeat_words": repeated,
        "base_failed": (w.n < LEAST_WORDS) | (100 * repeated > MOST_PERCENT * w.n),
        "ngram_share": covered.max(axis=0) / least,
        "line_share": lines[:, 1] / least,
    })
    made["kept"] = ~made["base_failed"] & (made["ngram_share"] <= LIMIT) & (made["line_share"] <= LIMIT)
    return made


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, ngram_share, line_share) of every row; the shares are what repetitions cover, of the
    length that covers most."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, at = b["t"].tolist(), 0
            upto = np.cumsum([len(t) for t in texts])
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
                made = measured(texts[at:stop])
                made.insert(0, "id", b["id"].to_numpy()[at:stop])
                yield made
                at = stop

    rows = byte_bounded(docs).select(F.col(id_col).alias("id"), whole_text(text_col).alias("t"))
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    made = rows.mapInPandas(run, f"id {kind}, {counts}, base_failed boolean, ngram_share double, line_share double, kept boolean")
    return made.withColumnRenamed("id", id_col)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def grams(n: int) -> str:
        return f"CASE WHEN i + {n - 1} <= n THEN string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS g{n}"

    def again(n: int) -> str:
        return f"g{n} IS NOT NULL AND row_number() OVER (PARTITION BY r, g{n} ORDER BY i) > 1 AS h{n}"

    def cover(n: int, by: str) -> str:
        return f"bool_or({by}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}"

    shares = ", ".join(f"coalesce(sum(length(w)) FILTER (WHERE c{n}), 0)" for n in LENGTHS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM e),
g AS (SELECT *, {", ".join(map(grams, (BASE_LENGTH, *LENGTHS)))} FROM w),
h AS (SELECT *, g{BASE_LENGTH} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{BASE_LENGTH}) > 1 AS h{BASE_LENGTH}, {", ".join(map(again, LENGTHS))} FROM g),
c AS (SELECT *, {", ".join(cover(n, f"h{n}") for n in (BASE_LENGTH, *LENGTHS))} FROM h),
s AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE c{BASE_LENGTH}) AS n_repeat_words, greatest({shares}) AS most FROM c GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
k AS (SELECT r, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM l),
m AS (SELECT r, count(*) FILTER (WHERE again AND chars > 0) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE again), 0) AS line_chars FROM k GROUP BY r),
b AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(most, 0) / greatest(coalesce(word_chars, 0), 1) AS ngram_share, line_chars / greatest(coalesce(word_chars, 0), 1) AS line_share
  FROM d LEFT JOIN s USING (r) JOIN m USING (r)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, ngram_share::DOUBLE AS ngram_share, line_share::DOUBLE AS line_share, NOT base_failed AND ngram_share <= {LIMIT} AND line_share <= {LIMIT} AS kept
FROM f"""


ORACLE_SQL = {"op12_quality_rules": _sql()}

QUERIES = {"op12_quality_rules": op12_quality_rules}
