"""Suffix-array dedup against brute force where grams are hot, texts are long and shards are many."""

import hashlib
import random

import pytest

from cellweave.llm import suffix_dedup


def brute(docs, window=200):
    seen = {}
    for _, x in docs:
        for p in range(len(x) - window + 1):
            seen[x[p : p + window]] = seen.get(x[p : p + window], 0) + 1
    out = {}
    for i, x in docs:
        cover = bytearray(len(x) + 1)
        for p in range(len(x) - window + 1):
            if seen[x[p : p + window]] > 1:
                cover[p : p + window] = b"\x01" * window
        kept = bytes(b for b, c in zip(x, cover) if not c)
        out[i] = (len(x), len(x) - len(kept), sum(1 for a, b in zip(b"\x00" + cover, cover) if b and not a), hashlib.sha256(kept).hexdigest())
    return out


def run(spark, tmp_path, docs):
    spark.createDataFrame([(i, x.decode()) for i, x in docs], "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op8_suffix_dedup(spark, str(tmp_path)).collect()}


def words(r, n):
    return b"".join(bytes(r.choices(b"abcdefghijklmnop", k=r.randrange(2, 9))) + b" " for _ in range(n))


@pytest.mark.parametrize("hot", [0, 2, 7])
def test_hot_grams_are_dealt_further(spark, tmp_path, monkeypatch, hot):
    """Passages with differing ends, of which some are shared by few documents, and runs of one letter."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(5)
    passage, near = words(r, 60), [words(r, 25) for _ in range(4)]
    docs = [(i, words(r, r.randrange(0, 40)) + r.choice(near) + passage[: r.randrange(150, len(passage))] + r.choice([b"", *near]) + words(r, r.randrange(0, 30))) for i in range(40)]
    docs += [(100 + i, b"x" * (190 + 7 * i) + words(r, 5)) for i in range(6)] + [(200, passage[20:230]), (201, b"q" + passage[20:229])]
    assert run(spark, tmp_path, docs) == brute(docs)


def test_texts_longer_than_a_piece(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 11)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    r = random.Random(6)
    long = words(r, 3000)
    docs = [(0, long), (1, long[5000:9000] + words(r, 50)), (2, words(r, 100) + long[2040:2300]), (3, long[100:299]), (4, long[4000:4201])]
    assert run(spark, tmp_path, docs) == brute(docs)
