"""Packing of more pieces than a shard holds, the genetic step, and whole sequences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import packing


def pieces_of(spark, n, length):
    return spark.range(n).select(F.col("id").alias("row"), length.cast("long").alias("length"))


@pytest.mark.parametrize("kind", ["equal, over half", "equal, two fit", "over half", "mixed"])
def test_levels_end(spark, monkeypatch, kind):
    spread = F.pmod(F.xxhash64("id"), F.lit(1008))
    length = {"equal, over half": F.lit(1100), "equal, two fit": F.lit(700), "over half": 1030 + spread, "mixed": F.when(F.col("id") % 3 == 0, 1100).otherwise(1 + spread)}[kind]
    n, levels, one = 6100 if kind != "mixed" else 12500, [], packing.packed_shards

    def counted(*args):
        levels.append(args)
        assert len(levels) <= 8, "levels go on without an end"
        return one(*args)

    monkeypatch.setattr(packing, "packed_shards", counted)
    items = pieces_of(spark, n, length)
    got = packing.packed(items).join(items, "row").collect()
    assert sorted(r.row for r in got) == list(range(n))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, size in sorted(b):
            assert o == at
            at += size
        assert at <= packing.CAPACITY
    if kind == "equal, two fit":
        assert len(bins) <= n // 2 + 2


def test_sequence_numbers_of_many_levels_differ(spark, monkeypatch):
    """Stands in for the packing: each of 66 levels settles one piece."""
    levels = []

    def one_settled(items, *_):
        k = len(levels)
        levels.append(k)
        settled = F.col("item.row") == k
        rows = items.select(F.lit(0).cast("long").alias("shard"), F.when(settled, 0).otherwise(1).alias("bin"), F.when(settled, packing.CAPACITY).otherwise(1).cast("long").alias("fill"), "item")
        return packing.written(rows, "one"), 1 if k == 65 else 2

    monkeypatch.setattr(packing, "packed_shards", one_settled)
    monkeypatch.setattr(packing, "MOST_LEFT", 1.0, raising=False)
    got = packing.packed(pieces_of(spark, 66, F.lit(1)).coalesce(1)).collect()
    assert len(levels) == 66 and len({r.sequence_id for r in got}) == 66


def test_crossover_beats_best_fit():
    """Pieces of which three fill a sequence exactly: best fit, longest first, is far from the 40 sequences there are."""
    better = 0
    for seed in range(6):
        r = np.random.default_rng(seed)
        a, b = r.integers(520, 800, (2, 40))
        sizes = np.concatenate([a, b, packing.CAPACITY - a - b])
        of, room = [0] * len(sizes), []
        packing.best_fit(sizes.tolist(), np.argsort(-sizes, kind="stable").tolist(), room, of, packing.CAPACITY)
        started, bred = (packing.evolved(sizes, [], packing.CAPACITY, seed, generations=g)[0] for g in (0, 60))
        assert (np.bincount(bred, weights=sizes) <= packing.CAPACITY).all() and len(bred) == len(sizes)
        n = [len(room), len(set(started.tolist())), len(set(bred.tolist()))]
        assert 40 <= n[2] <= n[1] <= n[0]
        better += n[2] < n[1]
    assert better


def test_sequences_are_few_and_equal_rows_are_dealt_evenly(spark, tmp_path, monkeypatch):
    """10,000 equal rows with one id, and rows of mixed length: near the lower bound, in shards of bounded size."""
    monkeypatch.setattr(packing, "SHARD", 1500)
    rows = spark.range(10_000).select(F.lit(7).alias("doc_id"), F.lit("one two three").alias("text"))
    more = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.pmod(F.xxhash64("id"), F.lit(1500)).cast("int")).alias("text"))
    rows.unionByName(more.withColumn("doc_id", F.col("doc_id").cast("int"))).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op7_best_fit_packing(spark, str(tmp_path))
    s = got.agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("bins"), F.count("*").alias("rows")).first()
    assert s.rows == 13_000 and s.bins <= 1.01 * -(-s.n // packing.CAPACITY)
    sizes = spark.range(10_000).select(F.col("id").alias("row"), F.lit(5).alias("length"))
    level, shards = packing.packed_shards(sizes.select(F.struct("length", "row").alias("item")), 10_000, 2048, 1500)
    assert shards == 7 and level.groupBy("shard").count().agg(F.max("count")).first()[0] < 2200


def test_a_sequence_is_its_pieces_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, texts = Tokenizer.from_file(path), {1: "a b c", 2: None, 3: "word " * 5000, 4: " " * 5000}
    got = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), path).collect()
    by_doc, by_place = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and r.start == len(by_doc.setdefault(r.doc_id, []))
        by_doc[r.doc_id] += ids
        by_place.setdefault(r.sequence_id, {})[r.offset] = ids
    assert by_doc == {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts.items()}
    for places in by_place.values():
        at = 0
        for offset in sorted(places):
            assert offset == at
            at += len(places[offset])
        assert at <= packing.CAPACITY
