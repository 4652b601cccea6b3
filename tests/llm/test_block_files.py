from pathlib import Path

import public_tokenizers
from cellweave.llm import token_alignment as T


def test_files_hold_few_blocks(spark, monkeypatch):
    """A reader takes thousands of rows of a file at once, and each is a block."""
    monkeypatch.setattr(T, "BLOCK_SIZE", 1)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.glob("aligned-*"))
    monkeypatch.setattr(T, "CHUNK", 1)
    docs = spark.range(10).selectExpr("id AS doc_id", "concat('some words ', id) AS text").coalesce(1)
    made = T.aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    (folder,) = set(shared.glob("aligned-*")) - before
    assert len(list(folder.glob("part-*.parquet"))) >= 10 / 4
    assert made.count() == 10
