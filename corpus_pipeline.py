"""The corpus pipeline: stages over the documents table, each written as Parquet and read back as the next one's docs.

1. toxicity: scores every text and drops the toxic ones; the labels of the sound fifth are never learned from.
2. near_duplicates: one document of each group of near copies (five-word shingles, likeness 0.8 or more) stays, the one
   with the least id; documents without words are no copies and all stay.
3. repeated_passages: bytes covered by a 200-byte string that also starts elsewhere are cut; a text keeps its place even
   where little is left, and is cut at whole characters.
4. secrets: every finding is replaced by a mark; all documents stay.
5. packing: the pieces of the token sequences that the texts are packed into.

All stages but the last keep the columns of documents and every document that they do not reject; ``n_chars`` follows the
text. Edge cases are those of the operators: null texts count as empty and stay, an empty table gives empty stages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import minhash_dedup, packing, secret_scan, suffix_dedup, toxicity
from cellweave.llm.common import byte_bounded, keyed, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out()).select("doc_id", "toxic")
    docs = byte_bounded(docs)
    model = toxicity.fitted(docs.select("doc_id", "text"), labels)
    return toxicity.with_score(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, by_id = keyed(byte_bounded(docs).select(*COLUMNS))
    found = minhash_dedup.near_duplicates(rows, by_id, k=5)
    return rows.join(found.where("first").select("key"), "key", "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.deduplicated(byte_bounded(docs).select(*COLUMNS))
    whole = rows.where("spans IS NULL").select(*COLUMNS)
    schema = docs.select(*COLUMNS).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, spans in zip(b["text"], b["spans"]):
                raw = text.encode("utf-8", "replace")
                out.append(suffix_dedup.kept_bytes(raw, suffix_dedup.merged_spans(spans)).decode("utf-8", "ignore"))
            b = b.drop(columns=["key", "spans"])
            b["text"], b["n_chars"] = out, [len(x) for x in out]
            yield b[list(COLUMNS)]

    cut = rows.where("spans IS NOT NULL").select(*COLUMNS, "key", "spans").mapInPandas(run, schema)
    return whole.unionByName(cut)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(byte_bounded(docs).select("doc_id", "text"), packing.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Minima, suffix arrays, a fitted score and a genetic search are beyond SQL; tests/llm/test_pipeline.py holds each stage
#: against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
