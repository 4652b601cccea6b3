"""Texts of over 1 MB, and further columns whose names clash with those that the operators use inside."""

import pytest
from pyspark.sql import functions as F
from test_edge_cases import SECRET, passage, result, sha, shingles

from cellweave import llm


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("long")
    text = passage(21, 190_000)
    edited = "changed " + text + " " + SECRET
    assert len(text.encode()) > 1_000_000
    rows = [(1, text), (2, edited), (3, "you stupid idiot scum"), (4, None), (5, passage(22, 60))]
    clash = {c: F.lit("x") for c in ("key", "t", "n", "bucket", "gram", "score", "w", "h", "id", "rep", "m", "_part", "x")}
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(clash).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 3)) for i in range(1, 6)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    turns = [(7, 0, "user", "short"), (7, 1, "assistant", text)]
    names = ("conv", "t", "example", "formatted", "loss", "n", "parts", "size", "ends", "trained")
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1) for c in names}).write.parquet(f"{d}/conversations.parquet")
    vecs = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (50, [0.5, 0.5]), (3, [2.0, 2.0])]
    spark.createDataFrame(vecs, "vec_id bigint, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "q", "query_id", "rank", "score")}).write.parquet(f"{d}/embeddings.parquet")
    return (str(d), rows), text


def test_documents(spark, long):
    (where, rows), text = long
    got = {r["doc_id"]: r for r in result(spark, (where, rows), "op1_secret_scan")}
    n = len(rows[1][1]) - len(SECRET)
    assert got[1]["spans"] == "" and got[2]["n_access"] == 1 and got[2]["n_hex"] == 1 and all(int(s.split(":")[1]) >= n for s in got[2]["spans"].split(","))
    scores = {r["doc_id"]: r["score"] for r in result(spark, (where, rows), "op3_toxicity")}
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores.values())
    prints = {r["doc_id"]: r for r in result(spark, (where, rows), "op4_fingerprint")}
    assert prints[2]["near_next"] > 0.9 and prints[1]["n_chars"] == len(text)
    near = {r["doc_id"]: r for r in result(spark, (where, rows), "op9_minhash_dedup")}
    assert near[1]["n_shingles"] == len(shingles(text)) and near[2]["component_id"] == 1 and near[3]["component_id"] == 3 and near[4]["n_shingles"] == 0


def test_every_other_document_query_runs(spark, long):
    for name in ("op5_token_count", "op7_best_fit_packing", "op8_suffix_dedup", "op10_bpe_codec", "op11_token_alignment", "op12_quality_rules", "op13_fill_in_middle"):
        assert llm.queries()[name](spark, long[0][0]).select("doc_id").distinct().count() == 5, name


def test_conversations_and_vectors(spark, long):
    (where, _), text = long
    got = {r["conv_id"]: r for r in result(spark, (where, None), "op2_chat_format")}
    assert got[7]["n_turns"] == 2 and got[7]["loss_chars"] == len(text) and got[7]["loss_sha256"] == sha(text) and got[7]["turns_sha256"] == sha(f"user\nshort\nassistant\n{text}\n")
    top = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in result(spark, (where, None), "op6_topk_search"))
    assert [r[2:] for r in top if r[0] == 0] == [(3, 3 * 512 * 256), (50, 3 * 128 * 256), (1, 256 * 256)]
