"""Top-k search: what it prunes, several query blocks, and columns of clashing names."""

import numpy as np

from cellweave.llm import topk_search


def brute(rows, queries, k=5):
    want = []
    for i, x in sorted(queries):
        best = sorted((-int(np.dot(x, y)), j) for j, y in rows if j != i)[:k]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return want


def test_ranges_below_the_kth_score_are_skipped():
    """Clustered rows: a query needs the ranges of its own cluster only, and the result is exact."""
    r = np.random.default_rng(3)
    centre = np.round(r.normal(size=(16, 32)) * 400)
    x = np.concatenate([c + r.integers(-20, 20, (256, 32)) for c in centre])
    ids = r.permutation(len(x)).astype(np.int64)
    score, best, scored = topk_search.block_topk(x[:40], ids[:40], x, ids, 5)
    assert scored < 0.5 * 40 * len(x)
    want = brute(list(zip(ids.tolist(), x)), list(zip(ids[:40].tolist(), x[:40])))
    got = sorted((int(i), n + 1, int(best[q, n]), int(score[q, n])) for q, i in enumerate(ids[:40]) for n in range(5))
    assert got == sorted(want)


def test_several_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_NUMBERS", 40)
    monkeypatch.setattr(topk_search, "TASK_ROWS", 50)
    r = np.random.default_rng(4)
    vecs = [(int(i), [float(v) for v in r.integers(-6, 6, 8)], "x", 1) for i in range(300)]
    frame = spark.createDataFrame(vecs, "vec_id bigint, embedding array<double>, query_id string, rank int").repartition(3)
    rows = topk_search.quantised(frame)
    got = sorted(tuple(x) for x in topk_search.top_k(rows, rows.where("id % 10 = 0")).collect())
    whole = [(i, [256 * v for v in x]) for i, x, *_ in vecs]
    assert got == sorted(brute(whole, [v for v in whole if v[0] % 10 == 0]))
