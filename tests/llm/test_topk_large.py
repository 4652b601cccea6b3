"""Top-k search with components beyond double precision's exact sums."""

import math

from cellweave.llm import topk_search


def test_large_components_take_part(spark):
    big = [46001.0, -3.7e16, 1.25e9, 50000.25]
    vecs = [(i, [((i * 37 + j * 11) % 19 - 9) / 8 for j in range(64)]) for i in range(120)]
    vecs += [(200 + i, [0.001] * 63 + [v]) for i, v in enumerate(big)] + [(50 + 7, [1.5, 2.0]), (300, [0.0] * 63 + [46341.0])]
    rows = topk_search.quantised(spark.createDataFrame(vecs, "vec_id bigint, embedding array<double>"))
    got = topk_search.top_k(rows, rows.where("id IN (0, 50, 10, 203, 300)")).collect()
    q = [(i, [math.floor(256 * x) for x in v] + [0] * (64 - len(v))) for i, v in vecs]
    want = []
    for i, x in q:
        if i in (0, 50, 10, 203, 300):
            best = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in q if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
