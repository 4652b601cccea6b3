"""Toxicity: segments against a quadratic search, weights and calibration recomputed, accuracy on held-out rows."""

import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from cellweave.llm import toxicity

SF = "/root/testdata/sf0.01"


def maximal(scores):
    """By definition: the best segment, shortest and leftmost first, and then those left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    best = max((round(total[j] - total[i], 9), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
    i, j = -best[2], -best[2] - best[1]
    return [*maximal(scores[:i]), (i, j - 1, best[0]), *((a + j, b + j, s) for a, b, s in maximal(scores[j:]))]


def test_segments_are_the_maximal_ones():
    r = random.Random(1)
    model = toxicity.Model({"x": 2.03, "y": 1.17, "z": -1.51, "long~": 0.77})
    for _ in range(300):
        words = [r.choice(["x", "y", "z", "a", "b", "c", "longer", "a"]) for _ in range(r.randrange(0, 25))]
        value = {"x": 2.03, "y": 1.17, "z": -1.51, "longer": 0.77}
        got, n = model.segments(" ".join(words))
        want = maximal([value.get(w, -toxicity.DRIFT) for w in words])
        assert n == len(words)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in want]


def test_weights_are_log_odds_with_a_prior():
    counts = [("bad", 40, 2), ("good", 3, 120), ("odd", 5, 5), ("rare", 4, 0)]
    got = toxicity.fit_weights(counts, 100, 300)
    assert set(got) == {"bad", "good"}
    a = 30 * 42 / 400
    p1, p0 = (40 + a) / 130, (2 + a) / 330
    assert got["bad"] == pytest.approx(math.log(p1 / (1 - p1)) - math.log(p0 / (1 - p0)) - toxicity.DRIFT, abs=1e-6)
    assert got["good"] < 0


def test_calibration_recovers_the_law():
    """Best scores drawn from the law, and cut off where no segment can be: lam and k come back."""
    r = np.random.default_rng(2)
    for lam, log_k in ((0.8, -3.0), (1.6, -7.0)):
        n = r.integers(20, 2000, 6000).astype(float)
        best = (log_k + np.log(n) - np.log(-np.log(r.random(6000)))) / lam
        model = toxicity.Model({"w": 1.5})
        toxicity.fit_calibration(model, np.where(best >= 1.5, best, 0.0), n, np.zeros(6000, int))
        assert model.lam == pytest.approx(lam, rel=0.1) and model.log_k == pytest.approx(log_k, abs=0.6)
    none = toxicity.Model({"w": 1.5})
    toxicity.fit_calibration(none, np.zeros(50), np.full(50, 100.0), np.zeros(50, int))
    assert none.lam == 1.0 and none.log_k < math.log(0.01)


def test_weights_of_the_table_and_held_out_accuracy(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs, some = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out())
    model = toxicity.fitted(docs, some)
    held = {i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    rows = {r.doc_id: r for r in toxicity.op3_toxicity(spark, SF).collect()}
    assert all(rows[i].score == pytest.approx(model.score(t)) for i, t in texts.items())
    assert {i for i, r in rows.items() if r.held_out} == {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    known = [(labels[i], rows[i].predicted) for i in held if i in rows and labels[i] in (0, 1)]
    assert np.mean([a == b for a, b in known]) >= 0.97
    # the weights, counted again over the rows that the fit counted
    part = toxicity.F.pmod(toxicity.F.xxhash64(toxicity.F.lit(8), "doc_id"), toxicity.F.lit(3)) >= 1
    counted = [r.doc_id for r in some.where("toxic IN (0, 1)").where(part).collect() if r.doc_id in texts]
    n, seen = [0, 0], {}
    for i in counted:
        words = set(toxicity.tokens(texts[i]))
        words |= {b for w in words for b in toxicity.stems(w)}
        n[labels[i]] += 1
        for w in words - {""}:
            seen.setdefault(w, [0, 0])[labels[i]] += 1
    want = toxicity.fit_weights([(w, y1, y0) for w, (y0, y1) in seen.items() if y0 + y1 >= toxicity.LEAST_DOCS], n[1], n[0])
    assert model.weight == pytest.approx(want)
