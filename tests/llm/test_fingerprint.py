"""Fingerprints against a Python version of the same hashes, and the error of the likeness."""

import random
import re
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from cellweave.llm import fingerprint as P

SF = "/root/testdata/sf0.001"
M = 1 << 64


def signed(x):
    return x - M if x >= M >> 1 else x


def chained(values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(4, "little", signed=True)
        seed = xxhash.xxh64(raw, seed).intdigest()
    return signed(seed)


def shingles(text, k=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def python_fingerprint(text):
    bins = {}
    for s in shingles(text):
        h = chained(s)
        j = (h >> (64 - P.BIN_BITS)) + (1 << P.BIN_BITS - 1)
        bins[j] = min(bins.get(j, M), h)
    if not bins:
        return ""
    n, r = 1 << P.BIN_BITS, random.Random(1)
    probes = [r.randrange(n) for _ in range(n * P.PROBES)]
    out = []
    for j in range(n):
        order = [j, *probes[j * P.PROBES : (j + 1) * P.PROBES], *sorted(bins, key=lambda b: chained([j, b]))]
        out.append(f"{bins[next(b for b in order if b in bins)] & 255:02x}")
    return "".join(out)


def test_equals_the_python_version(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in P.op4_fingerprint(spark, SF).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs[:120]):
        after = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = map(python_fingerprint, (t, edited, after))
        assert got[i].fingerprint == a and got[i].edited_fingerprint == b
        for value, other in ((got[i].near_edited, b), (got[i].near_next, c)):
            same = sum(a[j : j + 2] == other[j : j + 2] for j in range(0, len(a), 2)) / max(1, len(a) // 2)
            want = min(1.0, max(0.0, (same - 2**-8) / (1 - 2**-8))) if a and other else float(a == other)
            assert value == pytest.approx(want, abs=1e-12)


def test_likeness_is_near_the_share_of_common_shingles(spark):
    """Pairs of known likeness: no bias beyond the deviation of 128 bins."""
    r = random.Random(2)
    rows, errors = [], []
    for k in range(150):
        base = [f"w{r.randrange(10**9)}" for _ in range(600)]
        cut = r.randrange(0, 600)
        rows.append((k, " ".join(base), " ".join(base[:cut] + [f"v{r.randrange(10**9)}" for _ in range(600 - cut)])))
    df = P.with_fingerprint(P.with_fingerprint(spark.createDataFrame(rows, "k int, a string, b string"), "a", "fa"), "b", "fb")
    got = {x.k: x.l for x in df.select("k", P.likeness(F.col("fa"), F.col("fb")).alias("l")).collect()}
    for k, a, b in rows:
        x, y = shingles(a), shingles(b)
        errors.append(got[k] - len(x & y) / len(x | y))
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 5 * 0.5 / 128**0.5


def test_ids_that_repeat_or_are_missing(spark, tmp_path):
    """The order of neighbours does not depend on how the rows lie, and a common id is no trouble."""
    r = random.Random(3)
    text = lambda: " ".join(r.choice("abcdefg") for _ in range(r.randrange(0, 30)))
    rows = [(r.choice([None, 7, 7, 7, 1, 2]), text()) for _ in range(200)] + [(7, "same same")] * 20
    got = []
    for n, d in ((2, "a"), (5, "b")):
        r.shuffle(rows)
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n).write.parquet(f"{tmp_path}/{d}/documents.parquet")
        got.append(sorted(map(repr, P.op4_fingerprint(spark, f"{tmp_path}/{d}").collect())))
    assert got[0] == got[1] and len(got[0]) == len(rows)
