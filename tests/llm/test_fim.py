"""Fill-in-middle against a plain version, and the text rebuilt from every output."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from test_edge_cases import edge, passage, result, same, sha, texts_of, unique  # noqa: F401

from cellweave.llm.fim import fill_in_middle, restored, unit_ends


def brute(i, text):
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return dict(zip(("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"), (i, n, form, *sizes, sha(out), sha(text))))


@pytest.mark.parametrize("which", ["edge", "unique"])
def test_awkward_rows(spark, request, which):
    where = request.getfixturevalue(which)
    same(result(spark, where, "op13_fill_in_middle"), [brute(i, t) for i, t in texts_of(where[1])])


def test_markers_and_halves(spark):
    r = random.Random(9)
    parts = ["<", "<S", "P>", ">", "M", "<M", "S>", "a", "é", "\n", "🙂", " ", "<P>"]
    texts = ["".join(r.choice(parts[:-1] if i % 5 else parts) for _ in range(r.randrange(25))) for i in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = fill_in_middle(docs).withColumn("back", restored()).collect()
    assert all(x.back == texts[x.doc_id] for x in made) and {x.form for x in made} == {"plain", "psm", "spm"}
    same([x.asDict() for x in fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")).collect()], [brute(i, t) for i, t in enumerate(texts)])


def test_windows_cut_between_units():
    r = random.Random(10)
    texts = ["".join(r.choice("abZ é1🙂\n") for _ in range(r.randrange(80))) for _ in range(300)]
    for t in [*texts, "a" * 90, "é" * 50, passage(11, 30)]:
        want = [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", t, re.S)]
        assert all(unit_ends(t, w).tolist() == want for w in (1, 2, 7, 1000))


def test_long_text(spark):
    text = passage(12, 220_000)
    assert len(text) > 1_000_000
    (row,) = fill_in_middle(spark.createDataFrame([(4, text)], "doc_id bigint, text string")).withColumn("back", restored()).collect()
    assert row.back == text and row.n == brute(4, text)["n"]
