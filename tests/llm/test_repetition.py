"""Repetition coverage against brute force, on awkward rows, random texts and texts of all kinds of repetition."""

import random
import re

import pytest
from test_edge_cases import edge, passage, result, same, texts_of, unique  # noqa: F401

from cellweave.llm import repetition


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    chars = [len(w) for w in words]

    def covered(n, first):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        hit = {i for i, g in enumerate(grams) if (grams.count(g) > 1 if first else g in grams[:i])}
        return {j for i in hit for j in range(i, i + n)}

    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    total = max(sum(chars), 1)
    ngram = max(sum(chars[j] for j in covered(n, False)) for n in repetition.LENGTHS) / total
    line = sum(len(re.sub("[\x20\x09-\x0d]", "", x)) for x in again) / total
    repeat = len(covered(3, True))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return {
        "n_words": len(words), "word_chars": sum(chars), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(again), "n_repeat_words": repeat,
        "base_failed": failed, "ngram_share": ngram, "line_share": line, "kept": not failed and ngram <= 0.2 and line <= 0.2,
    }


@pytest.mark.parametrize("which", ["edge", "unique"])
def test_awkward_rows(spark, request, which):
    where = request.getfixturevalue(which)
    docs = [(i, t) for i, t in texts_of(where[1]) if len(t) < 20_000]
    got = [r for r in result(spark, where, "op12_quality_rules") if r["word_chars"] < 20_000]
    long = [t for _, t in texts_of(where[1]) if len(t) >= 20_000]
    assert len(got) + len(long) == len(where[1])
    same(got, [{"doc_id": i} | brute(t) for i, t in docs])


def test_random_texts():
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "b", "cc", " ", " ", "\n", "\t", "#", "é "]) for _ in range(r.randrange(200))) for _ in range(300)]
    body = passage(7, 300)
    words = body.split(" ")
    texts += [body, body + "\n" + body, "\n".join([" ".join(words[:9])] * 8 + [body]), " ".join([*words, *words[:40], *words[:40]]), " ".join([*words[:60], *words[20:29]]), "", "x " * 500]
    got = repetition.measured(texts).to_dict("records")
    assert got == [brute(t) for t in texts]
    assert [g["kept"] for g in got[-7:]] == [True, False, True, False, True, False, False]


def test_long_text():
    """A text of over 1 MB beside a short one; windows do not cross texts."""
    long = passage(8, 200_000)
    assert len(long) > 1_000_000
    a, b, c = repetition.measured([long, "one two three four five six", long]).to_dict("records")
    assert a == c and a["n_words"] == 200_000 and a["kept"] and a["ngram_share"] < 0.01 and not b["ngram_share"]
    (twice,) = repetition.measured([long + " " + long]).to_dict("records")
    assert twice["ngram_share"] == pytest.approx(0.5, abs=1e-5) and not twice["kept"]
