"""The token operators against the tokenizers library on random strings."""

import random

import numpy as np
import pytest

ALPHABET = "aab bTheé ñ'sßΣσςİ0123,.! \n\t 　\u0085\u001c日本́<|endoftext|><|startoftext|>x"
WORDS = ["<|endoftext|>", "the", "  ", "\n", "<|startoftext|>", "it's", "I'LL", "99", "…", "ﬁ", "é", "🙂"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    some = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(60))) for _ in range(1500)]
    some += [" ".join(r.choice(WORDS) for _ in range(12)) for _ in range(300)]
    return [*some, "", " ", "<|endoftext|>", "a  b   c \n\n d", "a" * 5000, "'s 't I'll O'Σ ΑΣ", "\x00 \x7f"]


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    return path, Tokenizer.from_file(path)


def test_counts(texts):
    from cellweave.llm.token_count import Counter

    path, t = library("byte_bpe_50k.json")
    count = Counter(path)
    assert [count(x) for x in texts] == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_proven_whole_strings_are_single_tokens():
    from cellweave.llm.token_count import proven_whole

    path, t = library("byte_bpe_50k.json")
    some = sorted(proven_whole(path))[::37]
    assert all(len(e.ids) == 1 for e in t.encode_batch(some, add_special_tokens=False))


def test_packing_ids(texts):
    from cellweave.llm.packing import Encoder

    path, t = library("byte_bpe_50k.json")
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path)(texts)] == want


def test_codec(texts):
    from cellweave.llm.bpe_codec import WordBpe

    path, t = library("word_bpe_49k.json")
    got = WordBpe(path).encode_batch(texts)
    ids = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x, _ in got] == ids
    assert [s for _, s in got] == [t.decode(x, skip_special_tokens=False) for x in ids]


def test_long_runs():
    """Runs of white space and words that a pattern or a round a merge cannot take."""
    from cellweave.llm.bpe_codec import WordBpe
    from cellweave.llm.packing import Encoder
    from cellweave.llm.token_count import Counter

    r = random.Random(4)
    run = ["w" + " " * 2_000_000 + "x", "a\n" + "\n \t" * 400_000, "w " + " " * 3000 + "<|endoftext|> b" + "　" * 1500 + "!", " " * 1500 + "\n" + " " * 20 + "é"]
    run += ["  \x1c" * 900 + "a", "a" * 50_000, "".join(r.choice("abcdefgh") for _ in range(40_000)), "Σé" * 3000 + " b " + "the" * 2000]
    path, t = library("byte_bpe_50k.json")
    encode, count = Encoder(path), Counter(path)
    for x in run:
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(encode([x])[0], "<u4").tolist() == want and count(x) == len(want)
    path, t = library("word_bpe_49k.json")
    codec = WordBpe(path)
    for x in run[4:]:
        want = t.encode(x, add_special_tokens=False).ids
        ((ids, text),) = codec.encode_batch([x])
        assert np.frombuffer(ids, "<u4").tolist() == want and text == t.decode(want, skip_special_tokens=False)
