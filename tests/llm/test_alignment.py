"""Token alignment against both libraries and brute-force links, on awkward rows and random strings."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from test_edge_cases import edge, result, same, texts_of, unique  # noqa: F401

from cellweave.llm.token_alignment import aligned

ALPHABET = "aab bTheé ñ'sßΣ0123,.! \n\t 　\u0085\u001c日本́▁<|endoftext|></s>x🙂"
NAMES = "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return [], []
        return list(zip(ids_a, raw_a)), list(zip(ids_b, raw_b))

    return paths, tokens


def groups(a, b):
    found, own, end_a, end_b = [], ([], []), 0, 0
    a, b = a[::-1], b[::-1]
    while a or b:
        side = 0 if end_a <= end_b and a else 1
        i, raw = (a, b)[side].pop()
        own[side].append(i)
        end_a, end_b = (end_a + len(raw), end_b) if side == 0 else (end_a, end_b + len(raw))
        if end_a == end_b:
            found.append(own)
            own = ([], [])
    return found


def brute(docs, tokens):
    rows, holds = [], Counter()
    for i, text in docs:
        a, b = tokens(text)
        g = groups(a, b)
        links = Counter((x, y) for own_a, own_b in g for x in own_a for y in own_b)
        holds.update(links.keys())
        rows.append((i, len(a), len(b), g, links))
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    want = []
    for i, n_a, n_b, g, links in rows:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(n for p, n in links.items() if holds[p] == most[p[0]])
        digest = hashlib.sha256(said.encode()).hexdigest() if g else ""
        want.append(dict(zip(("doc_id", *NAMES), (i, n_a, n_b, len(g), sum(links.values()), best, sum(n * holds[p] for p, n in links.items()), digest))))
    return want


@pytest.mark.parametrize("which", ["edge", "unique"])
def test_awkward_rows(spark, request, libraries, which):
    where = request.getfixturevalue(which)
    same(result(spark, where, "op11_token_alignment"), brute(texts_of(where[1]), libraries[1]))


def test_random_strings(spark, libraries):
    r = random.Random(5)
    some = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(50))) for _ in range(900)]
    some += ["the cat  sat on\n\nthe mat ", " x", "x ", "  ", "\n", "w" + " " * 3000 + "x y", "a" * 4000, "日本語" * 700, "it's the theatre " * 300, "ab▁c d", "\x00 \x7f"]
    paths, tokens = libraries
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(some)], "doc_id string, text string").repartition(5)
    got = [x.asDict() for x in aligned(docs, *paths).collect()]
    same(got, brute([(str(i), t) for i, t in enumerate(some)], tokens))


def test_blocks_share_counts(spark, libraries, monkeypatch):
    """Small blocks and parts: a pair of every block is counted over all of them."""
    from cellweave.llm import common, token_alignment

    monkeypatch.setattr(token_alignment, "BLOCK_SIZE", 200)
    monkeypatch.setattr(common, "PART_ROWS", 5)
    paths, tokens = libraries
    texts = [f"the cat and the dog number {i} of the {i % 7} houses" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    same([x.asDict() for x in aligned(docs, *paths).collect()], brute(list(enumerate(texts)), tokens))
