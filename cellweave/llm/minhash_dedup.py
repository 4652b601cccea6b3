"""MinHash near-dedup: universal hash minima, banding, signature verification, full-set verification, components.

A text's set holds its distinct shingles of ``WORDS`` words. Texts with equal sets are one class from the start. A class
has 256 minima, of which 32 bands of four are its buckets: a pair with likeness 0.8 misses all of them once in 10**7.
First every member of a bucket is compared with the bucket's least member only; signatures are compared before the full
sets are. The links' components are found by alternating large-star and small-star. Then only buckets that still hold
several components are compared further, pairs within one component never, in blocks of bounded size; so a large group of
copies costs one comparison a member, and no link between components is lost. Groups of equal sets and buckets are dealt
in parts, so none of them lands in one task.

Edge cases: a null or empty text has an empty set and is linked with nothing; with fewer words than a shingle has, the
whole sequence is the one shingle; very long texts are hashed whole, their shingles a few hundred at a time; rows that
repeat an id and text are linked unless empty; rows without an id take part, a component is named by its least id that is
not null, and null where all are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_PARTS, PART_ROWS, dealt, forget, keyed, parts_for, table, whole_text, with_found, with_totals, written

WORDS, SHARE = 4, (80, 100)
MINIMA, ROWS, BANDS = 256, 4, 32
#: The share of equal minima below which a pair is not compared on full sets: 0.8 less five standard deviations.
LEAST_ESTIMATE = 0.675
#: Members of a bucket up to which its pairs are moved one by one; members and shingles of a larger one's blocks.
SMALL, BLOCK, BLOCK_ITEMS = 24, 2000, 2_000_000
#: Rows that a comparing task gets on average, and the most tasks.
TASK_ROWS, MOST_TASKS = 10_000, 50_000

_rng = np.random.default_rng(20_240_601)
_A = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_COEF = [np.uint64(c) for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, from running sums of a polynomial that starts anew at each word."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    word = np.concatenate(([False], ~_SPACE[raw], [False]))
    turn = np.flatnonzero(word[1:] != word[:-1])
    start, stop = turn[::2], turn[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    size = stop - start
    place = np.arange(len(raw)) - np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [len(raw)]))))
    power = powers(int(size.max()))
    term = (raw.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)]
    term[_SPACE[raw]] = 0
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
    return mixed(total[stop] - total[start] + size.astype(np.uint64) * _COEF[7])


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 1024), _P))), dtype=np.uint64)
    return _POWERS


def shingle_set(text: str, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's k-word shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        if len(h) < k:
            one = np.uint64(len(h))
            for i, x in enumerate(h):
                one = one * _P + x * _COEF[i % 7]
            return mixed(np.array([one]) + _COEF[6])
        total = h[: len(h) - k + 1] * _COEF[0]
        for i in range(1, k):
            total = total + h[i : len(h) - k + 1 + i] * _COEF[i % 7] * powers(i + 1)[i]
    return np.unique(mixed(total))


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each universal hash function over the set."""
    least = np.full(MINIMA, np.uint64(2**64 - 1))
    for i in range(0, len(s), 512):
        x = _A[:, None] * s[None, i : i + 512]
        x += _B[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A 64-bit name for each band's minima."""
    part = (least[: BANDS * ROWS] >> np.uint64(16)).reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        total = mixed(total * _P + part[:, r])
    return total.view(np.int64)


def short(least: np.ndarray) -> bytes:
    """Eight bits of each minimum, of a mixed copy: the low bits of the sums alone are not random."""
    return (mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal minima behind rows of eight-bit signatures, chance agreement taken out."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


SIGNED = "n bigint, same binary, bands array<bigint>, sig binary, key bigint, doc_id bigint"


def signed(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """Per row of (key, doc_id, text): set size, a 128-bit name of the set, its buckets and short signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            out = []
            for t in b["text"].tolist():
                s = shingle_set(t, k)
                if len(s):
                    least = minima(s)
                    out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), bands(least), short(least)))
                else:
                    out.append((0, None, None, None))
            yield pd.DataFrame(out, columns=["n", "same", "bands", "sig"]).assign(key=b["key"].array, doc_id=b["doc_id"].astype("Int64").array)

    return docs.select("key", F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInPandas(run, SIGNED)


def shingle_sets(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(key, n, items) of rows of (key, text): the full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                yield pd.DataFrame({"key": part["key"], "items": [shingle_set(t, k).view(np.int64) for t in part["text"].tolist()]})

    return docs.select("key", whole_text().alias("text")).mapInPandas(run, "key bigint, items array<bigint>")


def near_signatures(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The (a, b) pairs whose signatures agree often enough."""

    @F.pandas_udf("double")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        both = [np.frombuffer(b"".join(v), np.uint8).reshape(-1, MINIMA) for v in (x, y)]
        return pd.Series(estimate(*both)) if len(x) else pd.Series([], dtype=float)

    return beside(pairs, sigs, "sig").where(agree("va", "vb") >= LEAST_ESTIMATE).select(*pairs.columns)


def beside(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """The pairs with a value of both, va and vb. An ``a`` has few pairs; a ``b`` may be the hub of any number, about ``m``
    if the pairs tell: they are dealt in parts by that, and the hub's value goes to each part."""
    first, second = rows.select(F.col("key").alias("a"), F.col(value).alias("va")), rows.select(F.col("key").alias("b"), F.col(value).alias("vb"))
    m = F.col("m") if "m" in pairs.columns else F.lit(1)
    parts = F.greatest(F.lit(1), F.least(F.lit(MOST_PARTS), F.ceil(m / PART_ROWS)))
    return with_found(dealt(pairs.join(first, "a"), ["b"], "a", parts), second, ["b"]).where("vb IS NOT NULL").drop("_part")


def linked(pairs: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """The (a, b) pairs whose full sets are as like as ``share`` says."""
    both = beside(pairs, sets, "items").withColumn("both", F.size(F.array_intersect("va", "vb")).cast("long"))
    return both.where(F.col("both") * share[1] >= (F.size("va") + F.size("vb") - F.col("both")) * share[0]).select("a", "b")


def components(edges: DataFrame, what: str = "stars") -> DataFrame:
    """(node, root) of the nodes of (a, b) edges: root is the least node reachable.

    Large-star hangs every larger neighbour of a node on its least neighbour, small-star every smaller one; both keep
    what is reachable, and they alternate until no edge changes. Each round is written to the shared folder. The neighbours
    of a node, which may be all others, are dealt in parts.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what)
    sums = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sums(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parts, least = parts_for(2 * before[0]), ([F.min("b").alias("m")], [F.min("m").alias("m")])
        large = with_totals(dealt(both, ["a"], "b", parts), ["a"], *least).where("b > a")
        large = large.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        moved = with_totals(dealt(large, ["a"], "b", parts), ["a"], *least)
        small = moved.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e, old = written(small, what), e
        after = sums(e)
        forget(old)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def mixed_buckets(members: DataFrame, parts: int) -> DataFrame:
    """The (bucket, key, comp) members of buckets that hold several components, with the bucket's size ``m`` and shingles
    ``w``."""
    lo, hi, m, w = F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum(F.col("n").cast("long")).alias("w")
    total = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("m").alias("m"), F.sum("w").alias("w")]
    whole = with_totals(dealt(members, ["bucket"], "key", parts), ["bucket"], [lo, hi, m, w], total, F.col("lo") < F.col("hi"))
    return whole.select("bucket", "key", "comp", "m", "w")


def tasks_for(rows: DataFrame) -> int:
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(min(least, 200), min(MOST_TASKS, rows.count() // TASK_ROWS))


def _grouped(batches: Iterator[pd.DataFrame], names: list[str], solve) -> Iterator[pd.DataFrame]:
    """``solve`` of each run of rows with equal names, which may span batches."""
    held: list[pd.DataFrame] = []

    def done() -> Iterator[pd.DataFrame]:
        if sum(map(len, held)) > 1:
            yield solve(pd.concat(held))
        held.clear()

    for b in batches:
        name = b[names].to_numpy()
        edge = np.concatenate(([0], np.flatnonzero((name[1:] != name[:-1]).any(axis=1)) + 1, [len(b)]))
        if held and len(b) and (held[-1][names].iloc[-1].to_numpy() != name[0]).any():
            yield from done()
        for i, j in zip(edge[:-1], edge[1:]):
            if i:
                yield from done()
            if j > i:
                held.append(b.iloc[i:j])
    yield from done()


def near_in_small(rest: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b) pairs of members of one bucket, in different components, that agree by size and signature."""

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n", kind="stable")
        key, comp, size = (f[c].to_numpy() for c in ("key", "comp", "n"))
        sig = np.frombuffer(b"".join(f["sig"]), np.uint8).reshape(-1, MINIMA)
        out = []
        for i in range(len(f) - 1):
            j = np.arange(i + 1, np.searchsorted(size, size[i] * SHARE[1] / SHARE[0], side="right"))
            j = j[comp[j] != comp[i]]
            if len(j):
                out += [(key[i], key[x]) for x in j[estimate(sig[j], sig[i]) >= LEAST_ESTIMATE]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    near = rest.join(sigs.select("key", "n", "sig"), "key").select("bucket", "key", "comp", "n", "sig")
    ordered = near.repartition(tasks_for(rest), "bucket").sortWithinPartitions("bucket")
    return ordered.mapInPandas(lambda b: _grouped(b, ["bucket"], compare), "a bigint, b bigint").distinct()


def linked_in_large(rest: DataFrame, sigs: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE, block: int = BLOCK) -> DataFrame:
    """(a, b) links, by signatures and then full sets, that join the components of large buckets.

    A bucket is cut into blocks of about ``block`` members and ``BLOCK_ITEMS`` shingles, and each pair of blocks is a unit
    of work that holds its members' sets. A pair is looked at in the first bucket it shares only, and only while it lies in
    different components, links found so far included; so a unit gives fewer links than it has members.
    """
    n = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("w") / BLOCK_ITEMS)).cast("int")
    units = rest.withColumn("own", F.pmod(F.xxhash64("key"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    units = units.select("bucket", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "key", "comp")
    held = units.join(sigs, "key").join(sets, "key").select("bucket", "b1", "b2", "own", "key", "comp", "n", "sig", "bands", "items")
    ordered = held.repartition(tasks_for(units), "bucket", "b1", "b2").sortWithinPartitions("bucket", "b1", "b2")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n", kind="stable")
        key, root, size, own = (f[c].to_numpy().copy() for c in ("key", "comp", "n", "own"))
        sig = np.frombuffer(b"".join(f["sig"]), np.uint8).reshape(-1, MINIMA)
        band = np.stack(f["bands"].to_list())
        k = int((band[0] == f["bucket"].iloc[0]).argmax())
        apart = f["b1"].iloc[0] != f["b2"].iloc[0]
        items, flat = np.unique(np.concatenate(f["items"].to_list()), return_inverse=True)
        stop = np.cumsum(size)
        start, mark, out = stop - size, np.zeros(len(items), bool), []
        for i in range(len(f) - 1):
            j = np.arange(i + 1, np.searchsorted(size, size[i] * share[1] / share[0], side="right"))
            j = j[root[j] != root[i]]
            if apart:
                j = j[own[j] != own[i]]
            if k and len(j):
                j = j[~(band[j, :k] == band[i, :k]).any(axis=1)]
            if len(j):
                j = j[estimate(sig[j], sig[i]) >= LEAST_ESTIMATE]
            mark[mine := flat[start[i] : stop[i]]] = True
            for x in j.tolist():
                if root[x] != root[i]:
                    both = int(mark[flat[start[x] : stop[x]]].sum())
                    if both * share[1] >= (size[i] + size[x] - both) * share[0]:
                        out.append((key[i], key[x]))
                        root[root == root[x]] = root[i]
            mark[mine] = False
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return ordered.mapInPandas(lambda b: _grouped(b, ["bucket", "b1", "b2"], compare), "a bigint, b bigint").distinct()


def linked_keys(rows: DataFrame, k: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(key, doc_id, n, comp) of the rows of (key, doc_id, text), ``key`` unique: the least key reachable."""
    known = written(signed(rows, k), "signed")
    parts = parts_for(known.count())
    slim = dealt(known.where("n > 0").select("key", "same"), ["same"], "key", parts)
    first, count = F.min("key").alias("rep"), F.count("*").alias("c")
    copies = with_totals(slim, ["same"], [first, count], [F.min("rep").alias("rep"), F.sum("c").alias("c")], F.col("c") > 1)
    copies = written(copies.where("key <> rep").select("key", "rep"), "copies")
    reps = known.where("n > 0").join(copies, "key", "left_anti").select("key", F.col("n").cast("int").alias("n"), "bands", "sig")
    sigs = reps.select("key", "n", "sig")

    exploded = dealt(reps.select("key", "n", F.explode("bands").alias("bucket")), ["bucket"], "key", parts)
    hub, m = F.min("key").alias("hub"), F.count("*").alias("m")
    shared = with_totals(exploded, ["bucket"], [hub, m], [F.min("hub").alias("hub"), F.sum("m").alias("m")], F.col("m") > 1)
    members = written(shared.select("bucket", "key", "n", "hub", "m"), "members")
    sets = written(shingle_sets(rows.join(members.select("key").distinct(), "key"), k), "sets")

    spokes = members.where("key <> hub").groupBy(F.col("key").alias("a"), F.col("hub").alias("b")).agg(F.max("m").alias("m"))
    links = written(linked(near_signatures(spokes, sigs), sets, share), "links")
    roots = components(links)
    placed = members.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("bucket", "key", "n", F.coalesce("root", "key").alias("comp"))
    rest = written(mixed_buckets(placed, parts), "rest")
    small, large = rest.where(F.col("m") <= SMALL), rest.where(F.col("m") > SMALL)
    more = written(linked(near_in_small(small, sigs), sets, share).unionByName(linked_in_large(large, reps, sets, share)), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    of = copies.select("key", "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", F.coalesce("root", "rep").alias("comp"))
    of = of.unionByName(roots.select(F.col("node").alias("key"), F.col("root").alias("comp")))
    made = written(known.select("key", "doc_id", "n").join(of, "key", "left").select("key", "doc_id", "n", F.coalesce("comp", "key").alias("comp")), "linked")
    forget(known, copies, members, sets, links, rest, more)
    return made


def near_duplicates(rows: DataFrame, by_id: bool, k: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(key, doc_id, n_shingles, component_id, first) of ``keyed`` rows; ``by_id``: whether the key is the id.

    ``first`` holds for one row of each component: its least by id, nulls last, and key.
    """
    found = linked_keys(rows.select("key", "doc_id", "text"), k, share)
    if by_id:  # the least key is the least id
        return found.select("key", "doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.expr("key = comp").alias("first"))
    parts = parts_for(found.count())
    least = lambda c: F.min(F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("doc_id"), "key"))
    named = with_totals(dealt(found, ["comp"], "key", parts), ["comp"], [least("doc_id").alias("of")], [F.min("of").alias("of")])
    return named.select("key", "doc_id", F.col("n").alias("n_shingles"), F.col("of.doc_id").alias("component_id"), (F.col("key") == F.col("of.key")).alias("first"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(*keyed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


QUERIES = {"op9_minhash_dedup": op9_minhash_dedup}
