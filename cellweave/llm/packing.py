"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

Documents become token pieces of at most ``capacity``. The pieces are dealt by hash into shards of bounded size, and each
shard is packed by several islands. An island breeds packings: a child takes whole well-filled bins of one parent, drops
the other parent's bins that hold any of their pieces, and puts the displaced pieces back by best fit, longest first.
After each epoch the islands of a shard pass their best packing on to the next island. What a shard leaves in bins that
are not nearly full is dealt anew, level by level, until one shard is left, so sharding costs next to nothing. Where a
level leaves most of its pieces so, as pieces of over half a sequence do, dealing anew gains nothing: its bins stay.

Each piece's ids are kept as bytes beside its place, so a sequence is its pieces' ids by offset, one after another.

Edge cases: a null text is empty and is the end token alone; pieces as long as a sequence stand alone; repeated rows are
pieces of their own; ties go by the pieces' order; an empty table gives an empty result; very long texts and runs of
white space are cut into whole sequences behind a shorter first piece; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import PATTERN, byte_bpe
from .common import table, whole_text, written

CAPACITY = 2048
#: Pieces a shard holds on average.
SHARD = 6000
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 5, 6
#: Bins filled less than this are dealt anew on the next level.
WELL = 0.995
#: A level that leaves more than this share of its pieces in such bins is the last one. Each level before it shrinks the
#: pieces by that share, so all levels together take 1 / (1 - MOST_LEFT) times the first one's work and disk at most.
MOST_LEFT = 0.75
#: Bits of a sequence's number that say which bin of its shard it is; the bins of a shard are an int.
BIN_BITS = 31

#: Characters of a run of white space from which on it is cut out before the pattern, which goes back over such a run.
LONG_SPACE = 1000


class Encoder:
    """Texts to the bytes of their ids, as the tokenizers library has them.

    The ranks and the pre-token pattern of the vocabulary file drive tiktoken's merge loop, which gives the same ids
    several times faster; ``tests/llm`` holds both libraries' ids against each other.
    """

    def __init__(self, path: str):
        import tiktoken

        bpe = byte_bpe(path)
        self.lib = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens=bpe.added)
        self.bpe, self.added = bpe, set(bpe.added)
        import regex

        self.space = regex.compile(rf"\p{{White_Space}}{{{LONG_SPACE},}}")

    def plain(self, text: str) -> bytes:
        return self.lib.encode_to_numpy(text, allowed_special=self.added).astype("<u4").tobytes() if text else b""

    def one(self, text: str) -> bytes:
        """The ids of a text; a long run of white space is one pre-token, but for its last character before a word."""
        out, at = [], 0
        for run in self.space.finditer(text):
            word = run.end() < len(text) and not text.startswith(tuple(self.added), run.end())
            stop = run.end() - 1 if word else run.end()
            out += [self.plain(text[at : run.start()]), np.array(self.bpe.long(text[run.start() : stop].encode()), "<u4").tobytes()]
            at = stop
        return b"".join([*out, self.plain(text[at:])])

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row's ids and the end id behind them; ids: four bytes each, little-endian."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for k in range(0, len(b), rows):
                part = b.iloc[k : k + rows]
                out = []
                for doc, ids in zip(part["doc_id"].tolist(), encode(part["t"].tolist())):
                    ids += end
                    n, at, j = len(ids) // 4, 0, 0
                    while at < n:
                        size = capacity if at or n <= capacity or n % capacity == 0 else n % capacity
                        size = min(size, n - at)
                        out.append((None if doc != doc else doc, j, at, size, ids[4 * at : 4 * (at + size)]))
                        at, j = at + size, j + 1
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids"]).astype({"doc_id": "Int64"})

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("t"))
    return text.mapInPandas(run, "doc_id bigint, piece int, start bigint, length int, ids binary")


class Fits:
    """The open bins by room left, and the smallest room that takes a piece."""

    def __init__(self, capacity: int):
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, room: int, b: int) -> None:
        self.at[room].append(b)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        high = self.mask >> size
        if not high:
            return None
        room = size + (high & -high).bit_length() - 1
        b = self.at[room].pop()
        if not self.at[room]:
            self.mask ^= 1 << room
        return room, b


def best_fit(sizes: list[int], items: list[int], room: list[int], of: list[int], capacity: int) -> None:
    """Put ``items`` into the bins of ``room``, opening bins where none takes one; ``of``: each piece's bin."""
    fits = Fits(capacity)
    for b, r in enumerate(room):
        if r > 0:
            fits.add(r, b)
    for i in items:
        found = fits.take(sizes[i])
        if found is None:
            left, b = capacity, len(room)
            room.append(capacity)
        else:
            left, b = found
        of[i] = b
        room[b] = left - sizes[i]
        if room[b]:
            fits.add(room[b], b)


def fitness(sizes: np.ndarray, of: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then unevenly filled ones."""
    fill = np.bincount(of, weights=sizes)
    fill = fill[fill > 0] / capacity
    return -len(fill), float((fill**2).mean()) if len(fill) else 1.0


def crossed(sizes: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The taker with some well-filled bins of the giver in place of those of its own that hold their pieces."""
    fill = np.bincount(giver, weights=sizes)
    good = np.flatnonzero(fill >= max(WELL * capacity, np.quantile(fill[fill > 0], 0.4)))
    if not len(good):
        good = np.flatnonzero(fill == fill.max())
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, int(len(good) * rng.uniform(0.1, 0.5))), replace=False)] = True
    injected = chosen[giver]
    broken = np.zeros(taker.max() + 1, bool)
    broken[taker[injected]] = True
    thin = np.bincount(taker, weights=sizes, minlength=len(broken)) < rng.uniform(0.85, 0.99) * capacity
    displaced = (broken | thin)[taker] & ~injected
    keep = ~injected & ~displaced
    of = np.full(len(sizes), -1)
    names, of[keep] = np.unique(taker[keep], return_inverse=True)
    more, at = np.unique(giver[injected], return_inverse=True)
    of[injected] = at + len(names)
    room = (capacity - np.bincount(of[of >= 0], weights=sizes[of >= 0], minlength=len(names) + len(more))).astype(int).tolist()
    loose = np.flatnonzero(displaced)
    loose = loose[np.argsort(-sizes[loose] + rng.uniform(0, rng.choice([0, 1, 32]), len(loose)), kind="stable")]
    out = of.tolist()
    best_fit(sizes.tolist(), loose.tolist(), room, out, capacity)
    return np.array(out)


def evolved(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The population after some generations, best first; at once where a packing meets the lower bound."""
    rng = np.random.default_rng(seed)
    least = -int(-(-sizes.sum() // capacity))
    order = np.argsort(-sizes, kind="stable")
    while len(population) < POPULATION:
        blur = 0 if not population else rng.choice([1, 16, 128])
        mixed = order if not population else np.argsort(-sizes + rng.uniform(0, blur, len(sizes)), kind="stable")
        of, room = [0] * len(sizes), []
        best_fit(sizes.tolist(), mixed.tolist(), room, of, capacity)
        population = [*population, np.array(of)]
        if -len(room) == least:
            break
    ranked = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: x[:2], reverse=True)
    for _ in range(generations):
        if ranked[0][0][0] == least:
            break
        for _ in range(POPULATION):
            a, b = rng.integers(0, max(1, len(ranked) // 2)), rng.integers(0, len(ranked))
            child = crossed(sizes, ranked[a][2], ranked[b][2], capacity, rng)
            ranked.append((fitness(sizes, child, capacity), len(ranked), child))
        ranked = [(f, k, p) for k, (f, _, p) in enumerate(sorted(ranked, key=lambda x: x[:2], reverse=True)[:POPULATION])]
    return [p for _, _, p in ranked]


def packed_shards(items: DataFrame, n: int, capacity: int = CAPACITY, shard_size: int = SHARD, level: int = 0) -> tuple[DataFrame, int]:
    """(shard, bin, fill, item) rows of one level's ``n`` pieces, written to the shared folder, and its number of shards."""
    shards = max(1, -(-n // shard_size))
    key = F.pmod(F.xxhash64("item.row", F.lit(level)), F.lit(shards))
    dealt = items.select(key.alias("shard"), "item").groupBy("shard").agg(F.sort_array(F.collect_list("item")).alias("items"))
    state = dealt.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.transform("items", lambda i: i["length"]).alias("sizes"), F.array().cast("array<binary>").alias("pop")
    )

    def epoch(batches: Iterator[pd.DataFrame], e: int) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                sizes = np.asarray(row.sizes, np.int64)
                population = [np.frombuffer(p, "<i4").astype(np.int64) for p in row.pop]
                seed = (int(row.shard) * ISLANDS + int(row.island)) * EPOCHS + e
                best = evolved(sizes, population, capacity, seed)[:2]
                f = fitness(sizes, best[0], capacity)
                yield pd.DataFrame({"shard": [row.shard], "island": [row.island], "bins": [-f[0]], "fill": [f[1]], "pop": [[p.astype("<i4").tobytes() for p in best]]})

    for e in range(EPOCHS):
        run = lambda batches, e=e: epoch(batches, e)
        done = state.repartition(max(1, min(shards * ISLANDS, 10_000)), "shard", "island").mapInPandas(run, "shard bigint, island int, bins int, fill double, pop array<binary>")
        if e + 1 < EPOCHS:  # each island goes on with its own two best and the best of the island before it
            elite = done.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("island", "pop"))).alias("all"))
            one = F.explode(F.transform("all", lambda x, i: F.struct(x["island"].alias("island"), F.concat(x["pop"], F.slice(F.get(F.col("all"), F.pmod(i - 1, F.size("all")))["pop"], 1, 1)).alias("pop"))))
            moved = elite.select("shard", one.alias("s")).select("shard", "s.island", "s.pop")
            state = dealt.select("shard", F.transform("items", lambda i: i["length"]).alias("sizes")).join(moved, "shard")
    winner = done.groupBy("shard").agg(F.min_by("pop", F.struct("bins", -F.col("fill"), "island")).alias("pop"))

    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                of = np.frombuffer(row.pop[0], "<i4")
                yield pd.DataFrame({"shard": [row.shard], "of": [of.tolist()]})

    bins = winner.mapInPandas(unfold, "shard bigint, of array<int>")
    rows = dealt.join(bins, "shard").select("shard", F.explode(F.arrays_zip(F.col("of").alias("bin"), F.col("items").alias("item"))).alias("x")).select("shard", "x.bin", "x.item")
    fills = F.sum("item.length").over(_by_bin())
    return written(rows.withColumn("fill", fills), f"packed-{level}"), shards


def _by_bin():
    from pyspark.sql.window import Window

    return Window.partitionBy("shard", "bin")


def packed(items: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD) -> DataFrame:
    """(row, sequence_id, offset) of ``items`` (row, length), ``row`` unique: the gapless place of each in its sequence."""
    from pyspark.sql.window import Window

    left = items.select(F.struct(F.col("length").cast("int").alias("length"), F.col("row").cast("long").alias("row")).alias("item"))
    every, level, n, before = None, 0, left.count(), 0
    while True:
        rows, shards = packed_shards(left, n, capacity, shard_size, level)
        number = F.shiftleft(F.col("shard") + F.lit(before).cast("long"), BIN_BITS) + F.col("bin")
        rows = rows.withColumn("sequence_id", number)
        thin = rows.where(F.col("fill") < WELL * capacity)
        n, n_before = (thin.count(), n) if shards > 1 else (0, n)
        last = shards == 1 or n > MOST_LEFT * n_before
        settled = rows if last else rows.where(F.col("fill") >= WELL * capacity)
        every = settled if every is None else every.unionByName(settled)
        if last or not n:
            break
        left, level, before = thin.select("item"), level + 1, before + shards
    place = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("item.row", "sequence_id", F.coalesce(F.sum("item.length").over(place), F.lit(0)).cast("long").alias("offset"))


def placed_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, piece, start, length, ids) of every piece, and (row, sequence_id, offset): its place."""
    items = written(pieces(docs, path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return items.withColumn("length", F.col("length").cast("long")), packed(items.select("row", "length"), capacity)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece."""
    items, placed = placed_pieces(docs, path, capacity, end_id)
    return items.join(placed, "row").drop("row")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, placed = placed_pieces(table(spark, sf_dir, "documents"), vocabulary())
    digests = items.select("row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))  # before the join, which then moves no ids
    return digests.join(placed, "row").drop("row")


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
