"""Suffix-array dedup: removes every byte covered by a 200-byte string that also starts elsewhere.

Every 200-byte window of a text picks its least 48-byte gram by hash, so equal windows pick the same gram. Neighbouring
windows with one gram form a context. A gram that occurs once is done with; where each context of a gram has several
places, all of them repeat whole and there is nothing to sort. The other contexts are dealt by gram, each distinct one once with its number of places, and a shard's
contexts, apart by separators, are sorted by induced sorting: suffixes are classified, the leftmost-smaller substrings
are sorted and named, the string of names recursively, and the suffix array is induced from them in linear time. Permuted
common prefixes of 200 bytes or more, irreducible ones compared and the others derived, mark the windows that repeat. The
marks go back to all places of a context.

A gram with more than ``HOT`` distinct contexts is dealt further, so that no gram's contexts gather in one task without a
bound: the windows that hold it far from their start go by the bytes before it that they all hold, the others by the bytes
behind it. Equal windows stay together, equal parts of contexts become one again, and each step halves where in a window
the gram may be, so the parts of a group are sorted after at most eight steps or are single windows that all differ.

Edge cases: a null text is empty; texts shorter than a window lose nothing; rows that repeat an id and text are documents
of their own and repeat each other; rows without an id take part; an empty table gives an empty result; very long texts
are read in overlapping pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, forget, keyed, parts_for, table, whole_text, with_found, with_totals, written

WINDOW, GRAM = 200, 48
#: Bytes read at once, bytes of contexts sorted at once, distinct contexts of a gram that are sorted together.
PIECE, SHARD_BYTES, HOT = 1 << 20, 1_500_000, 4096
#: Bytes of contexts that a sorting task gets on average, and the most tasks.
TASK_BYTES, MOST_TASKS = 6_000_000, 50_000

_BYTE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


# --- contexts -------------------------------------------------------------------------------------------------------


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed polynomial hash of the ``gram`` bytes from each place on, by doubling."""
    h = {1: _BYTE[raw]}
    power, size = {1: _P}, 1
    while size * 2 <= gram:
        h[size * 2] = h[size][:-size] * power[size] + h[size][size:]
        with np.errstate(over="ignore"):
            power[size * 2] = power[size] * power[size]
        size *= 2
    total, done = h[size], size
    while done < gram:
        size = max(s for s in h if s <= gram - done)
        n = len(raw) - done - size + 1
        total, done = total[:n] * power[size] + h[size][done : done + n], done + size
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return total ^ (total >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def contexts(raw: np.ndarray, sizes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, size, gram hash) of the contexts of texts that lie one after another in ``raw``.

    Starts are within ``raw``. A window's gram is the leftmost of the least by 40 bits of hash.
    """
    none = np.empty(0, np.int64)
    if len(raw) < window:
        return none, none, none, none
    h = gram_hashes(raw, gram)
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    least = sliding_least((h & ~low) | place, window - gram + 1)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    start = np.arange(len(least))
    ok = start + window <= ends[text]
    start, text, pick = start[ok], text[ok], (least[ok] & low).astype(np.int64)
    if not len(start):
        return none, none, none, none
    new = np.flatnonzero(np.concatenate(([True], (pick[1:] != pick[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((new[1:], [len(start)])) - 1
    return text[new], start[new], start[last] - start[new] + window, h[pick[new]].view(np.int64)


def pieces_of(rows: list[tuple[int, bytes]], most: int = PIECE) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (row, offset, bytes) of about ``most`` bytes; longer texts are cut so that each window is in one."""
    held, size = [], 0
    for i, raw in rows:
        for at in range(0, max(1, len(raw) - WINDOW + 1), most):
            part = raw[at : at + most + WINDOW - 1]
            if held and size + len(part) > 2 * most:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def places(docs: DataFrame) -> DataFrame:
    """(gram, ctx, key, at, size) of every context of the rows of (key, text); ``ctx``: a hash of its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            keys = b["key"].to_numpy(np.int64)
            for group in pieces_of([(i, t.encode("utf-8", "replace")) for i, t in enumerate(b["text"].tolist()) if len(t) * 4 >= WINDOW]):
                raw = b"".join(p for _, _, p in group)
                text, start, size, gram = contexts(np.frombuffer(raw, np.uint8), np.array([len(p) for _, _, p in group]))
                view = memoryview(raw)
                ctx = np.fromiter((xxh3_64_intdigest(view[s:e]) for s, e in zip(start.tolist(), (start + size).tolist())), np.uint64, len(start))
                begin = np.cumsum([0] + [len(p) for _, _, p in group])
                row, off = np.array([i for i, _, _ in group]), np.array([o for _, o, _ in group])
                yield pd.DataFrame({"gram": gram, "ctx": ctx.view(np.int64), "key": keys[row[text]], "at": start - begin[text] + off[text], "size": size.astype(np.int32)})

    return docs.select("key", whole_text().alias("text")).mapInPandas(run, "gram bigint, ctx bigint, key bigint, at bigint, size int")


# --- induced sorting ------------------------------------------------------------------------------------------------


def smaller_type(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last, the sentinel, is."""
    n = len(t)
    value = np.append(t[:-1] < t[1:], True)
    turn = np.where(np.append(t[:-1] != t[1:], True), np.arange(n), n - 1)
    return value[np.minimum.accumulate(turn[::-1])[::-1]]


def _runs(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per run of equal numbers its number and length; each place's rank in its run."""
    edge = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
    size = np.diff(np.append(edge, len(chars)))
    return chars[edge], size, np.arange(len(chars)) - np.repeat(edge, size)


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix array induced from the leftmost-smaller suffixes in their order, a bucket's wave at a time.

    A bucket's entries put the suffixes before them into buckets further on, or behind themselves in their own bucket;
    the latter are the next wave. So all entries of a wave can be handled at once.
    """
    n = len(t)
    stop = np.cumsum(np.bincount(t, minlength=alphabet))
    begin = np.concatenate(([0], stop[:-1]))
    sa = np.full(n, -1, np.int64)
    first, size, rank = _runs(t[lms]) if (t[lms[1:]] >= t[lms[:-1]]).all() else (None, None, None)
    if first is None:
        lms = lms[np.argsort(t[lms], kind="stable")]
        first, size, rank = _runs(t[lms])
    n_lms = np.zeros(alphabet, np.int64)
    n_lms[first] = size
    sa[np.repeat(stop[first] - size, size) + rank] = lms
    used = np.flatnonzero(stop > begin).tolist()
    begin_of, stop_of = begin.tolist(), stop.tolist()
    many = n_lms.tolist()

    head = begin.copy()

    def forward(cur: np.ndarray) -> None:
        j = cur - 1
        j = j[(j >= 0)]
        j = j[~small[j]]
        if len(j):
            c = t[j]
            order = np.argsort(c, kind="stable")
            j, c = j[order], c[order]
            ch, size, rank = _runs(c)
            sa[np.repeat(head[ch], size) + rank] = j
            head[ch] += size

    for c in used:
        lo = begin_of[c]
        while lo < (hi := int(head[c])):
            forward(sa[lo:hi])
            lo = hi
        if many[c]:
            forward(sa[stop_of[c] - many[c] : stop_of[c]])
    last_l = head.copy()

    tail = stop.copy()
    sa[0] = n - 1
    tail[t[n - 1]] = 0

    def backward(cur: np.ndarray) -> None:
        j = cur[::-1] - 1
        j = j[j >= 0]
        j = j[small[j]]
        if len(j):
            c = t[j]
            order = np.argsort(c, kind="stable")
            j, c = j[order], c[order]
            ch, size, rank = _runs(c)
            sa[np.repeat(tail[ch], size) - 1 - rank] = j
            tail[ch] -= size

    for c in reversed(used):
        hi = stop_of[c]
        while (lo := int(tail[c])) < hi:
            backward(sa[lo:hi])
            hi = lo
        lo, hi = begin_of[c], int(last_l[c])
        if lo < hi:
            backward(sa[lo:hi])
    return sa


def induce_singly(t: np.ndarray, small: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """As ``induce``, a suffix at a time: for alphabets so large that the waves are short."""
    n = len(t)
    counts = np.bincount(t, minlength=alphabet)
    stop = np.cumsum(counts)
    head, tail = (stop - counts).tolist(), stop.tolist()
    text, is_small = t.tolist(), small.tolist()
    sa = [-1] * n
    for i in reversed(lms.tolist()):
        c = text[i]
        tail[c] -= 1
        sa[tail[c]] = i
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not is_small[j]:
            c = text[j]
            sa[head[c]] = j
            head[c] += 1
    tail = stop.tolist()
    tail[text[n - 1]] = 0
    sa[0] = n - 1
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and is_small[j]:
            c = text[j]
            tail[c] -= 1
            sa[tail[c]] = j
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, alphabet: int) -> np.ndarray:
    """Of a text whose last number is its only smallest one."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    small = smaller_type(t)
    lms = np.flatnonzero(small & np.concatenate(([False], ~small[:-1])))
    by = induce if alphabet * 40 < len(t) else induce_singly
    sa = by(t, small, lms, alphabet)
    place = np.full(len(t), -1, np.int64)
    place[lms] = np.arange(len(lms))
    order = place[sa]
    order = order[order >= 0]
    size = np.append(np.diff(lms) + 1, 1)
    a, b = lms[order[:-1]], lms[order[1:]]
    differ = size[order[:-1]] != size[order[1:]]
    at, k = np.flatnonzero(~differ), 0
    length = size[order[:-1]]
    while len(at):
        same = t[a[at] + k] == t[b[at] + k]
        differ[at[~same]] = True
        k += 1
        at = at[same & (length[at] > k)]
    name = np.empty(len(lms), np.int64)
    name[order] = np.concatenate(([0], np.cumsum(differ)))
    names = int(name.max()) + 1
    if names < len(lms):
        order = suffix_array(name, names)
    return by(t, small, lms[order], alphabet)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix in text order: how much it shares with the suffix before it in ``sa``, and that suffix.

    Shared prefixes end before numbers of at most ``end``. Where the numbers before both suffixes are equal, the value is
    that of the place before, less one; only the other places are compared.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    before = np.concatenate(([-1], t[:-1]))
    other = np.where(phi > 0, before[phi], -2)
    derived = (before == other) & (before > end) & (phi >= 0)
    value = np.zeros(n, np.int64)
    at, k = np.flatnonzero(~derived & (phi >= 0)), 0
    while len(at):
        x = t[at + k]
        at = at[(x > end) & (x == t[phi[at] + k])]
        value[at] += 1
        k += 1
    base = np.maximum.accumulate(np.where(derived, 0, np.arange(n)))
    return np.where(derived, value[base] - (np.arange(n) - base), value), phi


def repeated_windows(texts: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """Per text the starts of its windows that also start elsewhere in these texts."""
    raw = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8).astype(np.int64) + 2  # no byte of UTF-8 is 255
    raw[raw == 257] = 1
    t = np.append(raw, 0)
    value, phi = permuted_prefixes(t, suffix_array(t.astype(np.uint16), 258), 1)
    long = np.flatnonzero(value >= window)
    hit = np.zeros(len(t), bool)
    hit[long] = True
    hit[phi[long]] = True
    stop = np.cumsum([len(x) + 1 for x in texts])
    return [np.flatnonzero(hit[e - len(x) - 1 : e - 1]) for x, e in zip(texts, stop.tolist())]


def as_spans(starts: np.ndarray, window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Starts of windows as the starts and ends of the covered bytes."""
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) > window)
    return starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.concatenate((cut, [len(starts) - 1]))] + window).tolist()


# --- the operator ---------------------------------------------------------------------------------------------------


def sorted_marks(texts: DataFrame) -> DataFrame:
    """(gram, ctx, s, e) of (gram, ctx, n, size, body) rows: starts and ends of what repeats.

    Whole grams lie together in shards of bounded size; the number of tasks follows from the bytes.
    """

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        body = f["body"].tolist()
        spans = [([0], [len(x)]) if n > 1 else as_spans(r) for x, n, r in zip(body, f["n"].tolist(), repeated_windows(body))]
        out = pd.DataFrame({"gram": f["gram"].to_numpy(), "ctx": f["ctx"].to_numpy(), "s": [s for s, _ in spans], "e": [e for _, e in spans]})
        return out[[len(s) > 0 for s, _ in spans]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            edge = np.flatnonzero(np.diff(b["gram"].to_numpy()) != 0) + 1
            weigh = np.cumsum([len(x) for x in b["body"]])
            at = 0
            if held and len(b) and held[-1]["gram"].iloc[-1] != b["gram"].iloc[0]:
                edge = np.concatenate(([0], edge))
            for e in edge.tolist():  # a gram ends here
                more = int(weigh[e - 1] - (weigh[at - 1] if at else 0)) if e else 0
                if size + more >= SHARD_BYTES:
                    held.append(b.iloc[at:e])
                    yield solve(pd.concat(held))
                    held, size, at = [], 0, e
            if at < len(b):
                held.append(b.iloc[at:])
                size += int(weigh[-1] - (weigh[at - 1] if at else 0))
        if held:
            yield solve(pd.concat(held))

    total = texts.agg(F.sum(F.col("size").cast("long")).alias("n")).first().n or 0
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(least, 200), min(MOST_TASKS, total // TASK_BYTES))
    return texts.repartition(tasks, "gram").sortWithinPartitions("gram", "ctx").mapInPandas(run, "gram bigint, ctx bigint, s array<int>, e array<int>")


def place_of_gram(body: bytes) -> int:
    """Where the gram that a context's windows share starts in it."""
    h = gram_hashes(np.frombuffer(body, np.uint8)[:WINDOW])
    low = np.uint64((1 << 24) - 1)
    return int(((h & ~low) | np.arange(len(h), dtype=np.uint64)).min() & low)


def halves(body: bytes, at: int, lo: int, hi: int) -> list[tuple[int, bytes, bytes, int, int, int]]:
    """(offset, name, body, place of the gram, least, most) of the two parts of a context by where a window holds its gram.

    ``at``: the gram's place; ``lo``, ``hi``: its least and largest place in the windows. The name is what all the
    windows of a part hold before or behind the gram.
    """
    mid = (lo + hi + 1) // 2
    out = []
    if at >= mid:  # windows that hold the gram at mid or later
        stop = min(len(body) - WINDOW, at - mid) + WINDOW
        out.append((0, b"<" + body[at - mid : at], body[:stop], at, mid, hi))
    start = max(0, at - mid + 1)
    if start + WINDOW <= len(body):
        behind = at + GRAM
        out.append((start, b">" + body[behind : behind + WINDOW - GRAM - mid + 1], body[start:], at - start, lo, mid - 1))
    return out


def divided(hot: DataFrame) -> DataFrame:
    """The parts of (gram, ctx, n, at, lo, hi, body) contexts; ``at`` is below 0 where the gram was not looked for yet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        for b in batches:
            for k in range(0, len(b), 1000):
                out = []
                for g, c, n, at, lo, hi, body in b.iloc[k : k + 1000][["gram", "ctx", "n", "at", "lo", "hi", "body"]].itertuples(index=False):
                    at = place_of_gram(body) if at < 0 else at
                    for off, name, part, place, a, z in halves(body, at, lo, hi):
                        sub = xxh3_64_intdigest(g.to_bytes(8, "little", signed=True) + name)
                        out.append((g, c, off, signed(sub), signed(xxh3_64_intdigest(part)), n, place, a, z, len(part), part))
                yield pd.DataFrame(out, columns=["gram", "ctx", "off", "sub", "subctx", "n", "at", "lo", "hi", "size", "body"])

    return hot.mapInPandas(run, "gram bigint, ctx bigint, off int, sub bigint, subctx bigint, n bigint, at int, lo int, hi int, size int, body binary")


def marks_in(bodies: DataFrame, parts: int, scratch: list[DataFrame]) -> DataFrame:
    """(gram, ctx, s, e) of distinct contexts (gram, ctx, n, kinds, at, lo, hi, size, body); ``kinds``: those of the gram."""
    found = sorted_marks(bodies.where(F.col("kinds") <= HOT))
    hot = bodies.where((F.col("kinds") > HOT) & (F.col("lo") < F.col("hi")))
    over = bodies.where((F.col("kinds") > HOT) & (F.col("lo") >= F.col("hi")) & (F.col("n") > 1))  # single windows
    found = found.unionByName(over.select("gram", "ctx", F.array(F.lit(0)).alias("s"), F.array("size").alias("e")))
    if hot.isEmpty():
        return found
    cut = written(divided(hot), "parts")
    scratch.append(cut)
    kinds = cut.groupBy("sub", "subctx").agg(F.sum("n").alias("n"), F.min(F.struct("gram", "ctx", "off")).alias("of"))
    count, least = F.count("*").alias("kinds"), F.min("n").alias("least")
    counted = with_totals(dealt(kinds, ["sub"], "subctx", parts), ["sub"], [count, least], [F.sum("kinds").alias("kinds"), F.min("least").alias("least")])
    alike = counted.where("least > 1").select("sub", "subctx", "of")
    wanted = counted.where("least = 1 AND kinds > 1").select("sub", "subctx", F.col("n").alias("_n"), "kinds", "of.gram", "of.ctx", "of.off")
    reps = cut.drop("sub", "subctx", "n").join(wanted, ["gram", "ctx", "off"]).select(F.col("sub").alias("gram"), F.col("subctx").alias("ctx"), F.col("_n").alias("n"), "kinds", "at", "lo", "hi", "size", "body")
    reps = written(reps, "bodies")
    scratch.append(reps)
    inner = marks_in(reps, parts, scratch)
    size = cut.groupBy("sub", "subctx").agg(F.min("size").alias("size"))
    inner = inner.select(F.col("gram").alias("sub"), F.col("ctx").alias("subctx"), "s", "e").unionByName(
        alike.join(size, ["sub", "subctx"]).select("sub", "subctx", F.array(F.lit(0)).alias("s"), F.array("size").alias("e"))
    )
    members = dealt(cut.select("gram", "ctx", "off", "sub", "subctx"), ["sub", "subctx"], "ctx", parts)
    back = with_found(members, inner, ["sub", "subctx"]).where("s IS NOT NULL")
    moved = back.select("gram", "ctx", F.transform("s", lambda x: x + F.col("off")).alias("s"), F.transform("e", lambda x: x + F.col("off")).alias("e"))
    return found.unionByName(moved)


def marks(rows: DataFrame) -> DataFrame:
    """(key, spans): the covered bytes of the rows of (key, text) that have any, as an array of (start, end)."""
    parts = parts_for(rows.count())
    moved = dealt(places(rows), ["gram"], "key", parts)
    count, low, high = F.count("*").alias("n"), F.min("ctx").alias("c1"), F.max("ctx").alias("c2")
    shared = with_totals(moved, ["gram"], [count, low, high], [F.sum("n").alias("n"), F.min("c1").alias("c1"), F.max("c2").alias("c2")], F.col("n") > 1)
    shared = written(shared.select("gram", "ctx", "key", "at", "size", F.expr("c1 <> c2").alias("several")), "places")
    several = shared.where("several").drop("several")
    kinds = several.groupBy("gram", "ctx").agg(F.min(F.struct("key", "at", "size")).alias("of"), F.count("*").alias("n"))
    count, least = F.count("*").alias("kinds"), F.min("n").alias("least")
    counted = with_totals(dealt(kinds, ["gram"], "ctx", parts), ["gram"], [count, least], [F.sum("kinds").alias("kinds"), F.min("least").alias("least")])
    sure = counted.where("least > 1").select("gram", "ctx", F.array(F.lit(0)).alias("s"), F.array("of.size").alias("e"))
    wanted = counted.where("least = 1").groupBy(F.col("of.key").alias("key")).agg(F.collect_list(F.struct("gram", "ctx", "n", "kinds", "of.at", "of.size")).alias("wants"))
    bodies = written(cut_out(rows.join(wanted, "key").select("text", "wants")), "bodies")
    scratch = [shared, bodies]
    found = marks_in(bodies, parts, scratch).unionByName(sure)
    spans = with_found(dealt(several, ["gram", "ctx"], "key", parts), found, ["gram", "ctx"]).select("key", "at", F.explode(F.arrays_zip("s", "e")).alias("x"))
    partly = spans.select("key", (F.col("at") + F.col("x.s")).alias("s"), (F.col("at") + F.col("x.e")).alias("e"))
    whole = shared.where("NOT several").select("key", F.col("at").alias("s"), (F.col("at") + F.col("size")).alias("e"))
    made = written(whole.unionByName(partly).groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    forget(*scratch)
    return made


def cut_out(wanted: DataFrame) -> DataFrame:
    """The contexts that (text, wants) rows ask for, with their bytes."""
    import pyarrow as pa

    names = ["gram", "ctx", "n", "kinds", "at", "size"]
    kinds = {"gram": pa.int64(), "ctx": pa.int64(), "n": pa.int64(), "kinds": pa.int64(), "size": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = b.column("wants").value_lengths().to_numpy()
            flat = b.column("wants").flatten()
            col = {n: flat.field(n).to_numpy() for n in names}
            at, stop = col["at"].tolist(), (col["at"] + col["size"]).tolist()
            begin, j, held, size = 0, 0, [], 0
            for text, k in zip(b.column("text"), many.tolist()):
                raw = text.as_py().encode("utf-8", "replace")
                held += [raw[at[i] : stop[i]] for i in range(j, j + k)]
                j += k
                size += len(raw)
                if size > 4 * PIECE:
                    yield batch(col, begin, j, held)
                    begin, held, size = j, [], 0
            if held:
                yield batch(col, begin, j, held)

    def batch(col: dict, i: int, j: int, held: list[bytes]) -> pa.RecordBatch:
        none = pa.array(np.full(j - i, -1, np.int32))
        lo, hi = pa.array(np.zeros(j - i, np.int32)), pa.array(np.full(j - i, WINDOW - GRAM, np.int32))
        return pa.RecordBatch.from_arrays(
            [*[pa.array(col[n][i:j], t) for n, t in kinds.items()], none, lo, hi, pa.array(held, pa.binary())], names=[*kinds, "at", "lo", "hi", "body"]
        )

    return wanted.mapInArrow(run, "gram bigint, ctx bigint, n bigint, kinds bigint, size int, at int, lo int, hi int, body binary")


def merged_spans(spans) -> list[tuple[int, int]]:
    """Sorted, apart from each other."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a unique ``key`` and ``spans`` (null: none)."""
    rows, _ = keyed(docs)
    return rows.join(marks(rows.select("key", whole_text().alias("text"))), "key", "left")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = deduplicated(table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, spans in zip(b["text"], b["spans"]):
                raw = text.encode("utf-8", "replace")
                cut = merged_spans(spans) if spans is not None else []
                left = kept_bytes(raw, cut)
                out.append((len(raw), len(raw) - len(left), len(cut), sha256(left).hexdigest()))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"]).assign(doc_id=b["doc_id"].astype("Int64").array)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInPandas(run, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, doc_id long").select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
