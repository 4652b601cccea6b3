"""Regression trees with every cut tried: boosted ones, and forests.

A level of all open nodes is one pass: each feature's values are summed up by node and value, prefix sums over the sorted
values give both sides of every cut, and the best cut of a node has the largest fall of the squared error. Values lie in
ranges of bounded size, whose totals are added to the prefix sums, so no task sorts a whole feature. Among equal falls, as
single precision has them, the first feature and then the least cut is taken. A node ends where its targets are all equal,
no cut leaves enough rows on both sides, or the depth is reached. Rows go left where the value is at most the middle of the
two values that the cut parts.

A boosted model is a few nodes a tree, whatever the rows; it is an expression. A forest of unlimited depth grows with the
rows, so it is never gathered: the rows to predict run down the trees with those that grow them, without weight, and a node
of few rows is grown to its leaves in one task.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import settled

#: Distinct values of a feature that a range holds on average; rows of a node, of up to NARROW features, that one task of a
#: forest grows to its leaves; rows from which on boosted trees are grown by all tasks.
RANGE_VALUES, SMALL, NARROW, FEW = 50_000, 500_000, 8, 20_000
#: Rows of a node up to which all nodes of a level below it are cut together.
TOGETHER = 20_000
#: Trees that are added up in an expression before the residuals are settled.
SETTLE = 10


def with_ranges(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """``rows`` (x: array of features) with ``b``, the range of each feature's value, and how many ranges there are."""
    ranges = max(1, rows.count() // RANGE_VALUES)
    if ranges == 1:
        return rows.withColumn("b", F.array_repeat(F.lit(0), width)), 1
    cuts = _quantiles(rows, width, ranges)

    def place(i: int) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts[i]))]), lambda c: c < F.get("x", F.lit(i))))

    at = [place(i) for i in range(width)]
    return rows.withColumn("b", F.array(*at)), ranges


def _quantiles(rows: DataFrame, width: int, ranges: int) -> list[list[float]]:
    """Of each feature the values that part it into ``ranges``; a common value comes several times."""
    if ranges == 1:
        return [[] for _ in range(width)]
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), shares, 10 * ranges).alias(f"c{i}") for i in range(width)]).first()
    return [list(found[f"c{i}"]) for i in range(width)]


def best_cuts(rows: DataFrame, by: list[str], least: int, ranges: int, features: Column | None = None) -> DataFrame:
    """(by, feature, cut, n, s, n_left, s_left): the best cut of each node of rows (by, x, b, w, r), with the node's and its
    left side's weight and sum of targets; nodes without one are left out. Each side has ``least`` rows, whatever their
    weight. ``features``: an array of those to try."""
    rows = rows.where("w > 0").select(*by, "w", "r", "x", "b", *([features.alias("_f")] if features is not None else []))
    long = _by_feature(rows, [*by, "w", "r", *(["_f"] if features is not None else [])])
    if features is not None:
        long = long.where(F.array_contains("_f", F.col("feature")))
    return _best(long.repartition(*by, "feature", "b"), by, least, ranges)


def _by_feature(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each feature of each row: ``columns``, feature, its range b and its value v."""
    long = rows.select(*columns, F.posexplode(F.arrays_zip("x", "b")).alias("feature", "p"))
    return long.select(*columns, "feature", F.col("p.b").alias("b"), F.col("p.x").alias("v"))


def _best(long: DataFrame, by: list[str], least: int, ranges: int, few: bool = False) -> DataFrame:
    """``best_cuts`` of rows by feature, of which all of a node, a feature and a range are in one partition; ``few``: of a few
    nodes, so that their ranges' totals go to all tasks."""
    keys = [*by, "feature"]
    values = long.groupBy(*keys, "b", "v").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("m"), F.sum("w").alias("n"), F.sum(F.col("w") * F.col("r")).alias("s"))
    own = Window.partitionBy(*keys, "b").orderBy("v")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumn("next", F.lead("v").over(own)).withColumns({f"{c}l": F.sum(c).over(upto) for c in "mns"})
    if ranges == 1:
        every = Window.partitionBy(*keys, "b")
        placed = placed.withColumns({f"{c}a": F.sum(c).over(every) for c in "mns"} | {"lo": F.min("lo").over(every), "hi": F.max("hi").over(every)})
    else:
        totals = values.groupBy(*keys, "b").agg(*[F.sum(c).alias(f"{c}1") for c in "mns"], F.min("v").alias("v1"), F.min("lo").alias("lo1"), F.max("hi").alias("hi1"))
        order, whole = Window.partitionBy(*keys).orderBy("b"), Window.partitionBy(*keys)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        zero = lambda c: F.coalesce(c, F.lit(0))
        sums = [zero(F.sum(f"{c}1").over(before)).alias(f"{c}0") for c in "mns"] + [F.sum(f"{c}1").over(whole).alias(f"{c}a") for c in "mns"]
        totals = totals.select(*keys, "b", *sums, F.lead("v1").over(order).alias("v2"), F.min("lo1").over(whole).alias("lo"), F.max("hi1").over(whole).alias("hi"))
        placed = placed.drop("lo", "hi").join(F.broadcast(totals) if few else totals, [*keys, "b"]).withColumns({f"{c}l": F.col(f"{c}l") + F.col(f"{c}0") for c in "mns"}).withColumn("next", F.coalesce("next", "v2"))
    nr, sr = F.col("na") - F.col("nl"), F.col("sa") - F.col("sl")
    gap = F.col("sl") / F.col("nl") - sr / nr
    fall = (F.col("nl") * nr / F.col("na") * gap * gap).cast("float")
    mid = (F.col("v") + F.col("next")) / 2
    cut = F.when(mid < F.col("next"), mid).otherwise(F.col("v"))
    open_ = placed.where((F.col("lo") < F.col("hi")) & F.col("next").isNotNull() & (F.col("ml") >= least) & (F.col("ma") - F.col("ml") >= least))
    made = F.struct("feature", cut.alias("cut"), F.col("na").alias("n"), F.col("sa").alias("s"), F.col("nl").alias("n_left"), F.col("sl").alias("s_left"))
    return open_.groupBy(*by).agg(F.max_by(made, F.struct(fall, -F.col("feature"), -F.col("v"))).alias("c")).select(*by, "c.*")


@dataclass
class Boosted:
    """A start and trees as SQL texts over the array ``x``; their sum is the prediction."""

    start: float
    trees: list[str]

    def prediction(self, trees: list[str] | None = None) -> Column:
        """The nested sums of all trees: as a balanced text, so that no long chain has to be parsed."""
        texts = list(self.trees if trees is None else trees)
        while len(texts) > 1:
            texts = [f"({' + '.join(texts[i : i + 2])})" for i in range(0, len(texts), 2)]
        return F.lit(self.start) + (F.expr(texts[0]) if texts else F.lit(0.0))


def boosted(rows: DataFrame, width: int, trees: int = 120, rate: float = 0.05, depth: int = 2, least: int = 1, subsample: float = 1.0, seed: int = 23) -> Boosted:
    """Trees that each fit what the ones before leave, from the mean on; ``rows``: id, x (array), y, all without nulls.

    Each level of a tree is one pass over blocks of sorted rows, which gives its cuts, at most 2^depth. The blocks stay where
    they are: a block knows all features of its rows, so each level finds its nodes and residuals there and gives sums and
    a few dozen points only. A few rows are one node of few rows: one task grows all trees of them, by the same rule.
    """
    takes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), t, "id"), F.lit(1 << 30)) / float(1 << 30) < subsample) if subsample < 1 else F.lit(None).cast("array<boolean>")
    if rows.count() <= min(SMALL, FEW):
        found = rows.select("id", "x", F.col("y").cast("double").alias("y"), takes.alias("takes"), F.lit(0).alias("node")).groupBy("node").applyInPandas(lambda f: _boosted_small(f, trees, rate, depth, least), "tree int, start double, text string")
        texts = found.orderBy("tree").collect()  # one row a tree
        return Boosted(texts[0].start, [r.text for r in texts if r.text]) if texts else Boosted(0.0, [])
    start = rows.agg(F.avg(F.col("y").cast("double"))).first()[0]
    if start is None:
        return Boosted(0.0, [])
    made, pending = Boosted(float(start), []), []
    held = _blocks(rows.select("id", "x", (F.col("y").cast("double") - F.lit(float(start))).alias("r"), takes.alias("takes")), width)
    for t in range(trees):
        cuts: dict[int, dict] = {}
        for level in range(depth):
            new = _level(held, pending, cuts, level, rate, least, t)
            cuts |= new
            if not new:
                break
        if not cuts:
            break
        pending.append(cuts)
        made.trees.append(_text(cuts, 0, rate))
        if len(pending) == SETTLE and t + 1 < trees:
            before, held = held, held.map(partial(_less, pending=pending, rate=rate)).persist(StorageLevel.MEMORY_AND_DISK)
            held.count()
            before.unpersist()
            pending = []
    held.unpersist()
    return made


@dataclass
class Block:
    """Neighbours in the order of a feature: ``x`` (features by rows), residuals, and the trees that take each row, as bits.

    The blocks of a feature follow each other by ``place``; equal values may lie in several ones.
    """

    feature: int
    place: tuple[int, int]
    x: np.ndarray
    r: np.ndarray
    takes: np.ndarray | None

    def residuals(self, pending: list[dict[int, dict]], rate: float) -> np.ndarray:
        out = self.r
        for cuts in pending:
            out = out - _routed(cuts, self.x, lambda k, c: rate * c[1] / c[0])
        return out

    def nodes(self, cuts: dict[int, dict], level: int, tree: int) -> np.ndarray:
        """The node of a level that each row is in; -1 where its way ended before or the tree does not take it."""
        node = np.zeros(len(self.r), np.int64) + (_routed(cuts, self.x, lambda k, c: k if k >= 2**level - 1 else -1) if level else 0)
        return node if self.takes is None else np.where(self.takes[:, tree // 8] >> (7 - tree % 8) & 1, node, -1)


def _routed(cuts: dict[int, dict], x: np.ndarray, leaf, k: int = 0):
    """``leaf`` (node, (weight, sum)) of the end that each row comes to."""
    c = cuts[k]
    ends = ((2 * k + 1, c["n_left"], c["s_left"]), (2 * k + 2, c["n"] - c["n_left"], c["s"] - c["s_left"]))
    left, right = (_routed(cuts, x, leaf, e[0]) if e[0] in cuts else leaf(e[0], e[1:]) for e in ends)
    return np.where(x[c["feature"]] <= c["cut"], left, right)


def _blocks(rows: DataFrame, width: int) -> RDD:
    """The blocks of rows (id, x, r, takes), about RANGE_VALUES rows each, kept where they lie. The rows of a value that is
    several of a feature's quantiles are dealt in parts."""
    ranges = max(1, rows.count() // RANGE_VALUES)
    cuts = _quantiles(rows, width, ranges)

    def at(i: int) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts[i]))]), lambda c: c < F.get("x", F.lit(i)))) if cuts[i] else F.lit(0)

    def dealt(i: int) -> Column:
        part = F.lit(0)
        for v, many in Counter(cuts[i]).items():
            if many > 1:
                part = F.when(F.get("x", F.lit(i)) == F.lit(float(v)), 1 + F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")).otherwise(part)
        return part

    places = F.array(*[F.struct(F.lit(i).alias("feature"), at(i).alias("b"), dealt(i).alias("part")) for i in range(width)])
    long = rows.select("r", "takes", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(width)], F.explode(places).alias("p")).select("p.*", "r", "takes", *[f"x{i}" for i in range(width)])

    def block(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(f"x{key[0]}", kind="stable")
        x = np.ascontiguousarray(f[[f"x{i}" for i in range(width)]].to_numpy(float).T)
        takes = b"" if f["takes"].iloc[0] is None else np.packbits(np.stack(f["takes"].to_numpy()).astype(bool), axis=1).tobytes()
        return pd.DataFrame({"feature": [key[0]], "b": [key[1]], "part": [key[2]], "n": [len(f)], "x": [x.tobytes()], "r": [f["r"].to_numpy(float).tobytes()], "takes": [takes]})

    parts = max(1, ranges * width)
    made = long.repartition(parts, "feature", "b", "part").groupBy("feature", "b", "part").applyInPandas(block, "feature int, b int, part int, n int, x binary, r binary, takes binary")

    def opened(row) -> Block:
        return Block(row.feature, (row.b, row.part), np.frombuffer(row.x).reshape(width, row.n), np.frombuffer(row.r), np.frombuffer(row.takes, np.uint8).reshape(row.n, -1) if row.takes else None)

    held = made.rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
    held.count()
    return held


def _less(block: Block, pending: list[dict[int, dict]], rate: float) -> Block:
    return replace(block, r=block.residuals(pending, rate))


def _in_nodes(block: Block, pending: list[dict[int, dict]], cuts: dict[int, dict], level: int, rate: float, tree: int):
    """(node, values, residuals) of each node of a level that has rows of the block."""
    r, node, v = block.residuals(pending, rate), block.nodes(cuts, level, tree), block.x[block.feature]
    for k in range(2**level - 1, 2 ** (level + 1) - 1):
        here = node == k
        if here.any():
            yield (k, v, r) if here.all() else (k, v[here], r[here])


def _outermost(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Places that hold all corners of the points' convex hull; ``n`` rises. No corner lies on or between two others."""
    kept = []
    for side in (s, -s):
        at = np.arange(len(n))
        while len(at) > 2:
            x, y = n[at], side[at]
            above = (y[1:-1] - y[:-2]) * (x[2:] - x[:-2]) > (y[2:] - y[:-2]) * (x[1:-1] - x[:-2])
            if above.all():
                break
            at = at[np.concatenate([[True], above, [True]])]
        kept.append(at)
    return np.unique(np.concatenate(kept))


def _fall(nl, sl, na, sa):
    """The fall of the squared error, in single precision."""
    gap = sl / nl - (sa - sl) / (na - nl)
    return (nl * (na - nl) / na * gap * gap).astype(np.float32)


def _level(held: RDD, pending: list[dict[int, dict]], cuts: dict[int, dict], level: int, rate: float, least: int, tree: int) -> dict[int, dict]:
    """The best cut of each node of a level, as ``best_cuts`` has it.

    The fall is a convex function of a cut's left weight and sum, wherever a block's sums begin, so the largest one is at a
    corner of the hull of a block's points. Blocks give their corners, and all points that ``least`` may shut out; a block
    that holds the largest fall is looked at once more for the least cut among equal ones.
    """

    def corners(part: int, blocks):
        for block in blocks:
            for k, v, r in _in_nodes(block, pending, cuts, level, rate, tree):
                s, m = r.cumsum(), len(r)
                end = np.flatnonzero(v[1:] > v[:-1])  # the last row on the left
                free = end[(end + 1 >= least) & (m - end - 1 >= least)]
                outer = end[(end + 1 < least) | (m - end - 1 < least)]
                at = np.concatenate([free[_outermost(free.astype(float), s[free])], outer])
                yield part, block.feature, block.place, k, m, float(s[-1]), float(v[0]), float(v[-1]), float(r.min()), float(r.max()), at + 1, s[at]

    found: dict[int, dict[int, list]] = {}
    for f in held.mapPartitionsWithIndex(corners).collect():  # a few dozen points a block
        found.setdefault(f[3], {}).setdefault(f[1], []).append(f)
    best, again, parts = {}, {}, set()
    for k, by_feature in found.items():
        if not min(f[8] for fs in by_feature.values() for f in fs) < max(f[9] for fs in by_feature.values() for f in fs):
            continue
        falls = []
        for feature, fs in by_feature.items():
            fs.sort(key=lambda f: f[2])
            na, sa, n0, s0 = sum(f[4] for f in fs), sum(f[5] for f in fs), 0, 0.0
            for f, after in zip(fs, [*fs[1:], None]):
                nl, sl = n0 + f[10], s0 + f[11]
                fits = (nl >= least) & (na - nl >= least)
                if fits.any():
                    falls.append((_fall(nl[fits], sl[fits], na, sa).max(), feature, None, (f[0], (feature, f[2], k)), (n0, s0, na, sa)))
                n0, s0 = n0 + f[4], s0 + f[5]
                if after and after[6] > f[7] and n0 >= least and na - n0 >= least:
                    falls.append((_fall(*np.array([[n0], [s0]], float), na, sa)[0], feature, f[7], after[6], (n0, s0, na, sa)))
        if not falls:
            continue
        most = max(f[0] for f in falls)
        for _, feature, v, where, sums in (f for f in falls if f[0] == most):
            if v is None:
                parts.add(where[0])
                again[where[1]] = (*sums, most)
            else:
                best.setdefault(k, []).append((feature, v, where, *sums))

    def least_of(blocks):
        for block in blocks:
            if any((block.feature, block.place, k) in again for k in range(2**level - 1, 2 ** (level + 1) - 1)):
                for k, v, r in _in_nodes(block, pending, cuts, level, rate, tree):
                    if (one := again.get((block.feature, block.place, k))) is not None:
                        n0, s0, na, sa, most = one
                        end = np.flatnonzero(v[1:] > v[:-1])
                        end = end[(n0 + end + 1 >= least) & (na - n0 - end - 1 >= least)]
                        nl, sl = n0 + end + 1, s0 + r.cumsum()[end]
                        i = int((_fall(nl, sl, na, sa) == most).argmax())
                        yield k, (block.feature, float(v[end[i]]), float(v[end[i] + 1]), int(nl[i]), float(sl[i]), na, sa)

    for k, one in held.context.runJob(held, least_of, sorted(parts)) if parts else []:
        best.setdefault(k, []).append(one)
    made = {}
    for k, ones in best.items():
        feature, v, after, nl, sl, na, sa = min(ones)
        mid = (v + after) / 2
        made[k] = {"feature": feature, "cut": mid if mid < after else v, "n": float(na), "s": float(sa), "n_left": float(nl), "s_left": float(sl)}
    return made


def _laid_out(rows: DataFrame) -> DataFrame:
    """``rows`` kept where they lie: unlike a checkpoint, what is kept still tells how its rows are partitioned."""
    held = rows.persist()
    held.count()
    return held


def _goes(c: dict) -> str:
    return f"x[{c['feature']}] <= {float(c['cut'])!r}D"


def _text(cuts: dict[int, dict], node: int, rate: float) -> str:
    c = cuts[node]
    sides = ((2 * node + 1, c["n_left"], c["s_left"]), (2 * node + 2, c["n"] - c["n_left"], c["s"] - c["s_left"]))
    left, right = (_text(cuts, k, rate) if k in cuts else f"{rate * s / n!r}D" for k, n, s in sides)
    return f"(CASE WHEN {_goes(c)} THEN {left} ELSE {right} END)"


# The shares of rows that a sample of the rows' own size, with replacement, takes at most 0, 1, 2, ... times.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020)


def drawn(tree: Column, row: Column, seed: int) -> Column:
    """How often a tree's sample takes a row: as often as a large sample with replacement does, by a hash."""
    u = F.pmod(F.xxhash64(F.lit(seed), tree, row), F.lit(1 << 40)) / float(1 << 40)
    return sum((F.when(u >= p, 1.0).otherwise(0.0) for p in POISSON), F.lit(0.0))


def _cut(x: np.ndarray, y: np.ndarray, w: np.ndarray, heavy: np.ndarray, features: np.ndarray, least: int) -> dict | None:
    """The best cut of a node, as ``best_cuts`` has it; ``heavy``: for each of the features the node's rows with weight, in
    the feature's order."""
    v, m = x[heavy, features[:, None]], heavy.shape[1]
    n, s, left = w[heavy].cumsum(axis=1), (w[heavy] * y[heavy]).cumsum(axis=1), np.arange(1, m)
    fits = (v[:, 1:] > v[:, :-1]) & (left >= least) & (m - left >= least)
    if not fits.any():
        return None
    nl, sl, na, sa = n[:, :-1], s[:, :-1], n[:, -1:], s[:, -1:]
    gap = sl / nl - (sa - sl) / (na - nl)
    fall = np.where(fits, nl * (na - nl) / na * gap * gap, -1.0).astype(np.float32)
    f, k = np.unravel_index(int(fall.argmax()), fall.shape)
    mid = (v[f, k] + v[f, k + 1]) / 2
    return {"feature": int(features[f]), "cut": float(mid if mid < v[f, k + 1] else v[f, k]), "n": float(na[f, 0]), "s": float(sa[f, 0]), "n_left": float(nl[f, k]), "s_left": float(sl[f, k])}


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, least: int, depth: int | None, tried: int | None = None, seed: int = 0, fewest: int = 2) -> np.ndarray:
    """What the tree of the rows with weight gives for every row: all features stay sorted, a node takes its rows of each.
    A node of at most TOGETHER rows that tries all features is grown by levels of all its nodes at once."""
    out, width, side = np.full(len(y), np.nan), x.shape[1], np.zeros(len(y), bool)
    place_of = np.zeros(len(y), int)
    heavy, light = np.flatnonzero(w > 0), np.flatnonzero(~(w > 0))
    if not len(heavy):
        return out
    random, some_only = np.random.default_rng(seed), bool(tried and tried < width)
    open_ = [(heavy, light, heavy[np.argsort(x[heavy], axis=0, kind="stable").T], depth)]
    while open_:
        rows, run, order, left = open_.pop()
        if len(rows) <= TOGETHER and not some_only:
            place_of[rows] = np.arange(len(rows))
            out[rows], out[run] = _grown_together(x[rows], y[rows], w[rows], place_of[order], x[run], least, left, fewest)
            continue
        cut = None
        if len(rows) >= max(fewest, 2) and y[rows].max() > y[rows].min() and (left is None or left > 0):
            some = np.sort(random.choice(width, tried, replace=False)) if some_only else np.arange(width)
            cut = _cut(x, y, w, order[some], some, least)
        if cut is None:
            out[rows] = out[run] = (w[rows] * y[rows]).sum() / w[rows].sum()
            continue
        for part in (rows, run):  # the node's rows only
            side[part] = x[part, cut["feature"]] <= cut["cut"]
        on, after = side[order], None if left is None else left - 1
        open_.append((rows[side[rows]], run[side[run]], order[on].reshape(width, -1), after))
        open_.append((rows[~side[rows]], run[~side[run]], order[~on].reshape(width, -1), after))
    return out


def _grown_together(x: np.ndarray, y: np.ndarray, w: np.ndarray, order: np.ndarray, run: np.ndarray, least: int, depth: int | None, fewest: int) -> tuple[np.ndarray, np.ndarray]:
    """What a tree of few rows gives for them and for the rows ``run``, a level of all open nodes at once, as ``_cut`` cuts.

    A level's nodes lie one after another in each feature's order; nodes of like size are cut together, filled up to the
    largest, so each node's sums are made as if it were alone.
    """
    x, run, width = np.ascontiguousarray(x.T), np.ascontiguousarray(run.T), order.shape[0]
    out, ran = np.zeros(x.shape[1]), np.zeros(run.shape[1])
    going, at = np.arange(run.shape[1]), np.zeros(run.shape[1], int)  # rows that still run, and their nodes
    size, level = np.array([order.shape[1]]), 0
    while len(size):
        start = size.cumsum() - size
        own = order[0]
        means = np.add.reduceat(w[own] * y[own], start) / np.add.reduceat(w[own], start)
        open_ = (size >= max(fewest, 2)) & (np.maximum.reduceat(y[own], start) > np.minimum.reduceat(y[own], start)) & (depth is None or level < depth)
        feature, cut, many = np.full(len(size), -1), np.zeros(len(size)), np.zeros(len(size), int)
        kinds = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        for kind in np.unique(kinds[open_]):
            k = np.flatnonzero(open_ & (kinds == kind))
            place = np.arange(size[k].max())
            there = place < size[k][:, None]
            rows = order[:, start[k][:, None] + np.minimum(place, size[k][:, None] - 1)]
            v = x[np.arange(width)[:, None, None], rows]
            weight = np.where(there, w[rows], 0.0)
            n, s = weight.cumsum(axis=2), (weight * y[rows]).cumsum(axis=2)
            left = place[1:]
            fits = (v[:, :, 1:] > v[:, :, :-1]) & there[:, 1:] & (left >= least) & (size[k][:, None] - left >= least)
            nl, sl, na, sa = n[:, :, :-1], s[:, :, :-1], n[:, :, -1:], s[:, :, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gap = sl / nl - (sa - sl) / (na - nl)
                fall = np.where(fits, nl * (na - nl) / na * gap * gap, -1.0).astype(np.float32)
            i, j = fall.argmax(axis=2), np.arange(len(k))
            f = fall.max(axis=2).argmax(axis=0)
            i = i[f, j]
            some = fits[f, j, i]
            lo, hi = v[f, j, i], v[f, j, i + 1]
            mid = (lo + hi) / 2
            feature[k], cut[k], many[k] = np.where(some, f, -1), np.where(mid < hi, mid, lo), np.where(some, i + 1, 0)
        ends = feature < 0
        node = np.repeat(np.arange(len(size)), size)
        out[own[ends[node]]] = means[node[ends[node]]]
        done = ends[at]
        ran[going[done]] = means[at[done]]
        going, at = going[~done], at[~done]
        # the two sides of a node take its place in each order, in the order they had
        stays = ~ends[node]
        order, node = order[:, stays], node[stays]
        new = np.cumsum(~ends) - 1
        goes = np.zeros(x.shape[1], bool)
        goes[order[0]] = x[feature[node], order[0]] <= cut[node]
        at_left = run[feature[at], going] <= cut[at]
        at = 2 * new[at] + ~at_left
        node, left, all_ = new[node], many[~ends], size[~ends]
        first = all_.cumsum() - all_
        on = goes[order]
        before = on.cumsum(axis=1) - on  # rows to the left, of all nodes before too
        passed = left.cumsum() - left
        within = before - passed[node]
        to = np.where(on, first[node] + within, first[node] + left[node] + np.arange(order.shape[1]) - first[node] - within)
        moved = np.empty_like(order)
        np.put_along_axis(moved, to, order, axis=1)
        order, size, level = moved, np.column_stack([left, all_ - left]).ravel(), level + 1
    return out, ran


def _boosted_small(f: pd.DataFrame, trees: int, rate: float, depth: int, least: int) -> pd.DataFrame:
    """(tree, start, text) of the boosted trees of a few rows."""
    f = f.sort_values("id", kind="stable")
    x, r = np.stack(f["x"].to_numpy()).astype(float), f["y"].to_numpy(float)
    start, texts, width, one = r.mean(), [], x.shape[1], np.ones(len(r))
    r, order = r - start, np.argsort(x, axis=0, kind="stable").T
    for t in range(trees):
        taken = np.array([v[t] for v in f["takes"]], bool) if f["takes"].iloc[0] is not None else np.ones(len(r), bool)
        cuts, node, value = {}, np.zeros(len(r), int), np.zeros(len(r))
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                here = node == k
                live = r[here & taken]
                own = order[(here & taken)[order]].reshape(width, -1)
                if len(live) > 1 and live.max() > live.min() and (cut := _cut(x, r, one, own, np.arange(width), least)):
                    cuts[k] = cut
                    goes = x[:, cut["feature"]] <= cut["cut"]
                    left = cut["s_left"] / cut["n_left"], 2 * k + 1, goes
                    right = (cut["s"] - cut["s_left"]) / (cut["n"] - cut["n_left"]), 2 * k + 2, ~goes
                    for v, child, side in (left, right):
                        value[here & side], node[here & side] = v, child
        if not cuts:
            break
        texts.append(_text(cuts, 0, rate))
        r = r - rate * value
    return pd.DataFrame({"tree": range(max(1, len(texts))), "start": start, "text": texts or [""]})


def forest(train: DataFrame, test: DataFrame, width: int, trees: int = 160, depth: int | None = None, least: int = 2, tried: int | None = None, fewest: int = 2, seed: int = 19) -> DataFrame:
    """(id, prediction) of the rows of ``test`` (id, x): the mean over trees that each grew on a sample of ``train`` (id, x, y).

    ``tried``: features that a node tries, all if not given. A level's cuts stay a table and are joined to the rows.
    """
    grow, ranges = with_ranges(train.select("id", "x", F.col("y").cast("double").alias("r")), width)
    run = test.select("id", "x", F.lit(None).cast("double").alias("r"), F.array_repeat(F.lit(0), width).alias("b"), F.lit(True).alias("asked"))
    every = grow.withColumn("asked", F.lit(False)).select("id", "x", "r", "b", "asked").unionByName(run)
    planted = every.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    times = F.when(F.col("asked"), 0.0).otherwise(drawn(F.col("tree"), F.col("id"), seed))
    rows = planted.withColumn("w", times).where("asked OR w > 0").withColumn("node", F.lit("")).withColumn("left", F.lit(depth).cast("int"))
    done: list[DataFrame] = []
    most = max(1, SMALL * NARROW // max(NARROW, width))
    sizes = rows.groupBy("tree", "node").agg(F.count("*").alias("n"))
    while (largest := sizes.agg(F.max("n")).first()[0]) and largest > most:
        rows = settled(rows)
        state = rows.groupBy("tree", "node").agg(F.count("*").alias("rows"), F.count_if(F.col("w") > 0).alias("grow"), F.sum("w").alias("nw"), F.sum(F.col("w") * F.col("r")).alias("sw"), F.min(F.when(F.col("w") > 0, F.col("r"))).alias("lo"), F.max(F.when(F.col("w") > 0, F.col("r"))).alias("hi"))
        large = state.where(F.col("rows") > most)
        of = rows.join(large, ["tree", "node"])
        splits = of.where((F.col("grow") >= fewest) & (F.col("lo") < F.col("hi")) & (F.col("left").isNull() | (F.col("left") > 0)))
        some = None
        if tried and tried < width:
            by_hash = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda f: F.struct(F.xxhash64(F.lit(seed), "tree", "node", f).alias("h"), f.alias("f"))))
            some = F.transform(F.slice(by_hash, 1, tried), lambda s: s["f"])
        cuts = settled(best_cuts(splits, ["tree", "node"], least, ranges, some).select("tree", "node", "feature", "cut"))
        cut = of.join(cuts, ["tree", "node"], "left")
        done.append(settled(cut.where("cut IS NULL AND asked").select("tree", "id", F.try_divide("sw", "nw").alias("p"))))
        goes = F.when(F.get("x", F.col("feature")) <= F.col("cut"), "l").otherwise("r")
        on = cut.where("cut IS NOT NULL").select("id", "x", "r", "b", "asked", "tree", "w", F.concat("node", goes).alias("node"), (F.col("left") - 1).alias("left"))
        rest = rows.join(state.where(F.col("rows") <= most).select("tree", "node"), ["tree", "node"]).select("id", "x", "r", "b", "asked", "tree", "w", "node", "left")
        rows = settled(on.unionByName(rest))
        sizes = rows.groupBy("tree", "node").agg(F.count("*").alias("n"))

    def leaves(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable")
        left, asked = f["left"].iloc[0], f["asked"].to_numpy(bool)
        if not asked.any():
            return pd.DataFrame({"tree": [], "id": [], "p": []})
        key = sum(map(ord, f["node"].iloc[0])) + 1009 * int(f["tree"].iloc[0])
        p = grown(np.stack(f["x"].to_numpy()).astype(float), f["r"].fillna(0.0).to_numpy(float), f["w"].to_numpy(float), least, None if pd.isna(left) else int(left), tried, seed + key, fewest)
        return pd.DataFrame({"tree": f["tree"].to_numpy()[asked], "id": f["id"].to_numpy()[asked], "p": p[asked]})

    kind = dict(test.dtypes)["id"]
    small = rows.select("tree", "node", "id", "x", "r", "w", "asked", "left").groupBy("tree", "node").applyInPandas(leaves, f"tree int, id {kind}, p double")
    for d in done:
        small = small.unionByName(d)
    return small.groupBy("id").agg(F.avg("p").alias("prediction"))
