"""Toxicity by maximum-scoring segments.

A token's weight is the log-odds of its document share in toxic against other labelled texts, with an informative
Dirichlet prior from both; only weights that stand out by their likelihood ratio count. A token without one scores a small
negative drift, so a passage must hold enough toxic tokens close together. One linear scan finds all maximal-scoring
segments of a text. Their scores are calibrated by an extreme-value law for the best segment of clean texts of a given
length, and a logistic function of the summed significance gives the score. The law is fitted by maximum likelihood; a
clean text without a segment says that its best score is below the least that a segment can have.

The weights and the calibration are fitted on disjoint parts, two thirds and one third, of at most about ``FIT_ROWS``
labelled rows, which bounds the tokens of the model as well; what a text scores depends on nothing but its words.

Edge cases: a null or empty text has no segment and gets the score of one; rows without a label teach nothing; without any
usable label all scores are the share of toxic labels, 0.5 without labels; repeated rows are scored each; very long texts
are scanned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text

#: Labelled rows that the fit uses at most, about.
FIT_ROWS = 24_000
PRIOR, LEAST_DOCS, DRIFT, TOP = 30.0, 4, 0.1, 8.0
#: A weight needs this log-likelihood ratio (chance gives it to one token in a million) and this size.
LEAST_G, LEAST_DELTA = 26.0, 1.0
EDGE = ".,;:!?\"'()[]{}<>*$%&#@-_/\\|~`=+"
STEMS = (5, 4)


def tokens(text: str) -> list[str]:
    return [w.strip(EDGE) for w in text.lower().split()]


def stems(w: str) -> list[str]:
    """A longer word's beginnings, which stand in for words that the labels do not show often enough."""
    return [f"{w[:n]}~" for n in STEMS if len(w) > n]


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = 0.0

    def scores(self, text: str) -> list[tuple[int, float]]:
        """(position, score) of the tokens that do not score the drift, the last one followed by the length."""
        get, at = self.weight.get, []
        words = tokens(text)
        for i, w in enumerate(words):
            s = get(w)
            if s is None and len(w) > STEMS[-1]:
                s = get(w[: STEMS[0]] + "~")
                if s is None:
                    s = get(w[: STEMS[1]] + "~")
            if s is not None:
                at.append((i, s))
        at.append((len(words), 0.0))
        return at

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """All maximal-scoring segments (first, last token, score) in linear time, and the number of tokens."""
        found, n = self.scores(text)[:-1], 0
        n = len(text.split())
        stack: list[list[float]] = []  # first, last, sum before, sum behind, place of the last one with a smaller sum before
        total, upto = 0.0, 0
        for i, s in found:
            total -= DRIFT * (i - upto)
            upto = i + 1
            before, total = total, total + s
            if s <= 0:
                continue
            first, k = i, len(stack)
            one = [first, i, before, total]
            while True:
                j = k - 1
                while j >= 0 and stack[j][2] >= one[2]:
                    j = int(stack[j][4])
                if j < 0 or stack[j][3] >= one[3]:
                    one.append(j)
                    del stack[k:]
                    stack.append(one)
                    break
                one, k = [stack[j][0], one[1], stack[j][2], one[3]], j
        return [(int(a), int(b), hi - lo) for a, b, lo, hi, _ in stack], n

    def significance(self, text: str) -> float:
        """The summed negative logs of the segments' expected numbers in a clean text of this length, above 0 each."""
        segments, n = self.segments(text)
        base = self.log_k + log(max(n, 1))
        return sum(max(0.0, self.lam * s - base) for _, _, s in segments)

    def score(self, text: str) -> float:
        z = self.offset + self.slope * log(1.0 + self.significance(text))
        return 1.0 / (1.0 + exp(-max(-700.0, min(700.0, z))))


def fit_weights(counts: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """Weights of tokens from the numbers of toxic and other texts that hold them."""
    weight, n = {}, n1 + n0
    for w, y1, y0 in counts:
        y = y1 + y0
        g = 2 * ((y1 * log(y1 * n / (y * n1)) if y1 else 0.0) + (y0 * log(y0 * n / (y * n0)) if y0 else 0.0))
        a = PRIOR * y / n
        p1, p0 = (y1 + a) / (n1 + PRIOR), (y0 + a) / (n0 + PRIOR)
        delta = log(p1 / (1 - p1 + 1e-9)) - log(p0 / (1 - p0 + 1e-9))
        if g >= LEAST_G and abs(delta) >= LEAST_DELTA:
            weight[w] = max(-TOP, min(TOP, delta)) - DRIFT
    return weight


def fit_calibration(model: Model, best: np.ndarray, length: np.ndarray, toxic: np.ndarray) -> None:
    """The extreme-value law of clean texts' best segments: the expected number of segments of score s or more in a text
    of n tokens is exp(log_k - lam * s) * n.

    ``best`` is 0 where a text has no segment. For each lam the likeliest k is known, so one number is searched for.
    """
    clean = toxic == 0
    least = min((w for w in model.weight.values() if w > 0), default=1.0)
    seen, log_n = best[clean] > 0, np.log(np.maximum(length[clean], 1))
    score, m = np.where(seen, best[clean], least), max(float(seen.sum()), 0.5)

    def log_total(lam: float) -> float:
        x = log_n - lam * score
        return float(x.max() + np.log(np.exp(x - x.max()).sum())) if len(x) else 0.0

    lams = np.geomspace(0.02, 20.0, 400)
    likely = [m * np.log(lam) - m * log_total(lam) - lam * float(score[seen].sum()) for lam in lams]
    model.lam = float(lams[int(np.argmax(likely))]) if seen.any() else 1.0
    model.log_k = float(np.log(m) - log_total(model.lam)) if clean.any() else 0.0


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a weak penalty; a step that does not lessen the loss is halved, so that classes
    that do not overlap, whatever their order, end at the one least loss."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w, penalty = np.zeros(2), np.diag([1e-3, 1e-3])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0.0, z).sum() - y @ z + w @ penalty @ w / 2)

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        h = (a * (p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(h, a.T @ (y - p) - penalty @ w)
        while loss(w + step) > now and np.abs(step).max() >= 1e-8:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        w = w + step
        now = loss(w)
    return float(w[0]), float(w[1])


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of (doc_id, text) and (doc_id, toxic) rows; at most about ``fit_rows`` of the labels are used."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n1")).first()
    share = (total.n1 + 0.5) / (total.n + 1)
    flat = Model(offset=log(share / (1 - share)))
    if not total.n1 or total.n1 == total.n:
        return flat
    part = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20))
    kept = known.where(part < int(min(1.0, fit_rows / total.n) * (1 << 20)) + 1)
    half = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(3))
    sample = docs.join(F.broadcast(kept), "doc_id").select(whole_text().alias("text"), "toxic", F.least(half, F.lit(1)).alias("half"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = (Counter(), Counter()), [0, 0]
        for b in batches:
            for t, y in zip(b["text"].tolist(), b["toxic"].tolist()):
                words = set(tokens(t))
                words |= {b for w in words for b in stems(w)}
                words.discard("")
                seen[y].update(words)
                n[y] += 1
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield _counted(seen, n)
                seen, n = (Counter(), Counter()), [0, 0]
        yield _counted(seen, n)

    counted = sample.where("half = 1").select("text", "toxic").mapInPandas(count, "w string, y1 long, y0 long").groupBy("w").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    size = counted.where("w = ''").first()
    if size is None or not size.y1 or not size.y0:
        return flat
    y1, y0, n1, n0 = F.col("y1"), F.col("y0"), size.y1, size.y0
    part_g = lambda y, n: F.when(y > 0, y * F.log(y * (n1 + n0) / ((y1 + y0) * n))).otherwise(0.0)
    g = 2 * (part_g(y1, n1) + part_g(y0, n0))
    odd = counted.where(f"y1 + y0 >= {LEAST_DOCS} AND w <> ''").withColumn("g", g).where(F.col("g") >= LEAST_G)
    rows = odd.select("w", "y1", "y0").collect()  # at most the tokens that LEAST_DOCS of the fit's rows hold
    model = Model(fit_weights([(r.w, r.y1, r.y0) for r in rows], size.y1, size.y0))

    rest = sample.where("half = 0").select("text", "toxic")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [model.segments(t) for t in b["text"].tolist()]
            yield pd.DataFrame({"toxic": b["toxic"], "n": [n for _, n in got], "s": [max((x[2] for x in s), default=0.0) for s, _ in got]})

    seen = rest.mapInPandas(best, "toxic int, n int, s double").collect()  # three numbers a row of the fit's third
    toxic, length = np.array([r.toxic for r in seen]), np.array([r.n for r in seen], float)
    if not toxic.any() or toxic.all():
        return flat
    fit_calibration(model, np.array([r.s for r in seen]), length, toxic)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "x": [log(1.0 + model.significance(t)) for t in b["text"].tolist()]})

    pairs = rest.mapInPandas(summed, "toxic int, x double").collect()
    model.slope, model.offset = fit_logistic(np.array([r.x for r in pairs]), np.array([float(r.toxic) for r in pairs]))
    return model


def _counted(seen: tuple[Counter, Counter], n: list[int]) -> pd.DataFrame:
    """The counts of both classes; the numbers of texts stand under the empty token."""
    words = list({*seen[0], *seen[1]})
    return pd.DataFrame({"w": [*words, ""], "y1": [*(seen[1][w] for w in words), n[1]], "y0": [*(seen[0][w] for w in words), n[0]]})


def with_score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series([m.score(t) for t in texts], dtype=float)

    return docs.withColumn("score", score(whole_text(text_col)))


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    return with_score(docs, fitted(docs, labels)).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op3_toxicity": op3_toxicity}
