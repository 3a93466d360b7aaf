"""Quality classifier: Naive Bayes support vectors.

A document is the set of its n-grams: of bytes, of word shapes and of repeated words, hashed to a fixed
number of features. Each indicator is scaled by the
log-count ratio of the two classes, and a linear hinge-loss model is fitted on the scaled indicators by
dual coordinate descent. A logistic curve fitted on rows left out of the fit turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Batch, slices

#: Features in all: bytes' n-grams, then words'.
BYTE_FEATURES, WORD_FEATURES = 1 << 15, 1 << 13
FEATURES = BYTE_FEATURES + WORD_FEATURES
#: Labelled rows of each class that the fit reads at most, those of the smallest hashed doc_ids.
FIT_ROWS = 1500
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 punctuation, 6 beyond ASCII
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1], _KIND[128:] = 1, 2, 3, 6
_KIND[list(b"#*$%&|<>=+~^@\\_{}[]")], _KIND[list(b".,;:!?'\"()-")] = 4, 5


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each text in turn (null and empty texts: none)."""
    batch = Batch(texts)
    raw = batch.raw.astype(np.uint32)
    after = np.concatenate([raw, np.zeros(2, np.uint32)])
    bi = raw | after[1:-1] << 8
    tri = bi | after[2:] << 16
    with np.errstate(over="ignore"):
        tri = (tri * np.uint32(0x9E3779B1)) >> np.uint32(17)
        bi = (bi * np.uint32(0x85EBCA6B)) >> np.uint32(17)
    kind = _KIND[batch.raw]
    starts, ends, hashes = batch.word_starts, batch.word_ends, batch.word_hashes
    first, last = kind[starts] if len(starts) else starts, kind[ends - 1] if len(ends) else ends
    second = np.where(ends - starts > 1, kind[np.minimum(starts + 1, max(len(kind) - 1, 0))], 7) if len(starts) else starts
    shape = (first.astype(np.int64) * 8 + second) * 8 + last
    size = np.minimum(ends - starts, 31) >> 2
    shape = shape * 8 + size
    equal = np.zeros(len(hashes), np.int64)
    if len(hashes) > 2:
        equal[1:] += hashes[1:] == hashes[:-1]
        equal[2:] += 2 * (hashes[2:] == hashes[:-2])
    mark = np.zeros(FEATURES, bool)
    for i in range(batch.n):
        a, b = batch.offsets[i], batch.offsets[i + 1]
        u, v = batch.word_cuts[i], batch.word_cuts[i + 1]
        mark[tri[a : max(a, b - 2)]] = True
        mark[bi[a : max(a, b - 1)]] = True
        s, e = shape[u:v], equal[u:v]
        base = BYTE_FEATURES
        mark[base + s % 4096] = True
        if v - u > 2:
            mark[base + 4096 + ((s[:-1] >> 3) * 31 + (s[1:] >> 3) * 17) % 2048] = True
            e = e[2:]
            mark[base + 6144 + e] = True
            mark[base + 6148 + e[:-1] * 4 + e[1:]] = True
        found = np.flatnonzero(mark)
        mark[found] = False
        yield found


@dataclass
class Model:
    weights: np.ndarray  # already times the log-count ratios
    squares: np.ndarray  # of the ratios, for the length of a row
    bias: float
    slope: float
    intercept: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        w, s = self.weights, self.squares
        return np.array([w[f].sum() / np.sqrt(s[f].sum() + 1e-12) for f in features(texts)], np.float64) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.intercept, -30, 30)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, FEATURES), alpha)
    for row, label in zip(rows, y, strict=True):
        counts[int(label), row] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def hinge_fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss over ratio-scaled indicators and a bias."""
    sign = np.where(y > 0, 1.0, -1.0)
    scaled = [ratio[r] for r in rows]
    norms = [np.sqrt(v @ v) + 1e-12 for v in scaled]
    scaled = [v / n for v, n in zip(scaled, norms, strict=True)]
    weights, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    each = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y <= 0).sum())))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (weights[rows[i]] @ scaled[i] + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), each[i])  # the row's squared norm with its bias is 2
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                weights[rows[i]] += step * scaled[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights, bias


def fit(rows: list[np.ndarray], y: np.ndarray, log_odds: float) -> Model:
    """log_odds: of label 1 over all labelled rows; the fit itself is balanced."""
    y = np.asarray(y)
    if not len(rows) or len(set(y.tolist())) < 2:  # one class or none to learn from
        share = float(np.clip(log_odds, -8, 8))
        return Model(np.zeros(FEATURES), np.ones(FEATURES), 0.0, 0.0, share)
    ratio = log_count_ratio(rows, y)
    fold = np.arange(len(rows)) % 3 == 0
    margins = np.zeros(len(rows))
    for left in (fold, ~fold):
        if len(set(y[~left].tolist())) < 2:
            left = np.zeros(len(rows), bool)
        some = [r for r, out in zip(rows, left, strict=True) if not out]
        inner = log_count_ratio(some, y[~left])
        w, b = hinge_fit(some, y[~left], inner, rounds=10)
        w = w * inner
        for i in np.flatnonzero(left):
            margins[i] = w[rows[i]].sum() / np.sqrt((inner[rows[i]] ** 2).sum() + 1e-12) + b
    weights, bias = hinge_fit(rows, y, ratio)
    slope, intercept = logistic(margins, y)
    return Model(weights * ratio, ratio**2, bias, slope, intercept + log_odds)


def logistic(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's curve by Newton's method, classes weighted equally, targets drawn in a little."""
    pos, neg = max(1, int((y > 0).sum())), max(1, int((y <= 0).sum()))
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    each = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = each * (p - target)
        h = each * p * (1 - p) + 1e-9 * each
        ga, gb = g @ margins + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (h * margins) @ margins + 1e-3, h @ margins, h.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Only text enters a score. Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0;
    of a doc_id with several labels the smallest counts, and labels other than 0 and 1 don't. The fit
    reads at most fit_rows rows a class; the classes' shares are counted over all labelled rows. Null
    text is empty; null doc_ids are held out; without labels of both classes every score is the share
    of label 1, drawn in. Repeated rows get a row each; an empty table gives none.
    """
    plain = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.selectExpr("cast(doc_id as long) doc_id", "cast(quality as int) quality").where("doc_id is not null and quality in (0, 1)")
    known = known.where(remainder != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    some = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for q in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * fit_rows rows of 12 bytes

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(2)):
                rows = [f.astype("<i4").tobytes() for f in features(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(rows, pa.binary())], names=["doc_id", "quality", "features"])

    training = plain.join(chosen, "doc_id").select("doc_id", "quality", "text").mapInArrow(read, "doc_id long, quality int, features binary")
    seen = {r["doc_id"]: r for r in training.dropDuplicates(["doc_id"]).collect()}
    rows = [seen[k] for k in sorted(seen)]
    model = fit([np.frombuffer(r["features"], "<i4") for r in rows], np.array([r["quality"] for r in rows]), float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                scores = shared.value.scores(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = plain.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
