"""A quality classifier: naive Bayes support vectors over n-gram indicators.

Texts become sets of hashed n-grams of words, word shapes and bytes.
Indicators are scaled by their class log-count ratio and a linear hinge-loss
model is fitted on the scaled, normalised vectors by dual coordinate descent.  Fitting uses a bounded sample of labelled
documents; scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_batches

BITS = 20
N_FEATURES = 1 << BITS
#: Labelled documents that a fit takes at most, by hash of their id.
MAX_TRAIN = 5000
#: Words whose hashes a worker keeps.
CACHE_WORDS = 200_000
#: Letters, capitals and digits by their kind; everything else as it is.
SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
RUN = re.compile(rb"(.)\1+", re.DOTALL)
_MIX32 = np.uint32(0x9E3779B1)
_SHIFT = np.uint32(32 - BITS)


class Hasher:
    """Feature sets of texts; keeps the hashes of common words.

    N-grams are word unigrams and bigrams in lower case, unigrams and bigrams
    of word shapes (``Worth...`` is ``Aa.``), byte trigrams as written, and how
    often a word follows itself, by powers of two.
    """

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def _word(self, w: bytes) -> int:
        """32 bits of the word's hash, then 32 bits of its shape's."""
        both = xxhash.xxh32_intdigest(w.lower(), 7) << 32 | xxhash.xxh32_intdigest(RUN.sub(rb"\1", w.translate(SHAPE)), 8)
        if len(self.cache) < CACHE_WORDS and len(w) < 64:
            self.cache[w] = both
        return both

    def features(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct feature numbers of a text; none if empty."""
        if not text:
            return np.empty(0, np.uint32)
        get, word = self.cache.get, self._word
        both = np.array([get(w) or word(w) for w in text.split()], np.uint64)
        ids = np.concatenate((both >> np.uint64(32), both & np.uint64(0xFFFFFFFF))).astype(np.uint32)
        n = len(both)
        pairs = (ids[:-1] * _MIX32 + ids[1:])[np.arange(2 * n - 1) != n - 1] if n else ids
        same = int(np.count_nonzero(ids[: n - 1] == ids[1:n])) if n else 0
        raw = np.frombuffer(text, np.uint8).astype(np.uint32)
        tri = ((raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]) + np.uint32(1)
        repeats = np.arange(same.bit_length() + 1, dtype=np.uint32) + np.uint32(1 << 25)
        out = np.concatenate((ids, pairs, tri, repeats)) * _MIX32 >> _SHIFT
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


@dataclass(frozen=True)
class NbSvm:
    """``weight`` per feature (count ratio times hinge-loss weight), and the
    sigmoid that turns a margin into a score.
    """

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, f: np.ndarray) -> float:
        if not len(f):
            return self.bias
        norm = np.sqrt((self.ratio[f] ** 2).sum())
        return float(self.weight[f].sum() / norm) + self.bias if norm else self.bias

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.offset, -30, 30))))


def _ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, N_FEATURES), alpha, np.float64)
    for f, label in zip(rows, y, strict=True):
        counts[int(label), f] += 1
    p = counts / counts.sum(axis=1, keepdims=True)
    seen = counts.sum(axis=0) > 2 * alpha
    return np.where(seen, np.log(p[1] / p[0]), 0.0).astype(np.float32)


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss; classes weigh alike."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = {1.0: max(1, (y > 0).sum()), -1.0: max(1, (y <= 0).sum())}
    diag = np.array([0.5 / (c * len(y) / (2 * share[s])) for s in sign])
    xs = []
    for f in rows:
        v = ratio[f].astype(np.float64)
        n = np.sqrt((v**2).sum())
        xs.append(v / n if n else v)
    w, b, a = np.zeros(N_FEATURES), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, x = rows[i], xs[i]
            g = sign[i] * (w[f] @ x + b) - 1 + diag[i] * a[i]
            new = max(a[i] - g / (x @ x + 1 + diag[i]), 0.0)
            step = (new - a[i]) * sign[i]
            if step:
                w[f] += step * x
                b += step
                moved = max(moved, abs(step))
            a[i] = new
        if moved < 1e-3:
            break
    return w, b


def _sigmoid(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Platt's fit of P(label 1 | margin), by damped Newton steps."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta, x = np.array([1.0, np.log((n1 + 1) / (n0 + 1))]), np.column_stack((margins, np.ones(len(margins))))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t))
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0, epochs: int = 6, folds: int = 2, seed: int = 10) -> NbSvm:
    """Fit on feature sets and 0/1 labels.  The sigmoid is fitted on margins
    of left-out folds.  Without both labels every score is the smoothed share
    of label 1.
    """
    zero = np.zeros(N_FEATURES, np.float32)
    n1 = int((y > 0).sum())
    if not n1 or n1 == len(y):
        return NbSvm(zero, zero, 0.0, 0.0, float(np.log((n1 + 1) / (len(y) - n1 + 1))))

    def model(at: np.ndarray) -> NbSvm:
        ratio = _ratios([rows[i] for i in at], y[at])
        w, b = _descend([rows[i] for i in at], y[at], ratio, c, epochs, seed)
        return NbSvm(ratio, (w * ratio).astype(np.float32), b, 1.0, 0.0)

    fold, margins = np.arange(len(y)) % folds, np.zeros(len(y))
    if min(n1, len(y) - n1) >= folds:
        for k in range(folds):
            part = model(np.flatnonzero(fold != k))
            for i in np.flatnonzero(fold == k):
                margins[i] = part.margin(rows[i])
        whole = model(np.arange(len(y)))
    else:
        whole = model(np.arange(len(y)))
        margins[:] = [whole.margin(f) for f in rows]
    slope, offset = _sigmoid(margins, y)
    return NbSvm(whole.ratio, whole.weight, whole.bias, slope, offset)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", may_learn: Column | None = None, max_train: int = MAX_TRAIN) -> NbSvm:
    """Fit on at most ``max_train`` labelled documents, those with the least
    hash of their id; ``may_learn`` restricts the label rows.

    A document with several labels has their majority, 1 on a tie; null labels
    and ids count for nothing.  Only the sample's ids are broadcast, and only
    its feature sets reach the driver.
    """
    text_batches(docs.sparkSession)
    known = labels.where(quoted(label_col).isNotNull() & quoted(id_col).isNotNull())
    if may_learn is not None:
        known = known.where(may_learn)
    known = known.groupBy(quoted(id_col).alias("_id")).agg((F.avg(quoted(label_col)) >= 0.5).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)

    @F.pandas_udf("binary")
    def featured(texts: pd.Series) -> pd.Series:
        hasher = Hasher()
        return pd.Series([hasher.features(t).tobytes() for t in texts], dtype=object)

    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).cast("binary").alias("_text")).join(F.broadcast(sample), "_id")
    got = sorted(rows.select("_id", "_y", featured("_text").alias("f")).toLocalIterator(), key=lambda r: (r[0], r[2]))
    order = np.random.default_rng(1).permutation(len(got))
    return fit([np.frombuffer(got[i][2], np.uint32) for i in order], np.array([got[i][1] for i in order], np.int64))


def score_column(docs: DataFrame, model: NbSvm, text_col: str = "text") -> Column:
    """The score, 0 to 1, of each text; null and empty texts get the model's
    score for no features at all.
    """
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    hashers: list[Hasher] = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not hashers:
            hashers.append(Hasher())
        m, hasher = held.value, hashers[0]
        return pd.Series([m.score(hasher.features(t)) for t in texts], dtype="float64")

    return score(quoted(text_col).cast("binary"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """``docs`` whose score reaches ``threshold``; columns stay as they are.

    Null and empty texts stay if the score for no features reaches it.  Equal
    texts share one fate.  Without labels every score is 0.5; an empty frame
    stays empty.
    """
    model = train(docs, labels, **how)
    return docs.where(score_column(docs, model, how.get("text_col", "text")) >= threshold)
