"""Quality rules: gradient-boosted trees over document statistics.

The statistics of every whole text are taken once.  Trees are grown on a bounded sample of labelled documents (logistic
loss, histogram splits), with monotonic constraints: more symbols, repeated lines or repeated passages never raise a
score.  The trees become flat numpy node arrays, and scoring walks all documents of a batch down all trees at once.

Defined results: a null or empty text has no words and fails the base rule; a text of any length is read whole;
repeated rows are scored each; labels that are null or belong to no document are not used, nor are those of an id whose
labels contradict each other; of texts that share an id the one of the least statistics is learned from; documents that
tie in a tree fall to the left; without labels of both kinds the trees are empty and the base rule alone decides; an
empty table gives an empty one; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, utf8

SAMPLE = 6000  # labelled documents that trees are grown on, at most
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 3, 0.15, 32, 20, 1.0
KEEP = 0.35  # least score that stays: a good document that is dropped is lost, so odds of about two to one must speak against it

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Model features and the sign of what they may do to the score (0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "upper_share": 0, "digit_share": 0, "punct_share": 0, "mark_share": 0, "mean_line": 0, "long_word": 0, "stop_share": 0,
}

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT, _MARK, _SYMBOL = b".,;:", b"!?=/\\@_|\"()[]{}", b"#*$%&|<>"


def _drop(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that stand in a window of ``size`` words that is found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(set(windows)) == n:
        return 0
    times = Counter(windows)
    inside = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i, w in enumerate(windows) if times[w] > 1])
    np.add.at(inside, at, 1)
    np.add.at(inside, at + size, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    again = 0
    for line in data.split(b"\n"):
        if line in seen:
            again += 1
        elif line.split(None, 1):
            seen.add(line)
    return again


def statistics(text: str | None) -> list[float]:
    """COUNTS and then FEATURES."""
    data = utf8(text)
    words = data.split()  # bytes split at the six ASCII white-space signs
    n, total = len(words), len(data)
    chars = sum(map(len, words))
    points = len(text or "") - (total - chars)
    symbols, dup, rep = _drop(data, _SYMBOL), duplicate_lines(data), repeated_words(words)
    lines = data.count(b"\n") + 1
    of = lambda x, y: x / y if y else 0.0
    features = [
        np.log1p(n), of(points, n), of(symbols, points), of(dup, lines), of(rep, n), of(len(set(words)), n), of(_drop(data, _UPPER), chars), of(_drop(data, _DIGIT), chars),
        of(_drop(data, _PUNCT), n), of(_drop(data, _MARK), n), of(n, lines), max(map(len, words), default=0), of(sum(len(w) <= 3 for w in words), n),
    ]
    return [n, points, symbols, dup, rep, *features]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([statistics(t) for t in b["text"]], dtype=np.float64).reshape(-1, len(COUNTS) + len(FEATURES))
            out = {"doc_id": b["doc_id"]} | {c: x[:, k].astype(np.int64) for k, c in enumerate(COUNTS)}
            yield pd.DataFrame(out | {c: x[:, k + len(COUNTS)] for k, c in enumerate(FEATURES)})

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


class Trees:
    """Boosted trees as flat arrays: node k tests feature[k] <= threshold[k]; a leaf's children are itself."""

    def __init__(self) -> None:
        self.base = 0.0
        self.roots: list[int] = []
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def _node(self, value: float) -> int:
        k = len(self.value)
        for column, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, k), (self.right, k), (self.value, value)):
            column.append(x)
        return k

    def flat(self) -> "Trees":
        self.feature, self.left, self.right = (np.array(x, np.int64) for x in (self.feature, self.left, self.right))
        self.threshold, self.value, self.roots = np.array(self.threshold), np.array(self.value), np.array(self.roots, np.int64)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality of each row."""
        if not len(self.roots):
            return np.ones(len(x))
        at = np.repeat(self.roots[None], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))

    def grow(self, x: np.ndarray, y: np.ndarray, signs: list[int]) -> "Trees":
        if len(set(y.tolist())) < 2:
            return self.flat()
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            root = self._node(0.0)
            self.roots.append(root)
            self._split(root, np.arange(len(y)), grad, hess, binned, cuts, signs, DEPTH, -np.inf, np.inf, score)
        return self.flat()

    def _split(self, node, rows, grad, hess, binned, cuts, signs, depth, low, high, score) -> None:
        value = lambda g, h: np.clip(g / (h + RIDGE), low, high)
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if depth and len(rows) >= 2 * LEAST_ROWS:
            for f, sign in enumerate(signs):
                bins = binned[f, rows]
                m = len(cuts[f]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(bins, w, m))[:-1] for w in (grad[rows], hess[rows], None))
                vl, vr = value(gl, hl), value(g - gl, h - hl)
                gain = gl * vl + (g - gl) * vr - 0.5 * ((hl + RIDGE) * vl**2 + (h - hl + RIDGE) * vr**2) - (g * value(g, h) - 0.5 * (h + RIDGE) * value(g, h) ** 2)
                gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS) | (sign * (vr - vl) < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (f, k, vl[k], vr[k]))
        if best[1] is None:
            self.value[node] = RATE * float(value(g, h))
            score[rows] += self.value[node]
            return
        f, k, vl, vr = best[1]
        left, right = self._node(0.0), self._node(0.0)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = f, float(cuts[f][k]), left, right
        middle = (vl + vr) / 2
        ranges = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[f]]
        for child, part, (lo, hi) in ((left, rows[binned[f, rows] <= k], ranges[0]), (right, rows[binned[f, rows] > k], ranges[1])):
            self._split(child, part, grad, hess, binned, cuts, signs, depth - 1, lo, hi, score)


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> Trees:
    """Trees from at most ``sample`` labelled documents, chosen by a hash of their ids."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).where("y = _y").drop("_y")
    share = 2.0 * sample / max(1, known.count())
    place = F.pmod(F.xxhash64(F.lit("labels"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    some = known.where(place < share).orderBy(place, "doc_id").limit(sample)  # few rows reach the sort, whatever the table's size
    each = stats.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min(F.struct(*FEATURES)).alias("x"))
    rows = each.orderBy("doc_id").select("y", "x.*").toPandas()  # ``sample`` rows at most
    return Trees().grow(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float), list(FEATURES.values()))


def quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, score of every row."""
    stats = materialize(document_statistics(docs, id_col, text_col))
    trees = train(stats, labels, sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["doc_id", *COUNTS]].copy()
            out["score"] = trees.scores(b[list(FEATURES)].to_numpy(float))
            yield out

    scored = stats.mapInPandas(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= keep))
