"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else becomes a gap, and the 1- to 3-grams of a whole text are hashed to BUCKETS
features.  Document frequencies are counted over all documents that may be learned from.  The weights are trained with
follow-the-regularised-leader and elastic-net penalties (so most stay zero) on a bounded sample, the same number of
documents for each language at most, and SAMPLE in all; a part of the sample that is not trained on then gives the
temperature that calibrates the scores.  Rows are sampled by id, text and place, and no more than half again as many reach the driver.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if nothing can be learned
from; texts of any length are read whole; languages that tie go to the one that comes first by name; repeated rows are
learned from and predicted each; a label of any name is learned, whatever their number; an empty table gives an empty one;
columns other than id, text and label are not read, and those of a filtered table stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, located, with_row_key

BUCKETS = 1 << 15
PER_LANGUAGE = 500  # documents of a language that the weights are trained on, about
SAMPLE = 50_000  # documents that they are trained on, about: with over a hundred languages, fewer of each
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 2e-3, 1e-4, 3
FEATURES = 30_000_000  # n-grams of all of them: the most frequent ones of each, beside 200 at least
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Of each code point: its lower case, or 0 if it is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(features, counts) of a text, or None if it has no letter."""
    if not text:
        return None
    code = _classes()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    if not code.any():
        return None
    code = np.concatenate([[0], code, [0]]).astype(np.uint64)
    gap = code == 0
    code = code[~(gap & np.concatenate([[False], gap[:-1]]))]  # runs of gaps are one
    a, b, c = code, code[1:], code[2:]
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)
    one, two = mix(a + np.uint64(1)), mix((a[:-1] << np.uint64(21)) + b + np.uint64(2))
    three = mix(((a[:-2] << np.uint64(42)) ^ (b[:-1] << np.uint64(21))) + c + np.uint64(3))
    n = np.bincount(np.concatenate([one, two, three]), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at.astype(np.int32), n[at]


def _vector(counted: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counted
    x = (1 + np.log(n)) * idf[at]
    return at, x / max(1e-9, np.sqrt((x * x).sum()))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each feature stands, and how many texts have a letter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            for t in b["text"]:
                if (x := ngram_counts(t)) is not None:
                    df[x[0]] += 1
                    n += 1
        df[BUCKETS] = n
        at = np.flatnonzero(df)
        yield pd.DataFrame({"feature": at, "n": df[at]})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    df = np.zeros(BUCKETS + 1, np.int64)
    df[rows["feature"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return df[:BUCKETS], int(df[BUCKETS])


class Model:
    """Languages, weights (features, languages), idf and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf, self.temperature = languages, idf.astype(np.float32), 1.0
        self.weights = np.zeros((BUCKETS, len(languages)), np.float32)

    def train(self, xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, seed: int = 5) -> None:
        """FTRL-proximal: per-weight learning rates, L1 for sparsity, L2 for size."""
        k = len(self.languages)
        z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
        rng = np.random.default_rng(seed)

        def weights(at):
            zz = z[at]
            return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

        for _ in range(EPOCHS):
            for i in rng.permutation(len(xs)):
                at, x = xs[i]
                w = weights(at)
                s = x @ w
                p = np.exp(s - s.max())
                p /= p.sum()
                p[ys[i]] -= 1
                g = x[:, None] * p[None]
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - sigma * w
                n[at] += g * g
        self.weights = weights(slice(None)).astype(np.float32)

    def calibrate(self, xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray) -> None:
        """The temperature of least loss on documents that were not trained on, by golden section over its logarithm."""
        if not xs:
            return
        s = np.array([x @ self.weights[at] for at, x in xs], np.float64)

        def loss(log_t: float) -> float:
            v = s / np.exp(log_t)
            v = v - v.max(axis=1, keepdims=True)
            return float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(ys)), ys]).mean())

        lo, hi, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = hi - r * (hi - lo), lo + r * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        self.temperature = float(np.exp((lo + hi) / 2))

    def predict(self, text: str | None) -> tuple[str, float]:
        counted = ngram_counts(text)
        if counted is None or not self.languages:
            return UNKNOWN, 0.0
        at, x = _vector(counted, self.idf)
        s = (x @ self.weights[at]) / self.temperature
        p = np.exp(s - s.max())
        return self.languages[int(s.argmax())], float(min(1.0, p.max() / p.sum()))


def _frequent(counted: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams of a training text; all of them where they are not too many."""
    at, n = counted
    if len(at) <= most:
        return counted
    chosen = np.sort(np.argsort(-n, kind="stable")[:most])
    return at[chosen], n[chosen]


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, id_col: str = "doc_id") -> Model:
    """Learn from the labelled rows of ``docs``."""
    rows = with_row_key(located(docs), id=F.col(id_col), text=F.col(text_col), label=F.col(label_col).cast("string")).where("label is not null")
    df, n = document_frequencies(rows)
    idf = np.log((n + 1) / (df + 1)) + 1
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # every label is learned
    model = Model(sorted(sizes), idf)
    if not sizes:
        return model
    # a share of each language by a hash of id, text and place, so that about per_language rows come, whatever the table's size and
    # however its rows repeat
    each = min(per_language, SAMPLE / len(sizes))
    share = F.create_map(*(x for k in model.languages for x in (F.lit(k), F.lit(min(1.0, 1.25 * each / sizes[k])))))
    place = F.pmod(F.xxhash64(F.lit("langid"), "id", "text", *ROW), F.lit(1_000_000)) / 1_000_000
    limit = int(1.5 * each * len(sizes)) + 1
    most = max(200, FEATURES // limit)
    some = rows.where(place < F.element_at(share, F.col("label"))).select("label", "text", place.alias("place"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(t, p, ngram_counts(x)) for t, p, x in zip(b["label"], b["place"], b["text"], strict=True)]
            got = [(t, p, _frequent(x, most)) for t, p, x in got if x is not None]
            yield pd.DataFrame({"label": [t for t, _, _ in got], "place": [p for _, p, _ in got], "at": [x[0] for _, _, x in got], "n": [x[1].astype(np.int32) for _, _, x in got]})

    made = some.mapInPandas(run, "label string, place double, at array<int>, n array<int>")
    sample = made.orderBy("place", "label", "at").limit(limit).toPandas()  # ``limit`` rows of ``most`` numbers at most
    order = sorted(range(len(sample)), key=lambda i: (sample["label"][i], bytes(np.asarray(sample["at"][i], np.int32)), bytes(np.asarray(sample["n"][i], np.int32))))
    number = {t: k for k, t in enumerate(model.languages)}
    xs = [_vector((np.asarray(sample["at"][i]), np.asarray(sample["n"][i])), idf) for i in order]
    ys = np.array([number[sample["label"][i]] for i in order], np.int64)
    aside = np.arange(len(ys)) % 5 == 4
    model.train([x for x, a in zip(xs, aside, strict=True) if not a], ys[~aside])
    model.calibrate([x for x, a in zip(xs, aside, strict=True) if a], ys[aside])
    return model


def predicted(model: Model, text: Column, spark: SparkSession) -> Column:
    """A struct of lang_pred and score."""
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights per language, whatever the data

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        out = [shared.value.predict(t) for t in texts]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return label(text)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that are not held out."""
    model = fit(docs.where(~held_out(id_col)), text_col, label_col, per_language, id_col)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), predicted(model, F.col(text_col), docs.sparkSession).alias("is"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "is.lang_pred", "is.score")


def keep_known(docs: DataFrame, least_score: float = 0.5, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``docs`` without texts that are in no known language, or whose language is not clear."""
    model = fit(docs.where(~held_out(id_col)), text_col, label_col, per_language, id_col)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), predicted(model, F.col(text_col), docs.sparkSession).alias("is"))
    return whole.where((F.col("is.lang_pred") != UNKNOWN) & (F.col("is.score") >= least_score)).select("whole.*")
