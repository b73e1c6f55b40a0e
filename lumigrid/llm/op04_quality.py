"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

A text becomes a row of statistics (``STATISTICS``). Standardised by the mean and deviation of all
labelled training rows, they are mapped to cosines of random projections, which approximate a Gaussian
kernel; each partition sums its part of the normal equations, the sums are added on the executors to a
fixed number of rows, and the driver solves the ridge system. Isotonic regression over the training rows' raw scores, binned in
``BINS`` equal steps, calibrates them; the steps are joined by lines, so that scores keep their order.

All labelled training rows take part; no sample is drawn. Defined results: null and empty texts get
the score of a text without characters. Labels of a doc_id with several rows of ``labels`` are
averaged (0.5 counts as 1); null labels and labels without document are left out. Repeated rows are
scored one by one; a null doc_id is scored and not held out. Without any training label every score
is 0.5. An empty table gives an empty result. Other columns are ignored by the score.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_texts, release, small_batches, stash, table, unused

FEATURES = 192
WIDTH = 4.0  # of the kernel, in standard deviations of the statistics
RIDGE = 1e-3
BINS = 2000
SUMS = 8  # rows to which partial sums are added before they reach the driver

STATISTICS = (
    "log_bytes", "log_words", "word_length", "distinct_words", "upper", "digit", "symbol", "stop_mark", "space", "newline", "beyond_ascii",
    "byte_entropy", "top_word", "repeated_pairs", "marked_words", "line_repeat", "top_symbol", "bars",
)
_MARK = re.compile(r"[^\w\s.,;:'\"()-]{2,}(?=\s|$)")


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(len(raw), 1)
    count = np.bincount(raw, minlength=256)
    words = text.split()
    m = max(len(words), 1)
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = text.split("\n")
    share = count[count > 0] / n
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    symbols = np.concatenate([count[33:48], count[58:65], count[91:97], count[123:127]])
    marks = count[[33, 44, 46, 63, 58, 59]].sum()
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        len(raw) / m,
        len(kinds) / m,
        count[65:91].sum() / max(letters, 1),
        count[48:58].sum() / n,
        (symbols.sum() - marks) / n,
        marks / m,
        (count[32] + count[9]) / n,
        count[10] / n,
        count[128:].sum() / n,
        float(-(share * np.log2(share)).sum()),
        max(kinds.values(), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m,
        len(_MARK.findall(text)) / m,
        1 - len(set(lines)) / len(lines),
        symbols.max() / n,
        count[124] / m,
    ]


class Fourier:
    """The random features: fixed by a seed, so driver and executors draw alike."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 4):
        draw = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        self.turn = draw.normal(size=(len(mean), features)) / width
        self.phase = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        wave = np.cos(z @ self.turn + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([np.ones((len(x), 1)), wave])


def isotonic(value: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the centres and levels of the resulting steps."""
    blocks: list[list[float]] = []
    for v, y, w in zip(value, mean, weight):
        blocks.append([v * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Raw ridge score, then calibration."""

    def __init__(self, map: Fourier | None, weights: np.ndarray, at: np.ndarray, level: np.ndarray):
        self.map, self.weights, self.at, self.level = map, weights, at, level

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.map(x) @ self.weights, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.map is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        # A small share of the raw score keeps the order inside a step.
        return np.clip(0.999 * np.interp(raw, self.at, self.level) + 0.001 * (raw + 1) / 3, 0, 1)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, h and the statistics of each row's text."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "h": frame["h"], "x": [statistics(t) for t in frame["text"]]})

    return keyed_texts(docs).mapInPandas(run, "doc_id long, h long, x array<double>")


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _summed(rows: DataFrame, work, size: int) -> np.ndarray:
    """The sum over partitions of the vectors that ``work(x, y)`` gives for batches."""

    def partial(frames):
        total = np.zeros(size)
        for frame in frames:
            if len(frame):
                total += work(np.stack(frame["x"].to_numpy()), frame["y"].to_numpy(np.float64))
        yield pd.DataFrame({"v": [total.tobytes()]})

    def added(frames):
        total = np.zeros(size)
        for frame in frames:
            for v in frame["v"]:
                total += np.frombuffer(v)
        yield pd.DataFrame({"v": [total.tobytes()]})

    parts = rows.mapInPandas(partial, "v binary").repartition(SUMS).mapInPandas(added, "v binary")
    return sum((np.frombuffer(r.v) for r in parts.toLocalIterator()), np.zeros(size))


def fit(train: DataFrame, features: int = FEATURES) -> Model:
    """``train``: x (array of double), y (0 or 1)."""
    k = len(STATISTICS)

    def moments(x, y):
        return np.concatenate([[len(x), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    m = _summed(train, moments, 2 + 2 * k)
    n = m[0]
    if not n:
        return Model(None, np.zeros(0), np.zeros(0), np.zeros(0))
    mean = m[2 : 2 + k] / n
    deviation = np.sqrt(np.maximum(m[2 + k :] / n - mean**2, 0))
    wave = Fourier(mean, np.where(deviation > 1e-9, deviation, 1.0), features)
    d = features + 1

    def normal(x, y):
        z = wave(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    s = _summed(train, normal, d * d + d)
    gram = s[: d * d].reshape(d, d) / n + RIDGE * np.diag([0.0] + [1.0] * features)
    weights = np.linalg.lstsq(gram, s[d * d :] / n, rcond=None)[0]
    model = Model(wave, weights, np.zeros(0), np.zeros(0))

    def binned(x, y):
        place = np.minimum(((model.raw(x) + 1) / 3 * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place, weights=y, minlength=BINS)])

    b = _summed(train, binned, 2 * BINS)
    full = np.flatnonzero(b[:BINS])
    model.at, model.level = isotonic((full + 0.5) / BINS * 3 - 1, b[BINS:][full] / b[full], b[full])
    return model


def scored(docs: DataFrame, labels: DataFrame, features: int = FEATURES) -> DataFrame:
    """doc_id, h (hash of the text), held_out, score, predicted of each row of ``docs``."""
    small_batches(docs.sparkSession)
    found = stash(measured(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).where("doc_id IS NOT NULL AND q IS NOT NULL")
    known = known.groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("double").alias("y"))
    train = stash(found.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("x", "y"), "train")
    model = fit(train, features)
    release(train)

    def run(frames):
        for frame in frames:
            if len(frame):
                made = model.score(np.stack(frame["x"].to_numpy()))
                yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "h": frame["h"], "score": made})

    out = found.mapInPandas(run, "doc_id long, h long, score double")
    return out.select("doc_id", "h", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score(docs: DataFrame, labels: DataFrame, features: int = FEATURES) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    return scored(docs, labels, features).drop("h")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be bad, with their columns as they were."""
    doc, h = unused(docs, "own_doc", "own_hash")
    bad = scored(docs, labels).where("predicted = 0").select(F.col("doc_id").alias(doc), F.col("h").alias(h)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h)), "left_anti")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
