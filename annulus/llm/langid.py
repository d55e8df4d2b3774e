"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier for each bit - a log-ratio of two hashed
byte n-gram multinomials, the languages with the bit against those without - scores a text;
the codeword of least loss, weighted by how well each bit separates the training languages, is
the prediction, and a small lead over the second codeword flags the text as ambiguous.

The classifiers' counts come from every training document.  They are one number for each
(language, bucket); the driver takes them in for LANGUAGES languages at a time and keeps what
each bit needs, so its memory follows neither the documents nor the number of languages, but
for the list of their names and codewords.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored
from .textscan import slices

BUCKETS = 1 << 13
LANGUAGES = 64
SMOOTHING = 0.5
AMBIGUOUS_LEAD = 0.2


def _buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram and bigram of one lower-cased text, framed by blanks."""
    b = np.empty(len(data) + 2, dtype=np.uint32)
    b[0] = b[-1] = 0x20
    b[1:-1] = data
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
    return np.concatenate([two * np.uint32(0x2C1B3C6D) >> np.uint32(19), three * np.uint32(0x297A2D39) >> np.uint32(19)])


def histograms(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, data, offsets in slices(texts):
        for a, b in zip(offsets[:-1], offsets[1:]):
            yield np.bincount(_buckets(data[a:b]), minlength=BUCKETS)


def gram_counts(train: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n): every training text counted, summed within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, h in zip(batch.column(1).to_pylist(), histograms(batch.column(0))):
                if name in totals:
                    totals[name] += h
                else:
                    totals[name] = h.astype(np.int64)
        for name, h in totals.items():
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(h[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = train.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.col(lang).alias("lang"))
    return rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: the exhaustive code up to seven languages, else a seeded random one."""
    if k <= 1:
        return np.ones((k, 0), dtype=np.int8)
    if k <= 7:
        columns = [[1] + [1 if m >> j & 1 else -1 for j in range(k - 1)] for m in range((1 << (k - 1)) - 1)]
        return np.array(columns, dtype=np.int8).T
    width, rng, best, distance = int(np.ceil(10 * np.log2(k))), np.random.default_rng(k), None, -1
    for _ in range(200):
        code = np.where(rng.random((k, width)) < 0.5, -1, 1).astype(np.int8)
        code = code[:, np.abs(code.sum(axis=0)) < k]
        apart = code.shape[1] - (code.astype(int) @ code.T.astype(int))
        least = int((apart + 4 * code.shape[1] * np.eye(k, dtype=int)).min())
        if least > distance:
            best, distance = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, scaled so that a training language's mean margin is about 1
    trust: np.ndarray  # of each bit

    def predict(self, histogram: np.ndarray) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, whether it is ambiguous)."""
        k = len(self.languages)
        if k == 1:
            return self.languages[0], 1.0, False
        at = np.flatnonzero(histogram)
        n = histogram[at]
        margins = n @ self.weights[at] / max(1, n.sum())
        loss = np.logaddexp(0.0, -2.0 * self.code * margins) @ self.trust / self.trust.sum()
        p = np.exp(-4.0 * (loss - loss.min()))
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.languages[order[0]], float(p[order[0]]), bool(p[order[0]] - p[order[1]] < AMBIGUOUS_LEAD)


def fit(train: DataFrame, *, text: str = "text", lang: str = "lang") -> Model:
    """Train on every row with a language; null and empty texts count nothing."""
    rows = pick(train, text, lang).where(F.col(lang).isNotNull())
    counts = stored(gram_counts(rows, text, lang))
    languages = sorted(r.lang for r in counts.select("lang").distinct().toLocalIterator())
    k, code = len(languages), codewords(len(languages))
    if k < 2:
        return Model(languages, code, np.zeros((BUCKETS, 0)), np.ones(0))

    def shares() -> Iterator[tuple[int, np.ndarray]]:
        """(number, smoothed share of each bucket) of every language, in order."""
        for lo in range(0, k, LANGUAGES):
            part = {x: i for i, x in enumerate(languages[lo : lo + LANGUAGES])}
            held = counts.toArrow() if k <= LANGUAGES else counts.where(F.col("lang").isin(*part)).toArrow()
            n = np.zeros((len(part), BUCKETS))
            n[[part[x] for x in held.column("lang").to_pylist()], held.column("bucket").to_numpy()] = held.column("n").to_numpy()
            for i, row in enumerate(n + SMOOTHING):
                yield lo + i, row / row.sum()

    has, lacks, bits = np.zeros((BUCKETS, code.shape[1])), np.zeros((BUCKETS, code.shape[1])), code > 0
    for i, share in shares():
        has += share[:, None] * bits[i]
        lacks += share[:, None] * ~bits[i]
    weights = np.log(has / bits.sum(axis=0)) - np.log(lacks / (~bits).sum(axis=0))
    margins = np.stack([share @ weights for _, share in shares()])
    scale = np.abs(margins).mean(axis=0)
    scale[scale == 0] = 1.0
    trust = np.maximum((margins / scale * code).min(axis=0), 1e-3)
    return Model(languages, code, weights / scale, trust)


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, ambiguous) of every whole text.

    `und` with score 0 where the text is null, empty or has no letter, or where nothing was
    learned.  Languages that fit equally well go by name, and are ambiguous.  Equal texts get equal results; repeated rows stay; a null key stays null.
    """
    rows = pick(docs, key, text).select(
        F.col(key), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(h) if ok and model.languages else ("und", 0.0, False) for ok, h in zip(batch.column(2).to_pylist(), histograms(batch.column(1)))]
            names, scores, flags = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], names=[key, "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, lang_pred string, score double, ambiguous boolean")
