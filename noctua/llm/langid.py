"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

Letters are lower-cased, each run of other characters is one blank, and n-grams of 1 to 3 characters are hashed into
BUCKETS. Document frequencies come from all training rows: each task sums its rows, and only the sums are shuffled.
The weights come from a bounded sample of SAMPLE rows for each language (the least hashes of the key), by
follow-the-regularised-leader with elastic-net penalties, which leaves most weights zero; a fifth of the sample is
kept back to fit one temperature for all probabilities. Prediction is a narrow pass over whole texts; tasks are sent
those weights only that are not zero. Texts of any length are read whole, piece by piece; repeated rows count as often as
they come, and are given the same language.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.llm.common import slices, table

BUCKETS_LOG2 = 15
BUCKETS = 1 << BUCKETS_LOG2
LONGEST = 3
#: Labelled rows that weights are fitted on: of each language, and of all, at most. So no more than half as many languages
#: are learned, those of the most rows; documents of any other are given one of them.
SAMPLE, SAMPLE_ALL = 600, 12_000
#: Characters of a text handled at once.
SLICE = 1 << 20
UNDETERMINED = "und"


@dataclass(frozen=True)
class Penalties:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    epochs: int = 4


@dataclass(frozen=True)
class Model:
    """Weights that are not zero, bucket by bucket: those of bucket b stand at starts[b] to starts[b + 1]."""

    languages: list[str]
    idf: np.ndarray
    starts: np.ndarray
    language: np.ndarray
    weight: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        return np.bincount(self.language[places], self.weight[places] * np.repeat(x, sizes), len(self.languages)) / self.temperature


def model_of(languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float) -> Model:
    """From weights as a matrix of buckets and languages."""
    bucket, language = np.nonzero(weights)
    return Model(languages, idf, np.searchsorted(bucket, np.arange(BUCKETS + 1)), language.astype(np.int32), weights[bucket, language], temperature)


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Occurrences of n-grams in each bucket; None without letters."""
    counts = np.zeros(BUCKETS, np.int64)
    seen, before = False, np.array([32] * (LONGEST - 1), np.uint64)
    for i in range(0, len(text or ""), SLICE):
        codes = np.frombuffer(text[i : i + SLICE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters()[codes]
        seen = seen or bool(is_letter.any())
        codes = np.concatenate([before, np.where(is_letter, codes, 32).astype(np.uint64)])
        blank = codes == 32
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        keep[: LONGEST - 1] = True
        codes = codes[keep]
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, LONGEST + 1):  # h at p: hash of the n characters that end there
            h = codes * np.uint64(0x9E3779B97F4A7C15) if n == 1 else (np.concatenate([h[:1], h[:-1]]) ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + codes * np.uint64(2 * n + 1)
            mixed = h * np.uint64(0xFF51AFD7ED558CCD)
            counts += np.bincount((mixed >> np.uint64(64 - BUCKETS_LOG2))[LONGEST - 1 :].astype(np.int64), minlength=BUCKETS)
        before = codes[-(LONGEST - 1) :]
    return counts if seen else None


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a document: damped counts by inverse document frequency, of length one."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, p: Penalties) -> np.ndarray:
    """Follow the regularised leader: weights are zero until the sum of their gradients passes the l1 penalty."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) <= p.l1, 0.0, (np.sign(own) * p.l1 - own) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for epoch in range(p.epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / p.alpha * w
            n[at] = grown
    return weights(slice(None))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search over its logarithm.

    Targets are drawn in from 0 and 1 as with one more row of each outcome: else rows without an error would call
    for certainty.
    """
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    wrong = 1 / (len(y) + 2)
    target = np.full(logits.shape, wrong / (logits.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - wrong

    def loss(t):
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()

    a, b, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(key: str):
    """Rows of which crc32(key as text) mod 5 is 0; a null key counts as the empty text, so it is held out."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5) == 0


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, penalties: Penalties = Penalties()) -> Model:
    """Learns from text and non-null lang of the rows that are not held out."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches):
        df, seen = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in slices(batches):
            for body in batch.column(0).to_pylist():
                counts = ngram_counts(body)
                if counts is not None:
                    df[:BUCKETS] += counts > 0
                    seen += 1
        df[BUCKETS] = seen
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "n"])

    df = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in rows.select("text").mapInArrow(frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).toLocalIterator():
        df[bucket] = n
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    counts = dict(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ALL // 2).collect())
    languages = sorted(counts)
    if not languages:
        return model_of([], idf, np.zeros((BUCKETS, 0)), 1.0)
    each = min(sample, max(2, SAMPLE_ALL // len(languages)))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.3 * each / n))))
    h = F.xxhash64(F.col("id").cast("string"))
    some = rows.withColumn("h", h).where(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def sparse(batches):
        for batch in slices(batches):
            found = [ngram_counts(x) for x in batch.column("text").to_pylist()]
            at = [None if c is None else np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("lang", "h", "t")),
                    pa.array([None if a is None else a.astype("<u2").tobytes() for a in at], pa.binary()),
                    pa.array([None if a is None else c[a].astype("<u4").tobytes() for a, c in zip(at, found)], pa.binary()),
                ],
                names=["lang", "h", "t", "at", "n"],
            )

    counted = some.select("lang", "h", F.xxhash64("text").alias("t"), "text").mapInArrow(sparse, "lang string, h bigint, t bigint, at binary, n binary")
    counted = counted.where("at IS NOT NULL").orderBy("h", "t").limit(2 * each * len(languages))  # counts of n-grams, not texts
    train, kept, used = [], [], dict.fromkeys(languages, 0)
    for row in counted.toLocalIterator():
        if used[row.lang] >= each:
            continue
        used[row.lang] += 1
        c = np.zeros(BUCKETS, np.int64)
        c[np.frombuffer(row.at, "<u2")] = np.frombuffer(row.n, "<u4")
        (kept if row.h // 7 % 5 == 0 else train).append((*features(c, idf), languages.index(row.lang)))
    weights = fit_weights(train, len(languages), penalties)
    logits = np.array([x @ weights[at] for at, x, _ in kept]).reshape(len(kept), len(languages))
    return model_of(languages, idf, weights, fit_temperature(logits, np.array([y for _, _, y in kept], np.int64)))


def predict(docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its calibrated probability to each row; columns of those names are replaced.

    Only the text is used. Null texts, texts without letters, and all texts if nothing was learned: ``und``, score 0.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (label, score)]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept))

    def run(batches):
        m = shipped.value
        for batch in slices(batches):
            names, scores = [], []
            for body in batch.column(text).to_pylist():
                counts = ngram_counts(body) if m.languages else None
                if counts is None:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                at, x = features(counts, m.idf)
                p = softmax(m.logits(at, x))
                best = int(p.argmax())
                names.append(m.languages[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, label, score])

    return rows.mapInArrow(run, rows.select("*").schema.add(label, "string").add(score, "double"))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return predict(rows, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
