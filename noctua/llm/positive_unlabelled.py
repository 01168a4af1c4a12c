"""Quality classifier learned from trusted positives and unlabelled text (positive-unlabelled learning).

A text becomes NUMERIC shares and lengths, each spread over KNOTS hat functions, and the frequencies of hashed triples of
character classes: a linear function g of these is learned. With the squared loss l(z) = (1 - z)^2 / 4, class prior p,
positives P and all texts U (unlabelled), the risk is p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)]): the unlabelled
texts' loss as negatives less what positives among them cause, never below zero. It needs only the moments of P and U, so
those are summed over all training texts in one pass, tasks' sums are added up in a tree, and the driver minimises the risk
exactly as over all rows. Nothing is sampled.

The prior is estimated from positives and unlabelled texts alone: a first scorer tells them apart, and of all thresholds
the least ratio of the shares of U and of P above it, with a margin for chance, is the prior. A last pass counts g over P
and U, from which a rising logistic curve makes probabilities.

Null and empty texts have features as any other. Texts of any length are read whole. Repeated rows count as often as they
come. A text whose labels disagree is not trusted. Without positives nothing is learned and every score is 0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.llm.common import cut, quoted, slices, stored, table

#: Features: numbers of a text, hat functions for each, buckets of hashed triples of character classes.
NUMERIC, KNOTS, TRIPLES = 16, 8, 64
WIDTH = 1 + NUMERIC * KNOTS + TRIPLES
#: Bins of the histograms of g, from -LIMIT to LIMIT.
BINS, LIMIT = 400, 2.0
#: Sums added up at once.
FAN_IN = 32
#: Ridge, as a share of the mean square of a feature; steps of the minimisation and what a step may take back from a negative part.
RIDGE, STEPS, BACK = 1e-3, 200, 0.5
#: A text is of good quality from this probability on.
LEAST = 0.7
SYMBOLS = frozenset("#*$%&|<>{}[]\\^~=+_@`")
ENDS = re.compile("[.!?…。]+")


def held_out(key: str) -> Column:
    """Rows of which crc32(key as text) mod 4 is 2; a null key counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4) == 2


def character_classes() -> np.ndarray:
    """The class of each code point: 0 space, 1 line end, 2 lower-case, 3 capital, 4 other letter, 5 digit, 6 symbol, 7 other mark."""
    kinds = np.full(0x110000, 7, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isspace():
            kinds[i] = c in "\n\r"
        elif c.isalpha():
            kinds[i] = 2 if c.islower() else 3 if c.isupper() else 4
        elif c.isdigit():
            kinds[i] = 5
        elif c in SYMBOLS:
            kinds[i] = 6
    return kinds


_CLASSES: list[np.ndarray] = []


def classes_of(text: str) -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(character_classes())
    return _CLASSES[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def repeated(numbers: np.ndarray, n: int) -> float:
    """The share of runs of n words that are equal to an earlier one."""
    if len(numbers) <= n:
        return 0.0
    key = np.zeros(len(numbers) - n + 1, np.uint64)
    for i in range(n):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + numbers[i : len(numbers) - n + 1 + i].astype(np.uint64)
    return 1 - len(np.unique(key)) / len(key)


def numbers_of(text: str | None) -> np.ndarray:
    """NUMERIC numbers from 0 to 1, then the frequencies of triples of character classes (their roots, so the squares add up to one)."""
    text = text or ""
    kinds = classes_of(text)
    words = text.split()
    n, chars = len(words), max(len(kinds), 1)
    count = np.bincount(kinds, minlength=8)
    inside = max(int(count[2:].sum()), 1)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    often = np.bincount(ids) if n else np.zeros(1, np.int64)
    lines = [x for x in text.split("\n") if x.strip()]
    space = kinds < 2
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if n else np.zeros(0, np.int64)
    marked = np.logical_or.reduceat(kinds == 6, starts).sum() if len(starts) else 0
    log = lambda x, most: min(math.log1p(x) / math.log1p(most), 1.0)
    least = max(n, 1)
    values = [
        log(n, 20_000), log(inside / least, 40), count[2:5].sum() / inside, count[5] / inside,
        min(4 * count[6] / inside, 1.0), min(4 * count[7] / inside, 1.0), min(4 * count[3] / inside, 1.0), (count[0] + count[1]) / chars,
        marked / least, (ids[1:] == ids[:-1]).sum() / least, often.max() / least, repeated(ids, 3),
        1 - len(set(lines)) / max(len(lines), 1), log(n / max(len(lines), 1), 2000), log(n / (len(ENDS.findall(text)) + 1), 500), len(number) / least,
    ]
    triples = (kinds[:-2].astype(np.int64) * 64 + kinds[1:-1] * 8 + kinds[2:]) if len(kinds) > 2 else np.zeros(0, np.int64)
    per = np.bincount((triples * 0x9E3779B1 >> 13) % TRIPLES, minlength=TRIPLES)
    return np.concatenate([np.array(values), np.sqrt(per / max(len(triples), 1))]).astype(np.float32)


def spread(numbers: np.ndarray) -> np.ndarray:
    """Rows of numbers as rows of WIDTH features: one, the hat functions of each number, the triples."""
    hats = np.maximum(0, 1 - np.abs(numbers[:, :NUMERIC, None] * (KNOTS - 1) - np.arange(KNOTS)))
    return np.concatenate([np.ones((len(numbers), 1)), hats.reshape(len(numbers), -1), numbers[:, NUMERIC:]], axis=1)


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out and x (the numbers, 16-bit) of each row; texts go no farther than here."""

    def run(batches):
        for batch in slices(batches):
            x = [numbers_of(t).astype("<f2").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["id", "held_out", "x"])

    rows = docs.select(quoted(key).alias("id"), held_out(key).alias("held_out"), quoted(text).alias("text"))
    return rows.mapInArrow(run, docs.select(quoted(key).alias("id")).schema.add("held_out", "boolean").add("x", "binary"))


def trusted(labels: DataFrame, key: str, label: str) -> DataFrame:
    """id of what is labelled 1 and never otherwise. Only labels that are not held out are looked at."""
    known = labels.select(quoted(key).alias("id"), quoted(label).alias("y")).where(~held_out("id") & F.col("id").isNotNull() & F.col("y").isNotNull())
    return known.groupBy("id").agg(F.min("y").alias("y")).where("y = 1").select("id")


def matrix(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<f2").reshape(-1, NUMERIC + TRIPLES).astype(np.float64)


def total(rows: DataFrame, of_batch, size: int) -> np.ndarray:
    """The sum over all batches of an array of ``size`` numbers: in each task, then FAN_IN tasks at a time."""

    def task(batches):
        sums = np.zeros(size)
        for batch in slices(batches, 2000):
            if batch.num_rows:
                sums += of_batch(batch)
        yield pa.RecordBatch.from_pydict({"lane": [TaskContext.get().partitionId()], "sums": [sums.tobytes()]}, KIND)

    def add(data: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x) for x in data.column("sums").to_pylist())
        return pa.Table.from_pydict({"lane": [data.column("lane")[0].as_py()], "sums": [sums.tobytes()]}, KIND)

    partial = cut(rows.mapInArrow(task, "lane bigint, sums binary"))
    left = (partial.agg(F.max("lane")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // FAN_IN)
        partial = partial.withColumn("lane", F.floor(F.col("lane") / FAN_IN)).groupBy("lane").applyInArrow(add, "lane bigint, sums binary")
    return sum((np.frombuffer(bytes(r.sums)) for r in partial.collect()), np.zeros(size))  # one row


KIND = pa.schema([("lane", pa.int64()), ("sums", pa.binary())])


@dataclass(frozen=True)
class Moments:
    """Of the texts of one set: how many, the sum of the features, the sum of their products."""

    n: float
    sum: np.ndarray
    products: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sum / max(self.n, 1)

    @property
    def square(self) -> np.ndarray:
        return self.products / max(self.n, 1)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sum + other.sum, self.products + other.products)


#: Weights that are fitted on one fold are looked at on the other, for the prior and the curve.
FOLDS = 2


def sets_of(batch) -> list[np.ndarray]:
    """Which rows are positives of each fold, then which are texts of each fold."""
    positive, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
    return [*((fold == k) & positive for k in range(FOLDS)), *(fold == k for k in range(FOLDS))]


def moments(rows: DataFrame) -> tuple[list[Moments], list[Moments]]:
    """Of the positives and of all texts, by fold. rows: x, positive, fold."""
    size = 1 + WIDTH + WIDTH * WIDTH

    def of_batch(batch):
        x = spread(matrix(batch.column(0)))
        return np.concatenate([np.concatenate([[own.sum()], x[own].sum(axis=0), (x[own].T @ x[own]).ravel()]) for own in sets_of(batch)])

    sums = total(rows, of_batch, 2 * FOLDS * size).reshape(2 * FOLDS, size)
    found = [Moments(x[0], x[1 : 1 + WIDTH], x[1 + WIDTH :].reshape(WIDTH, WIDTH)) for x in sums]
    return found[:FOLDS], found[FOLDS:]


def histograms(rows: DataFrame, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How often g lies in each bin, among positives and among all texts. Each fold has weights of its own."""

    def of_batch(batch):
        g, sets = spread(matrix(batch.column(0))) @ np.stack(w, axis=1), sets_of(batch)
        at = np.clip((g + LIMIT) * (BINS / (2 * LIMIT)), 0, BINS - 1).astype(np.int64)
        return np.concatenate([sum(np.bincount(at[own, k], minlength=BINS) for k, own in enumerate(sets[i : i + FOLDS])) for i in (0, FOLDS)])

    sums = total(rows, of_batch, 2 * BINS)
    return sums[:BINS], sums[BINS:]


def risk_parts(w: np.ndarray, p: Moments, u: Moments, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The risk of positives, that of negatives (which may come out below zero), and their gradients."""

    def loss(m: Moments, sign: float) -> tuple[float, np.ndarray]:  # the mean of (1 - sign * g)^2 / 4
        return (1 - 2 * sign * w @ m.mean + w @ m.square @ w) / 4, (m.square @ w - sign * m.mean) / 2

    (plus, d_plus), (minus, d_minus), (free, d_free) = loss(p, 1), loss(p, -1), loss(u, -1)
    return prior * plus, free - prior * minus, prior * d_plus, d_free - prior * d_minus


def ridge_of(p: Moments, u: Moments) -> np.ndarray:
    return (RIDGE + 1 / max(p.n, 1)) * np.trace(u.square) / WIDTH * np.eye(WIDTH)


def tell_apart(p: Moments, u: Moments) -> np.ndarray:
    """Least squares between positives and unlabelled texts, which needs no prior."""
    return np.linalg.solve(p.square + u.square + 2 * ridge_of(p, u), p.mean - u.mean)


def minimise(p: Moments, u: Moments, prior: float) -> np.ndarray:
    """Weights of least non-negative risk, by steps scaled with the mean products of U.

    Where the negatives' part is below zero, steps go against it, as it then only fits chance; the best weights met count.
    """
    ridge = ridge_of(p, u)
    scale = np.linalg.inv(u.square + p.square + ridge)
    w, best = np.zeros(WIDTH), (math.inf, np.zeros(WIDTH))
    for _ in range(STEPS):
        plus, minus, d_plus, d_minus = risk_parts(w, p, u, prior)
        value = plus + max(minus, 0.0) + w @ ridge @ w / 4
        if value < best[0]:
            best = value, w
        step = d_plus + d_minus + ridge @ w / 2 if minus >= 0 else -BACK * d_minus
        w = w - scale @ step
    return best[1]


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in U from histograms of a scorer over P and U, at the threshold of the least upper bound."""
    above_p, above_u = (np.cumsum(h[::-1]) / max(h.sum(), 1) for h in (p, u))
    chance = math.sqrt(math.log(40) / (2 * max(p.sum(), 1))) + math.sqrt(math.log(40) / (2 * max(u.sum(), 1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        upper = np.where(above_p > 0, (above_u + chance) / above_p, math.inf)
        at = int(upper.argmin())
    return float(np.clip(above_u[at] / max(above_p[at], 1e-12), 0.01, 0.99))


def curve(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-a * g - b)): the likeliest rising curve where positives in U are as P, and the rest negatives."""
    g = (np.arange(BINS) + 0.5) * (2 * LIMIT / BINS) - LIMIT
    positive = prior * (p + 1e-9) / (p.sum() + BINS * 1e-9)
    negative = np.maximum((u + 1e-9) / (u.sum() + BINS * 1e-9) - positive, 0)
    n = max(u.sum(), 1)
    x, weight = np.stack([g, np.ones(BINS)], axis=1), (positive + negative) * n
    target = np.concatenate([np.full(BINS, (n + 1) / (n + 2)), np.full(BINS, 1 / (n + 2))])
    x, weight = np.concatenate([x, x]), np.concatenate([positive, negative]) * n
    z = np.array([2.0, math.log(prior / (1 - prior))])
    for _ in range(100):  # Newton's method with a little ridge
        s = 1 / (1 + np.exp(-np.clip(x @ z, -35, 35)))
        slope = x.T @ (weight * (s - target)) + 1e-3 * n * np.array([1e-3, 0]) * z
        z = z - np.linalg.solve((x * (weight * np.maximum(s * (1 - s), 1e-9))[:, None]).T @ x + 1e-3 * np.eye(2), slope) * 0.7
    return max(float(z[0]), 0.0), float(z[1])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    prior: float
    slope: float
    offset: float

    def probabilities(self, numbers: np.ndarray) -> np.ndarray:
        if not self.prior:
            return np.zeros(len(numbers))
        g = np.clip(spread(numbers) @ self.weights, -LIMIT, LIMIT)
        return 1 / (1 + np.exp(-np.clip(self.slope * g + self.offset, -35, 35)))


def fit(features: DataFrame, positives: DataFrame) -> Model:
    """From featured() rows and the ids of trusted positives. Rows that are held out are not learned from."""
    trained = features.where("NOT held_out").select("id", "x", (F.crc32("x") % FOLDS).cast("int").alias("fold"))
    marked = positives.withColumn("positive", F.lit(True))
    rows = stored(trained.join(marked, "id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive"), "fold"), "training")
    p, u = moments(rows)
    all_p, all_u = p[0] + p[1], u[0] + u[1]
    if not all_p.n:
        return Model(np.zeros(WIDTH), 0.0, 0.0, 0.0)
    other = [(p[1 - k], u[1 - k]) for k in range(FOLDS)]
    prior = estimate_prior(*histograms(rows, [tell_apart(*x) for x in other]))
    slope, offset = curve(*histograms(rows, [minimise(*x, prior) for x in other]), prior)
    return Model(minimise(all_p, all_u, prior), prior, slope, offset)


def score(features: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """Adds score and predicted to featured() rows; x is dropped."""
    shipped = features.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in features.columns if c != "x"]

    def run(batches):
        for batch in slices(batches, 2000):
            p = shipped.value.probabilities(matrix(batch.column("x")))
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= least).astype(np.int32))], names=[*kept, "score", "predicted"])

    return features.mapInArrow(run, features.select(*kept).schema.add("score", "double").add("predicted", "integer"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", least: float = LEAST) -> DataFrame:
    """key, held_out, score (probability of good quality) and predicted of each row of docs."""
    features = stored(featured(docs, key, text), "features")
    return score(features, fit(features, trusted(labels, key, label)), least).withColumnRenamed("id", key)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored, learning from labels.quality of the rows that are not held out."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
