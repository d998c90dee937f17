"""Operator 4: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space runs become one space, and the distinct n-grams of 3 to 5 characters are
hashed to ``2**20`` features. Each feature is scaled by the log ratio of its smoothed document rates under the two
labels; a logistic regression with an L2 penalty is fitted over the scaled features. Fitting takes a bounded sample of labelled rows
(``TOXIC_ROWS`` and ``CLEAN_ROWS``, those with the smallest hash of their key) and ``FEATURES`` features (those
with the largest chi-square of their counts); the sample's keys are broadcast, so documents are never shuffled. The
intercept is shifted by the log-odds that the bounds add, so that the model keeps the share of toxic labels among all
labelled training rows, whatever their number.

Null text is the empty text and gets the score of no features. A null key is scored and never trained on. A key with
contradicting labels counts as toxic. Without labels of both kinds every score is the share of toxic labels (0.5 without labels).
A score of exactly 0.5 predicts toxic. Repeated rows have equal scores. A very long text is scored as a whole. An empty table gives no rows. Columns that are
added get free names; of the others only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh_name, small_batches, table

TOXIC_ROWS = 3000
CLEAN_ROWS = 6000
FEATURES = 1 << 13
ENTRIES = 1 << 18  # places of the sample that the driver handles at once
ORDERS = (3, 4, 5)
BITS = 20
PENALTY = 1.0
STEPS = 60


class NGrams:
    """Distinct hashed n-grams of texts."""

    def __init__(self, orders: tuple[int, ...] = ORDERS, bits: int = BITS):
        self.orders, self.shift = orders, np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        flat = f" {' '.join((text or '').lower().split())} "
        c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h, found = c, []
        for n in range(2, max(self.orders) + 1):
            h = h[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
            if n in self.orders:
                found.append(((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift)
        ids = np.concatenate(found).astype(np.int64)
        places = np.arange(len(ids), dtype=np.int32)
        self.seen[ids] = places
        return ids[self.seen[ids] == places]


def labelled(labels: DataFrame, key: str = "doc_id", label: str = "toxic", modulus: int = 5, held: int = 0) -> DataFrame:
    """(key, label) of all training rows."""
    each = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("key").isNotNull())
    return each.where(F.crc32(F.col("key").cast("string")) % modulus != held).groupBy("key").agg(F.max("label").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 5, held: int = 0) -> DataFrame:
    """(text, label) of the bounded training sample."""
    each = labelled(labels, key, label, modulus, held)
    order = [F.xxhash64("key"), F.col("key")]
    picked = each.where("label = 1").orderBy(*order).limit(TOXIC_ROWS).unionAll(each.where("label = 0").orderBy(*order).limit(CLEAN_ROWS))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return texts.join(F.broadcast(picked), "key").select("text", "label")  # at most TOXIC_ROWS + CLEAN_ROWS rows


def shift(clean: int, toxic: int) -> float:
    """What a fit on the bounded sample lacks in log-odds, given the numbers of all labelled training rows: the log ratio of the labels' sampling rates."""
    if not clean or not toxic:
        return 0.0
    return float(np.log(min(1.0, CLEAN_ROWS / clean)) - np.log(min(1.0, TOXIC_ROWS / toxic)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = NGrams()
    sums = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
            sums[label, grams(text)] += 1
    used = np.flatnonzero(sums.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0, used]), pa.array(sums[1, used])], names=["feature", "clean", "toxic"])


def _minimise(loss, x: np.ndarray, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving."""
    value, slope = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = -slope, []
        for s, y in reversed(pairs):
            a = s @ d / (s @ y)
            d = d - a * y
            alphas.append(a)
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            d = d + (a - y @ d / (s @ y)) * s
        step = 1.0 if pairs else min(1.0, 1.0 / max(np.abs(slope).sum(), 1e-9))
        while True:
            new_value, new_slope = loss(x + step * d)
            if new_value <= value + 1e-4 * step * (slope @ d) or step < 1e-8:
                break
            step /= 2
        s, y = step * d, new_slope - slope
        if new_value > value or s @ y <= 1e-12:
            break
        pairs = [*pairs, (s, y)][-memory:]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        x, value, slope = x + s, new_value, new_slope
        if done:
            break
    return x


def _loss(flat: np.ndarray, sizes: np.ndarray, target: np.ndarray, ratio: np.ndarray):
    """The penalised loss and its slope at (weights, intercept), of documents that hold ``sizes`` places of ``flat``. Arrays of entries are made for ``ENTRIES`` at a time."""
    ends = np.cumsum(sizes)
    parts, at = [], 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + ENTRIES, side="right")))
        parts.append((at, to, int(ends[at] - sizes[at]), int(ends[to - 1])))
        at = to

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, z, slope = ratio * w[:-1], np.empty(len(target)), np.zeros(len(ratio))
        for a, b, low, high in parts:
            z[a:b] = np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), scaled[flat[low:high]], b - a)
        z += w[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        for a, b, low, high in parts:
            slope += np.bincount(flat[low:high], np.repeat(off[a:b], sizes[a:b]), len(ratio))
        value = float(np.logaddexp(0, -z * (2 * target - 1)).sum() + PENALTY / 2 * (w[:-1] @ w[:-1]))
        return value, np.append(ratio * slope + PENALTY * w[:-1], off.sum())

    return loss


def fit(train: DataFrame) -> tuple[np.ndarray, float]:
    """(weight of each feature, intercept) from (text, label) rows; what reaches the driver is bounded by the sample and the features."""
    spark = train.sparkSession
    small_batches(spark)
    sums = train.mapInArrow(_counts, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = dict(train.groupBy("label").count().collect())
    clean, toxic = n.get(0, 0), n.get(1, 0)
    weights = np.zeros(1 << BITS, np.float32)
    if not clean or not toxic:
        return weights, 0.0 if clean == toxic else (-20.0 if clean else 20.0)
    got = sums.toArrow()
    feature, a, b = (got[c].to_numpy() for c in ("feature", "clean", "toxic"))
    q, p = (a + 1.0) / (clean + 2.0), (b + 1.0) / (toxic + 2.0)
    ratio = np.log(p / q)
    share = (a + b) / (clean + toxic)
    chi = (b - toxic * share) ** 2 / (share * (1 - share) + 1e-9)
    best = np.lexsort((feature, -chi))[:FEATURES]
    feature, ratio = feature[best], ratio[best]
    place = np.full(1 << BITS, -1, np.int32)
    place[feature] = np.arange(len(feature))
    shared = spark.sparkContext.broadcast(place)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, at = NGrams(), shared.value
        for batch in batches:
            kept = [x[x >= 0].astype("<u2").tobytes() for x in (at[grams(t)] for t in batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), batch["label"]], names=["places", "label"])

    got = train.mapInArrow(rows, "places binary, label int").toArrow()
    sizes, target = pc.binary_length(got["places"]).to_numpy() // 2, got["label"].to_numpy().astype(np.float64)
    flat = np.frombuffer(b"".join(x.as_py() for x in got["places"]), "<u2")  # two bytes a place: FEATURES fit in them
    del got
    loss = _loss(flat, sizes, target, ratio)
    w = _minimise(loss, np.zeros(len(ratio) + 1))
    weights[feature] = w[:-1] * ratio
    shared.unpersist()
    return weights, float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs and the score of the text, 0 to 1. The model's 4 MB table is broadcast."""
    small_batches(docs.sparkSession)
    weights, intercept = model
    shared, name = docs.sparkSession.sparkContext.broadcast(weights), fresh_name(docs, name)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, table = NGrams(), shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            z = np.array([table[grams(t)].sum(dtype=np.float64) + intercept for t in batch[at].to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model of labelled documents."""
    space = Workspace(spark, "toxicity")
    weights, intercept = fit(space.save(sample(docs, labels), "sample"))
    n = dict(labelled(labels).groupBy("label").count().collect())
    return weights, intercept + shift(n.get(0, 0), n.get(1, 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(spark, docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
