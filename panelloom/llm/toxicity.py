"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and word beginnings is trained with numpy
from confirmed toxic texts (P) and texts whose labels are not looked at (U), by the
non-negative risk estimator with class prior p and sigmoid loss l:

    p * mean_P l(g) + max(0, mean_U l(-g) - p * mean_P l(-g))

When the second part falls below zero, a step undoes it instead of descending the whole
risk. The prior is the share of toxic rows among the labelled training rows.

Training reads at most `max_positive` and `max_unlabelled` texts (documented bounds, chosen
by a hash of doc_id) and `max_features` features; their counts are summed by Spark, and
only the bounded sample's selected features reach the driver. Scoring is a map over all
rows with the model (at most `max_features` weights) sent along; a worker remembers the
features of at most CACHED words.

Defined cases: null and empty texts score sigmoid(bias); without a confirmed toxic row or
without texts every score is 0; a doc_id with several labels is toxic if one row says so,
null labels are left out; rows with a null doc_id are scored but never trained on; repeated
rows are scored alike; other columns are ignored; texts are read whole.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
CACHED = 200_000


@dataclass(frozen=True)
class Training:
    max_positive: int = 4000
    max_unlabelled: int = 8000
    max_features: int = 2048
    min_positive_texts: int = 3
    min_lift: float = 2.0
    class_prior: float | None = None
    least_steps: int = 1500
    batch: int = 512
    rate: float = 0.05
    decay: float = 1e-4
    beta: float = 0.0
    seed: int = 7


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    prior: float = 0.0

    @property
    def trained(self) -> bool:
        return bool(self.weights)


def word_features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in BEGINNINGS if len(word) >= k)]


class FeatureLookup(dict):
    """Word -> its features known to the model; forgets everything when full."""

    def __init__(self, known):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple:
        if len(self) >= CACHED:
            self.clear()
        self[word] = found = tuple(f for f in word_features(word) if f in self.known)
        return found

    def of(self, text: str) -> set[str]:
        out: set[str] = set()
        for word in set(WORD.findall(text.lower())):
            if found := self[word]:
                out.update(found)
        return out


def held_out(doc_id: str = "doc_id"):
    """True where a row's label may not be learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, training: Training) -> tuple[DataFrame, float]:
    """The bounded sample (text, positive) and the class prior."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic"))
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = marked.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    prior = training.class_prior if training.class_prior is not None else counts["p"] / max(counts["n"], 1)

    def sample(ids: DataFrame, most: int) -> DataFrame:
        return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out())
    chosen = sample(marked.where("toxic = 1").select("doc_id"), training.max_positive).withColumn(
        "positive", F.lit(True)
    ).unionByName(sample(ids, training.max_unlabelled).distinct().withColumn("positive", F.lit(False)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    # at most max_positive + max_unlabelled short rows are broadcast
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "positive"), prior


def selected_features(rows: DataFrame, training: Training) -> list[str]:
    """The features most typical of positive texts, by the count in all sampled texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, positive in zip(batch.column("text"), batch.column("positive").to_pylist()):
                words = set(WORD.findall(text.as_py().lower()))
                seen[positive].update({f for w in words for f in word_features(w)})
        for positive, counts in seen.items():
            names = list(counts)
            for at in range(0, len(names), 20_000):
                part = names[at : at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array([counts[f] for f in part], pa.int64()),
                     pa.array([positive] * len(part))],
                    names=["feature", "n", "positive"],
                )

    counts = rows.mapInArrow(counted, "feature string, n long, positive boolean")
    totals = rows.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).first()
    lift = ((F.col("p") + 0.1) / (totals["p"] + 1)) / ((F.col("u") + 0.1) / (totals["u"] + 1))
    best = (
        counts.groupBy("feature")
        .agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"),
             F.sum(F.when(F.col("positive"), 0).otherwise(F.col("n"))).alias("u"))
        .where(F.col("p") >= training.min_positive_texts)
        .where(lift >= training.min_lift)
        .orderBy((F.col("p") * F.log(lift)).desc(), "feature")
        .limit(training.max_features)
    )
    return [r["feature"] for r in best.select("feature").collect()]


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> ToxicityModel:
    """Fit on the bounded sample. docs: doc_id, text; labels: doc_id, toxic."""
    from panelloom.sources.storage import store

    rows, prior = training_rows(docs, labels, training)
    rows = store(rows, "toxicity_sample")
    features = selected_features(rows, training)
    if not features:
        return ToxicityModel()
    index = {f: i for i, f in enumerate(features)}

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = FeatureLookup(index)
        for batch in batches:
            ids = [sorted(index[f] for f in lookup.of(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.list_(pa.int32())), batch.column("positive")], names=["ids", "positive"]
            )

    sample = rows.mapInArrow(encoded, "ids array<int>, positive boolean").collect()
    sample = sorted(sample, key=lambda r: (r["positive"], r["ids"]))
    positive = dense([r["ids"] for r in sample if r["positive"]], len(features))
    unlabelled = dense([r["ids"] for r in sample if not r["positive"]], len(features))
    if not len(positive) or not len(unlabelled):
        return ToxicityModel()
    weights, bias = fit_nnpu(positive, unlabelled, prior, training)
    return ToxicityModel({f: float(w) for f, w in zip(features, weights)}, float(bias), prior)


def dense(ids: list[list[int]], width: int) -> np.ndarray:
    """Presence as bytes: at most max_positive + max_unlabelled rows of max_features."""
    out = np.zeros((len(ids), width), dtype=np.uint8)
    for row, found in enumerate(ids):
        out[row, found] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, t: Training):
    """Weights and bias by minibatch Adam on the non-negative risk.

    All features were chosen for being typical of toxic texts, so weights stay at 0 or above.
    """
    draw = np.random.default_rng(t.seed)
    theta = np.zeros(positive.shape[1] + 1, dtype=np.float64)
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    batches = max(1, -(-len(unlabelled) // t.batch))

    def with_bias(rows: np.ndarray) -> np.ndarray:
        return np.hstack([rows.astype(np.float32), np.ones((len(rows), 1), np.float32)])

    for _ in range(-(-t.least_steps // batches)):
        of_p = np.array_split(draw.permutation(len(positive)), batches)
        of_u = np.array_split(draw.permutation(len(unlabelled)), batches)
        for ip, iu in zip(of_p, of_u):
            if not len(ip) or not len(iu):
                continue
            xp, xu = with_bias(positive[ip]), with_bias(unlabelled[iu])
            at = theta.astype(np.float32)
            sp, su = sigmoid(xp @ at), sigmoid(xu @ at)
            slope_p, slope_u = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
            negative_part = su.mean() - prior * sp.mean()
            negative_slope = slope_u @ xu - prior * (slope_p @ xp)
            if negative_part < -t.beta:
                gradient = -negative_slope
            else:
                gradient = -prior * (slope_p @ xp) + negative_slope
            gradient = gradient + t.decay * theta
            step += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            theta -= t.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            np.maximum(theta[:-1], 0, out=theta[:-1])
    return theta[:-1], theta[-1]


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; all columns and rows stay, in their partitions."""
    if not model.trained:
        return docs.withColumn(score, F.lit(0.0))
    weights, bias = model.weights, model.bias

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lookup = FeatureLookup(weights)
        for texts in batches:  # one text at a time leaves Arrow's memory
            sums = [bias + sum(weights[f] for f in sorted(lookup.of(t.as_py()))) for t in texts]
            yield pa.array(sigmoid(np.array(sums, dtype=np.float64)))

    return docs.withColumn(score, scores(F.coalesce(F.col(text), F.lit(""))))
