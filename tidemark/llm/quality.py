"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output.

The vectors and the output weights are learned by stochastic gradient descent in numpy from labelled rows of the
training fold (crc32 of doc_id as text, mod 3, not 1). They are at most SAMPLE rows, those with the least hash of their
id: a documented bound on the fit alone; every document is scored over its whole text. As the output is linear in the
average, a word adds the sum of its features' projections; workers keep those of frequent words.

Defined results: a null or empty text gets the score of the bias; a doc_id with several labels takes the largest; null labels
do not count; a row without doc_id is scored too (held_out null); without any labelled row every score is 0.5 (kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, read, staged
from tidemark.llm.words import Kept

SAMPLE, BUCKETS, DIM, EPOCHS, RATE = 6000, 1 << 16, 8, 6, 4.0
NGRAMS = (3, 4)
#: Words whose sums a task keeps in each of two generations.
KEPT_WORDS = 250_000


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def features(word: str) -> list[int]:
    """Buckets of the word itself and of the character n-grams of <word>."""
    marked = f"<{word}>"
    grams = [word.encode("utf-8", "surrogatepass")]
    for n in NGRAMS:
        grams.extend(marked[i : i + n].encode("utf-8", "surrogatepass") for i in range(len(marked) - n + 1))
    return [xxhash.xxh32_intdigest(g, seed=i > 0) % BUCKETS for i, g in enumerate(grams)]


def _counted(texts: pd.Series) -> pd.Series:
    """Per text: its features and their counts, as two int32 arrays in one cell."""
    out = []
    for text in texts:
        words: dict[str, int] = {}
        for w in text.split():
            words[w] = words.get(w, 0) + 1
        counts: dict[int, int] = {}
        for w, n in words.items():
            for f in features(w):
                counts[f] = counts.get(f, 0) + n
        out.append(np.array([*counts, *counts.values()], np.int32).tobytes())
    return pd.Series(out)


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors BUCKETS x DIM, output weights DIM x 2, bias 2) by stochastic gradient descent."""
    rng = np.random.default_rng(7)
    vectors, out, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    docs = [(a[: len(a) // 2], (a[len(a) // 2 :] / max(1, a[len(a) // 2 :].sum())).astype(np.float32), y) for b, y in rows if len(a := np.frombuffer(b, np.int32))]
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, share, y = docs[i]
            hidden = share @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = rate * (1 - done / steps)
            back = out @ p
            out -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            vectors[ids] -= step * share[:, None] * back
            done += 1
    return vectors, out, bias


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(each bucket's projection on the difference of the two outputs, bias difference)."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    chosen = known.where(fold(F.col("doc_id"), 3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    counted = F.pandas_udf(_counted, "binary")
    texts = id_text(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # at most SAMPLE small rows
    sample = texts.select("doc_id", "y", counted("text").alias("features")).repartition(1).sortWithinPartitions("doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["features"], int(r["y"] > 0)) for b in batches for r in b.to_pylist()]
        vectors, out, bias = train(rows)
        yield pa.RecordBatch.from_pydict({"vectors": pa.array([vectors.tobytes()], pa.binary()), "out": pa.array([out.tobytes()], pa.binary()), "bias": pa.array([bias.tobytes()], pa.binary())})

    model = staged(sample.mapInArrow(learn, "vectors binary, out binary, bias binary"), "quality-model").first()
    if model is None:
        return np.zeros(BUCKETS), 0.0
    out, bias = np.frombuffer(model.out, np.float32).reshape(DIM, 2), np.frombuffer(model.bias, np.float32)
    return np.frombuffer(model.vectors, np.float32).reshape(-1, DIM).astype(float) @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


class _Projected(Kept):
    """word -> its features' summed projection and their number, as one complex number, which sums in one pass."""

    def __init__(self, weights: np.ndarray):
        super().__init__(KEPT_WORDS)
        self.weights = weights.tolist()

    def make(self, word: str) -> complex:
        own = features(word)
        return complex(sum(self.weights[f] for f in own), len(own))


def scorer(docs: DataFrame, labels: DataFrame):
    """A pandas UDF text -> score (0 to 1, the probability of label 1), fitted on docs and labels."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = model.value
        words = _Projected(weights)
        for batch in texts:
            total = np.array([sum(map(words.__getitem__, t.split()), 0j) for t in batch], complex)
            yield pd.Series(1 / (1 + np.exp(-np.clip(total.real / np.maximum(total.imag, 1) + bias, -500, 500))))

    return score


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs plus _score (double) and _predicted (int, 1 if the score is at least 0.5); columns of docs with these names give way to them."""
    score = scorer(docs, labels)
    return docs.withColumn("_score", score(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn("_predicted", (F.col("_score") >= 0.5).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
