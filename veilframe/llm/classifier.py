"""Quality classifier: random-indexing word vectors, pooled, and a calibrated two-layer network.

1. Every token of every document falls into a bucket of a fixed number by the
   hash of its letters in lower case, and into one of a few markers by its
   form (case, digits, attached signs, same as the token before). Each bucket
   and marker owns a sparse random index vector; a bucket's word vector is the
   sum of the index vectors of what stands within WINDOW tokens of it, over
   the whole corpus. Sums are integers, so reruns agree.
2. A document's features are the means of its tokens' vectors, of words and of
   markers, and the logarithm of its length.
3. A network of one hidden layer is trained on the driver from at most
   TRAIN_ROWS labelled documents (those with the smallest hash of their id;
   the bound is a parameter), in numpy. A fifth of them sets the temperature
   that calibrates the probabilities.
4. Every document is scored.

The vectors' table has a fixed size, whatever the corpus: it is what travels
to the driver and back. Labels, language, source and ids are never inputs.

Defined results: null and empty texts have the features of no tokens and get
a score like any other; a null doc_id is not held out and not learnt from;
rows of labels with a null label don't count and of repeated ones each
counts; documents that share an id are each learnt from with its label, all of
them together at most train_rows (those with the smallest hash of their features); without labels of both kinds all scores are the share of label 1, or
0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import Recent, sliced, written

BUCKETS, MARKERS, WIDTH, NONZERO = 1 << 14, 256, 32, 4
WINDOW = 2
#: Rows of the vectors' table that are summed and sent as one value.
SLICE = 256
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE = 24, 30, 256, 0.01
THRESHOLD = 0.7
#: Bytes of tokens that a worker keeps, about.
KEPT_BYTES = 64 << 20

_SIZE = BUCKETS + MARKERS


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero entries of each bucket's and marker's index vector."""
    made = np.random.default_rng(seed)
    return made.integers(0, WIDTH, (_SIZE, NONZERO)), made.choice(np.array([-1.0, 1.0]), (_SIZE, NONZERO))


def token_code(token: bytes) -> int:
    """A token's 40 random bits, bucket and marker, packed into 62 bits."""
    text = token.decode("utf-8", "surrogatepass")
    letters = "".join(filter(str.isalpha, text))
    signs = len(text) - len(letters)
    marker = 128 if not letters else 64 * (len(letters) > 1 and letters.isupper()) + 32 * letters[0].isupper()
    marker += 16 * any(map(str.isdigit, text)) + min(signs, 3) * 4 + 2 * (signs > 0 and not text[-1].isalpha()) + (text[-1] in ".,;:?!")
    bucket = xxhash.xxh3_64_intdigest(letters.lower().encode("utf-8", "surrogatepass")) % BUCKETS
    return (xxhash.xxh3_64_intdigest(token) >> 26) << 24 | bucket << 8 | marker


@cache
def known_tokens() -> Recent:
    """The tokens of a worker process, whatever its tasks (tasks find them by this function's name)."""
    return Recent(token_code, KEPT_BYTES, 160)


def tokens_of(texts: list[str | None], known: Recent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, marker, document) of every token of a batch; a repeated token has marker 192 and more."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    packed = np.fromiter((known[t] for s in split for t in s), np.int64, int(counts.sum()))
    doc = np.repeat(np.arange(len(texts)), counts)
    marker = packed & 0xFF
    again = np.zeros(len(packed), bool)
    if len(packed) > 1:
        again[1:] = (packed[1:] >> 24 == packed[:-1] >> 24) & (doc[1:] == doc[:-1])
    marker[again] = 192 + (marker[again] & 31)
    return (packed >> 8) & 0xFFFF, marker + BUCKETS, doc


def _accumulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of one task, as rows (slice, sums)."""
    places, signs = index_vectors()
    total, known = np.zeros(_SIZE * WIDTH), known_tokens()
    seen = False
    for batch in sliced(batches, 1024):
        bucket, marker, doc = tokens_of(batch.column("text").to_pylist(), known)
        seen = seen or bool(len(doc))
        pairs = [(marker, bucket)]
        for step in range(1, WINDOW + 1):
            same = doc[step:] == doc[:-step]
            for of in (bucket, marker):
                a, b = of[step:][same], of[:-step][same]
                pairs += [(a, b), (b, a)]
        for a, b in pairs:
            for k in range(NONZERO):
                total += np.bincount(a * WIDTH + places[b, k], signs[b, k], _SIZE * WIDTH)
    if seen:
        sums = total.astype(np.int64).reshape(-1, SLICE * WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], names=["slice", "sums"])


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("sums"))
    return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The unit vectors of all buckets and markers from all documents, of fixed size.

    Tasks' sums are added in two levels, so that no task adds more than a
    part of them.
    """
    partial = docs.select("text").mapInArrow(_accumulated, "slice int, sums binary").withColumn("part", F.spark_partition_id() % 64)
    first = partial.groupBy("slice", "part").applyInArrow(_summed, "slice int, sums binary")
    rows = first.groupBy("slice").applyInArrow(_summed, "slice int, sums binary").collect()  # _SIZE / SLICE rows
    out = np.zeros((_SIZE // SLICE, SLICE * WIDTH))
    for row in rows:
        out[row["slice"]] = np.frombuffer(row["sums"], np.int64)
    out = out.reshape(_SIZE, WIDTH)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray, known: Recent) -> np.ndarray:
    """A row of features for each text."""
    bucket, marker, doc = tokens_of(texts, known)
    out = np.zeros((len(texts), 2 * WIDTH + 1), np.float64)
    counts = np.bincount(doc, minlength=len(texts))
    some = np.flatnonzero(counts)
    if len(some):
        starts = np.r_[0, np.cumsum(counts[some])[:-1]]
        per = counts[some][:, None]
        out[some, :WIDTH] = np.add.reduceat(vectors[bucket], starts, axis=0, dtype=np.float64) / per
        out[some, WIDTH:-1] = np.add.reduceat(vectors[marker], starts, axis=0, dtype=np.float64) / per
    out[:, -1] = np.log1p(counts)
    return out


class Network:
    """Features to the probability of label 1: standardised, one hidden layer of tanh, temperature."""

    def __init__(self, width: int, seed: int = 11) -> None:
        made = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w1, self.b1 = made.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = made.normal(0, HIDDEN**-0.5, HIDDEN), 0.0
        self.temperature, self.constant = 1.0, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 13) -> Network:
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        made = np.random.default_rng(seed)
        order = made.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        params = [self.w1, self.b1, self.w2, np.array([self.b2])]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for i in range(0, len(used), BATCH):
                rows = used[(i if i else 0) : i + BATCH] if not epoch else made.choice(used, min(BATCH, len(used)), replace=False)
                h = np.tanh(z[rows] @ params[0] + params[1])
                error = (1.0 / (1.0 + np.exp(-np.clip(h @ params[2] + params[3][0], -500, 500))) - y[rows]) / len(rows)
                back = np.outer(error, params[2]) * (1 - h * h)
                grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ error + 1e-4 * params[2], np.array([error.sum()])]
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = params[0], params[1], params[2], float(params[3][0])
        if len(held):
            logits, target = self.logits(x[held]), y[held]

            def loss(t: float) -> float:
                u = np.clip(logits / t, -500, 500)
                return float(np.mean(np.logaddexp(0, u) - target * u))

            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
        return self


def held_out(doc_id: str = "doc_id"):
    """True for rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_tokens()
        for batch in sliced(batches, 1024):
            x = pooled(batch.column("text").to_pylist(), vectors.value, known)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    return run


def _scores(vectors, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_tokens()
        for batch in sliced(batches, 1024):
            scores = model.value.scores(pooled(batch.column("text").to_pylist(), vectors.value, known))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return run


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs (doc_id, text), learnt from labels (doc_id, label) outside the held-out rows."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows), "labels")  # at most train_rows
    sample = docs.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_features(vectors), "label double, x array<double>")
    sample = written(sample, "sample")
    if sample.count() > train_rows:  # ids that repeat in docs
        sample = sample.orderBy(F.xxhash64("x"), "x", "label").limit(train_rows)
    rows = sample.collect()  # at most train_rows
    order = sorted(rows, key=lambda r: (r["label"], r["x"]))  # the same order in every run
    x = np.array([r["x"] for r in order]).reshape(len(order), 2 * WIDTH + 1)
    model = spark.sparkContext.broadcast(Network(x.shape[1]).fit(x, np.array([r["label"] for r in order])))
    return docs.withColumn("held_out", held_out()).mapInArrow(_scores(vectors, model), "doc_id long, held_out boolean, score double, predicted int")
