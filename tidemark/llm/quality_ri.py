"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

A run without white space is a *word* (its letters in lower case) and a *form* (its case, digits and
punctuation). Each has a fixed sparse random index vector; its word vector is the sum of the index vectors
of its neighbours over the whole corpus, two to either side, and of the form or word it comes with. Words and
forms are hashed to a fixed number of rows, so the vectors' size does not follow the corpus. A document is
the mean and the mean square of its words' and its forms' unit vectors, with its length and repetition.
A network of two layers, written in numpy, learns quality labels from a bounded sample of labelled rows;
a temperature, fitted on sample rows that it did not learn from, calibrates its probabilities.

Scores use the text only. Null and empty texts have no words; they are scored like any other text. Rows
without labels teach nothing but count for the vectors. Repeated rows are kept; an id with several labels
counts once, with their rounded mean. With no labels, or of one kind only, all scores are the smoothed
share of label 1. Further columns play no part.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TwoGenerations, claim, crc_mod, map_batches, small_batches, table

WORD_ROWS, FORM_ROWS, DIM = 1 << 15, 1 << 12, 32
ROWS = WORD_ROWS + FORM_ROWS
NONZERO, WINDOW = 2, 2
#: Bound of the labelled sample that the network learns from, and the share that fits the temperature.
SAMPLE_ROWS, CALIBRATION = 20_000, 5
HIDDEN, STEPS, BATCH, RATE, DECAY = 48, 2500, 256, 3e-3, 1e-4
THRESHOLD = 0.3
FEATURES = 4 * DIM + 5

UPPER, CAPITAL, LOWER, DIGITS, REPEAT = re.compile(r"[^\W\d_a-zß-öø-ÿ]{2,}"), re.compile(r"[^\W\d_a-zß-öø-ÿ][a-zß-öø-ÿ]*"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+"), re.compile(r"(.)\1{3,}")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def rows_of(chunk: str) -> int:
    """Row of the word and of the form of a run, as one number: word * FORM_ROWS + form."""
    form = chunk if chunk.isascii() and chunk.isalpha() and chunk.islower() else REPEAT.sub(r"\1\1\1", DIGITS.sub("9", LOWER.sub("a", CAPITAL.sub("C", UPPER.sub("U", chunk)))))
    form = "a" if form is chunk else form
    word = NOT_LETTERS.sub("", chunk.lower()) or form
    return zlib.crc32(word.encode("utf-8", "replace")) % WORD_ROWS * FORM_ROWS + zlib.crc32(form.encode("utf-8", "replace")) % FORM_ROWS


_rows = TwoGenerations(rows_of)


def rows_in(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    chunks = text.split() if text else []
    both = np.fromiter(map(_rows.__getitem__, chunks), np.int64, len(chunks))
    return both // FORM_ROWS, both % FORM_ROWS + WORD_ROWS


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each row the places of its non-zero entries and their signs."""
    rng = np.random.default_rng(20_240_601)
    places = np.argsort(rng.random((ROWS, DIM), np.float32), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice([-1.0, 1.0], (ROWS, NONZERO))


class ContextSums:
    """Sums of neighbours' index vectors, a row a word or form."""

    def __init__(self):
        self.places, self.signs = index_vectors()
        self.sums = np.zeros(ROWS * DIM)

    def add(self, texts: list[str | None]) -> None:
        targets, contexts = [], []
        for text in texts:
            words, forms = rows_in(text)
            targets += [words, forms]
            contexts += [forms, words]
            for seq in (words, forms):
                for k in range(1, WINDOW + 1):
                    targets += [seq[:-k], seq[k:]]
                    contexts += [seq[k:], seq[:-k]]
        t, c = np.concatenate(targets) * DIM, np.concatenate(contexts)
        for j in range(NONZERO):
            self.sums += np.bincount(t + self.places[c, j], self.signs[c, j], ROWS * DIM)

    def matrix(self) -> np.ndarray:
        return self.sums.reshape(ROWS, DIM).astype(np.int64)


def word_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors (ROWS x DIM) learnt from every text of ``df``; of the same size for any corpus."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        sums = None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sums = sums or ContextSums()
            for i in range(0, len(texts), 128):
                sums.add(texts[i : i + 128])
        if sums is not None:
            m = sums.matrix()
            used = np.flatnonzero(m.any(1))
            for part in np.array_split(used, max(1, len(used) // 4096)):
                flat = pa.array(m[part].ravel(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.FixedSizeListArray.from_arrays(flat, DIM).cast(pa.list_(pa.int64()))], ["row", "sums"])

    parts = df.select(text).mapInArrow(run, "row int, sums array<bigint>")
    total = parts.groupBy("row").agg(*[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(DIM)]).toArrow()
    out = np.zeros((ROWS, DIM), np.float32)
    if total.num_rows:
        m = np.stack([total.column(f"s{j}").to_numpy() for j in range(DIM)], axis=1).astype(np.float64)
        m = np.sign(m) * np.log1p(np.abs(m))
        out[total.column("row").to_numpy()] = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return out


class Pooler:
    def __init__(self, vectors: np.ndarray):
        self.table = np.concatenate([vectors, vectors * vectors], axis=1)

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES), np.float32)
        for i, text in enumerate(texts):
            words, forms = rows_in(text)
            n = len(words)
            if n:
                w, f = self.table[words].mean(0), self.table[forms].mean(0)
                distinct = len(np.unique(words))
                out[i] = np.concatenate([w, f, [np.log1p(n), distinct / n, np.log(distinct) / np.log1p(n), np.linalg.norm(w[:DIM]), np.count_nonzero(words[1:] == words[:-1]) / n]])
        return out


@dataclass
class Network:
    """tanh layer and logistic layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    @classmethod
    def constant(cls, share: float) -> Network:
        z = np.zeros
        return cls(z(FEATURES), np.ones(FEATURES), z((FEATURES, 1)), z(1), z(1), float(np.log(share / (1 - share))))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on the log loss, about STEPS mini-batches; a fixed seed, so equal rows give an equal network."""
        rng = np.random.default_rng(7)
        mean, scale = x.mean(0), x.std(0) + 1e-6
        x = np.clip((x - mean) / scale, -8, 8)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        epochs = -(-STEPS * BATCH // len(x))
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                at = order[i : i + BATCH]
                h = np.tanh(x[at] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[at]) / len(at)
                dh = d[:, None] * p[2] * (1 - h * h)
                t += 1
                for k, g in enumerate((x[at].T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], d.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return cls(mean, scale, p[0], p[1], p[2], float(p[3][0]))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = self.logits(x)
        losses = {t: np.mean(np.logaddexp(0, -np.where(y == 1, z, -z) / t)) for t in 2.0 ** np.arange(-2, 3.01, 0.125)}
        self.temperature = float(min(losses, key=losses.__getitem__))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


def fit_quality(docs: DataFrame, labels: DataFrame, teaches: Column, vectors: np.ndarray, sample_rows: int = SAMPLE_ROWS) -> Network:
    """Learns from labelled documents where ``teaches`` (of labels) holds: at most ``sample_rows`` of them, by hash of the id."""
    few = (
        labels.filter(teaches & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.round(F.avg("quality")).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality sample")), "doc_id")
        .limit(sample_rows)
    )
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        pooler = None
        for batch in batches:
            pooler = pooler or Pooler(held.value)
            x = pooler.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    # of an id that several rows have, one text: the first in order
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    got = texts.mapInArrow(run, "doc_id long, y int, x binary").toArrow()
    y = got.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return Network.constant((y.sum() + 0.5) / (len(y) + 1))
    ids = got.column("doc_id").to_numpy()
    rows = got.column("x").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], rows[i]))
    x = np.frombuffer(b"".join(rows[i] for i in order), np.float32).reshape(len(order), FEATURES).astype(np.float64)
    y, ids = y[order].astype(np.float64), ids[order]
    aside = np.array([zlib.crc32(f"calibration {i}".encode()) % CALIBRATION == 0 for i in ids])
    if len(set(y[~aside].tolist())) < 2:
        aside[:] = False
    network = Network.fit(x[~aside], y[~aside])
    if aside.sum() >= 50:
        network.calibrate(x[aside], y[aside])
    return network


_poolers: dict[str, Pooler] = {}


def score_quality(df: DataFrame, network: Network, vectors: np.ndarray, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """``keep`` columns and ``out``, the score (0 to 1, higher: label 1 likelier) of every whole text."""
    small_batches(df.sparkSession)
    held, name = df.sparkSession.sparkContext.broadcast((network, vectors)), uuid.uuid4().hex

    def work(batch):
        if name not in _poolers:
            _poolers.clear()
            _poolers[name] = Pooler(held.value[1])
        return {out: held.value[0].scores(_poolers[name].features(batch.column(text).to_pylist()))}

    return map_batches(df, keep, work, T.StructType([T.StructField(out, T.DoubleType())]), [text])


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Network, np.ndarray]:
    """The production model: vectors from all documents, labels only of ids whose crc32 modulo 5 is not 0."""
    vectors = word_vectors(docs)
    return fit_quality(docs, labels, crc_mod("doc_id", 5) != 0, vectors), vectors


def op5_quality_ri(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network, vectors = fitted(docs, table(spark, sf_dir, "labels"))
    out = score_quality(docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")), network, vectors, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
