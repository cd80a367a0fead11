"""Quality by nearest-neighbour voting in a latent semantic space.

A text's terms are pairs and triples of neighbouring character classes, by which prose, tables, shouting and debris differ
in any language, and measures of repetition. A bounded sample of labelled rows gives the term weights and, by a truncated
singular value decomposition, the latent space, about a point halfway between the origin and the sample's mean (CENTRE), so that length of the mean direction
still counts. Its vectors are broadcast. Every document's cosines to all of them come from
blocked matrix products; the NEIGHBOURS nearest vote, each with its similarity to the power POWER. As the sample may hold one class more densely than the
labels do, a vote also counts by the root (SOFTEN) of what would undo that: wholly undone, the rarer class would hardly be heard.

The score is the share of the weight that falls to label 1; predicted is 1 from THRESHOLD on. Null and empty texts have a vector
of their own kind and are scored like others. Without any training label every score is 0.5. Texts are read whole; doc_id only tells held-out rows,
and lang, source and other columns are not read.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.llm.common import give_back, map_batches, table, texts
from hornspark.llm.labelled import held_out, training_rows

#: Labelled rows of each class that the classifier is fitted on at most.
MOST_ROWS = 2000
NEIGHBOURS, LATENT, POWER, THRESHOLD = 15, 48, 8, 0.3
CENTRE, SOFTEN = 0.5, 0.5
PAIRS, TRIPLES, EXTRA = 32 * 32, 1024, 8
TERMS = PAIRS + TRIPLES + EXTRA
#: Bytes of a text looked at together.
STRETCH = 1 << 20


def _classes() -> np.ndarray:
    """Class of each UTF-8 byte: vowels, other small letters, capitals, digits, blank, line end, marks one by one."""
    out = np.full(256, 3, np.int64)
    for b in range(128):
        c = chr(b)
        if c in "aeiou":
            out[b] = 0
        elif c.islower():
            out[b] = 1
        elif c.isupper():
            out[b] = 2
        elif c.isdigit():
            out[b] = 4
        elif c == " ":
            out[b] = 5
        elif c == "\n":
            out[b] = 6
        elif b < 32:
            out[b] = 7
        else:
            out[b] = 8 + "".join(chr(x) for x in range(33, 127) if not chr(x).isalnum()).index(c) % 24 if not c.isalnum() and b < 127 else 7
    return out


CLASS = _classes()


def term_vectors(batch: list[str]) -> np.ndarray:
    """Hellinger-scaled term frequencies of each text, a row each."""
    out = np.zeros((len(batch), TERMS), np.float32)
    for k, t in enumerate(batch):
        raw = t.encode("utf-8", "surrogatepass")
        row = out[k]
        pairs, triples = np.zeros(PAIRS), np.zeros(TRIPLES)
        for lo in range(0, len(raw), STRETCH):  # stretches overlap by what a triple needs
            cls = CLASS[np.frombuffer(raw[lo : lo + STRETCH + 2], np.uint8)]
            pair = cls[:-1] * 32 + cls[1:]
            pairs += np.bincount(pair[:STRETCH], minlength=PAIRS)
            triples += np.bincount((pair[:-1] * 32 + cls[2:])[:STRETCH] * 40503 >> 4 & TRIPLES - 1, minlength=TRIPLES)
        row[:PAIRS] = pairs / max(1, len(raw) - 1)
        row[PAIRS : PAIRS + TRIPLES] = triples / max(1, len(raw) - 2)
        words = raw.split()
        n = len(words)
        lines = raw.split(b"\n")
        extra = row[PAIRS + TRIPLES :]
        if n:
            distinct = len(set(words))
            extra[0] = sum(map(eq, words, words[1:])) / n
            extra[1] = max(0.0, 1 - distinct / n ** 0.9)
            extra[2] = 1 - len(set(lines)) / len(lines)
            extra[3] = 1 - len(set(zip(words, words[1:]))) / max(1, n - 1)
            extra[4] = min(1.0, 4 / n)
        else:
            extra[5] = 1.0
        extra[6] = 0.02
    return np.sqrt(out)


class LatentModel:
    def __init__(self, vectors: np.ndarray, labels: np.ndarray):
        seen = (vectors > 0).mean(axis=0)
        self.idf = np.log((1 + len(vectors)) / (1 + len(vectors) * seen)).astype(np.float32) + 0.5
        self.idf[PAIRS + TRIPLES :] = 1.0
        weighted = vectors * self.idf
        self.mean = weighted.mean(axis=0) * CENTRE
        centred = weighted - self.mean
        rank = min(LATENT, *centred.shape)
        # Randomized range finder with a fixed seed, then a small exact decomposition.
        probe = np.random.default_rng(7).standard_normal((centred.shape[1], rank + 12)).astype(np.float32)
        basis = np.linalg.qr(centred @ probe)[0]
        for _ in range(3):
            basis = np.linalg.qr(centred @ np.linalg.qr(centred.T @ basis)[0])[0]
        self.axes = np.linalg.svd(basis.T @ centred, full_matrices=False)[2][:rank].T.astype(np.float32)
        self.points = self._unit(centred @ self.axes)
        self.labels = labels.astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Similarity-weighted votes, each also weighted by its point's ``weights``."""
        k = min(NEIGHBOURS, len(self.points))
        out = np.empty(len(vectors))
        for lo in range(0, len(vectors), 256):
            cos = self._unit((vectors[lo : lo + 256] * self.idf - self.mean) @ self.axes) @ self.points.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cos, near, 1), 1e-6) ** POWER * weights[near]
            out[lo : lo + 256] = (vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality") -> tuple[LatentModel, np.ndarray] | None:
    """The model and its points' weights, from at most 2 * MOST_ROWS labelled rows; None without any. Term vectors travel in half precision."""
    rows, totals = training_rows(docs, labels, column, {0: MOST_ROWS, 1: MOST_ROWS})

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = term_vectors(texts(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array([v.astype(np.float16).tobytes() for v in vectors], pa.binary())], ["doc_id", "label", "vector"])

    found = map_batches(rows, ["doc_id", "text", "label"], work, "doc_id long, label int, vector binary").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    vectors = np.frombuffer(b"".join(found.column("vector").to_pylist()), np.float16).reshape(-1, TERMS).astype(np.float32)
    label = found.column("label").to_numpy()
    share = {c: totals.get(c, 0) / max(1, int((label == c).sum())) for c in (0, 1)}
    weights = np.array([share[int(c)] for c in label])
    return LatentModel(vectors, label), (weights / weights.max()) ** SOFTEN


def score(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, column))  # some 2 * MOST_ROWS * LATENT floats
    give_back()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = texts(batch.column(1))
        if shared.value is None:
            scores = np.full(len(found), 0.5)
        else:
            model, weights = shared.value
            scores = np.concatenate([model.scores(term_vectors(found[lo : lo + 256]), weights) for lo in range(0, len(found), 256)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = map_batches(docs, ["doc_id", "text"], work, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: rows of ``docs`` that the classifier doesn't reject, as they were. Labels are those of ``sf_dir``."""
    shared = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))
    give_back()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if shared.value is None:
            return batch
        model, weights = shared.value
        found = texts(batch.column(batch.schema.get_field_index("text")))
        scores = np.concatenate([model.scores(term_vectors(found[lo : lo + 256]), weights) for lo in range(0, len(found), 256)])
        return batch.filter(pa.array(scores >= THRESHOLD))

    return map_batches(docs, docs.columns, work, docs.schema)
