"""Toxicity by two class-conditional Kneser-Ney language models with shared backoff.

From a bounded sample of labelled texts come the counts of word pairs of either class, a pair once for each text
that has it, so that one text's repetitions weigh no more than one. With n_c the counts of class c, D the discounts
and q the continuation probability of a word (the number of different words before it, over both classes, with a floor
for unseen words), the models are

    p_c(w)     = k_c * max(n_c(w) - D1, 0) / N_c + L * q(w)
    p_c(w | v) = k_cv * max(n_c(v w) - D2, 0) / n_c(v) + L_v * p_c(w)

L and L_v are the larger of the classes' backoff masses, and k_c, k_cv scale what remains so that each sums to one.
Thus backoff weight and backoff distribution are shared: a word or pair that neither class supports says nothing, and a
rare one says little. Where a class has not seen v, its backoff mass is all, so L_v is 1 and either class has p_c(w) there.
As this alone lets the many rare words of long texts drown the telling ones (figures in the README), both classes back off further, log-linearly, to what they share:
p_c ** h times shared ** (1 - h), so that a log ratio counts h times. h falls smoothly, never to 0, where the counts could well be chance
(a likelihood-ratio statistic G2 around SIGNIFICANT and below) and, for words, where the ratio is around MILD and below. Every counted word and pair is scored; none is dropped.
A text's evidence is the length-normalised difference of its log-likelihoods, over the whole text and in
its worst stretch of WINDOW words; a logistic curve, fitted on sample rows kept out of the counts, turns both into a score.

The model is broadcast; it holds every word of the counted texts, and every pair whose ratio isn't its word's own. Null and
empty texts get the score of no evidence. Without labels of both classes every score is 0. Texts are read whole; doc_id
only tells held-out rows, and lang, source and other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornspark.llm.common import give_back, map_batches, table, texts
from hornspark.llm.labelled import held_out, training_rows
from hornspark.sources.scratch import Scratch

#: Labelled rows of each class that the models are fitted on at most; a quarter of them calibrates.
MOST_ROWS = {0: 6000, 1: 3000}
WINDOW = 24
#: G2 of a word's or pair's counts at which half of the log ratio is left, as below it they are more and more taken for chance.
SIGNIFICANT = 12.0
#: A word's log ratio at which half of it is left, as below it is more and more taken for language, topic or length, which the labels were not about.
MILD = 1.5
#: How fast both fall.
STEEP = 4
#: Parts in which the pairs come to the driver.
PARTS = 8
WORD = regex.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class RatioModel:
    """Log ratios of words and of pairs, toxic over ordinary."""

    def __init__(self, unigrams: pa.Table, bigrams: Iterable[pa.Table]):
        """w, ratio of every word; v, w, extra of pairs, table by table, where extra is what a pair adds to its second word's own ratio. v is empty at a text's start."""
        names = pa.array(sorted({"", *unigrams["w"].to_pylist()}), pa.string())
        self.index = {w: i + 1 for i, w in enumerate(names.to_pylist())}
        size = len(names) + 1
        self.uni = np.zeros(size)

        def ids(words: pa.ChunkedArray) -> np.ndarray:
            return pc.index_in(words, names).to_numpy().astype(np.int64) + 1

        if len(unigrams):
            self.uni[ids(unigrams["w"])] = unigrams["ratio"].to_numpy()
        keys, extra = [np.array([-1], np.int64)], [np.zeros(1, np.float32)]
        for t in bigrams:
            if len(t):
                keys.append(ids(t["v"]) * size + ids(t["w"]))
                extra.append(t["extra"].to_numpy().astype(np.float32))
        self.keys, self.extra = np.concatenate(keys), np.concatenate(extra)
        order = np.argsort(self.keys)
        self.keys, self.extra = self.keys[order], self.extra[order]
        self.curve = (np.zeros(4), np.zeros(4), np.ones(4))

    def evidence(self, text: str) -> tuple[float, float, float, float]:
        """Mean log ratio, that of the worst stretch, and both times the square root of the length's logarithm."""
        return self.evidences([text])[0]

    def evidences(self, batch: list[str]) -> list[tuple[float, float, float, float]]:
        """Of each text; the pairs of all are looked up at once, in ascending order, which is much faster."""
        get, start = self.index.get, self.index[""]
        rows = [np.array([start, *(get(w, 0) for w in words(t))], np.int64) for t in batch]
        keys = np.concatenate([r[:-1] * len(self.uni) + r[1:] for r in rows] + [np.zeros(0, np.int64)])
        order = np.argsort(keys)
        slot = np.searchsorted(self.keys, keys[order])
        slot = np.minimum(slot, len(self.keys) - 1)
        extra = np.zeros(len(keys))
        extra[order] = np.where(self.keys[slot] == keys[order], self.extra[slot], 0.0)
        out, at = [], 0
        for r in rows:
            n = len(r) - 1
            if not n:
                out.append((0.0, 0.0, 0.0, 0.0))
                continue
            total = np.concatenate([[0.0], np.cumsum(self.uni[r[1:]] + extra[at : at + n])])
            at += n
            k = min(WINDOW, n)
            mean, worst = total[-1] / n, float((total[k:] - total[:-k]).max()) / WINDOW
            scale = np.sqrt(np.log1p(n))
            out.append((mean, worst, mean * scale, worst * scale))
        return out

    def scores(self, batch: list[str]) -> np.ndarray:
        x = np.array(self.evidences(batch)).reshape(-1, 4)
        weights, mean, spread = self.curve
        return 1 / (1 + np.exp(-np.clip((x - mean) / spread @ weights[: x.shape[1]] + self.bias, -30, 30)))

    bias = 0.0

    def calibrate(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Weighted ridge logistic regression by Newton's method."""
        mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[(x - mean) / spread, np.ones(len(x))]
        ridge = np.diag([1.0] * x.shape[1] + [1e-3])
        beta = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (label - p)) - ridge @ beta)
            beta += step
            if np.abs(step).max() < 1e-6:
                break
        self.curve, self.bias = (beta[:-1], mean, spread), float(beta[-1])


def pair_counts(rows: DataFrame) -> DataFrame:
    """v, w, n0, n1: texts of either class that have w after v; v is empty at a text's start."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for t, c in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            found = words(t)
            counts[c].update(set(zip(["", *found], found)))
        keys = list({**counts[0], **counts[1]})
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[0][k] for k in keys], pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64())],
            ["v", "w", "n0", "n1"],
        )

    found = map_batches(rows, ["doc_id", "text", "label"], work, "v string, w string, n0 long, n1 long")
    return found.groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def _g2(n0: Column, n1: Column, share1) -> Column:
    """Twice the log likelihood ratio of the counts against class shares (1 - share1, share1)."""

    def part(n: Column, share) -> Column:
        return F.when(n > 0, n * F.log(n / ((n0 + n1) * share))).otherwise(0.0)

    return 2 * (part(n0, 1 - share1) + part(n1, share1))


def _half_at(x: Column, half: float) -> Column:
    """From 0 to 1 as x grows; one half at ``half``."""
    return 1 / (1 + F.pow(half / F.greatest(x, F.lit(1e-9)), STEEP))


def smoothed(pairs: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, float]] | None:
    """The models' probabilities, all by aggregations; None unless both classes have words.

    Of words: w, n0, n1, p0, p1. Of pairs whose first word both classes have: v, w, n0, n1, c0, c1 (counts of v), backoff, b0, b1 (p of w after v), and the
    word's p0, p1. Constants: p of an unseen word, the same in both classes, and the toxic share of all counts.
    """

    def occurrences(c: str) -> list:
        return [F.count_if(F.col(c) == k).alias(f"{c}_{k}") for k in (1, 2)]

    uni = pairs.groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("before"))
    u = uni.agg(F.sum("n0").alias("N0"), F.sum("n1").alias("N1"), F.sum("before").alias("types"), F.count("*").alias("V"), F.count_if(F.col("n0") > 0).alias("T0"), F.count_if(F.col("n1") > 0).alias("T1"), *occurrences("n0"), *occurrences("n1")).first()
    p = pairs.agg(*occurrences("n0"), *occurrences("n1")).first()
    if not u["N0"] or not u["N1"]:
        return None
    d1 = _discount(u["n0_1"] + u["n1_1"], u["n0_2"] + u["n1_2"])
    d2 = _discount(p["n0_1"] + p["n1_1"], p["n0_2"] + p["n1_2"])
    masses = [d1 * u[f"T{c}"] / u[f"N{c}"] for c in (0, 1)]
    shared = max(masses)
    floor = 0.5 / (u["types"] + 0.5 * (u["V"] + 1))
    q = (F.col("before") + 0.5) * (2 * floor)

    def unigram(c: int):
        kept = (1 - shared) / (1 - masses[c])
        return F.lit(kept) * F.greatest(F.col(f"n{c}") - d1, F.lit(0.0)) / u[f"N{c}"] + F.lit(shared) * q

    uni = uni.select("w", "n0", "n1", unigram(0).alias("p0"), unigram(1).alias("p1"))
    context = pairs.groupBy("v").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), F.count_if(F.col("n0") > 0).alias("t0"), F.count_if(F.col("n1") > 0).alias("t1"))
    # Where a class has no v its backoff mass is 1, and so is L_v: such pairs are as likely as their second word, in both classes.
    every = pairs.join(context.filter("c0 > 0 and c1 > 0"), "v").join(uni.select("w", "p0", "p1"), "w")
    every = every.withColumn("backoff", F.greatest(d2 * F.col("t0") / F.col("c0"), d2 * F.col("t1") / F.col("c1")))

    def bigram(c: int):
        kept = (1 - F.col("backoff")) / (1 - d2 * F.col(f"t{c}") / F.col(f"c{c}"))
        return kept * F.greatest(F.col(f"n{c}") - d2, F.lit(0.0)) / F.col(f"c{c}") + F.col("backoff") * F.col(f"p{c}")

    every = every.select("v", "w", "n0", "n1", "c0", "c1", "p0", "p1", "backoff", bigram(0).alias("b0"), bigram(1).alias("b1"))
    return uni, every, {"unseen": shared * floor, "share1": u["N1"] / (u["N0"] + u["N1"])}


def build(pairs: DataFrame, scratch: Scratch | None = None) -> RatioModel:
    """The models' log ratios from the pair counts; the words and pairs of the bounded sample come to the driver, the pairs in PARTS parts."""
    found = smoothed(pairs)
    if found is None:
        return RatioModel(pa.table({"w": [], "ratio": []}), ())
    uni, every, constants = found
    ratio = F.log(F.col("p1") / F.col("p0"))
    words_ratio = ratio * _half_at(F.abs(ratio), MILD) * _half_at(_g2(F.col("n0"), F.col("n1"), F.lit(constants["share1"])), SIGNIFICANT)
    # By chance w would follow v in either class as often as v occurs there and w's own ratio says.
    tilt = F.col("c1") * F.exp(ratio)
    extra = (F.log(F.col("b1") / F.col("b0")) - ratio) * _half_at(_g2(F.col("n0"), F.col("n1"), tilt / (F.col("c0") + tilt)), SIGNIFICANT)
    scored = (scratch or Scratch(pairs.sparkSession)).write(every.select("v", "w", extra.cast("float").alias("extra")))
    part = F.pmod(F.xxhash64("v", "w"), F.lit(PARTS))
    return RatioModel(uni.select("w", words_ratio.alias("ratio")).toArrow(), (scored.filter(part == k).toArrow() for k in range(PARTS)))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> RatioModel | None:
    spark = docs.sparkSession
    rows, totals = training_rows(docs, labels, column, MOST_ROWS)
    if not totals.get(0) or not totals.get(1):
        return None
    scratch = Scratch(spark)
    rows = scratch.write(rows.repartition(16, "doc_id"))
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    model = build(scratch.write(pair_counts(rows.filter(~calibrates))), scratch)
    shared = spark.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array(shared.value.evidences(texts(batch.column(1)))).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), *(pa.array(found[:, k]) for k in range(4))], ["doc_id", "label", "a", "b", "c", "d"])

    found = map_batches(rows.filter(calibrates), ["doc_id", "text", "label"], work, "doc_id long, label int, a double, b double, c double, d double").toArrow().sort_by("doc_id")
    label = found.column("label").to_numpy()
    scratch.drop()
    if len(set(label.tolist())) == 2:
        x = np.c_[tuple(found.column(c).to_numpy() for c in "abcd")]
        weight = np.array([totals[int(c)] / (label == c).sum() for c in label])
        model.calibrate(x, label, weight * len(label) / weight.sum())
    return model


def _scores(model: RatioModel | None, batch: list[str]) -> np.ndarray:
    return np.zeros(len(batch)) if model is None else model.scores(batch)


def score(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, column))
    give_back()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, texts(batch.column(1))))], ["doc_id", "score"])

    scored = map_batches(docs, ["doc_id", "text"], work, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: rows of ``docs`` with a score below 0.5, as they were. Labels are those of ``sf_dir``."""
    shared = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))
    give_back()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_scores(shared.value, texts(batch.column(batch.schema.get_field_index("text")))) < 0.5))

    return map_batches(docs, docs.columns, work, docs.schema)
