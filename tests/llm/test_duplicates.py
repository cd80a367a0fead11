"""Near duplicates and fingerprints against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from helpers import CLASHES, ODD, components, frame, shingles
from pyspark.sql import functions as F

from hornspark.llm import components as graph
from hornspark.llm import fingerprints, near_dups
from hornspark.llm.shingles import shingle_sets
from hornspark.sources.scratch import Scratch


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words)


def corpus(seed=1):
    """Copies, a hot group of near copies, chains, unrelated and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    out = list(ODD)
    base = rng.choices(vocabulary, k=120)
    out += [edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.05, 0.1])) for _ in range(150)]
    out += [" ".join(base)] * 40
    for _ in range(30):
        words = rng.choices(vocabulary, k=rng.randint(3, 200))
        for _ in range(4):  # a chain: each like the one before
            out.append(" ".join(words))
            for k in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
    out += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(100)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("width", "percent", "docs_in_block"), [(3, 85, 1024), (5, 80, 1024), (3, 85, 20)])
def test_components(spark, monkeypatch, width, percent, docs_in_block):
    monkeypatch.setattr(near_dups, "BLOCK_DOCS", docs_in_block)
    monkeypatch.setattr(near_dups, "BLOCK_BITS", docs_in_block)
    if docs_in_block < 100:
        monkeypatch.setattr(graph, "HUB", 3)
    texts = corpus()
    docs = frame(spark, texts)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("x"))
    want = components(texts, width, percent)
    rows = near_dups.near_duplicates(docs.repartition(7), width=width, percent=percent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(shingles(texts[r.doc_id], width)), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_texts_of_one_template_are_never_joined(spark, monkeypatch):
    """4000 texts of pairwise likeness 0.3: none is a candidate, so no full set is compared."""
    rng = random.Random(9)
    form = [f"t{i}" for i in range(60)]
    texts = [" ".join(form + [f"u{rng.randrange(10**9)}" for _ in range(70)]) for _ in range(4000)]
    a, b = shingles(texts[0], 3), shingles(texts[1], 3)
    assert 0.25 < len(a & b) / len(a | b) < 0.35
    texts += [texts[7] + " x", texts[8][:-12] + " y z"]
    compared = []
    plain = near_dups.map_batches

    def spy(df, *args, **options):
        if "n_blocks" in df.columns:
            compared.append(df.count())
        return plain(df, *args, **options)

    monkeypatch.setattr(near_dups, "map_batches", spy)
    rows = near_dups.near_duplicates(frame(spark, texts), width=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in rows if r.component_id != r.doc_id} == {4000: 7, 4001: 8}
    assert compared == [4]


def test_a_cloud_of_near_copies_in_many_blocks(spark, monkeypatch):
    """Blocks meet through their hub; strays, alike to one another but not to the hub, are found across blocks."""
    monkeypatch.setattr(near_dups, "BLOCK_DOCS", 16)
    monkeypatch.setattr(near_dups, "BLOCK_BITS", 16)
    rng = random.Random(10)
    base = [f"w{i}" for i in range(300)]
    texts = [edited(rng, base, 0.012) for _ in range(200)]
    for _ in range(20):
        far = edited(rng, base, 0.03).split()
        texts += [" ".join(far), edited(rng, far, 0.006)]
    rng.shuffle(texts)
    want = components(texts, 3, 85)
    assert len(set(want)) > 5
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(frame(spark, texts), width=3, percent=85).collect()}
    assert got == dict(enumerate(want))


def test_components_of_a_hub(spark):
    """A vertex with 10**5 neighbours: its edges stay spread over the tasks."""
    n = 100_000
    edges = spark.range(1, n).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).union(spark.range(n, n + 50).select("id", F.col("id") + 1))
    found = graph.components(edges, Scratch(spark))
    assert found.count() == n - 1 + 50 and found.groupBy("b").count().orderBy("b").collect() == [(0, n - 1), (n, 50)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sides = graph._with_least(edges.union(edges.select("b", "a")), n // 100)
        held = sides.filter("a = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(held) >= 4 and max(r["count"] for r in held) < n / 2


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "A  b c\nd"), (None, "a b c d"), (None, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(docs, width=3, percent=85).collect()), key=repr)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, 3, False), (None, None, True), (9, 9, True)], key=repr)
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    texts = corpus(2)
    docs = frame(spark, texts)
    want = components(texts, 5, 80)
    kept = near_dups.keep_one(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, c in enumerate(want) if c == i}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 2, 3, 50, 1000)]
    sketch = near_dups.fast_similarity_sketch([*sets, np.zeros(0, np.uint64)], 128)
    full = np.iinfo(np.uint64).max
    assert (sketch[:-1] != full).all() and (sketch[-1] == full).all()
    errors = []
    for _ in range(60):
        common, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (300, 100, 100))
        x, y = near_dups.fast_similarity_sketch([np.unique(np.r_[common, a]), np.unique(np.r_[common, b])], 128)
        errors.append((x == y).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_neighbour_fingerprints(spark):
    texts = corpus(3)
    rng = random.Random(4)
    ids = rng.sample(range(10**6), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("range", F.lit(1)).withColumn("guard", F.lit(1))
    monkey = fingerprints.RANGE_ROWS
    fingerprints.RANGE_ROWS = 32
    try:
        rows = {r.doc_id: r for r in fingerprints.neighbour_fingerprints(docs.repartition(5)).collect()}
    finally:
        fingerprints.RANGE_ROWS = monkey
    assert len(rows) == len(texts)
    order = sorted(zip(ids, texts, strict=True))
    errors = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        for near, other in ((r.near_edited, changed), (r.near_next, following)):
            a, b = shingles(t, 5), shingles(other, 5)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
        if changed == t:
            assert r.near_edited == 1.0 and r.fingerprint == r.edited_fingerprint
    assert np.std(errors) < 0.05 and abs(np.mean(errors)) < 0.01
    by_text = {}
    for i, t in order:
        assert by_text.setdefault(t or "", rows[i].fingerprint) == rows[i].fingerprint


def test_fingerprints_bin_by_bin(spark):
    """One set at a time, one bin at a time, with integers of Python."""
    mask, k = (1 << 64) - 1, fingerprints.BINS

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    rng = random.Random(6)
    texts = ["", "one", "a b c d e f", " ".join(f"w{rng.randrange(90)}" for _ in range(300)), "long text " * 300_000, " ".join(map(str, range(5000)))]
    want = []
    for s in shingle_sets(texts, fingerprints.WIDTH):
        bins = [None] * k
        for x in s.tolist():
            h = mix(x + 0x632BE59BD9B4E019 & mask)
            at, value = (h >> 40) * k >> 24, h & (1 << 40) - 1
            bins[at] = value if bins[at] is None else min(bins[at], value)
        full = list(bins)
        for at in range(k):
            attempt = 0
            while full[at] is None and any(b is not None for b in bins):
                attempt += 1
                full[at] = bins[(mix(at * 0x9E3779B97F4A7C15 + attempt & mask) >> 33) % k]
        want.append("".join(f"{mix(b + 0x9E3779B97F4A7C15 & mask) & 255:02x}" for b in full) if len(s) else "-" + "00" * k)
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_fingerprint_corners(spark):
    docs = spark.createDataFrame([(None, "p q r s t u"), (4, "a"), (4, "b"), (None, None)], "doc_id long, text string")
    rows = fingerprints.neighbour_fingerprints(docs).collect()
    assert len(rows) == 4 and all(0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.neighbour_fingerprints(docs.limit(0)).count() == 0
    one = fingerprints.neighbour_fingerprints(docs.filter("text = 'a'")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs.filter("text = 'a'")).collect()} == {4: one[0].fingerprint}


def test_batches_of_fewer_words_than_a_shingle():
    assert [len(s) for s in shingle_sets(["a b", "", "c"], 5)] == [1, 0, 1]
    assert [len(s) for s in shingle_sets([], 5)] == []
