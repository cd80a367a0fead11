"""Near duplicates by fast similarity sketching, banding and exact verification.

Dahlgaard, Knudsen, Thorup, Fast Similarity Sketching (2017): each element is thrown into one of t bins in
round after round, and a bin keeps the least (round, value). After a round in which all bins are full a set is done; rounds from t
on aim at one bin each, so none stays empty, and the share of equal coordinates estimates the Jaccard
similarity with the concentration of t independent ones.

The steps:

1. Sketch every text (one pass, no shuffle); keep doc_id, size, a 128-bit digest of the whole shingle set, band keys and one bit of each coordinate.
2. Documents of equal sets form a class; the least doc_id stands for it. Only such heads go on, however many copies there are.
3. Heads that share a band key form a bucket. In it they are joined if the bits say that they are about as similar as asked (MARGIN
   standard errors below still count); others, such as texts that share a template, are not. Components of these joins bound where links can lie.
4. Each such component's full shingle sets meet. A prefix filter finds all pairs that may
   be similar, intersections are counted exactly, and pairs already connected are skipped. This verification is exact.
5. Components of the links, carried back to all documents of the classes.

Buckets and components meet in tasks of bounded size. A larger one is dealt into blocks, each with a copy of its hub, the document that most others are
likely to be near. What isn't connected with the hub in its own block, a stray, visits all other blocks in a second pass; documents
of different blocks that are connected with the hub need no comparison. So a large group around one text costs one copy of each
member, not one for each pair of blocks.

With BANDS bands a pair just at the threshold shares no band with a chance of LOSS at most; the rows of a band follow from that (8 at 0.85, 6 at 0.8).

A null or empty text, or one of blanks, has no shingles and is linked with nothing. Rows with a null doc_id get their class's component but
never name one. Repeated rows are copies. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from hornspark.llm.common import map_batches, mix, texts
from hornspark.llm.components import components
from hornspark.llm.shingles import shingle_sets, with_ids
from hornspark.sources.scratch import Scratch

BANDS, LOSS = 64, 1e-8
#: Standard errors of the estimate by bits that a pair in a bucket may lie below the threshold: all but one in 10 ** 10 do.
MARGIN = 6.5
#: Shingles (8 bytes each) and documents of one block where sets are compared, and documents of one where bits are.
BLOCK_SHINGLES, BLOCK_DOCS, BLOCK_BITS = 250_000, 256, 1024
ROUND = 0x9E3779B97F4A7C15


def fast_similarity_sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t coordinates for each set; of empty sets all are the largest integer."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    items = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    full = np.iinfo(np.uint64).max
    sketch = np.full(len(sets) * t, full, np.uint64)
    for r in range(2 * t):
        if not len(items):
            break
        h = mix(items + np.uint64((r + 1) * ROUND & (1 << 64) - 1))
        bins = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if r < t else np.full(len(items), r - t)
        np.minimum.at(sketch, owner * t + bins, np.uint64(r) << np.uint64(48) | (h & np.uint64((1 << 40) - 1)) << np.uint64(8))
        open_sets = (sketch.reshape(-1, t) == full).any(axis=1)
        go = open_sets[owner]
        items, owner = items[go], owner[go]
    return sketch.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sketch), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sketch), b + 1, np.uint64)
        for c in range(rows):
            key = mix(key + sketch[:, b * rows + c])
        out[:, b] = key
    return out.view(np.int64)


def band_rows(percent: int) -> int:
    """Rows of a band such that a pair of just this similarity shares none of the bands with a chance of LOSS at most."""
    return max(1, int(np.log(1 - LOSS ** (1 / BANDS)) / np.log(min(percent, 99.9) / 100)))


def sketches(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (null: no shingles), bands, bits (the lowest of each coordinate's value)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts(batch.column(1)), width)
        sketch = fast_similarity_sketch(sets, BANDS * rows)
        bits = np.packbits(((sketch >> np.uint64(8)) & np.uint64(1)).astype(np.uint8), axis=1)
        digests = [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(band_keys(sketch, BANDS, rows).ravel()), BANDS).cast(pa.list_(pa.int64())), pa.array([x.tobytes() for x in bits], pa.binary())],
            ["doc_id", "n_shingles", "digest", "bands", "bits"],
        )

    return map_batches(docs, ["doc_id", "text"], work, "doc_id long, n_shingles long, digest binary, bands array<long>, bits binary")


def alike_groups(payloads: list[bytes], percent: int, label: np.ndarray) -> np.ndarray:
    """Labels of single linkage, starting from ``label``, over all pairs whose bits agree as those of similar sets do.

    Each document meets the first of every group, then the whole of those groups that it isn't joined with by that.
    """
    bits = np.frombuffer(b"".join(payloads), np.uint64).reshape(len(payloads), -1)
    n, share = bits.shape[1] * 64, percent / 100
    agree = (1 + share) / 2
    most = n * (1 - agree) + MARGIN * np.sqrt(n * agree * (1 - agree))  # differing bits
    groups: dict[int, list[int]] = {}
    for x in range(len(bits)):
        groups.setdefault(int(label[x]), [])

    def near(x: int, some: list[int]) -> np.ndarray:
        return np.bitwise_count(bits[some] ^ bits[x]).sum(axis=1) <= most

    for x in range(len(bits)):
        mine = int(label[x])
        others = [k for k, g in groups.items() if g and k != mine]
        if others:
            hit = near(x, [groups[k][0] for k in others])
            joined = [k for k, h in zip(others, hit, strict=True) if h]
            rest = [(k, i) for k, h in zip(others, hit, strict=True) if not h for i in groups[k][1:]]
            if rest:
                joined += dict.fromkeys(k for (k, _), h in zip(rest, near(x, [i for _, i in rest]), strict=True) if h)
            for k in joined:
                label[label == k] = mine
                groups[mine] = groups.pop(k) + groups[mine]
        groups[mine].append(x)
    return label


def similar_groups(payloads: list[bytes], percent: int, label: np.ndarray) -> np.ndarray:
    """Labels of single linkage, starting from ``label``, over all pairs of sets with 100 * intersection >= percent * union.

    If two sets are similar, each shares with the other one of its first n - ceil(percent * n / 100) + 1 elements in any
    order common to all; the order is by rarity. Whole intersections are then counted over posting lists.
    """
    sets = [np.frombuffer(b, np.uint64) for b in payloads]
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    owner = np.repeat(np.arange(m), sizes)
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_token = np.argsort(token, kind="stable")
    postings, start = owner[by_token], np.concatenate([[0], np.cumsum(counts)])
    ends = np.cumsum(sizes)
    for x in range(m):
        mine = token[ends[x] - sizes[x] : ends[x]]
        prefix = sizes[x] + (-percent * sizes[x] // 100) + 1
        rare = mine[np.lexsort((mine, counts[mine]))[:prefix]]
        rare = rare[counts[rare] > 1]
        if not len(rare):
            continue
        near = np.unique(np.concatenate([postings[start[k] : start[k + 1]] for k in rare]))
        near = near[(label[near] != label[x]) & (100 * sizes[near] >= percent * sizes[x]) & (100 * sizes[x] >= percent * sizes[near])]
        if not len(near):
            continue
        if len(near) > 4:
            mine = mine[counts[mine] > 1]
            common = np.bincount(np.concatenate([postings[start[k] : start[k + 1]] for k in mine]), minlength=m)[near]
        else:
            common = np.array([np.intersect1d(sets[x], sets[y], assume_unique=True).size for y in near])
        linked = near[100 * common >= percent * (sizes[x] + sizes[near] - common)]
        if len(linked):
            label[np.isin(label, label[linked])] = label[x]
    return label


HUB, OWN, VISITOR = 0, 1, 2


def _meet(rows: DataFrame, percent: int, join: Callable[[list[bytes], int, np.ndarray], np.ndarray]) -> DataFrame:
    """One Arrow stream a task over rows (group, block, n_blocks, role, tied, doc_id, payload), cut where group or block changes.

    Edges a, b from each document to the least one it is joined with; and, in the first pass over a divided group, its strays as b = null.
    ``tied`` rows are known to be joined with the hub.
    """

    def results(rows: list[tuple]) -> pa.RecordBatch | None:
        role, tied, ids, payloads = zip(*(r[3:] for r in rows), strict=True)
        label = np.arange(len(ids))
        known = np.flatnonzero(tied)
        label[known] = known[0] if len(known) else 0
        label = join(list(payloads), percent, label)
        least: dict[int, int] = {}
        for k, i in zip(label.tolist(), ids, strict=True):
            least[k] = min(i, least.get(k, i))
        edges = [(i, least[k]) for k, i, t in zip(label.tolist(), ids, tied, strict=True) if least[k] != i and not (t and len(known) == len(ids))]
        hub = next((k for k, r in zip(label.tolist(), role, strict=True) if r == HUB), None)
        first_pass = hub is not None and VISITOR not in role
        strays = [(i, None) for k, i, r in zip(label.tolist(), ids, role, strict=True) if first_pass and r == OWN and k != hub]
        if not edges and not strays:
            return None
        a, b = zip(*edges, *strays, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([rows[0][0]] * len(a), pa.int64())], ["a", "b", "group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    if len(held) > 1 and (out := results(held)):
                        yield out
                    held = []
                held.append(row)
        if len(held) > 1 and (out := results(held)):
            yield out

    columns = ["group", "block", "n_blocks", "role", "tied", "doc_id", "payload"]
    return rows.select(columns).repartition("group", "block").sortWithinPartitions("group", "block", "role", "doc_id").mapInArrow(run, "a long, b long, group long")


def connected(rows: DataFrame, percent: int, join: Callable[[list[bytes], int, np.ndarray], np.ndarray], scratch: Scratch) -> DataFrame:
    """Edges a, b that connect what ``join`` finds in each group of rows (group, n_blocks, hub, doc_id, payload)."""
    own = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int"))
    is_hub = F.col("doc_id") == F.col("hub")
    no = F.lit(False)
    everywhere = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    hubs = rows.filter(is_hub & (F.col("n_blocks") > 1)).withColumn("block", everywhere).withColumn("role", F.lit(HUB)).withColumn("tied", no)
    rest = own.filter(~is_hub | (F.col("n_blocks") == 1)).withColumn("role", F.lit(OWN)).withColumn("tied", no)
    first = scratch.write(_meet(hubs.unionByName(rest), percent, join))
    edges = first.filter("b is not null").select("a", "b")
    strays, n = scratch.write_counted(first.filter("b is null").select(F.col("a").alias("doc_id"), "group"))
    if not n:
        return edges
    # Strays visit the other blocks of their group. A stray may itself be in a large group, so this is an ordinary join on both.
    marked = own.join(strays.withColumn("stray", F.lit(True)), ["group", "doc_id"], "left").withColumn("stray", F.coalesce("stray", F.lit(False)))
    marked = marked.join(strays.select("group").distinct(), "group", "left_semi")
    visits = marked.filter("stray").withColumn("own_block", F.col("block")).withColumn("block", everywhere).filter("block != own_block").drop("own_block")
    second = marked.withColumn("role", F.lit(OWN)).unionByName(visits.withColumn("role", F.lit(VISITOR))).withColumn("tied", ~F.col("stray"))
    return edges.unionByName(_meet(second, percent, join).filter("b is not null").select("a", "b"))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.select("doc_id", "text")
    # Joins on doc_id merge at any size: both sides grow with the documents, and a broadcast would pass through the driver.
    all_sketches = scratch.write(sketches(docs, width, band_rows(percent)))
    classes = scratch.write(all_sketches.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("head")))
    heads = all_sketches.join(classes.select(F.col("head").alias("doc_id")).filter("doc_id is not null").hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    keyed = heads.select("doc_id", F.explode("bands").alias("group"))
    shared = keyed.groupBy("group").agg(F.min("doc_id").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    # Both sides of this join are shuffled plainly, so that the engine can split a bucket of very many documents.
    shared, keyed = scratch.write(shared), scratch.write(keyed)
    buckets = scratch.write(keyed.join(shared, "group").withColumn("n_blocks", F.ceil(F.col("size") / BLOCK_BITS).cast("int")))
    scratch.forget(shared, keyed)
    weights = scratch.write(buckets.groupBy("doc_id").agg(F.sum("size").alias("weight")))
    bits = all_sketches.join(weights.select("doc_id").hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", F.col("bits").alias("payload"))
    near = components(connected(buckets.join(bits.hint("merge"), "doc_id").select("group", "n_blocks", "hub", "doc_id", "payload"), percent, alike_groups, scratch), scratch)

    members = near.select(F.col("a").alias("doc_id"), F.col("b").alias("group")).union(near.select("b", "b").distinct())
    members = scratch.write(members.join(all_sketches.select("doc_id", "n_shingles").dropDuplicates(["doc_id"]).hint("merge"), "doc_id").join(weights.hint("merge"), "doc_id"))
    size = F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int").alias("n_blocks")
    # The document that shares most buckets with most others is the likeliest to be what they were copied from.
    groups = scratch.write(members.groupBy("group").agg(size, F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("hub")))
    members = scratch.write(members.select("doc_id", "group").join(groups, "group"))

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s.tobytes() for s in shingle_sets(texts(batch.column(1)), width)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), *batch.columns[2:]], ["doc_id", "payload", "group", "n_blocks", "hub"])

    sets = map_batches(with_ids(docs, members, "inner").dropDuplicates(["doc_id"]), ["doc_id", "text", "group", "n_blocks", "hub"], sets_of, "doc_id long, payload binary, group long, n_blocks int, hub long")
    links = scratch.write(connected(sets, percent, similar_groups, scratch))
    if not groups.filter("n_blocks > 1").isEmpty():  # links of undivided groups are whole already; only those found in several tasks have to meet
        links = components(links, scratch)
    scratch.forget(buckets, weights, members, groups)

    of_head = classes.join(links.select(F.col("a").alias("head"), "b"), "head", "left").select("digest", F.coalesce("b", "head").alias("component"))
    joined = all_sketches.select("doc_id", "n_shingles", "digest").join(of_head, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: rows of ``docs`` but for those that are linked, directly or not, with a smaller doc_id. Rows without id stay."""
    scratch = Scratch(spark)
    found = near_duplicates(docs, scratch=scratch)
    dropped = scratch.write(found.filter("not kept and doc_id is not null").select("doc_id").distinct())
    return with_ids(docs, dropped, "left_anti")


#: The rows of ``near_duplicates(documents, width=3, percent=85)`` by comparing all pairs that share a shingle.
ORACLE = """
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents
), s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) end as sh from d
), e as (select doc_id, len(sh) as n, unnest(sh) as x from s
), p as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), l as (select a, b from p where 100 * c >= 85 * (na + nb - c)
), edges as (select a, b from l union all select b, a from l
), reach as (select doc_id as a, doc_id as b from documents union select reach.a, edges.b from reach join edges on reach.b = edges.a
), least as (select a, min(b) as component_id from reach group by a)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept from s join least on least.a = s.doc_id
"""
