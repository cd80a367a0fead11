"""SentencePiece, token counts and packing against the libraries."""

import hashlib
import random
import sys
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import CLASHES, ODD, frame
from pyspark.sql import functions as F

from hornspark.llm import bpe_counts, packing, pieces

DOCS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_counts.default_tokenizer())


def noise(seed, count, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(count)]


def test_pieces_equal_library(sp):
    texts = [t or "" for t in ODD] + noise(1, 800, "abcde \nthenrins  ▁é中.,0") + noise(2, 200, "ab")
    for t, ids in zip(texts, pieces.encode_texts(texts, pieces.default_model()), strict=True):
        assert ids.tolist() == sp.encode(t), t


def test_decode_equals_library_on_any_ids(sp):
    rng = random.Random(3)
    m = pieces.model(pieces.default_model())
    for _ in range(800):
        ids = [rng.choice([rng.randrange(0, 260), rng.randrange(0, 32000), 29871]) for _ in range(rng.randint(0, 8))]
        assert m.decode_bytes(ids).decode() == sp.decode(ids), ids


def test_a_new_pair_of_lower_rank_is_merged_first():
    """Where a merge makes a pair that ranks before it, the other occurrences have to wait."""
    m = object.__new__(pieces.PieceModel)
    m.pieces = list("xab") + ["ab", "xab", "aba"]
    m.char_symbol = np.full(0x110000, 6, np.int64)
    for i, c in enumerate("xab"):
        m.char_symbol[ord(c)] = i
    m._index(np.array([1 << 20 | 2, 3 << 20 | 1]), np.array([5, 2]), np.array([3, 5]))  # a+b, then ab+a, which ranks before
    assert [x.tolist() for x in m.encode_words(["abab", "xabab"])] == [[5, 2], [0, 5, 2]]


def test_round_trip_query(spark, sp):
    docs = spark.read.parquet(DOCS).unionByName(frame(spark, ODD, 10**6))
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(1))
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pieces.round_trip(docs).collect()
    assert len(got) == len(want)
    for r in got:
        ids = sp.encode(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert back == {i: t.replace("▁", " ") for i, t in want.items()}


def test_token_counts(spark, words):
    docs = spark.read.parquet(DOCS).unionByName(frame(spark, ODD + noise(4, 300, "abcde \nthenrins  'sé中.,0<|>LǗ\t"), 10**6))
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe_counts.token_counts(docs).collect():
        n = len(words.encode(want[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(want[r.doc_id].encode()), n > 2048)


def test_counts_at_every_prefix(spark, words):
    c = bpe_counts.counter(bpe_counts.default_tokenizer())
    odd = ["x'rex 'l 'll 'lx !'s ''s '", "İİ ete\u0301 \u1112\u1161\u11ab ȩ\u0301x", "!<|endoftext|>' s<|startof", "a\t\tb\x85c·1²"]
    for t in ["The quickbrownfox, it's laziness. Übergröße 12", "unbelievability of", "", "a  \n b <|endoftext|>x", *odd, *noise(7, 200, "abstrelv''!.1e\u0301İß日<|> ")]:
        want = [len(words.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert c.prefix_counts(t).tolist() == want
        for budget in (0, 1, 3, 100):
            assert c.fit(t, budget) == max(i for i, n in enumerate(want) if n <= budget)
    cut = bpe_counts.truncate(frame(spark, ["one two three four", None]), 3).orderBy("doc_id").collect()
    assert [r.text.strip() for r in cut] == ["one two three", ""]


def test_counts_around_every_code_point(words):
    texts = [f"a{chr(x)}b{chr(x)}{chr(x)}1" for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    for lo in range(0, len(texts), 1 << 16):
        some = texts[lo : lo + (1 << 16)]
        assert bpe_counts.count_chunks(some, bpe_counts.default_tokenizer()) == [len(e.ids) for e in words.encode_batch_fast(some, add_special_tokens=False)]


def test_prefix_counts_of_long_runs_without_blanks(words):
    c = bpe_counts.counter(bpe_counts.default_tokenizer())
    c.prefix_counts("é")
    rng = random.Random(2)
    began = time.process_time()
    for t in ("ab1é." * 40000, "".join(rng.choice("abcdefghij") for _ in range(100_000))):
        found = c.prefix_counts(t)
        assert found[-1] == len(words.encode(t, add_special_tokens=False).ids) and (np.diff(found) >= -2).all()
        for i in rng.sample(range(len(t)), 3):
            assert found[i] == len(words.encode(t[:i], add_special_tokens=False).ids)
    assert time.process_time() - began < 30


def check_pieces(rows, docs, words):
    """Every id in exactly one piece, sequences gapless and of at most 4096 ids; the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for i, t in docs.items():
        ids = np.array([*words.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    pad = total = 0
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += at
        pad += 0 if at & (at - 1) == 0 else 4096 - at
    return pad / total


def test_packing(spark, words, monkeypatch):
    docs = spark.read.parquet(DOCS).unionByName(frame(spark, [*ODD, "word " * 20000, "no end " * 9000], 10**6))
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    assert check_pieces(packing.pack(docs.coalesce(1)).collect(), want, words) < 0.02
    assert check_pieces(packing.pack(docs.repartition(5)).collect(), want, words) < 0.03
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_is_optimal():
    """Against dynamic programming over all pairs of candidates."""
    rng = random.Random(5)
    for _ in range(30):
        at = np.array(sorted({0, *(rng.randrange(1, 20000) for _ in range(60)), 20000}))
        at = np.array(sorted({*at.tolist(), *range(0, 20000, 4096), *(int(p) + (1 << rng.randrange(12)) for p in rng.choices(at[:-1], k=20))} - {*range(20001, 30000)}))
        pen = np.array([rng.choice([0, 6, 24]) for _ in at])

        def pad(n):
            return 0 if n in packing.POWERS else 4096 - n

        f = [0] + [10**9] * (len(at) - 1)
        for j in range(1, len(at)):
            f[j] = min(f[i] + pad(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 4096) + pen[j] + packing.SEQUENCE
        ends = packing.plan(at, pen)
        where = {int(p): k for k, p in enumerate(at)}
        cost = sum(pad(b - a) + pen[where[b]] + packing.SEQUENCE for a, b in zip([0, *ends], ends, strict=False))
        assert cost == f[-1] and ends[-1] == 20000


def test_plan_of_blocks_carries_over(spark, words, monkeypatch):
    enc = packing.encoder(packing.default_tokenizer())
    stream = packing.Stream(0, enc.sentence_end)
    stream.add(1, np.arange(10000, dtype="<u4") % 300)
    first = stream.flush(False)
    sent = sum(first.column("length").to_pylist())
    assert first.num_rows >= 2 and stream.length == 10000 - sent > 0
    last = stream.flush(True)
    assert sum(last.column("length").to_pylist()) == 10000 - sent and last.column("start")[0].as_py() == sent and stream.flush(True) is None


def test_every_sentence_end_is_a_candidate():
    ends = np.array([3, 5, 9, 14, 17, 30])
    at, penalty = packing.candidates(40, np.array([40]), ends)
    assert [p for p, c in zip(at.tolist(), penalty.tolist(), strict=True) if c == packing.SENTENCE] == ends.tolist()


def test_little_padding_without_sentence_ends():
    lengths = np.array([100, 4200] * 40)
    ends = np.cumsum(lengths)
    cuts = packing.plan(*packing.candidates(int(ends[-1]), ends, np.array([], int)))
    windows = np.diff([0, *cuts])
    assert windows.sum() == ends[-1] and windows.max() <= packing.WINDOW
    padding = sum(0 if n in (*packing.POWERS, packing.WINDOW) else packing.WINDOW - n for n in windows[:-1].tolist())
    assert padding < 0.02 * packing.WINDOW * len(windows)


def test_packing_encodes_as_the_library_and_looks_up_a_word_of_a_batch_once(words, monkeypatch):
    enc = packing.encoder(packing.default_tokenizer())
    some = [t or "" for t in ODD] + ["Some words, some Words\nand  others. " * 500, " \n ", "<|endoftext|> Some <|startoftext|>Words", "ÅÉ A-Z"] * 2
    asked = []
    monkeypatch.setattr(enc.memo, "look_up", lambda keys, new, own=enc.memo.look_up: (asked.extend(keys), own(keys, new))[1])
    for t, ids in zip(some, enc.encode(some), strict=True):
        assert ids.dtype == "<u4" and ids.tolist() == [*words.encode(t, add_special_tokens=False).ids, packing.END_ID]
    assert len(asked) == len(set(asked))
    assert [x.tolist() for x in enc.encode([""])] == [[packing.END_ID]] and enc.encode([]) == []


def test_plan_takes_no_step_of_python_for_each_candidate():
    rng = np.random.default_rng(3)
    at, penalty = packing.candidates(1 << 18, np.array([1 << 18]), np.unique(rng.integers(1, 1 << 18, 1 << 14)))
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        ends = packing.plan(at, penalty)
    finally:
        sys.settrace(before)
    assert ends[-1] == 1 << 18 and lines < len(at)
