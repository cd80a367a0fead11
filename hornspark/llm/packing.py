"""Packing documents into training sequences by order-preserving dynamic programming.

A partition's documents form one stream of token ids in the order they are read; no shuffle is needed. Windows
of at most 4096 ids cut the stream. Candidates for cuts are the ends of documents (free) and of sentences (a small penalty); in a stretch
of over GRID ids without either, every GRID-th id is one, too (a larger penalty). With p the candidates' positions, the cost of the best cuts up to p[j] is

    f[j] = penalty[j] + SEQUENCE + min over i with p[j] - p[i] <= 4096 of (f[i] + padding(p[j] - p[i]))

where the padding of n ids is 4096 - n, and none at a power of two. With g = f + p the term is g[i] + 4096, or g[i] + n at one of the few powers
of two, so the minimum is that of a sliding window, which a monotone queue gives in constant time. The queue serves a stretch of 4096 ids
at once: what a stretch leaves in it are the least g from each candidate to the stretch's end, rising, and windows of the next stretch take its front
from their first candidate on. Of what their own stretch adds only the running minimum matters, as nothing there has to leave the queue yet.

The stream is planned in blocks of bounded size. A block's last window isn't closed but begins the next block; at a partition's
end it is padded, or cut into powers of two where that costs less. Rows come out in stream order.

Null or empty texts are the end id alone. Texts of any length are packed whole. Repeated rows are packed as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hornspark.llm.bpe_counts import byte_letters, default_tokenizer
from hornspark.llm.common import Memo, bound_batches

WINDOW = 4096
END_ID = 2
#: Costs in ids of padding: a cut at a sentence's end, a cut inside one, and each sequence as such.
SENTENCE, INSIDE, SEQUENCE = 6, 24, 48
#: Distance of the candidates inside a long sentence, or a text without recognised sentence ends.
GRID = 64
#: Ids in a block: what a task holds and plans at once.
BLOCK = 1 << 19
#: Window lengths without padding, apart from a full window.
POWERS = tuple(1 << b for b in range(11, -1, -1))
#: More than any cost.
FAR = 1 << 60
SEPARATOR = "<|startoftext|>"
#: How ids are remembered; a vocabulary has to fit.
ID = "<u2"
END = np.array([END_ID], ID).tobytes()
BLANKS = bytes.maketrans(b"\n", b" ")
BLANKS_AND_LOWER = BLANKS.lower()

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A chunk in lower case that ends in marks: the word before them, and they.
MARKS_AFTER_WORD = re.compile(rb"([^<]*[a-z0-9])([!-/:-@\[-`{-~]+)")

#: Letters a to z, and the small ones of Latin-1, which have no other normal form.
PLAIN_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class ChunkEncoder:
    """Ids by the library, for each blank-free chunk once: blanks never matter to this tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that need no normalizing, written in the alphabet the library has for bytes.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.letters = {k: v for k, v in byte_letters().items() if k != 32}
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.memo, self.words = Memo(1_100_000), Memo(550_000)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.sentence_end, self.word_end = (np.zeros(self.tokenizer.get_vocab_size(), bool) for _ in range(2))
        for token, i in self.tokenizer.get_vocab().items():
            self.word_end[i] = token.endswith("</w>")
            self.sentence_end[i] = bool(token.removesuffix("</w>")) and not token.removesuffix("</w>").strip(".!?")

    def _new(self, raw_chunks: list[bytes]) -> list[bytes]:
        """A letter or digit and the marks after it are never in one token, so words are encoded once whatever marks follow them."""
        cores, tails, marked = list(raw_chunks), [], []
        for k, c in enumerate(raw_chunks):
            if not c.isalpha() and (m := MARKS_AFTER_WORD.fullmatch(c)):
                cores[k] = m[1]
                tails.append(m[2])
                marked.append(k)
        out = self.words.look_up(cores, self._library)
        for k, tail in zip(marked, self.words.look_up(tails, self._library), strict=True):
            out[k] = out[k] + tail
        return out

    def _library(self, raw_chunks: list[bytes]) -> list[bytes]:
        """Plain words, which the normalizer leaves alone and the pattern whole, go to the model at once; others through the whole tokenizer."""
        out: list[bytes | None] = [None] * len(raw_chunks)
        plain = [k for k, c in enumerate(raw_chunks) if c.isalpha() and c.islower() or PLAIN_WORD.fullmatch(c)]
        for lo in range(0, len(plain), 4096):
            some = plain[lo : lo + 4096]
            text = b" ".join([raw_chunks[k] for k in some]).decode("latin-1").translate(self.letters)
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, ID)
            self._cut(out, some, ids, np.flatnonzero(self.word_end[ids])[:-1] + 1, 0)
        rest = [k for k, c in enumerate(raw_chunks) if out[k] is None and b"<|" not in c]
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            text = f" {SEPARATOR} ".join([raw_chunks[k].decode("utf-8", "surrogatepass") for k in some])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, ID)
            self._cut(out, some, ids, np.flatnonzero(ids == self.separator), 1)
        for k, c in enumerate(raw_chunks):
            if out[k] is None:
                out[k] = np.array(self.tokenizer.encode(c.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, ID).tobytes()
        return out

    @staticmethod
    def _cut(out: list, some: list[int], ids: np.ndarray, cuts: np.ndarray, skip: int) -> None:
        """Deal the ids out to the chunks they are of; ``skip`` ids stand between two chunks."""
        raw, at = ids.tobytes(), 0
        for k, end in zip(some, [*cuts.tolist(), len(ids)], strict=True):
            out[k] = raw[2 * at : 2 * end]
            at = end + skip

    @staticmethod
    def folded(text: bytes | str) -> bytes:
        """Line ends as blanks. A-Z go to lower case here, as the tokenizer does it anyhow, but not where that could spell a special string."""
        raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
        return raw.translate(BLANKS if b"<|" in raw else BLANKS_AND_LOWER)

    def _entries(self, keys: list[bytes]) -> list[bytes]:
        """Ids of chunks that bear the blank after them; none at all is a document's end."""
        return [ids if k else END for k, ids in zip(keys, self._new([k[:-1] for k in keys]), strict=True)]

    def encode(self, batch: list[bytes] | list[str]) -> list[np.ndarray]:
        """Each text's ids and the end id. The chunks of all texts lie in one buffer; distinct ones alone become objects."""
        if not batch:
            return []
        raw = [self.folded(t) for t in batch]
        doc_ends = np.cumsum([len(r) + 1 for r in raw])
        data = b"".join(chain.from_iterable(zip(raw, repeat(b" "))))
        cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
        before = np.searchsorted(cuts, doc_ends, side="right")
        offsets = np.concatenate([[0], np.insert(cuts, before, doc_ends)])
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        keys = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = pa.array(self.memo.look_up(keys, self._entries), pa.large_binary()).take(chunks.indices)
        _, at, ids = values.buffers()
        at = np.frombuffer(at, np.int64)[: len(offsets)]
        ends = (at[before + np.arange(1, len(batch) + 1)] // 2).tolist()
        stream = np.frombuffer(ids, ID, ends[-1]).astype("<u4")
        return [stream[a:z] for a, z in pairwise([0, *ends])]


@lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def candidates(length: int, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of possible cuts, ascending, the first 0 and the last ``length``, and their penalties."""
    penalty = np.full(length + 1, -1, np.int8)
    penalty[sentence_ends] = SENTENCE
    penalty[doc_ends] = 0
    penalty[0] = penalty[length] = 0
    known = np.flatnonzero(penalty >= 0)
    inside = (np.diff(known) - 1) // GRID  # candidates to come after each known one
    before = np.repeat(np.cumsum(inside) - inside, inside)
    penalty[np.repeat(known[:-1], inside) + GRID * (np.arange(len(before)) - before + 1)] = INSIDE
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at].astype(np.int64)


def plan(at: np.ndarray, penalty: np.ndarray) -> list[int]:
    """The cheapest cuts: window ends, ascending, the last at[-1]."""
    n = len(at)
    if n < 2:
        return []
    cost = penalty + SEQUENCE
    stretch = (at - 1) // WINDOW  # 0 begins at position 1; the candidate at 0 stands alone before it
    index = np.full(at[-1] + 1, -1, np.int64)
    index[at] = np.arange(n)
    back = at[:, None] - np.array(POWERS)
    source = np.where(back >= 0, index[np.maximum(back, 0)], -1)
    to, which = np.nonzero(source >= 0)  # windows of a power of two, by their ends
    source, power = source[to, which], np.array(POWERS)[which]
    near = stretch[source] == stretch[to]
    near_to, near_source, near_cost = to[near], source[near], power[near] + cost[to[near]]
    far_to, far_source, far_power = to[~near], source[~near], power[~near]
    first = np.searchsorted(at, at - WINDOW)
    starts = np.searchsorted(stretch, np.arange(stretch[-1] + 2))
    near_starts, far_starts = (np.searchsorted(x, starts).tolist() for x in (near_to, far_to))
    g = np.full(n, FAR)
    g[0] = 0
    before, queue = 0, np.array([0, FAR])  # the least g from each candidate of the last stretch to its end
    for k, (a, z) in enumerate(pairwise(starts.tolist())):
        here = queue[first[a:z] - before] + WINDOW
        some = slice(far_starts[k], far_starts[k + 1])
        np.minimum.at(here, far_to[some] - a, g[far_source[some]] + far_power[some])
        here += cost[a:z]
        # Windows that begin in this stretch make g larger than where they begin, so they never lower its running minimum.
        least = np.minimum.accumulate(here)[:-1] + WINDOW
        np.minimum(here[1:], least + cost[a + 1 : z], out=here[1:])
        g[a:z] = here
        some = slice(near_starts[k], near_starts[k + 1])
        i, j, more = near_source[some], near_to[some], near_cost[some]
        while True:  # chains of powers of two, a link at a time
            value = g[i] + more
            better = np.flatnonzero(value < g[j])
            if not len(better):
                break
            np.minimum.at(g, j[better], value[better])
        before, queue = a, np.append(np.minimum.accumulate(g[a:z][::-1])[::-1], FAR)
    out, j = [], n - 1
    while j:
        out.append(int(at[j]))
        lo = first[j]
        size = at[j] - at[lo:j]
        j = int(lo + np.argmin(g[lo:j] + np.where(size & (size - 1), WINDOW, size)))
    return out[::-1]


def tail_cuts(length: int) -> list[int]:
    """Ends of the windows over a partition's last ids: one padded window, or powers of two, largest first."""
    bits = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    if len(bits) == 1 or WINDOW - length <= (len(bits) - 1) * (SEQUENCE + INSIDE):
        return [length]
    return np.cumsum(bits).tolist()


class Stream:
    """The open part of a partition's stream: (doc_id, its ids, from where in the document)."""

    def __init__(self, partition: int, sentence_end: np.ndarray):
        self.docs: list[tuple[int | None, np.ndarray, int]] = []
        self.length, self.next_sequence, self.sentence_end = 0, partition << 32, sentence_end

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.length += len(ids)

    def flush(self, final: bool) -> pa.RecordBatch | None:
        if not self.length:
            return None
        lengths = np.array([len(ids) - start for _, ids, start in self.docs], np.int64)
        doc_ends = np.cumsum(lengths)
        stream = np.concatenate([ids[start:] for _, ids, start in self.docs])
        at, penalty = candidates(self.length, doc_ends, np.flatnonzero(self.sentence_end[stream]) + 1)
        ends = plan(at, penalty)
        last = ends[-2] if len(ends) > 1 else 0
        ends = ends[:-1]
        if final:
            ends += [last + x for x in tail_cuts(self.length - last)]
            last = self.length
        out = self._pieces(ends, doc_ends, lengths) if ends else None
        keep = []
        for (doc_id, ids, start), end, size in zip(self.docs, doc_ends.tolist(), lengths.tolist(), strict=True):
            if end > last:
                keep.append((doc_id, ids, start + max(0, last - (end - size))))
        self.docs, self.length = keep, self.length - last
        return out

    def _pieces(self, ends: list[int], doc_ends: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        """Where windows and documents overlap, in stream order."""
        windows = np.array(ends, np.int64)
        cuts = np.unique(np.concatenate([windows, doc_ends[doc_ends <= windows[-1]]]))
        starts = np.concatenate([[0], cuts[:-1]])
        doc, window = np.searchsorted(doc_ends, starts, side="right"), np.searchsorted(windows, starts, side="right")
        begin = np.array([start for _, _, start in self.docs], np.int64)
        start = starts - (doc_ends - lengths)[doc] + begin[doc]
        size = cuts - starts
        crc = [zlib.crc32(self.docs[d][1][a : a + n]) for d, a, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
        sequence = self.next_sequence + window
        self.next_sequence += len(windows)
        offset = starts - np.concatenate([[0], windows[:-1]])[window]
        total = np.array([len(ids) for _, ids, _ in self.docs], np.int64)[doc]
        ids = pa.array([self.docs[d][0] for d in doc.tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (start, size, crc, total, sequence, offset))], [c.split()[0] for c in SCHEMA.split(", ")])


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece; sequence_id numbers a partition's sequences from partition << 32."""
    path = path or default_tokenizer()
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        Memo.keep_only(enc.memo, enc.words)
        stream = Stream(TaskContext.get().partitionId(), enc.sentence_end)
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]), strict=True):
                stream.add(doc_id, ids)
                if stream.length >= BLOCK and (out := stream.flush(False)):
                    yield out
        if out := stream.flush(True):
            yield out

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
