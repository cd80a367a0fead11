"""SentencePiece BPE encoding and decoding, by vectorised merge rounds.

A text is cut into words where no piece of the vocabulary can cross: before a run of blanks, and around line
ends. The distinct words of a batch that are not in the memo are encoded together: flat arrays hold the symbols of all words, and each round
looks up the rank of every adjacent pair, takes the least rank of each word (a segmented minimum), merges that
pair's leftmost disjoint occurrences in all words at once and compacts the arrays, until no pair remains.

Greedy BPE merges one occurrence at a time, so merging all of a word's occurrences in one round is exact only
if none of the pairs that arise ranks as low as the pair just merged. Each round checks that, and in words where it fails it
merges the leftmost occurrence alone.

Texts: null counts as empty; an empty text has no ids and decodes to the empty text. Texts of any length are
encoded whole. Other columns of the input are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hornspark.llm.common import Memo, by_row, map_batches, texts

BLANK = "▁"
INF = np.int64(1 << 40)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """A BPE model with byte fallback: pieces, pair ranks and what a round of merges needs."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not proto.trainer_spec.byte_fallback or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("supported are BPE models with byte fallback, a dummy prefix and no other normalization")
        self.pieces = [p.piece for p in proto.pieces]
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(re.search(f"[^{BLANK}]{BLANK}|.\n|\n.", p, re.S) for p in normal):
            raise ValueError("a piece crosses a word's start or a line end")
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == 3}
        self.unknown = {i for i, p in enumerate(proto.pieces) if p.type == 2}
        self.unk_surface = proto.trainer_spec.unk_surface
        # Symbols: the pieces, then characters that occur in pieces without being one, then one for all others.
        letters = sorted({c for p in normal for c in p} - normal.keys())
        symbol = dict(normal) | {c: len(self.pieces) + k for k, c in enumerate(letters)}
        self.other = len(self.pieces) + len(letters)
        self.char_symbol = np.full(0x110000, self.other, np.int64)
        for s, i in symbol.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = i
        # Equal scores share a rank: between them the leftmost goes first.
        ranks = {s: k for k, s in enumerate(sorted({proto.pieces[i].score for i in normal.values()}, reverse=True))}
        keys, values, merged = [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(ranks[proto.pieces[i].score])
                    merged.append(i)
        self._index(np.array(keys, np.int64), np.array(values, np.int64), np.array(merged, np.int64))
        self.surface = [b"" if i in self.control else self.unk_surface.encode() if i in self.unknown else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.last_special = max(*self.byte_of, *self.control, *self.unknown)
        self.decimal = [str(i) for i in range(len(self.pieces))]

    def _index(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """An open hash table of the pairs, probed for whole arrays."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.slot_key, self.slot_rank, self.slot_merged = np.full(size, -1, np.int64), np.full(size, INF), np.zeros(size, np.int64)
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = (self._hash(keys[left]) + step) & (size - 1)
            free = self.slot_key[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slot_key[at[put]], self.slot_rank[at[put]], self.slot_merged[at[put]] = keys[left[put]], ranks[left[put]], merged[left[put]]
            left = np.delete(left, put)
            step += 1
        self.probes = step

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (INF: no piece) and merged symbol of each pair."""
        keys = a << 20 | b
        rank, merged = np.full(len(keys), INF), np.zeros(len(keys), np.int64)
        at, todo = self._hash(keys), np.arange(len(keys))
        for step in range(self.probes):
            slot = (at[todo] + step) & (len(self.slot_key) - 1)
            found = self.slot_key[slot]
            hit = found == keys[todo]
            rank[todo[hit]], merged[todo[hit]] = self.slot_rank[slot[hit]], self.slot_merged[slot[hit]]
            todo = todo[~hit & (found != -1)]
            if not len(todo):
                break
        return rank, merged

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (blanks as ▁)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        sym = self.char_symbol[points]
        sym = np.where(sym < len(self.pieces), sym, len(self.pieces) + points)  # as yet without ids: by their code point
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            sym, word = self._round(sym, word, done)
        if not done:
            return [np.zeros(0, np.int32) for _ in words]
        word, sym = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        if (sym >= len(self.pieces)).any():
            word, sym = self._bytes(word, sym)
        order = np.argsort(word, kind="stable")
        flat = sym[order].astype(np.int32)
        cuts = np.searchsorted(word[order], np.arange(len(words) + 1)).tolist()
        return [flat[a:b] for a, b in pairwise(cuts)]

    def _symbols(self, sym: np.ndarray) -> np.ndarray:
        return np.where(sym < len(self.pieces), sym, self.char_symbol[np.maximum(sym - len(self.pieces), 0)])

    def _ranks(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = np.full(len(sym), INF), np.zeros(len(sym), np.int64)
        at = np.flatnonzero(word[:-1] == word[1:])
        known = self._symbols(sym)
        rank[at], merged[at] = self.pairs(known[at], known[at + 1])
        return rank, merged

    def _round(self, sym: np.ndarray, word: np.ndarray, done: list) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = self._ranks(sym, word)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
        finished = least == INF
        if finished.any():
            done.append((word[finished], sym[finished]))
            go = ~finished
            sym, word, rank, merged, least = sym[go], word[go], rank[go], merged[go], least[go]
        if not len(sym):
            return sym, word
        hit = rank == least
        at = np.flatnonzero(hit)
        run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]  # of overlapping occurrences every other one, from the left
        new, owner = self._merge(sym, word, merged, at)
        several = len(at) > len(np.unique(word[at]))
        if several:
            # As each occurrence is merged, those before it are merged already and those after it aren't: the new
            # symbol's pair with what stands right of it now, and all pairs of the finished state, have to rank above.
            again, _ = self._ranks(new, owner)
            bound = np.zeros(word[-1] + 1, np.int64)
            bound[word] = least
            right = at[at + 2 < len(word)]
            right = right[word[right + 2] == word[right]]
            early, _ = self.pairs(self._symbols(merged[right]), self._symbols(sym[right + 2]))
            unsafe = np.unique(np.concatenate([owner[again <= bound[owner]], word[right][early <= least[right]]]))
            if len(unsafe):
                bad = np.isin(word[at], unsafe)
                first = np.r_[True, word[at][1:] != word[at][:-1]]
                new, owner = self._merge(sym, word, merged, at[~bad | first])
        return new, owner

    @staticmethod
    def _merge(sym: np.ndarray, word: np.ndarray, merged: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sym = sym.copy()
        sym[at] = merged[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        return sym[keep], word[keep]

    def _bytes(self, word: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the ids of their UTF-8 bytes."""
        rare = np.flatnonzero(sym >= len(self.pieces))
        spelled = [[self.byte_id[b] for b in chr(s - len(self.pieces)).encode("utf-8", "surrogatepass")] for s in sym[rare].tolist()]
        counts = np.ones(len(sym), np.int64)
        counts[rare] = list(map(len, spelled))
        at, sym = np.cumsum(counts) - counts, np.repeat(sym, counts)
        for start, ids in zip(at[rare].tolist(), spelled, strict=True):
            sym[start : start + len(ids)] = ids
        return np.repeat(word, counts), sym

    def decode_bytes(self, ids, *, at_start: bool = True) -> bytes:
        """UTF-8 of the decoded ids. Runs of byte ids are decoded together, each invalid byte to U+FFFD; the first blank of the text is the dummy prefix."""
        out, pending = [], bytearray()
        for i in ids:
            b = self.byte_of.get(int(i))
            if b is not None:
                pending.append(b)
                at_start = False
                continue
            if pending:
                out.append(_replace(bytes(pending)))
                pending.clear()
            s = self.surface[int(i)]
            if at_start and s:
                if int(i) not in self.unknown and s[:1] == b" ":
                    s = s[1:]
                at_start = False
            out.append(s)
        if pending:
            out.append(_replace(bytes(pending)))
        return b"".join(out)


def _replace(raw: bytes) -> bytes:
    out, k = [], 0
    while k < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[k : k + n].decode("utf-8").encode())
                k += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�".encode())
            k += 1
    return b"".join(out)


def split_words(text: str) -> list[str]:
    """Words as memo keys: ``w`` for one blank and w, a key with blanks in it as it stands, "\\n..." for what follows a line end."""
    if BLANK in text:
        text = text.replace(BLANK, " ")
    out: list[str] = []
    for k, line in enumerate(text.split("\n")):
        if k == 0 and text:
            line = " " + line
        if "  " in line or line[-1:] == " ":
            words = [w[1:] if w[0] == " " and w[1:2] not in ("", " ") else w for w in re.findall(r" *[^ ]+| +", line)]
            if k:
                if line[0] == " ":
                    out.append("\n")
                else:
                    words[0] = "\n" + words[0]
            out += words
        else:
            words = line.split(" ")  # before the first blank: nothing, or the rest of a word that a line end cut off
            if k:
                words[0] = "\n" + words[0]
                out += words
            else:
                out += words[1:]
    return out


def surface_word(key: str) -> str:
    return (key if key[0] in "\n " else " " + key).replace(" ", BLANK)


@lru_cache(2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(2)
def _memo(path: str, kind: str) -> Memo:
    return Memo(500_000)


def encode_texts(batch: list[str], path: str) -> list[np.ndarray]:
    """Ids of each whole text, without begin or end ids."""
    rows, memo, m = [split_words(t) for t in batch], _memo(path, "ids"), model(path)
    ids = by_row(rows, lambda keys: memo.look_up(keys, lambda new: m.encode_words([surface_word(k) for k in new])))
    return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in ids]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>."""
    path = path or default_model()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encode_texts(texts(batch.column(1)), path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs, ["doc_id", "text"], work, "doc_id long, ids array<int>", lambda: (_memo(path, "ids"),))


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids decode to the empty text."""
    path = path or default_model()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        out = [m.decode_bytes(x or ()).decode() for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return map_batches(ids, ["doc_id", "ids"], work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode every text, decode its ids, digest both.

    The memo holds, for each word, its ids as text and what these ids decode to inside a text; a document's ids
    and decoded text are these in a row. No byte run crosses words, as each starts with a blank or a line end's own ids.
    """
    path = path or default_model()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, memo = model(path), _memo(path, "digest")

        def entries(new: list[str]):
            for array in m.encode_words([surface_word(k) for k in new]):
                ids = array.tolist()
                yield len(ids), ",".join([m.decimal[i] for i in ids]), b"".join([m.surface[i] for i in ids]) if min(ids) > m.last_special else m.decode_bytes(ids, at_start=False)

        rows = [split_words(t) for t in texts(batch.column(1))]
        counts, ids_sha, text_sha = [], [], []
        for found in by_row(rows, lambda keys: memo.look_up(keys, entries)):
            counts.append(sum([x[0] for x in found]))
            ids_sha.append(hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest())
            decoded = b"".join([x[2] for x in found])
            text_sha.append(hashlib.sha256(decoded[1:] if decoded[:1] == b" " else decoded).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )

    return map_batches(docs, ["doc_id", "text"], work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: (_memo(path, "digest"),))
