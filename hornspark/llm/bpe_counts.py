"""Token counts by prefix dynamic programming over a word-end BPE tokenizer.

A byte-level BPE encoding has a useful shape: a sequence of tokens is the encoding of its text exactly if each
adjacent pair is the encoding of the pair's text. Every prefix of a word therefore has one last token, and the
tokens before it encode the rest. So one pass over a word's bytes finds, for every prefix, the last token and
the count: try the vocabulary entries that end there, longest first, until one is compatible with the last token of the
prefix before it. Counts at all prefixes answer questions of truncation and budget: a reader takes a text one character at a time, keeps
the open word's tables, and closes the word at every character, so that no prefix is encoded again.

In this tokenizer a word's last symbol bears an end mark, so two tables run side by side: tokens without the mark,
over which the pass goes, and tokens with it, one of which closes each prefix taken as a whole word.

Counts are those of the library: its normalizer and word pattern are applied by the library's own objects (only words of a to z alone, which they leave whole, skip them), special strings in
texts count as one token each, nothing is added, cut or padded. Null counts as empty, with no tokens. Texts are
counted whole; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from copy import copy
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hornspark.llm.common import Memo, by_row, map_batches, texts


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The library writes each byte as a printable character; that alphabet, asked of the library itself, for str.translate of Latin-1."""
    from tokenizers.pre_tokenizers import ByteLevel

    level, letters = ByteLevel(add_prefix_space=False, use_regex=False), {}
    for point in chain(range(0x800), range(0x800, 0xD800, 0x40), range(0xE000, 0x10000, 0x40), range(0x10000, 0x110000, 0x1000)):
        letters.update(zip(chr(point).encode(), "".join(s for s, _ in level.pre_tokenize_str(chr(point))), strict=True))
    return letters


class PrefixCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bpe, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if bpe["type"] != "BPE" or bpe["end_of_word_suffix"] != "</w>" or bpe["unk_token"] or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("supported are byte-level BPE tokenizers with the end mark </w>")
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.end = bpe["end_of_word_suffix"]
        self.translate = byte_letters()
        vocab: dict[str, int] = bpe["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(bpe["merges"])}
        made = {a + b for a, b in self.rank}
        usable = [t for t in vocab if t not in self.specials and (t in made or len(t) == 1 or (len(t) == 1 + len(self.end) and t.endswith(self.end)))]
        # Tokens that no encoding ever holds would break the scheme: keep those that encode to themselves.
        self.inner = {t: (i := vocab[t]) for t in usable if not t.endswith(self.end)}
        self.closing = {t[: -len(self.end)]: vocab[t] for t in usable if t.endswith(self.end) and len(t) > len(self.end)}
        self.symbols = {i: [t] for t, i in vocab.items()}
        self.text_of = {i: t for t, i in vocab.items()}
        own = self._owns
        self.inner = {t: i for t, i in self.inner.items() if own(t, False)}
        self.closing = {t: i for t, i in self.closing.items() if own(t, True)}
        self.longest = max(map(len, chain(self.inner, self.closing)))
        self.inner_lengths, self.closing_lengths = self._lengths(self.inner), self._lengths(self.closing)
        self.fits: dict[int, bool] = {}
        self.kinds: dict[str, str] = {}

    def _merge(self, parts: list[str]) -> list[str]:
        """Plain BPE: the pair of least rank, leftmost first."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _spell(self, text: str, closed: bool) -> list[str]:
        return [*text[:-1], text[-1] + self.end] if closed else list(text)

    def _owns(self, text: str, closed: bool) -> bool:
        return len(text) == 1 or len(self._merge(self._spell(text, closed))) == 1

    @staticmethod
    def _lengths(table: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """By an entry's last three letters the lengths of such entries, longest first, and always two and one."""
        found: dict[str, set[int]] = {}
        for t in table:
            if len(t) > 2:
                found.setdefault(t[-3:], set()).add(len(t))
        return {k: (*sorted(v, reverse=True), *SHORT) for k, v in found.items()}

    def compatible(self, a: int, b: int) -> bool:
        """The encoding of both tokens' text is these two tokens."""
        key = a << 20 | b
        found = self.fits.get(key)
        if found is None:
            x, y = self.text_of[a], self.text_of[b]
            closed = y.endswith(self.end) and len(y) > len(self.end) and y[: -len(self.end)] in self.closing and self.closing[y[: -len(self.end)]] == b
            text = x + (y[: -len(self.end)] if closed else y)
            found = self._merge(self._spell(text, closed)) == [x, y]
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = found
        return found

    def _token(self, table: dict[str, int], lengths: dict[str, tuple[int, ...]], word: str, j: int, last: list[int]) -> int:
        """Start of the longest entry ending at j that is compatible with the token before it; -1 if there is none."""
        fits = self.fits
        for n in lengths.get(word[j - 3 : j] if j > 2 else "", SHORT):
            if n <= j and (t := table.get(word[j - n : j])) is not None:
                if n == j:
                    return 0
                key = last[j - n] << 20 | t
                if fits[key] if key in fits else self.compatible(last[j - n], t):
                    return j - n
        return -1

    def grow(self, word: str, last: list[int], count: list[int]) -> None:
        """Extend the last open token and the count of each prefix, which may be given for some first ones, to the whole word."""
        inner, lengths, token = self.inner, self.inner_lengths, self._token
        for j in range(len(last), len(word) + 1):
            k = token(inner, lengths, word, j, last)
            last.append(inner[word[k:j]] if k >= 0 else -1)
            count.append(count[k] + 1 if k >= 0 else 0)

    def closed_count(self, word: str, last: list[int], count: list[int], end: int | None = None) -> int:
        """Tokens of the word up to ``end``; ``last`` and ``count`` reach one short of it at least."""
        k = self._token(self.closing, self.closing_lengths, word, len(word) if end is None else end, last)
        return count[k] + 1 if k >= 0 else 0

    def word_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of a word (in the byte alphabet), each taken as a word: [0] is for the empty one."""
        last, count = [-1], [0]
        self.grow(word, last, count)
        return [0, *(self.closed_count(word, last, count, j) for j in range(1, len(word) + 1))]

    def count_word(self, word: str) -> int:
        if word in self.specials:
            return 1
        last, count = [-1], [0]
        self.grow(word[:-1], last, count)
        return self.closed_count(word, last, count)

    def shown(self, char: str) -> str:
        """A character in the byte alphabet."""
        return char.encode("utf-8").decode("latin-1").translate(self.translate)

    def words(self, batch: list[str]) -> list[list[str]]:
        """Words in the byte alphabet, and special strings, of each blank-free text, as the library cuts it."""
        out: list[list[str]] = [[] for _ in batch]
        plain: list[tuple[int, str]] = []
        for i, text in enumerate(batch):
            if text.isascii() and text.isalpha():
                out[i].append(text.lower())
            elif "<|" in text and any(s in text for s in self.specials):
                at = 0
                for m in self.special_pattern.finditer(text):
                    out[i] += [w for w, _ in self.split(self.normalize(text[at : m.start()]))]
                    out[i].append(m.group())
                    at = m.end()
                out[i] += [w for w, _ in self.split(self.normalize(text[at:]))]
            else:
                plain.append((i, self.normalize(text)))
        for lo in range(0, len(plain), 1024):  # many texts in one call: no word goes over a blank
            some = plain[lo : lo + 1024]
            ends = list(accumulate(len(n) + 1 for _, n in some))
            k = 0
            for word, (start, _) in self.split(" ".join([n for _, n in some])):
                while start >= ends[k]:
                    k += 1
                out[some[k][0]].append(word)
        return out

    def kind(self, char: str) -> str:
        """What the library's pattern takes a normalized character for: letter L, number N, blank " " or other "."."""
        found = self.kinds.get(char)
        if found is None:
            found = " " if not self.split(char) else "N" if len(self.split(char + char)) == 2 else "L" if len(self.split("a" + char)) == 1 else "."
            self.kinds[char] = found
        return found

    def prefix_counts(self, text: str) -> np.ndarray:
        """P[i]: tokens of the whole text cut after i code points, for every i from 0 to its length, in one pass over the text.

        Code points that the normalizer may join are looked at together; a cut between them is read from the state before them.
        """
        out = np.zeros(len(text) + 1, np.int64)
        state, at = Reader(self), 0
        for m in self.special_pattern.finditer(text) if self.special_pattern and "<|" in text else ():
            state.read(text[at : m.start()], out[at : m.start() + 1])
            inside = state.copy()  # a special string that isn't whole is ordinary text
            inside.read(m.group()[:-1], out[m.start() : m.end()])
            state.end_word()
            state.done += 1
            at = m.end()
            out[at] = state.done
        state.read(text[at:], out[at:])
        return out

    def fit(self, text: str, budget: int) -> int:
        """The most code points of the text, from its start, whose tokens number ``budget`` at most."""
        within = np.flatnonzero(self.prefix_counts(text) <= budget)
        return int(within[-1]) if len(within) else 0


#: Lengths of entries that end in no known three letters.
SHORT = (2, 1)
#: Endings of the pattern's own words with an apostrophe: fixed values.
ONE, TWO = "stmd", {"r": "e", "v": "e", "l": "l"}


@lru_cache(1)
def joining() -> frozenset[str]:
    """Characters that the normalizer may join with the one before: marks, second parts of canonical compositions, Hangul vowels and finals."""
    found = {chr(c) for c in chain(range(0x1161, 0x1176), range(0x11A8, 0x11C3))}
    for c in map(chr, chain(range(0x80, 0xD800), range(0xE000, 0x110000))):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
        if unicodedata.combining(c):
            found.add(c)
    return frozenset(found)


class Reader:
    """Tokens of all that was read, character by character: those of whole words, and the open word's last tokens and counts."""

    def __init__(self, counter: PrefixCounter):
        self.counter, self.done = counter, 0
        self.end_word()

    def end_word(self) -> None:
        if getattr(self, "word", ""):
            self.done = self.tokens()
        self.word, self.sort, self.last, self.count, self.apostrophe = "", "", [-1], [0], None

    def copy(self) -> Reader:
        other = copy(self)
        other.last, other.count = self.last.copy(), self.count.copy()
        return other

    def tokens(self) -> int:
        return self.done + (self.counter.closed_count(self.word, self.last, self.count) if self.word else 0)

    def push(self, char: str) -> None:
        """One normalized character."""
        c, sort = self.counter, self.counter.kind(char)
        if sort == " ":
            return self.end_word()
        if self.apostrophe is not None and sort == "L":
            before, so_far = self.apostrophe
            if not so_far and char in ONE or so_far and TWO[so_far] == char:
                self.done, self.word = before + c.count_word("'" + so_far + char), ""
                return self.end_word()
            keep = (before, char) if not so_far and char in TWO else None
            if not so_far:
                self.end_word()
            self.apostrophe = keep
        else:
            self.apostrophe = None
        if sort == "N" or sort != self.sort:
            keep = self.apostrophe
            self.end_word()
            self.apostrophe = keep
            if char == "'":
                self.apostrophe = (self.done, "")
        self.sort = sort
        self.word += c.shown(char)
        c.grow(self.word, self.last, self.count)
        if len(self.word) > 64 * c.longest:  # no entry reaches further back than c.longest
            self.word, self.last, self.count = self.word[-2 * c.longest :], self.last[-2 * c.longest - 1 :], self.count[-2 * c.longest - 1 :]

    def read(self, text: str, out: np.ndarray) -> None:
        """``out[i]``: tokens after i more characters."""
        joins, normalize = joining(), self.counter.normalize
        at, n = 0, len(text)
        out[0] = self.tokens()
        while at < n:
            end = at + 1
            while end < n and text[end] in joins:
                end += 1
            for cut in range(at + 1, end):
                some = self.copy()
                for char in normalize(text[at:cut]):
                    some.push(char)
                out[cut] = some.tokens()
            for char in normalize(text[at:end]):
                self.push(char)
            out[end] = self.tokens()
            at = end


def chunks(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


@lru_cache(2)
def _memos(path: str) -> tuple[Memo, Memo]:
    return Memo(600_000), Memo(600_000)


def count_chunks(new: list[str], path: str) -> list[int]:
    """Tokens of each chunk: its words' last prefix counts."""
    c, (_, by_word) = counter(path), _memos(path)
    found = c.words(new)
    return list(map(sum, by_row(found, lambda words: by_word.look_up(words, lambda new: [c.count_word(w) for w in new]))))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    path = path or default_tokenizer()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo, _ = _memos(path)
        found = texts(batch.column(1))
        rows = [chunks(t) for t in found]
        counts = np.array([sum(x) for x in by_row(rows, lambda keys: memo.look_up(keys, lambda new: count_chunks(new, path)))], np.int64)
        sizes = np.array([len(t.encode()) for t in found], np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        )

    return map_batches(docs, ["doc_id", "text"], work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", lambda: _memos(path))


def truncate(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """doc_id, n_chars, text: the longest prefix of each text within a token budget, read off its prefix counts."""
    path = path or default_tokenizer()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        out = [t[: c.fit(t, budget)] for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in out], pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_chars", "text"])

    return map_batches(docs, ["doc_id", "text"], work, "doc_id long, n_chars long, text string")
