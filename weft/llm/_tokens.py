"""Token ids of whole texts from a public tokenizer file, word by word.

The tokenizer file splits at white space and drops it, takes letters in lower case and tells runs of letters from what follows them, so the
ids of a text are the ids of its words, one after another; marks behind a letter or digit are a word of their own. Each worker encodes
a word once with the tokenizers library and keeps its ids; texts are then put together from words with numpy. Words are told apart by 64-bit
hashes and lengths.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from weft.llm import _words

CACHED_WORDS = 800_000
#: Letters that normalising leaves as they are, or only makes small.
_PURE = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_SENTENCE = re.compile(r"""[.!?]["')\]]*$""")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class WordIds:
    """Ids of words, kept for about ``CACHED_WORDS`` words (then those met least are forgotten: a bound on memory, not on work)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(n)])
        # the same model for words that need no normalising and no splitting
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bare.model._resize_cache(0)  # words come once
        self.clear()

    def clear(self) -> None:
        self.number = _words.Numbers()
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.size = np.zeros(1 << 16, np.int32)  # bytes of the word
        self.met = np.zeros(1 << 16, np.int32)
        self.ends_sentence = np.zeros(1 << 16, bool)
        self.pool = np.zeros(1 << 18, np.int32)
        self.filled = 0

    def forget(self) -> None:
        """Keep the words met most, at most half of ``CACHED_WORDS``."""
        known = self.number.known
        met = self.met[:known]
        beyond = max(0, known - CACHED_WORDS // 2)
        least = max(2, int(np.partition(met, beyond)[beyond]) + 1)
        stay = np.flatnonzero(met >= least)
        keys, sizes, flat, lengths, ends = self.number.keys[stay], self.size[stay], self.ids(stay), self.length[stay], self.ends_sentence[stay]
        self.clear()
        self.number.add(keys)
        self._room(len(stay))
        self.size[: len(stay)], self.ends_sentence[: len(stay)] = sizes, ends
        self._add(np.arange(len(stay)), lengths, flat)

    def _room(self, total: int) -> None:
        if total > len(self.start):
            more = max(total, 2 * len(self.start)) - len(self.start)
            for name in ("start", "length", "size", "met", "ends_sentence"):
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, np.zeros(more, x.dtype)]))

    def _add(self, numbers: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        end = self.filled + len(flat)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(end, 2 * len(self.pool)) - len(self.pool), self.pool.dtype)])
        self.pool[self.filled : end] = flat
        self.start[numbers] = self.filled + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.filled = end

    def _learn(self, keys: np.ndarray, sizes: np.ndarray, texts: list[str]) -> None:
        """Encode new words: those of letters many at a time, told apart by their word ends, and the others one by one."""
        first = self.number.known
        self.number.add(keys)
        self._room(first + len(texts))
        self.size[first : first + len(texts)] = sizes
        self.ends_sentence[first : first + len(texts)] = [_SENTENCE.search(t) is not None for t in texts]
        pure = np.fromiter((_PURE.fullmatch(t) is not None for t in texts), bool, len(texts))
        places = np.flatnonzero(pure)
        for at in range(0, len(places), 50_000):
            part = places[at : at + 50_000]
            names = [texts[i].lower() for i in part.tolist()]
            lines = [" ".join(names[k : k + 500]) for k in range(0, len(names), 500)]
            flat = np.concatenate([np.array(e.ids, np.int32) for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)])
            self._add(first + part, np.diff(np.flatnonzero(self.ends_word[flat]) + 1, prepend=0), flat)
        places = np.flatnonzero(~pure)
        for at in range(0, len(places), 50_000):
            part = places[at : at + 50_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in part.tolist()], add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self._add(first + part, lengths, np.fromiter((i for ids in found for i in ids), np.int32, int(lengths.sum())))

    def numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The number of each of these words in the bytes ``raw``, new ones encoded first."""
        if self.number.known > CACHED_WORDS:
            self.forget()
        sizes = (ends - starts).astype(np.int32)
        keys = keys ^ _words.mix(sizes.astype(np.uint64))  # the length is part of the key
        out = self.number.find(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            own, first = np.unique(keys[new], return_index=True)
            at = new[first]
            whole = raw.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self._learn(own, sizes[at], [t.lower() if t.isascii() else t for t in texts])
            out[new] = self.number.find(keys[new])
        self.met[: self.number.known] += np.bincount(out, minlength=self.number.known).astype(np.int32)
        return out

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the words with these numbers, one after another."""
        lengths = self.length[numbers].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.start[numbers] - (ends - lengths), lengths) + np.arange(total)]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each Python worker: its tasks follow on one another."""
    return WordIds(path)


class Encoded:
    """Some texts as one run of ids: text i has flat[upto[edges[i]]:upto[edges[i + 1]]], word by word."""

    def __init__(self, words: WordIds, texts: list[str | None]) -> None:
        raw, first = _words.joined(texts)
        starts, ends, keys = _words.hashed(raw, split_marks=True, raw_beyond_ascii=True)
        self.numbers = words.numbers(raw, starts, ends, keys)
        self.flat = words.ids(self.numbers)
        self.upto = np.concatenate([[0], np.cumsum(words.length[self.numbers], dtype=np.int64)])
        self.edges = np.searchsorted(starts, first)
        self.line_ends = np.searchsorted(starts, np.flatnonzero(raw == 10))


def batches(texts: list[str | None], budget: int = 6 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``budget`` characters together, one text at least."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= budget):
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def encoded(words: WordIds, texts: list[str | None], end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text with ``end_id`` after them."""
    for at, to in batches(texts):
        e = Encoded(words, texts[at:to])
        for i in range(to - at):
            yield np.append(e.flat[e.upto[e.edges[i]] : e.upto[e.edges[i + 1]]], np.int32(end_id))


_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC polynomial, lowest power in the highest bit (uint32)."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    b = np.broadcast_to(b, out.shape).copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return out


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    """x to the powers 8, 16, 32, ..."""
    p, out = np.array(1 << 30, np.uint32), []
    for k in range(64):
        if k >= 3:
            out.append(p)
        p = _times(p, p)
    return out


def crc_before(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What byte strings with these crc32 add to that of a longer one in which ``length`` bytes follow them: the crc32 of strings joined is the XOR of all."""
    out, length = np.asarray(crc).astype(np.uint32), np.asarray(length, np.int64)
    for k, p in enumerate(_powers()):
        if not (length >> k).any():
            break
        out = np.where(length >> k & 1, _times(p, out), out)
    return out
