"""The words of a byte-level tokenizer, split in numpy for many texts at once.

A word is a contraction ('s 't 're 've 'm 'll 'd), or a run of letters, of numbers or of other characters with the one space before it if any, or white
space: all but the last character of a run that something follows, and that last one alone unless it is a space that goes with the next word. Which
characters are letters, numbers and white space is asked of the tokenizers library itself, character by character as they are met.
"""

from __future__ import annotations

import os
import re

import numpy as np
import xxhash

from weft.llm import _words

WINDOW = 1 << 20
_U = np.uint64
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: What may follow an apostrophe.
ONE, TWO = "stmd", ("re", "ve", "ll")

_DRAWN = _words.mix(np.arange(_words.PLACES * 256, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(0x1F83D9ABFB41BD6B)).ravel()


class Splitter:
    """Splits texts as the tokenizer file's added tokens and byte-level rule do."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if self.tokenizer.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("a byte-level tokenizer file without normalizer, its added tokens without conditions, is needed")
        self.added = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None
        self.kinds = np.full(0x110000, 255, np.uint8)

    def _ask(self, codes: np.ndarray) -> None:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for code in codes.tolist():
            c = chr(code)
            kind = next((k for k, x in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(split(x + c + x)) == 1), _SPACE)
            self.kinds[code] = kind

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """Parts of ``text`` that are split apart from each other, and whether each is one added token. Long parts are cut before white space."""
        out, at = [], 0
        for m in self.added.finditer(text) if self.added else ():
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        out.append((text[at:], False))
        return [(s, whole) for part, whole in out for s in ([part] if whole else _cut(part)) if s]

    def split(self, parts: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of these segments and where each word begins in them (then the end of all)."""
        raw = "".join(p for p, _ in parts)
        codes = np.frombuffer(raw.encode("utf-32-le"), "<u4")
        data = np.frombuffer(raw.encode(), np.uint8)
        n = len(codes)
        if not n:
            return data, np.zeros(1, np.int64)
        kind = self.kinds[codes]
        if kind.max() == 255:
            self._ask(np.unique(codes[kind == 255]))
            kind = self.kinds[codes]
        sizes = np.array([len(p) for p, _ in parts])
        edge = np.zeros(n + 1, bool)
        edge[np.cumsum(sizes)] = edge[0] = True
        start = edge.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(start)
        # white space before something: its last character is apart, or goes with what follows if it is a space
        b = run[1:][(kind[run[:-1]] == _SPACE) & ~edge[run[1:]]]
        start[b - 1] = True
        start[b[codes[b - 1] == 32]] = False
        # an apostrophe alone, with no space before it, and the letters behind it
        a = np.flatnonzero((codes == 39) & start[:n])
        a = a[(a + 1 < n)]
        a = a[start[a + 1] & ~edge[a + 1] & (kind[np.minimum(a + 1, n - 1)] == _LETTER)]
        if len(a):
            first, second = codes[a + 1], codes[np.minimum(a + 2, n - 1)]
            one = np.isin(first, [ord(c) for c in ONE])
            two = np.zeros(len(a), bool)
            for x, y in TWO:
                two |= (first == ord(x)) & (second == ord(y))
            two &= (a + 2 < n) & ~start[np.minimum(a + 2, n)]
            start[a[one | two] + 1] = False
            start[a[one] + 2] = True
            start[a[two] + 3] = True
        if any(whole for _, whole in parts):
            upto = np.cumsum(sizes)
            for i, (_, whole) in enumerate(parts):
                if whole:
                    start[upto[i] - sizes[i] + 1 : upto[i]] = False
        begin = np.flatnonzero(start)
        if len(data) > n:
            width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
            begin = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[begin]
        return data, begin


def _cut(part: str) -> list[str]:
    out, at = [], 0
    while len(part) - at > WINDOW:
        m = re.compile(r"\S(?= )").search(part, at + WINDOW)
        if not m:
            break
        out.append(part[at : m.end()])
        at = m.end()
    return [*out, part[at:]]


def hashes(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, its length part of it."""
    starts, sizes = begin[:-1], np.diff(begin)
    if not len(starts):
        return np.zeros(0, _U)
    place = np.arange(len(data), dtype=np.int32)
    place -= np.repeat(starts.astype(np.int32), sizes)
    place &= _words.PLACES - 1
    place <<= 8
    place |= data
    keys = np.add.reduceat(_DRAWN[place], starts)
    for i in np.flatnonzero(sizes > _words.PLACES).tolist():
        keys[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return keys ^ _words.mix(sizes.astype(_U))
