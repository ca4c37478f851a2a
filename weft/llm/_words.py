"""Bounds and hashes of the words of many texts at once, in numpy.

A word is a run of bytes other than \\x20 and \\x09-\\x0D. Its hash is the sum of fixed random numbers, one for each (place, byte), so that two
different words have equal ones with a chance of 2^-64; words over ``PLACES`` bytes take the XXH64 of their bytes instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

PLACES, WINDOW, NEAR = 64, 1 << 20, 1 << 13
_U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_IS_MARK = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=?@[\\]^_`{|}~"))  # without >, which ends a tokenizer's special tokens
_IS_PLAIN = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_DRAWN = mix(np.arange(PLACES * 256, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(0x2545F4914F6CDD1D)).reshape(PLACES, 256)
_DRAWN[:, IS_SPACE] = 0
_DRAWN = _DRAWN.ravel()


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a line feed between two, and where each begins; the last place is the end of all."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    first = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=first[1:])
    return np.frombuffer(b"\n".join(parts), np.uint8), first


def _windows(raw: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end behind a space (or at the end), so that no word is cut."""
    at = 0
    while at < len(raw):
        to = at + size
        while to < len(raw):
            space = np.flatnonzero(IS_SPACE[raw[max(at, to - NEAR) : to]])
            if len(space):
                to = max(at, to - NEAR) + int(space[-1]) + 1
                break
            to += NEAR
        to = min(to, len(raw))
        yield at, to
        at = to


def hashed(raw: np.ndarray, split_marks: bool = False, raw_beyond_ascii: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, ends and hashes of all words, with A-Z taken as a-z.

    ``split_marks``: ASCII marks at the end of a word, behind an ASCII digit or a letter of Latin-1, are a word of their own. ``raw_beyond_ascii``: words with other
    than ASCII characters keep their case.
    """
    found = [_window(raw[a:b], a, split_marks, raw_beyond_ascii) for a, b in _windows(raw, WINDOW)]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _window(raw: np.ndarray, at: int, split_marks: bool, raw_beyond_ascii: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = ~IS_SPACE[raw]
    begin, last = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    if split_marks:
        mark = np.zeros(len(raw) + 2, bool)
        mark[1:-1] = _IS_MARK[raw]
        first = np.flatnonzero(mark[1:-1] & ~mark[:-2])
        first = first[last[np.flatnonzero(mark[1:-1] & ~mark[2:])] & (first > 0)]
        before = raw[first - 1]
        letter = (raw[first - 2] == 0xC3) & (first > 1) & (before != 0x97) & (before != 0xB7)  # of Latin-1
        own = first[_IS_PLAIN[before] | letter]
        begin[own] = True
        last[own - 1] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, _U)
    body = raw[starts[0] :]
    reach = np.diff(starts, append=len(raw))
    low = LOWER[body]
    if raw_beyond_ascii and body.max() > 127:
        beyond = np.maximum.reduceat(raw, starts) > 127
        if beyond.any():
            low = np.where(np.repeat(beyond, reach), body, low)
    place = np.arange(len(body), dtype=np.int32)
    place -= np.repeat((starts - starts[0]).astype(np.int32), reach)
    place &= PLACES - 1
    place <<= 8
    place |= low
    keys = np.add.reduceat(_DRAWN[place], starts - starts[0])
    for i in np.flatnonzero(ends - starts > PLACES).tolist():
        own = slice(starts[i] - starts[0], ends[i] - starts[0])
        keys[i] = xxhash.xxh64_intdigest(low[own].tobytes())
    return starts + at, ends + at, keys


class Numbers:
    """Numbers 0, 1, 2, ... of 64-bit keys in an open-addressing table, many keys at a time."""

    def __init__(self, bits: int = 16) -> None:
        self.keys = np.zeros(1 << (bits - 1), _U)
        self.known = 0
        self._table(bits)

    def _table(self, bits: int) -> None:
        self.bits = bits
        self.slots = np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for one that isn't there."""
        at = (keys >> _U(64 - self.bits)).astype(np.int64)
        out = self.slots[at]
        other = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(other):
            at[other] = (at[other] + 1) & ((1 << self.bits) - 1)
            out[other] = got = self.slots[at[other]]
            other = other[(got >= 0) & (self.keys[got] != keys[other])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number these keys, which are different and not there yet, in their order."""
        total = self.known + len(keys)
        if total > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros(max(total, 2 * len(self.keys)) - len(self.keys), _U)])
        self.keys[self.known : total] = keys
        fresh = np.arange(self.known, total, dtype=np.int32)
        self.known = total
        if 2 * total > 1 << self.bits:
            self._table(max(self.bits + 1, int(2 * total).bit_length()))
            fresh = np.arange(total, dtype=np.int32)
        at = (self.keys[fresh] >> _U(64 - self.bits)).astype(np.int64)
        while len(fresh):
            free = self.slots[at] < 0
            self.slots[at[free]] = fresh[free]  # of several for one slot the last stays
            left = self.slots[at] != fresh
            fresh, at = fresh[left], (at[left] + 1) & ((1 << self.bits) - 1)
