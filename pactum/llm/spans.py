"""Chunks of texts as spans of code points, many at a time in numpy.

A text is cut between two characters wherever no piece of the vocabulary holds both in
a row. No piece can cross such a place, so the parts of a text are encoded apart and
the best path of the text is the best paths of its parts, one after the other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of texts that one pass takes; bounds the memory of a task, not what it reads.
PASS_CHARS = 1 << 18
#: Chunks of a dictionary that are hashed at a time: hashing takes many times their bytes.
BLOCK = 1 << 14
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Cutter:
    """Where texts may be cut, from the pairs of characters that stand in a row in pieces."""

    def __init__(self, pieces: list[str]):
        pairs = {ab for p in pieces for ab in zip(p, p[1:], strict=False)}
        chars = sorted({c for ab in pairs for c in ab})
        self.width = len(chars) + 1
        self.place = np.zeros(0x110000, np.uint16)
        self.place[[ord(c) for c in chars]] = np.arange(1, self.width)
        self.joined = np.zeros(self.width * self.width, bool)
        for a, b in pairs:
            self.joined[int(self.place[ord(a)]) * self.width + int(self.place[ord(b)])] = True

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """For each code point, whether a chunk starts there; the first always does."""
        place = self.place[codes].astype(np.int32)
        out = np.ones(len(codes), bool)
        np.logical_not(self.joined[place[:-1] * self.width + place[1:]], out=out[1:])
        return out

    def split(self, text: str | None) -> list[str]:
        """The chunks of a text, which joined give a space and the text; none for no text."""
        if not text:
            return []
        at = np.flatnonzero(self.cuts(code_points(text := " " + text))).tolist()
        return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]

    def segments(self, text: str, size: int) -> Iterator[str]:
        """A space and the text, in parts of about ``size`` that end where a chunk does."""
        text, start = " " + text, 0
        while start < len(text):
            end = min(start + size, len(text))
            back = end
            while start < back < len(text) and not self.cuts(code_points(text[back - 1 : back + 1]))[1]:
                back -= 1
            if back == start:  # no cut in this part: on to the next one
                while end < len(text) and not self.cuts(code_points(text[end - 1 : end + 1]))[1]:
                    end += 1
                back = end
            yield text[start:back]
            start = back

    def passes(self, texts: pa.Array, size: int = PASS_CHARS) -> Iterator[tuple[int, int, Iterator[Pass]]]:
        """(low, high, passes): rows low to high of ``texts`` and their chunks. Many texts
        share one pass; a text of over ``size`` characters has passes of its own."""
        lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
        low = 0
        while low < len(lengths):
            high, held = low + 1, int(lengths[low])
            while high < len(lengths) and held + lengths[high] <= size:
                held += int(lengths[high])
                high += 1
            rows = texts.slice(low, high - low).to_pylist()
            if held > size:
                yield low, high, (Pass([part], self) for part in self.segments(rows[0], size))
            else:
                yield low, high, iter([Pass([" " + t if t else "" for t in rows], self)])
            low = high


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as needed so far."""

    up = down = np.empty(0, np.uint64)

    @classmethod
    def reach(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = max(1 << 16, n + n // 16)
            row = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
            cls.up, cls.down = row(np.uint64(_BASE)), row(np.uint64(pow(_BASE, -1, 1 << 64)))
        return cls.up, cls.down


class Pass:
    """The chunks of some texts: they tile ``codes`` and start at ``at``."""

    def __init__(self, texts: list[str], cutter: Cutter | None = None):
        """With a cutter texts are cut into chunks, without one each is a chunk."""
        self.text = "".join(texts)
        self.codes = code_points(self.text)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(lengths) - lengths
        if cutter is None:
            self.at = self.starts
        else:
            cuts = cutter.cuts(self.codes) if len(self.codes) else np.empty(0, bool)
            cuts[self.starts[lengths > 0]] = True
            self.at = np.flatnonzero(cuts)
        self.lengths = np.diff(np.append(self.at, len(self.codes)))
        #: Chunks of each text.
        self.counts = np.diff(np.searchsorted(self.at, np.append(self.starts, len(self.codes)), side="left"))

    def hashes(self) -> np.ndarray:
        """64 bits of each chunk, never 0: prefix sums of code points times powers, taken apart."""
        up, down = Powers.reach(len(self.codes) + 1)
        sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum((self.codes + np.uint64(1)) * up[: len(self.codes)], out=sums[1:])
        h = (sums[self.at + self.lengths] - sums[self.at]) * down[self.at] + self.lengths.astype(np.uint64) * _MIX
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h ^ (h >> np.uint64(29)) | np.uint64(1)

    def equal(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each chunk, whether it is what stands at ``starts`` of ``codes``."""
        if not len(self.at):
            return np.empty(0, bool)
        other = np.repeat(starts - self.at, self.lengths)
        other += np.arange(len(self.codes))
        np.minimum(other, len(codes) - 1, out=other)
        return np.logical_and.reduceat(codes[other] == self.codes, self.at)

    def chunks(self, some: np.ndarray) -> list[str]:
        a = self.at[some]
        return [self.text[i:j] for i, j in zip(a.tolist(), (a + self.lengths[some]).tolist(), strict=True)]

    def counted(self, some: np.ndarray) -> tuple[list[str], list[int]]:
        """The distinct ones of ``some`` chunks and their uses."""
        n = Counter(self.chunks(some))
        return list(n), list(n.values())


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 up in the smallest unsigned type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


class Dictionary:
    """Chunks with what belongs to them, looked up by hash and then compared in full. Its
    arrays are narrow, because every task holds them."""

    def __init__(self, chunks: list[str]):
        codes, lengths, h = [np.empty(0, np.uint8)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for low in range(0, len(chunks), BLOCK):
            held = Pass(chunks[low : low + BLOCK])
            codes.append(narrow(held.codes))
            lengths.append(held.lengths)
            h.append(held.hashes())
        lengths, h = np.concatenate(lengths), np.concatenate(h)
        self.codes, self.at, self.lengths = narrow(np.concatenate([*codes, np.zeros(1, np.uint8)])), narrow(np.cumsum(lengths) - lengths), narrow(lengths)
        bits = max(4, int(2 * len(h)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.places = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint32)
        slot, left = self._slots(h), np.arange(len(h))
        while len(left):
            free = self.keys[slot[left]] == 0
            self.keys[slot[left[free]]] = h[left[free]]
            self.places[slot[left[free]]] = left[free]
            # Of those that met in one slot the last stays there; the others go on.
            left = left[self.places[slot[left]] != left]
            slot[left] = (slot[left] + 1) % len(self.keys)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * _MIX) >> self.shift).astype(np.int64)

    def find(self, some: Pass) -> np.ndarray:
        """The place of each chunk in the list, -1 where it is not there."""
        if not len(self.at) or not len(some.at):
            return np.full(len(some.at), -1, np.int64)
        h = some.hashes()
        slot = self._slots(h)
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        while len(left):
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.places[slot[left[hit]]]
            left = left[~hit & (key != 0)]
            slot[left] = (slot[left] + 1) % len(self.keys)
        known = out >= 0
        known &= some.lengths == self.lengths[out]
        known &= some.equal(self.codes, self.at[out].astype(np.int64))
        return np.where(known, out, -1)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The parts of ``flat`` at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    places = np.repeat(starts - (ends - lengths), lengths)
    places += np.arange(len(places))
    return flat[places]
