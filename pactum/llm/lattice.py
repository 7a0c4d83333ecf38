"""Segmentation lattices over a fixed piece vocabulary, many words at a time.

A word is the string of U+2581 and its characters. Its lattice has an edge for
each substring that is a piece; a character that is no piece gets one edge of
fixed small weight, so every word has a path. All steps are numpy over matrices
of words of like length; tasks call this on the distinct words of what they hold.
"""

from __future__ import annotations

from functools import cache

import numpy as np

MARK = "▁"
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@cache
def vocabulary(path: str) -> list[tuple[int, str, float]]:
    """(id, piece, score) of the ordinary pieces of a SentencePiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
    return [(i, m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not special(i)]


def rank_prior(scores: list[float]) -> np.ndarray:
    """Weights from existing vocabulary scores. Scores here are negative merge ranks, not
    log-probabilities, so the weight is Zipf's: the reciprocal of the rank."""
    order = np.argsort(-np.asarray(scores), kind="stable")
    weight = np.empty(len(scores))
    weight[order] = 1.0 / (np.arange(len(scores)) + 10.0)
    return weight / weight.sum()


class PieceTable:
    """Pieces hashed for vectorised look-up; ``find`` gives positions in the piece list."""

    BITS = 18

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        self.n = len(pieces)
        keys, places = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, self.n, np.int32)
        with np.errstate(over="ignore"):
            for at, piece in enumerate(pieces):
                h = np.uint64(0)
                for c in piece:
                    h = h * _MUL + np.uint64(ord(c))
                slot = int((h * _MIX) >> np.uint64(64 - self.BITS))
                while keys[slot]:
                    slot = (slot + 1) % len(keys)
                keys[slot], places[slot] = h, at
        self.keys, self.places = keys, places

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = ((h * _MIX) >> np.uint64(64 - self.BITS)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.places[slot], self.n)
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            key = self.keys[slot[left]]
            hit = key == h.flat[left]
            out[left[hit]] = self.places[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths, and piece positions [length of piece - 1][word][start]; ``self.n`` is none.

        The first column of each word is the word mark.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        wide = int(lengths.max())
        chars = np.zeros((len(words), wide), np.uint64)
        chars[:, 0] = ord(MARK)
        inner = np.arange(wide)[None, :] < lengths[:, None]
        inner[:, 0] = False
        chars[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        top = min(self.longest, wide)
        found = np.full((top, len(words), wide), self.n, np.int32)
        h = np.zeros_like(chars)
        for k in range(top):
            span = wide - k
            h[:, :span] = h[:, :span] * _MUL + chars[:, k:]
            found[k, :, :span] = self.find(np.ascontiguousarray(h[:, :span]).ravel()).reshape(len(words), span)
        return lengths, found

    def _by_length(self, words: list[str], cells: int = 2_000_000):
        """Index arrays of words of like length, so that matrices hold little padding."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(order):
            end = start + 1
            room = len(words[order[start]]) + 2
            while end < len(order) and (end - start + 1) * (len(words[order[end]]) + 1) * min(self.longest, 16) <= cells and len(words[order[end]]) <= room:
                end += 1
            yield order[start:end]
            start = end

    def log_marginals(self, words: list[str], weights: np.ndarray, unknown: float) -> np.ndarray:
        """Natural log of the summed weight of all segmentations, [word][model].

        ``weights``: [piece][model]. Forward recursion, rescaled every few characters
        with the logarithm of the scale carried beside it.
        """
        table = np.vstack([weights, np.zeros((1, weights.shape[1]))])
        out = np.empty((len(words), weights.shape[1]))
        for part in self._by_length(words):
            lengths, found = self.edges([words[i] for i in part])
            alpha, scale, final = self._forward(lengths, found, table, unknown)
            out[part] = final
        return out

    def _forward(self, lengths, found, table, unknown):
        top, n, wide = found.shape
        alpha = np.zeros((wide + 1, n, table.shape[1]))
        alpha[0] = 1.0
        scale = np.zeros((n, table.shape[1]))
        final = np.zeros((n, table.shape[1]))
        for e in range(1, wide + 1):
            total = alpha[e]
            for k in range(min(top, e)):
                w = table[found[k, :, e - 1 - k]]
                if k == 0:
                    w = np.where((found[0, :, e - 1] == self.n)[:, None], unknown, w)
                total += alpha[e - 1 - k] * w
            if e % 8 == 0:
                low = max(0, e - self.longest)
                peak = alpha[low : e + 1].max(axis=0)
                alpha[low : e + 1] /= peak
                scale += np.log(peak)
            ends = lengths == e
            if ends.any():
                final[ends] = np.log(alpha[e][ends]) + scale[ends]
        return alpha, scale, final

    def expected_counts(self, words: list[str], times: np.ndarray, weights: np.ndarray, unknown: float) -> np.ndarray:
        """Expected uses of each piece, [piece][column of times], over all segmentations
        of each word under one set of ``weights``, each word counted ``times`` times.

        Forward and backward sums, each rescaled every few characters; their logarithms
        with the scales are kept, so words of any length count in full.
        """
        table = np.append(weights, [0.0, unknown])
        with np.errstate(divide="ignore"):
            logs = np.log(table)
        out = np.zeros((self.n, times.shape[1]))
        for part in self._by_length(words):
            lengths, found = self.edges([words[i] for i in part])
            top, n, wide = found.shape
            found[0][found[0] == self.n] = self.n + 1
            ahead, behind = self._log_sums(lengths, found, table)
            total = ahead[lengths, np.arange(n)]
            ids, rows, post = [], [], []
            for k in range(top):
                edge = found[k, :, : wide - k]
                word, s = np.nonzero(edge < self.n)
                ids.append(edge[word, s])
                rows.append(word)
                post.append(np.exp(ahead[s, word] + logs[ids[-1]] + behind[s + 1 + k, word] - total[word]))
            ids, post, rows = np.concatenate(ids), np.concatenate(post), np.asarray(part)[np.concatenate(rows)]
            for c in range(times.shape[1]):
                out[:, c] += np.bincount(ids, post * times[rows, c], self.n)
        return out

    @staticmethod
    def _log_sums(lengths, found, table):
        """Logarithms of the summed weights of all paths to, and from, each place, [place][word]."""
        top, n, wide = found.shape
        steps, each = np.arange(top), np.arange(n)
        ahead, behind = np.zeros((wide + 1, n)), np.full((wide + 1, n), -np.inf)
        sums, scale = np.zeros((wide + 1, n)), np.zeros(n)
        sums[0] = 1.0
        for e in range(1, wide + 1):
            k = steps[:e]
            x = (sums[e - 1 - k] * table[found[k, :, e - 1 - k]]).sum(axis=0)
            ahead[e] = np.log(x) + scale
            sums[e] = x
            if e % 4 == 0:
                sums[max(0, e - top) : e + 1] /= x
                scale += np.log(x)
        sums, scale = np.zeros((wide + top + 1, n)), np.zeros(n)
        sums[lengths, each] = 1.0
        behind[lengths, each] = 0.0
        for s in range(wide - 1, -1, -1):
            sums[s] += (sums[s + 1 : s + 1 + top] * table[found[:, :, s]]).sum(axis=0)
            inside = s < lengths
            x = np.where(inside, sums[s], 1.0)
            behind[s, inside] = np.log(x[inside]) + scale[inside]
            if s % 4 == 0:
                sums[s : s + top + 1] /= x
                scale += np.log(x)
        return ahead, behind
