"""Texts of an Arrow column as flat arrays: words, their hashes and counts by text, without a Python step for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lumora.llm.packs import BASE1, BASE2, BYTES1, MIX2, mixed, powers, window_hashes

PIECE_BYTES, PIECE_ROWS = 1 << 18, 1 << 14
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A byte's kind in the shape of a word: capital, other letter (all beyond ASCII), digit, or the mark itself.
KINDS = LOWER.copy()
KINDS[48:58], KINDS[97:123], KINDS[128:], KINDS[65:91] = ord("0"), ord("a"), ord("a"), ord("A")
_TEXT_BITS = np.uint64(16)


def pieces_of(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, where each text starts and the last ends) of runs of rows of about `limit`
    bytes; a longer text is a run of its own. The column has no nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return
    _, places, data = column.buffers()
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1), lo + PIECE_ROWS, len(column))
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def flat(text: str | bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return raw, np.array([0, len(raw)])


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of `values`, wherever it lies."""
    up, down = powers(BASE1, len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES1[values] * up[: len(values)])])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Texts:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: where they start and end, the text and the hash of each."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, lower: bool = False):
        self.data, self.cuts, self.rows = LOWER[data] if lower else data, cuts, len(cuts) - 1
        n = len(data)
        gap, edge = SPACES[data], np.zeros(n + 1, bool)
        edge[cuts] = True
        self.inside = ~gap
        before = np.concatenate([[False], self.inside[:-1]]) if n else np.zeros(0, bool)
        self.start = np.flatnonzero(self.inside & (~before | edge[:n]))
        stop = np.append(before & (gap | edge[:n]), n > 0 and not gap[-1])
        self.end = np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, cuts)
        self.n_words = np.diff(self.first)
        self.text = np.repeat(np.arange(self.rows), self.n_words)
        self.hash = span_hashes(self.data, self.start, self.end)

    def counted(self, flags: np.ndarray) -> np.ndarray:
        """How many of the marked bytes lie in each text."""
        return np.diff(np.searchsorted(np.flatnonzero(flags), self.cuts))

    def words_counted(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.text[flags], minlength=self.rows)

    def keyed(self, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
        """One key of text and hash, the text in the upper 16 bits: sorted keys are grouped by text."""
        return (text.astype(np.uint64) << np.uint64(64 - int(_TEXT_BITS))) | (hashes >> _TEXT_BITS)

    def runs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text of each distinct key, and how often the key occurs."""
        keys = np.sort(keys)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return (keys[new] >> np.uint64(64 - int(_TEXT_BITS))).astype(np.int64), np.diff(np.append(new, len(keys)))

    def repetition(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: distinct words, the count of the commonest word, words equal to the one before."""
        text, times = self.runs(self.keyed(self.hash, self.text))
        top = np.zeros(self.rows, np.int64)
        np.maximum.at(top, text[times > 1], times[times > 1])
        top = np.maximum(top, self.n_words > 0)
        again = np.concatenate([[False], (self.hash[1:] == self.hash[:-1]) & (self.text[1:] == self.text[:-1])]) if len(self.hash) else np.zeros(0, bool)
        return np.bincount(text, minlength=self.rows), top, self.words_counted(again)

    def repeated_words(self, size: int) -> np.ndarray:
        """Per text the words in windows of `size` words that occur twice or more in it."""
        n = len(self.hash) - size + 1
        if n < 2:
            return np.zeros(self.rows, np.int64)
        valid = self.text[:n] == self.text[size - 1 :]
        keys = self.keyed(mixed(window_hashes(self.hash, size, BASE2), MIX2), self.text[:n])
        order = np.sort(keys[valid])
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if not len(twice):
            return np.zeros(self.rows, np.int64)
        at = np.flatnonzero(valid & (twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys))
        edge = np.zeros(len(self.hash) + 1, np.int64)
        edge[at] += 1
        np.subtract.at(edge, at + size, 1)
        return self.words_counted(np.cumsum(edge)[:-1] > 0)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text the lines with a word, and those of them that equal an earlier one."""
        breaks = np.flatnonzero(self.data == 10)
        start, end = np.sort(np.concatenate([self.cuts[:-1], breaks + 1])), np.sort(np.concatenate([breaks, self.cuts[1:]]))
        text = np.searchsorted(self.cuts[1:], start, "right") if self.rows else start
        words = np.searchsorted(self.start, end) - np.searchsorted(self.start, start)
        full = (words > 0) & (text < self.rows)
        text = text[full]
        of, _ = self.runs(self.keyed(span_hashes(self.data, start[full], end[full]), text))
        n = np.bincount(text, minlength=self.rows)
        return n, n - np.bincount(of, minlength=self.rows)

    def shapes(self, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, share of it, hash) of the words' shapes: kinds of bytes without repeats, in pieces of `piece` kinds."""
        kind, first = KINDS[self.data], np.zeros(len(self.data), bool)
        first[self.start] = True
        keep = self.inside & (first | np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else first
        shape, place = kind[keep], np.concatenate([[0], np.cumsum(keep)])
        a, b = place[self.start], place[self.end]
        parts = (b - a + piece - 1) // piece
        word = np.arange(len(a))
        if len(a) and parts.max() > 1:
            word = np.repeat(word, parts)
            k = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
            a = a[word] + piece * k
            b = np.minimum(a + piece, b[word])
        return word, 1.0 / parts[word], mixed(span_hashes(shape, a, b), MIX2)
