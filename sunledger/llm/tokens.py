"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow batch.

Texts are lower-cased (A-Z only), split at piece breaks and those at spaces. A word is known by a 64-bit hash of its bytes and of
its language; a phrase by the hashes of its words. Texts are worked through in slices of about a megabyte; only a text that is
longer is cut, at a piece break.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
SPACES = b"\x20\x09"
SLICE = 1 << 20

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(SPACES)] = 1
_CLASS[list(BREAKS)] = 2


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, kept for the life of a worker at slice size."""
    size = max(SLICE, n)
    if size not in _POWERS:
        def run(base: int) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)
        made = run(_BASE), run(_INVERSE)
        if size > SLICE:
            return made
        _POWERS[size] = made
    return _POWERS[size]


def text_hash(value: str) -> np.uint64:
    """Hash of a short string, such as a language."""
    h = np.uint64(len(value))
    with np.errstate(over="ignore"):
        for b in value.encode("utf-8", "surrogatepass"):
            h = mixed(np.array([h * np.uint64(_BASE) + np.uint64(b)], np.uint64))[0]
    return h


@dataclass
class Words:
    """Words of a slice: ``hash`` (with the language, never 0), ``piece`` (equal within a piece), ``text`` (row of the batch)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    piece: np.ndarray
    text: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)

    def spelled(self, at: np.ndarray) -> list[str]:
        data = self.data.tobytes()
        return [data[s:e].lower().decode("utf-8", "replace") for s, e in zip(self.start[at].tolist(), self.end[at].tolist())]

    def within(self, at: np.ndarray, m: int) -> np.ndarray:
        """Which of the places ``at`` have ``m`` words up to the end of their piece."""
        at = at[at < len(self) - m + 1]
        return at[self.piece[at + m - 1] == self.piece[at]]

    def phrase_hash(self, at: np.ndarray, m: int) -> np.ndarray:
        """Hash of the ``m`` words from each place on."""
        g = self.hash[at]
        for i in range(1, m):
            g = chained(g, self.hash[at + i])
        return g

    def neighbour(self, at: np.ndarray, offset: int) -> np.ndarray:
        """Hash of the word ``offset`` places on in the same piece, 0 where there is none."""
        there = np.clip(at + offset, 0, len(self) - 1)
        same = (there == at + offset) & (self.piece[there] == self.piece[at])
        return np.where(same, self.hash[there], np.uint64(0))


def chained(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word, and its last word."""
    return mixed(prefix * np.uint64(_BASE) + word)


def _words(data: np.ndarray, begins: np.ndarray, texts: np.ndarray, languages: np.ndarray) -> Words:
    """``begins``: where non-empty texts begin in ``data``; ``texts`` their rows; ``languages`` a hash for each row."""
    kind = _CLASS[data]
    inside = kind == 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    last[:-1] &= ~inside[1:]
    behind = begins[1:] - 1     # the last bytes of texts
    last[behind] = inside[behind]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data))
    total = _VALUE.take(data)
    total *= up[:len(data)]
    np.cumsum(total, out=total)
    before = total[start - 1]
    before[start == 0] = 0
    owner = np.repeat(np.arange(len(begins)), np.diff(np.r_[np.searchsorted(start, begins), len(start)]))
    text = texts[owner]
    h = mixed((total[end - 1] - before) * down[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))
    h = mixed(h ^ languages[text])
    piece = np.cumsum(kind == 2, dtype=np.int64)[start] + owner    # both grow along the data, so a sum is unique to a piece
    return Words(data, start, end, np.where(h == 0, np.uint64(1), h), piece, text)


def words_of(texts: pa.Array, languages: list[np.uint64]) -> Iterator[Words]:
    """The words of a batch's texts (nulls: empty), slice by slice; ``languages`` has a hash for each text."""
    if not len(texts):
        return
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    sizes = np.diff(bounds)
    if texts.null_count:
        sizes = np.where(np.asarray(texts.is_null()), 0, sizes)
    rows = np.flatnonzero(sizes)
    hashes = np.array(languages, np.uint64)
    i = 0
    while i < len(rows):
        at = int(bounds[rows[i]])
        # As many texts as fill a slice and lie next to each other.
        j = i + 1
        while j < len(rows) and bounds[rows[j]] == bounds[rows[j - 1]] + sizes[rows[j - 1]] and bounds[rows[j]] + sizes[rows[j]] - at <= SLICE:
            j += 1
        stop = int(bounds[rows[j - 1]] + sizes[rows[j - 1]])
        if j > i + 1 or stop - at <= SLICE:
            yield _words(data[at:stop], bounds[rows[i:j]] - at, rows[i:j], hashes)
        else:
            while at < stop:    # one long text, cut behind breaks
                cut = _cut(data, at, stop)
                yield _words(data[at:cut], np.zeros(1, np.int64), rows[i:j], hashes)
                at = cut
        i = j


def _cut(data: np.ndarray, at: int, stop: int) -> int:
    """End of the next slice of a text: behind the last break of a slice's size, else the next break after it, else the end."""
    if stop - at <= SLICE:
        return stop
    breaks = np.flatnonzero(_CLASS[data[at:at + SLICE]] == 2)
    if len(breaks):
        return at + int(breaks[-1]) + 1
    for begin in range(at + SLICE, stop, SLICE):
        breaks = np.flatnonzero(_CLASS[data[begin:min(begin + SLICE, stop)]] == 2)
        if len(breaks):
            return begin + int(breaks[0]) + 1
    return stop
