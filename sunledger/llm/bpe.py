"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

A leaf of the tree holds the rank of the pair that starts at a live position, together with the position, so the root is the
leftmost pair of the smallest rank. A merge changes three leaves (the pair, its right half, the live neighbour on the left),
each in logarithmic time; a piece of n bytes takes O(n log n) however long it is.

Rows are independent: one narrow pass, no shuffle. Workers keep the ids of words they have met in bounded caches. The words
of a slice of texts that are new get their trees side by side, as rows of numpy arrays: one step merges one pair in each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .vocab import BoundedCache, FileOnWorkers

NO_PAIR = 1 << 62
_POSITION = 32      # low bits of a leaf
CACHED = 400_000
SIDE_BY_SIDE = 64   # bytes; longer pieces get a tree of their own
SLICE = 4 << 20     # characters of text whose new words are merged together


def _decimal(ids: list[int]) -> str:
    return ",".join(map(str, ids))


class ByteBpe:
    """Codec of one rank file; ids are ranks."""

    def __init__(self, rank_file: bytes, pattern: str = public_tokenizers.PATTERN):
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, rank_file.splitlines())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self._bytes = [self.ranks[bytes([b])] for b in range(256)]
        self._pairs = BoundedCache(self._pair, 2 * CACHED)
        self._find = regex.compile(pattern).findall
        self._pieces = BoundedCache(lambda piece: _decimal(self.merge(piece.encode("utf-8"))), CACHED)
        self._words = BoundedCache(lambda word: self._joined(" " + word), CACHED)
        self._by_decimal = {str(r): t for t, r in self.ranks.items()}
        whole = np.array(sorted((self.ranks[t[:i]] << _POSITION | self.ranks[t[i:]], r) for t, r in self.ranks.items()
                                for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks), np.int64)
        self._pair_keys, self._pair_ranks = whole[:, 0].copy(), whole[:, 1].copy()

    def _pair(self, key: int) -> int:
        return self.ranks.get(self.tokens[key >> _POSITION] + self.tokens[key & (1 << _POSITION) - 1], NO_PAIR)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the leftmost pair of smallest rank is merged until no pair has a rank."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, pairs = len(piece), self._pairs
        ids = list(map(self._bytes.__getitem__, piece))
        size = 1 << (n - 1).bit_length()
        tree = [NO_PAIR] * (2 * size)
        for i in range(n - 1):
            rank = pairs[ids[i] << _POSITION | ids[i + 1]]
            if rank != NO_PAIR:
                tree[size + i] = rank << _POSITION | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: int) -> None:
            at += size
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    return
                tree[at] = value

        while (best := tree[1]) != NO_PAIR:
            i = best & (1 << _POSITION) - 1
            j = after[i]
            k = after[i] = after[j]
            ids[i] = best >> _POSITION
            ids[j] = -1
            put(j, NO_PAIR)
            if k < n:
                before[k] = i
                rank = pairs[ids[i] << _POSITION | ids[k]]
                put(i, rank << _POSITION | i if rank != NO_PAIR else NO_PAIR)
            else:
                put(i, NO_PAIR)
            if (h := before[i]) >= 0:
                rank = pairs[ids[h] << _POSITION | ids[i]]
                put(h, rank << _POSITION | h if rank != NO_PAIR else NO_PAIR)
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """``merge`` of each piece, none longer than ``SIDE_BY_SIDE``."""
        out: list = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for x, piece in enumerate(pieces):
            if piece in self.ranks:
                out[x] = [self.ranks[piece]]
            else:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(x)
        for size, members in by_size.items():
            for begin in range(0, len(members), 1 << 14):
                part = members[begin:begin + (1 << 14)]
                for x, ids in zip(part, self._merge_rows([pieces[x] for x in part], size), strict=True):
                    out[x] = ids
        return out

    def _leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs (left, right) at a position; no pair where not ``there``."""
        key = left << _POSITION | right
        found = np.minimum(np.searchsorted(self._pair_keys, key), len(self._pair_keys) - 1)
        return np.where(there & (self._pair_keys[found] == key), self._pair_ranks[found] << _POSITION | at, NO_PAIR)

    def _merge_rows(self, pieces: list[bytes], size: int) -> list[list[int]]:
        m = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
        place = np.arange(size)
        ids = np.where(place < n[:, None], np.array(self._bytes, np.int64)[raw], -1)
        after, before = np.tile(place + 1, (m, 1)), np.tile(place - 1, (m, 1))
        tree = np.full((m, 2 * size), NO_PAIR)
        tree[:, size:-1] = self._leaves(ids[:, :-1], ids[:, 1:], place[:-1], place[1:] < n[:, None])
        level = size
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] != NO_PAIR)
        while len(rows):
            best = tree[rows, 1]
            i, rank = best & (1 << _POSITION) - 1, best >> _POSITION
            j = after[rows, i]
            k = after[rows, j]
            after[rows, i], ids[rows, i], ids[rows, j] = k, rank, -1
            more, near = k < n[rows], np.minimum(k, size - 1)
            before[rows[more], k[more]] = i[more]
            h = before[rows, i]
            left = np.maximum(h, 0)
            tree[rows, size + j] = NO_PAIR
            tree[rows, size + i] = self._leaves(rank, ids[rows, near], i, more)
            # without a left neighbour the leaf of i is written again
            tree[rows, size + np.where(h >= 0, left, i)] = np.where(
                h >= 0, self._leaves(ids[rows, left], rank, left, h >= 0), tree[rows, size + i])
            for at in (size + j, size + i, size + left):
                while at[0] > 1:
                    at = at >> 1
                    tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            rows = rows[tree[rows, 1] != NO_PAIR]
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def prepare(self, texts: list[str]) -> None:
        """Fill the caches with what ``encode`` will ask for."""
        words = {w for t in texts for w in t.split(" ") if w not in self._words}
        split = {w: self._find(" " + w) for w in words if w}
        new = [p for p in {p for ps in split.values() for p in ps} if p not in self._pieces and len(p) * 4 <= SIDE_BY_SIDE]
        for cache, more in ((self._words, split), (self._pieces, new)):
            if len(cache) + len(more) > 2 * CACHED:
                cache.clear()
                if cache is self._pieces:
                    new = [p for p in {p for ps in split.values() for p in ps} if len(p) * 4 <= SIDE_BY_SIDE]
        pieces = self._pieces
        for p, ids in zip(new, self.merge_many([p.encode("utf-8") for p in new]), strict=True):
            dict.__setitem__(pieces, p, _decimal(ids))
        for w, ps in split.items():
            dict.__setitem__(self._words, w, ",".join(map(pieces.__getitem__, ps)))

    def encode_all(self, texts: list[str]) -> Iterator[str]:
        part, held = [], 0
        for t in texts:
            part.append(t)
            held += len(t)
            if held >= SLICE:
                self.prepare(part)
                yield from map(self.encode, part)
                part, held = [], 0
        self.prepare(part)
        yield from map(self.encode, part)

    def _joined(self, text: str) -> str:
        return ",".join(map(self._pieces.__getitem__, self._find(text)))

    def encode(self, text: str) -> str:
        """Decimal ids of a whole text, joined by commas.

        No match of the pattern goes on from a non-space into a space, so words that follow a single space can be looked up
        one by one. Texts with runs of spaces take the pattern as a whole.
        """
        words = text.split(" ")
        if "" in words[1:]:
            return self._joined(text)
        first = self._joined(words[0])
        rest = ",".join(map(self._words.__getitem__, words[1:]))
        return f"{first},{rest}" if first and rest else first or rest

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self._by_decimal.__getitem__, ids.split(","))) if ids else b""


def encode_documents(spark: SparkSession, docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id (long), ids (array<int>) of every row's whole text; null and empty texts have no ids."""
    file = FileOnWorkers(spark, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = file.parsed(ByteBpe)
        for batch in batches:
            ids = codec.encode_all([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [list(map(int, x.split(","))) if x else [] for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("bigint(doc_id) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(spark: SparkSession, encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, decoded (binary) from doc_id, ids; null ids give null. An id that has no rank raises KeyError."""
    file = FileOnWorkers(spark, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = file.parsed(ByteBpe).tokens
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [None if x is None else b"".join(map(tokens.__getitem__, x)) for x in batch.column(1).to_pylist()],
                pa.binary())], names=["doc_id", "decoded"])

    return encoded.selectExpr("bigint(doc_id) doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def bpe_report(spark: SparkSession, docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes decoded from them)."""
    file = FileOnWorkers(spark, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = file.parsed(ByteBpe)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for ids in codec.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(decoded_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("bigint(doc_id) doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
