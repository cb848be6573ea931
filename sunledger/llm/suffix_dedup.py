"""Removal of long repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document of smaller id. Equal strings stand next to
each other when the suffixes that start with them are sorted. Sorting all suffixes of a corpus in one place is not possible, so:

1. Every start of ``length`` bytes has a minimizer: the least hash of its 16-byte windows. Equal strings have equal minimizers, so
   starts whose minimizer is in one document only cannot repeat. Blocks and buckets (see ``blocks``) find those out.
2. What is left is cut into segments, runs of starts with one minimizer, and dealt by minimizer hash; a segment that repeats in a
   block is sent once. A suffix bucket thus holds whole groups of equal strings, however the groups are spread over documents.
3. A task sorts its segments' suffixes, part by part and one range of first bytes at a time: by their first 32 bytes, and longer ties by the ranks
   of a difference-cover sample: for any two suffixes some offset below 31 puts both on sampled places, whose precomputed ranks
   decide. So memory is bounded by the bucket and long ties cost no more than short ones.
4. The neighbours in that order give each string its smallest document, and each block gets one bit a start in return.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T

from . import blocks as B

GRAM = 16           # bytes of a minimizer window
LONGEST_RUN = 64    # starts in a segment
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)   # every difference modulo 31 is one of two members of the cover
DEPTH = 8           # 8-byte words that rank the sample, at least
RANGE = 1 << 18     # suffixes that are sorted together
CHUNK = 1 << 19     # starts whose minimizers are computed together
BLOCK_BYTES = 2 << 20
BLOCKS_A_BUCKET = 4
FINE = 32           # parts of a bucket, sorted one after another
NO_ID = np.iinfo(np.int64).min


def _common_offsets() -> np.ndarray:
    """[a, b]: the least k such that a + k and b + k are both in the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    return np.array([[next(k for k in range(PERIOD) if inside[a + k] and inside[b + k]) for b in range(PERIOD)]
                     for a in range(PERIOD)])


_OFFSET = _common_offsets()


def words_at(text: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte word at every place of ``text``, which is padded with zeros."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    out = np.empty(len(text) + 1, np.uint64)
    for k in range(8):
        part = out[k::8]
        part[:] = np.frombuffer(padded, ">u8", len(part), k)
    return out[:len(text)]


@dataclass
class Order:
    """Places in order; ``group`` numbers runs of equal ones from 0."""

    places: np.ndarray
    group: np.ndarray

    def tied(self) -> np.ndarray:
        first = np.r_[True, self.group[1:] != self.group[:-1]]
        return np.flatnonzero(~(first & np.r_[first[1:], True]))

    def refine(self, tied: np.ndarray, order: np.ndarray, new: np.ndarray) -> None:
        """Put the tied entries in ``order``; ``new`` marks those that now begin a group."""
        self.places[tied] = self.places[tied][order]
        begins = np.r_[True, self.group[1:] != self.group[:-1]]
        begins[tied] |= new
        self.group = np.cumsum(begins) - 1


def sort_by_words(words: np.ndarray, places: np.ndarray, depth: int) -> Order:
    """Sort places by their first ``depth`` words; only ties read the next word."""
    first = words[places]
    order = np.argsort(first)
    first = first[order]
    out = Order(places[order], np.cumsum(np.r_[True, first[1:] != first[:-1]]) - 1)
    for d in range(1, depth):
        tied = out.tied()
        if not len(tied):
            break
        at = out.places[tied] + 8 * d
        key, group = np.where(at < len(words), words[np.minimum(at, len(words) - 1)], 0), out.group[tied]
        order = np.lexsort((key, group))
        key = key[order]
        out.refine(tied, order, np.r_[False, (key[1:] != key[:-1]) & (group[1:] == group[:-1])])
    return out


def cover_ranks(words: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Rank of every sampled place among the sample, -1 elsewhere; places equal in ``depth`` words have one rank."""
    places = np.flatnonzero(np.isin(np.arange(len(words)) % PERIOD, COVER))
    ranks = np.full(len(words) + PERIOD, -1, np.int32)
    if len(places):
        order = sort_by_words(words, places, depth)
        ranks[order.places] = order.group
    return ranks


def sort_suffixes(words: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> Order:
    """Sort the suffixes at ``places``: 32 bytes, then ties by the sample's ranks, all ties at once, each split in three by a
    pivot (before, equal, after) until only equal ones are together."""
    out = sort_by_words(words, places, 4)
    open_ = np.zeros(len(places), bool)
    open_[out.tied()] = True
    while open_.any():
        tied = np.flatnonzero(open_)
        group = out.group[tied]
        begin = np.r_[True, group[1:] != group[:-1]]
        at = np.flatnonzero(begin)
        size = np.diff(np.r_[at, len(tied)])
        mine = out.places[tied]
        pivot = np.repeat(mine[at + size // 2], size)
        k = _OFFSET[mine % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[mine + k] - ranks[pivot + k])
        order = np.lexsort((side, group))
        side = side[order]
        out.refine(tied, order, np.r_[False, (side[1:] != side[:-1]) & (group[1:] == group[:-1])])
        open_[tied] = side != 0
        alone = np.ones(len(places), bool)
        alone[out.tied()] = False
        open_ &= ~alone
    return out


def smallest_elsewhere(text: np.ndarray, starts: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each start the smallest of the ``ids`` of the starts with the same ``length`` bytes."""
    words = words_at(text)
    ranks = cover_ranks(words, max(DEPTH, -(-length // 8)))
    out = np.empty(len(starts), np.int64)
    lead = words[starts] >> np.uint64(48)
    by_lead = np.argsort(lead, kind="stable")
    ends = np.flatnonzero(np.r_[lead[by_lead][1:] != lead[by_lead][:-1], True]) + 1 if len(starts) else []
    begin = 0
    for x, end in enumerate(ends):  # one range of first bytes at a time
        if x + 1 < len(ends) and ends[x + 1] - begin <= RANGE:
            continue
        part = by_lead[begin:end]
        begin = end
        # Places carry their index along: starts differ, so a lookup by place finds it.
        order = sort_suffixes(words, starts[part], ranks)
        index = part[np.argsort(starts[part])][np.searchsorted(np.sort(starts[part]), order.places)]
        differs = np.zeros(len(part) - 1, bool)
        for d in range(0, length, 8):
            a, b = words[order.places[1:] + d], words[order.places[:-1] + d]
            keep = np.uint64(max(0, 8 * (8 - (length - d))))
            differs |= (a >> keep) != (b >> keep)
        group = np.cumsum(np.r_[True, differs]) - 1
        least = np.minimum.reduceat(ids[index], np.flatnonzero(np.r_[True, differs]))
        out[index] = least[group]
    return out


class Block:
    """Texts of one block with their runs of equal minimizers."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int):
        self.length = length
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(self.size)
        self.ids = ids
        self.data = b"".join(texts)
        n = len(self.data)
        self.text = np.frombuffer(self.data, np.uint8)
        if n < length:
            self.begin = self.stop = self.doc = np.empty(0, np.int64)
            self.key = np.empty(0, np.uint64)
            return
        parts = [self._runs(c, min(c + CHUNK, n)) for c in range(0, n, CHUNK)]
        self.begin, self.stop, self.key = (np.concatenate(x) for x in zip(*parts))
        self.doc = np.searchsorted(self.end, self.begin, "right")

    def _runs(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, stop, minimizer) of the runs of starts from ``low`` to ``high``; runs stay in their document."""
        text = self.text[low:high + self.length - 1]
        starts = len(text) - self.length + 1
        if starts <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        words = words_at(text)
        grams = len(text) - GRAM + 1
        gram = words[:grams] * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
        gram += words[8:grams + 8] * np.uint64(0xD6E8FEB86659FD93)
        gram ^= gram >> np.uint64(32)
        gram *= np.uint64(0xD6E8FEB86659FD93)
        gram ^= gram >> np.uint64(29)
        window, have = self.length - GRAM + 1, 1
        while have < window:
            step = min(have, window - have)
            gram = np.minimum(gram[:-step], gram[step:])
            have += step
        valid = np.ones(starts, bool)       # starts that fit in their document
        new = np.r_[True, gram[1:] != gram[:-1]]
        ends = self.end[(self.end > low) & (self.end - self.length + 1 < high)] - low
        for end in ends.tolist():
            valid[max(0, end - self.length + 1):end] = False
            if end < starts:
                new[end] = True
        new[1:] |= ~valid[:-1]
        new &= valid
        begin = np.flatnonzero(new)
        stop = np.flatnonzero(valid & np.r_[new[1:] | ~valid[1:], True]) + 1
        pieces = (stop - begin + LONGEST_RUN - 1) // LONGEST_RUN
        if pieces.max(initial=1) > 1:
            first = np.repeat(np.cumsum(pieces) - pieces, pieces)
            nth = np.arange(len(first)) - first
            begin, stop = np.repeat(begin, pieces) + LONGEST_RUN * nth, np.repeat(stop, pieces)
            stop = np.minimum(stop, begin + LONGEST_RUN)
        # Minimizers are small hashes: mixed again, they spread over the buckets.
        key = gram[begin] * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
        return begin + low, stop + low, key * np.uint64(0xD6E8FEB86659FD93)

    def repeated_here(self) -> np.ndarray:
        """Sorted minimizers that documents of different ids in this block have."""
        ids = self.ids[self.doc]
        order = np.lexsort((ids, self.key))
        key, ids = self.key[order], ids[order]
        return np.unique(key[1:][(key[1:] == key[:-1]) & (ids[1:] != ids[:-1])])

    def segments(self, repeated: np.ndarray) -> None:
        """Number the different segments of repeated minimizers: ``run`` (runs), ``segment`` (of each), and of each segment its
        first run ``at`` and smallest id ``least``, in order of the minimizers."""
        self.run = np.flatnonzero(B.is_in(self.key, repeated))
        self.run = self.run[np.argsort(self.key[self.run], kind="stable")]
        number: dict[bytes, int] = {}
        data, tail = self.data, self.length - 1
        self.segment = np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip(
            self.begin[self.run].tolist(), (self.stop[self.run] + tail).tolist())), np.int64, len(self.run))
        self.at = self.run[np.unique(self.segment, return_index=True)[1]]
        self.least = np.full(len(self.at), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.segment, self.ids[self.doc[self.run]])


def _ids(frame: pd.DataFrame) -> np.ndarray:
    return np.array([NO_ID if pd.isna(x) else int(x) for x in frame["doc_id"]], np.int64)


def _in_order(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows in one order, whatever order the shuffle brings: segments are numbered and cut along it each time."""
    return frame.sort_values(["doc_id", "text"], kind="stable", ignore_index=True)


def _block(frame: pd.DataFrame, length: int) -> Block:
    return Block(_ids(frame), [t.encode("utf-8") if isinstance(t, str) else b"" for t in frame["text"]], length)


def _earlier(sent: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """For each block's (sizes, smallest ids, bytes) of its segments, whether each start is also in a document of smaller id."""
    size, least, text = (np.concatenate([s[k] for s in sent]) for k in (0, 1, 2))
    if not len(size):
        return [np.empty(0, bool) for _ in sent]
    # Segments that blocks have in common are sorted once, for the smallest of their ids.
    end = np.cumsum(size)
    data, number = text.tobytes(), {}
    which = np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip(
        (end - size).tolist(), end.tolist())), np.int64, len(size))
    once = np.unique(which, return_index=True)[1]
    smallest = np.full(len(once), np.iinfo(np.int64).max)
    np.minimum.at(smallest, which, least)
    own = np.frombuffer(b"".join(number), np.uint8)
    starts_of = size[once] - length + 1
    first = np.cumsum(starts_of) - starts_of
    begin = np.cumsum(size[once]) - size[once]
    starts = np.repeat(begin - first, starts_of) + np.arange(starts_of.sum())
    found = smallest_elsewhere(own, starts, np.repeat(smallest, starts_of), length)
    out, at = [], 0
    for sizes, ids, _ in sent:
        mine = which[at:at + len(sizes)]
        at += len(sizes)
        lengths = starts_of[mine]
        of = np.repeat(first[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        out.append(found[of] < np.repeat(ids, lengths))
    return out


_SENT = "bucket int, block int, payload binary"
_REPLY = "block int, kind int, bucket int, payload binary"


def _remove(docs: DataFrame, length: int, finish, schema: T.StructType) -> DataFrame:
    """Run ``finish(frame, bytes of each row, covered, bounds)`` on every block of ``docs``; see ``repeated_bytes``."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    in_blocks, blocks = B.in_blocks(docs, BLOCK_BYTES)
    n = -(-blocks // BLOCKS_A_BUCKET)

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(_block(frame, length).key)
        bucket, bound = B.bucket_bounds(keys, n)
        block = int(frame["_block"].iloc[0])
        return B.rows(["bucket", "block", "payload"], [
            (b, block, B.packed(B.deltas(keys[x:y]))) for b, x, y in zip(bucket, bound[:-1], bound[1:])])

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [B.undeltas(B.unpacked(p)[0]) for p in frame["payload"]]
        found, times = np.unique(np.concatenate(keys), return_counts=True)
        found = found[times > 1]
        return B.rows(["block", "kind", "bucket", "payload"], [
            (block, 0, bucket, B.packed(B.deltas(mine))) for block, bucket, k in zip(frame["block"], frame["bucket"], keys)
            if len(mine := k[B.is_in(k, found)])])

    def repeated(frame: pd.DataFrame, replies: pd.DataFrame) -> Block:
        block = _block(frame, length)
        keys = [B.undeltas(B.unpacked(p)[0]) for p in replies.loc[replies["kind"] == 0, "payload"]]
        block.segments(np.unique(np.concatenate([block.repeated_here(), *keys])))
        return block

    def send(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "block", "payload"]
        if frame.empty:
            return B.rows(columns, [])
        frame = _in_order(frame)
        block, number = repeated(frame, replies), int(frame["_block"].iloc[0])
        fine = B.bucket_of(block.key[block.at], FINE * n)
        begin, end = block.begin[block.at], block.stop[block.at] + length - 1
        bounds = np.searchsorted(fine, np.arange(FINE * n + 1))
        out = []
        for b in np.unique(fine // FINE).tolist():
            cut = bounds[FINE * b:FINE * b + FINE + 1]
            x, y = cut[0], cut[-1]
            out.append((b, number, B.packed(
                np.diff(cut), end[x:y] - begin[x:y], block.least[x:y],
                np.frombuffer(b"".join(block.data[s:e] for s, e in zip(begin[x:y].tolist(), end[x:y].tolist())), np.uint8))))
        return B.rows(columns, out)

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        sent = [B.unpacked(p) for p in frame["payload"]]
        cuts = [np.r_[0, np.cumsum(s[0])] for s in sent]
        bytes_at = [np.r_[0, np.cumsum(s[1])] for s in sent]
        bits: list[list[np.ndarray]] = [[] for _ in sent]
        for f in range(FINE):   # whole groups of equal minimizers, so of equal strings
            part = [(s[1][c[f]:c[f + 1]], s[2][c[f]:c[f + 1]], s[3][t[c[f]]:t[c[f + 1]]])
                    for s, c, t in zip(sent, cuts, bytes_at)]
            for mine, found in zip(bits, _earlier(part, length)):
                mine.append(found)
        return B.rows(["block", "kind", "bucket", "payload"], [
            (block, 1, bucket, B.packed(np.packbits(np.concatenate(mine))))
            for block, bucket, mine in zip(frame["block"], frame["bucket"], bits)])

    def apply(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame(columns=schema.names)
        frame = _in_order(frame)
        block = repeated(frame, replies)
        starts_of = (block.stop - block.begin)[block.at]
        bucket, bound = B.bucket_bounds(block.key[block.at], n)
        earlier = np.zeros(int(starts_of.sum()), bool)
        told = dict(zip(*(replies.loc[replies["kind"] == 1, c] for c in ("bucket", "payload"))))
        first = np.r_[0, np.cumsum(starts_of)]
        for b, x, y in zip(bucket, bound[:-1], bound[1:]):
            bits = np.unpackbits(B.unpacked(told[b])[0])
            earlier[first[x]:first[y]] = bits[:first[y] - first[x]]
        lengths = starts_of[block.segment]
        small = lambda a: np.repeat(a.astype(np.int32), lengths)  # noqa: E731  places in a block
        offset = np.arange(lengths.sum(), dtype=np.int32) - small(np.cumsum(lengths) - lengths)
        gone = earlier[small(first[:-1][block.segment]) + offset]
        gone |= np.repeat(block.ids[block.doc[block.run]] > block.least[block.segment], lengths)
        starts = (small(block.begin[block.run]) + offset)[gone]
        change = np.zeros(len(block.text) + length + 1, np.int8)
        change[starts] += 1
        change[starts + length] -= 1     # starts are distinct
        covered = np.cumsum(change, dtype=np.int32)[:len(block.text)] > 0
        return finish(frame, block, covered)

    own = in_blocks.groupBy("_block")
    found = own.applyInPandas(ask, _SENT).groupBy("bucket").applyInPandas(shared, _REPLY)
    sent = own.cogroup(found.groupBy("block")).applyInPandas(send, _SENT)
    bits = sent.groupBy("bucket").applyInPandas(sort, _REPLY)
    return own.cogroup(found.unionByName(bits).groupBy("block")).applyInPandas(apply, schema)


def _rows_of(block: Block, covered: np.ndarray):
    for begin, end in zip((block.end - block.size).tolist(), block.end.tolist()):
        gone = covered[begin:end]
        yield block.text[begin:end], gone


def repeat_report(docs: DataFrame, length: int = 50) -> DataFrame:
    """For each row doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (lowercase hex of what is left).

    Null text is empty. A null doc_id counts as smaller than all others. Strings are judged on the input; rows of one doc_id do
    not repeat each other. An empty table gives an empty result; texts shorter than ``length`` bytes stay.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in (
        "n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def finish(frame: pd.DataFrame, block: Block, covered: np.ndarray) -> pd.DataFrame:
        out = []
        for (text, gone), x in zip(_rows_of(block, covered), block.ids.tolist(), strict=True):
            out.append((x if x != NO_ID else None, len(text), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()),
                        hashlib.sha256(text[~gone].tobytes()).hexdigest()))
        return pd.DataFrame(out, columns=schema.names).astype({"doc_id": "Int64"})

    return _remove(docs.selectExpr("bigint(doc_id) doc_id", "text"), length, finish, schema)


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with repeated strings taken out of ``text``; bytes of characters that were cut apart go as well.

    Other columns stay, whatever their names. A null text stays null. Repeated rows are treated alike; an empty table gives an
    empty result.
    """
    names = docs.columns
    docs = docs.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)))
    schema = docs.schema

    def finish(frame: pd.DataFrame, block: Block, covered: np.ndarray) -> pd.DataFrame:
        out = frame[schema.names].copy()
        out["text"] = [t if not gone.any() else bytes(text[~gone]).decode("utf-8", "ignore")
                       for t, (text, gone) in zip(frame["text"], _rows_of(block, covered), strict=True)]
        return out

    return _remove(docs, length, finish, schema).toDF(*names)
