"""Packing of token sequences into bins by minimum bin slack.

For each bin the largest length left is taken first; a bitset subset-sum over the lengths left then finds the fullest combination
that still fits, and the bin's lengths are removed. Only the number of pieces of each length matters for that, so the plan is
made from a histogram (at most ``capacity`` rows, whatever the input's size), and a combination is repeated as long as its
lengths last, as the next bins would come out the same. Pieces then find their place by their rank among the pieces of their
length; ranks come from counts of (length, hash part), so no length, however common, is ranked by one task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import work_dir
from .vocab import FileOnWorkers

SPLITS = 64         # parts of a length that are ranked independently
CACHED = 150_000    # words, and pieces of words, after which a worker forgets those not seen since the last time
SLICE = 1 << 17     # characters whose new words are encoded together
TOGETHER = 100      # words in a call's text
# The normalizer and the splitting rule for which texts of the characters in PLAIN are split here instead, by PIECE: none of them
# is changed by NFC, and their lower case and classes are the same in every Unicode version.
NORMALIZED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
         {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+")    # most frequent first: letters and digits start no other
# The characters that a byte-level model has for the bytes of the letters in PLAIN.
BYTES = [chr(0x122 + i) for i in range(0x21)] + [chr(0x143) if b == 0xAD else chr(b) for b in range(0xA1, 0x100)]   # from 0x80
SHOWN = "".join([*map(chr, range(0x80)), *BYTES])      # of every byte


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """A multiset of the counted lengths with the largest sum up to ``room``: bitset subset-sum, long lengths first."""
    reach, steps, full = 1, [], (1 << room + 1) - 1
    for length in sorted(counts, reverse=True):
        left, some = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            k = min(some, left)
            steps.append((length, k, reach))
            reach |= reach << k * length & full
            left, some = left - k, 2 * some
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= k * length
    return used


def bin_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: number in a bin}): the bins, equal ones together."""
    left, plan = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        seed = max(left)
        rest = {n: c - (n == seed) for n, c in left.items() if c > (n == seed)}
        bin_ = fullest(rest, capacity - seed)
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(left[n] // m for n, m in bin_.items())
        plan.append((times, bin_))
        for n, m in bin_.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return plan


def _places(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first bin, number in a bin, offset), by length and rank."""
    rows, rank, first_bin = [], {}, 0
    for times, bin_ in plan:
        offset = 0
        for n in sorted(bin_, reverse=True):
            rows.append((n, rank.get(n, 0), first_bin, bin_[n], offset))
            rank[n] = rank.get(n, 0) + times * bin_[n]
            offset += n * bin_[n]
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """``pieces`` (a column ``length``, 1 to ``capacity``) plus sequence_id and offset (long).

    ``order`` ranks the pieces of a length and must tell different pieces apart; equal rows may swap places. ``pieces`` is read
    three times: give a written table. Empty input gives an empty result; lengths outside the range raise ValueError. Extra
    columns may have any names; ``sequence_id`` and ``offset`` of the input are replaced.
    """
    names = pieces.columns
    short = {c: f"c{i}" for i, c in enumerate(names)}   # no name of the input can meet those used here
    pieces = pieces.toDF(*short.values())
    size, order = short["length"], [short[c] for c in order]
    kept = [c for c in names if c.lower() not in ("sequence_id", "offset")]
    keep = [short[c] for c in kept]
    counts = {r[size]: r["count"] for r in pieces.groupBy(size).count().collect()}  # at most capacity rows
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"piece lengths must be 1 to {capacity}")
    table = _places(bin_plan(counts, capacity))
    part = F.pmod(F.xxhash64(*order), F.lit(SPLITS)).cast("int")
    placed = pieces.withColumn("_part", part)
    before = Window.partitionBy(size).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(size, "_part").agg(F.count("*").alias("_n")).select(
        size, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row = F.row_number().over(Window.partitionBy(size, "_part").orderBy(*order)) - 1
    ranked = placed.withColumn("_row", row).join(starts, [size, "_part"]).withColumn(
        "_rank", F.col("_start") + F.col("_row")).drop("_part", "_start", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            nth = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(at[:, 2] + nth // at[:, 3]),
                 pa.array(at[:, 4] + nth % at[:, 3] * length)], names=[*kept, "sequence_id", "offset"])

    schema = ranked.select(keep).toDF(*kept).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


class Recent:
    """Values of keys that came up lately: once ``CACHED`` are new, the ones not seen since the last time go."""

    def __init__(self):
        self.values: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def unknown(self, keys: Iterable[str]) -> list[str]:
        """Those of ``keys``, each once, without a value; ``values`` has the others."""
        if len(self.values) > CACHED:
            self.values, self._older = {}, self.values
        older = self._older
        new = set(filterfalse(self.values.__contains__, keys))
        known = list(filter(older.__contains__, new))
        self.values.update(zip(known, map(older.__getitem__, known)))
        new.difference_update(known)
        return list(new)


class WordIds:
    """Ids of texts by a tokenizer that drops white space, so that words between spaces can be encoded one by one.

    New words go to the tokenizer together, with one of its own marks (an added token) between them; words that could touch such a
    mark, and all words if it has none, go alone. Where the tokenizer's rules are NORMALIZED and SPLIT, a text of plain characters
    is split into the rules' pieces instead, which spares the tokenizer its normalizer and its splitting; new pieces go to its model
    together. Words and pieces that came up lately are kept.
    """

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_str(content.decode("utf-8"))
        added = [t for _, t in sorted(self._tokenizer.get_added_tokens_decoder().items())]
        own = [t.content for t in added if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        marks = [c for c in own if len(c) > 2]
        self._mark, self._mark_id = (marks[-1], self._tokenizer.token_to_id(marks[-1])) if marks else (None, None)
        self._words, self._pieces = Recent(), Recent()
        rules = json.loads(content)
        self._added = own
        self._model = None
        if (len(own) == len(added) and (rules["normalizer"] or {}).get("normalizers") == NORMALIZED
                and (rules["pre_tokenizer"] or {}).get("pretokenizers") == SPLIT
                and not (rules["truncation"] or rules["padding"] or rules["model"].get("dropout")) and rules["model"].get("end_of_word_suffix") == "</w>"):
            self._model = Tokenizer(self._tokenizer.model)
            self._model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            # No piece has these characters itself, so an id with them ends one.
            last = [i for token, i in self._tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]
            self._last = np.zeros(max(self._tokenizer.get_vocab().values()) + 1, bool)
            self._last[last] = True

    def _alone(self, words: list[str]) -> None:
        for word, e in zip(words, self._tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self._words.values[word] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        if self._mark is None:
            return self._alone(words)
        near = self._mark[:2]
        self._alone([w for w in words if near in w])
        words = [w for w in words if near not in w]
        parts = [words[x:x + TOGETHER] for x in range(0, len(words), TOGETHER)]
        joined = self._tokenizer.encode_batch_fast(list(map(self._mark.join, parts)), add_special_tokens=False)
        for part, e in zip(parts, joined, strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == self._mark_id)
            if len(ends) != len(part) - 1:      # another added token took a part of a mark
                self._alone(part)
                continue
            raw = ids.tobytes()
            for word, x, y in zip(part, [0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), len(raw)], strict=True):
                self._words.values[word] = raw[x:y]

    def _learn_pieces(self, pieces: list[str]) -> None:
        parts = [pieces[x:x + TOGETHER] for x in range(0, len(pieces), TOGETHER)]
        texts = [text if (text := " ".join(part)).isascii() else charmap_decode(text.encode("utf-8"), "strict", SHOWN)[0] for part in parts]
        for part, e in zip(parts, self._model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = [0, *(4 * np.flatnonzero(self._last[ids]) + 4).tolist()]
            if len(at) != len(part) + 1:    # the model has no id for the end of some piece
                for piece, one in zip(part, self._tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self._pieces.values[piece] = np.array(one.ids, "<u4").tobytes()
                continue
            raw = ids.tobytes()
            for piece, x, y in zip(part, at, at[1:]):
                self._pieces.values[piece] = raw[x:y]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        split = [text.split(" ") for text in texts]
        if new := self._words.unknown(chain.from_iterable(split)):
            self._learn(new)
        return [b"".join(map(self._words.values.__getitem__, words)) for words in split]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        split = [PIECE.findall(text.lower()) for text in texts]
        if new := self._pieces.unknown(chain.from_iterable(split)):
            self._learn_pieces(new)
        return [b"".join(map(self._pieces.values.__getitem__, pieces)) for pieces in split]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self._model is None:
            return self._by_words(texts)
        plain = [PLAIN.fullmatch(text) is not None and not any(a in text for a in self._added) for text in texts]
        pieces, words = (iter(f([t for t, p in zip(texts, plain) if p == kind])) for f, kind in ((self._by_pieces, True), (self._by_words, False)))
        return [next(pieces if p else words) for p in plain]


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts (null: empty) in order, some ``SLICE`` characters at a time."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size > SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_pieces(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int, end_id: int,
                 ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every document, cut only where longer than
    ``capacity``. Null and empty texts give one piece that holds the end id."""
    file = FileOnWorkers(spark, tokenizer)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = file.parsed(WordIds), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc, rows, cut = batch.column(0), [], []
            for x, text_ids in enumerate(chain.from_iterable(map(encode, _slices(batch.column(1))))):
                all_ids = text_ids + end
                for piece, start in enumerate(range(0, len(all_ids), 4 * capacity)):
                    part = all_ids[start:start + 4 * capacity]
                    rows.append((x, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                    if ids:
                        cut.append(np.frombuffer(part, "<i4"))
            at, *values = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(at)), pa.array(values[0].astype(np.int32)), *(pa.array(v) for v in values[1:]),
                 *([pa.array(cut, pa.list_(pa.int32()))] if ids else [])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + ids])

    return docs.selectExpr("bigint(doc_id) doc_id", "text").mapInArrow(run, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1,
                   ids: bool = False) -> DataFrame:
    """Every document's pieces (see ``token_pieces``) with sequence_id and offset.

    The pieces are written once below spark.checkpoint.dir. Repeated rows are packed each; of pieces equal in doc_id, number
    and ids either may take either place.
    """
    at = work_dir(spark, "pieces")
    token_pieces(spark, docs, tokenizer, capacity, end_id, ids).write.parquet(at)
    return pack(spark.read.parquet(at), capacity, ["doc_id", "piece", "ids_crc32"])
