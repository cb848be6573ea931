"""Vector codes: product quantisation with an equal-average search for the nearest codebook entry.

A vector of integers is cut into equal parts, and every part is replaced by the index of its nearest entry in the codebook of
that part position. Entries are sorted by component sum; a part's search starts where its own sum falls and goes outward on both
sides. As the squared gap of the sums over the dimension is a lower bound of the squared distance, a side ends once that bound
strictly exceeds the best distance so far: entries that tie are still looked at, so the lowest index wins exactly.

Codebooks (entries x dimension, whatever the input) are on the driver and in the tasks; vectors never are. A training round is one
pass: tasks add up the parts by entry, Spark adds the sums of the tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sunledger.session import work_dir

MOST = (1 << 63) - 1
LIMB = 40           # bits of a limb of a sum


def _limit(width: int) -> int:
    """Components below it in size leave all sums of squares of a part within 64 bits."""
    return (1 << 28) // max(width, 1)


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]``: the entries of part position p, one row each; ``width``: components of a vector, a multiple of the parts."""

    entries: list[np.ndarray]
    width: int

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for x in e.ravel()).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that rows of codes stand for."""
        return np.concatenate([e[codes[:, p]] for p, e in enumerate(self.entries)], axis=1)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry (ties: lowest index), and the number of distances computed."""
    if parts.dtype != entries.dtype:
        parts, entries = parts.astype(object), entries.astype(object)
    n, dim = parts.shape
    sums = entries.sum(axis=1)
    order = np.array(sorted(range(len(entries)), key=lambda i: (sums[i], i)), np.int64)
    sums = sums[order]
    own = parts.sum(axis=1)
    start = np.searchsorted(sums, own)
    best = np.zeros(n, parts.dtype)
    index = np.full(n, -1, np.int64)
    looked = 0
    sides = [(start - 1, -1), (start.copy(), 1)]
    live = [np.arange(n), np.arange(n)]
    while len(live[0]) or len(live[1]):
        for side, (at, step) in enumerate(sides):
            rows = live[side]
            rows = rows[(at[rows] >= 0) & (at[rows] < len(order))]
            gap = own[rows] - sums[at[rows]]
            rows = rows[(index[rows] < 0) | (gap * gap <= dim * best[rows]).astype(bool)]   # else the bound strictly exceeds the best
            live[side] = rows
            if not len(rows):
                continue
            entry = order[at[rows]]
            diff = parts[rows] - entries[entry]
            far = (diff * diff).sum(axis=1)
            looked += len(rows)
            better = (index[rows] < 0) | (far < best[rows]).astype(bool) | ((far == best[rows]).astype(bool) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = far[better], entry[better]
            at[rows] += step
    return index, best, looked


def _integers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of all vectors, padded by zeros to ``width``; Python integers where 64 bits could overflow."""
    values = np.asarray(vectors.flatten(), dtype=np.float64)
    lengths = np.asarray(vectors.value_lengths(), dtype=np.int64)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    if len(values) and np.abs(values).max() >= _limit(width) / scale:
        # Whole and broken part apart: the product may leave the range of doubles.
        return np.array([math.floor(x) * scale + math.floor((x - math.floor(x)) * scale) for x in out.ravel().tolist()],
                        dtype=object).reshape(out.shape)
    return np.floor(out * scale).astype(np.int64)


def _narrow(ints: np.ndarray, width: int) -> np.ndarray:
    """64-bit integers where that is safe."""
    return ints.astype(np.int64) if all(abs(x) < _limit(width) for x in ints.ravel().tolist()) else ints


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """Addends of ``value`` by limb: all but the last are below 2^40, the last has the sign."""
    limb = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield limb, value & ((1 << LIMB) - 1)
        value, limb = value >> LIMB, limb + 1
    yield limb, value


def _kept(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(v.isNotNull() & F.coalesce(finite, F.lit(False)))


class VectorCoder:
    """Learns codebooks from a table of vectors and encodes it.

    Rows with a null vector or a null, infinite or not-a-number component are left out. A vector shorter than the longest one
    is filled up with zeros, as is the longest to a multiple of ``parts``. With fewer than ``size`` vectors the codebooks have
    fewer entries; without any they are empty, and so are the results. Equal ids are ordered by vector, null ids come last.
    Repeated rows are rows of their own. Components too large for 64-bit arithmetic are handled exactly; an error beyond 64
    bits is given as the largest long. Columns other than the id, the vector and the label are not touched.
    """

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 16, size: int = 64,
                 rounds: int = 2, scale: int = 256):
        if not 0 < size <= 256:
            raise ValueError("a code has two hex digits: at most 256 entries")
        self.parts, self.scale, self.key, self.vector = parts, scale, key, vector
        self.rows = _kept(vectors, vector)
        width = self.rows.agg(F.max(F.size(vector))).first()[0] or 0
        self.width = max(-(-width // parts), 1) * parts
        first = self.rows.select(vector).orderBy(F.col(key).asc_nulls_last(), F.col(vector)).limit(size).collect()
        seeds = _integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), self.width, scale)
        self.codebooks = Codebooks(np.split(seeds, parts, axis=1), self.width)
        for _ in range(rounds if first else 0):
            self.codebooks = self._round(self.codebooks)

    def _round(self, books: Codebooks) -> Codebooks:
        """Every entry becomes the floor of the mean of its parts; one without parts stays."""
        width, scale = self.width, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count: dict[tuple[int, int], int] = {}
            total: dict[tuple[int, int], list[int]] = {}
            for batch in batches:
                for p, part in enumerate(np.split(_integers(batch.column(0), width, scale), len(books.entries), axis=1)):
                    index, _, _ = nearest(part, books.entries[p])
                    for e in np.unique(index).tolist():
                        mine = part[index == e]
                        count[p, e] = count.get((p, e), 0) + len(mine)
                        total[p, e] = [a + int(b) for a, b in zip(total.get((p, e), [0] * part.shape[1]), mine.sum(axis=0))]
            rows = [(p, e, d, limb, value, count[p, e]) for (p, e), sums in total.items()
                    for d, s in enumerate(sums) for limb, value in _limbs(s)]
            names = ["part", "entry", "position", "limb", "value", "n"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=names)

        # Tasks send one row per component of a codebook (and limb), and as many rows come to the driver. The count of an entry
        # comes with the first limb, which every sum has.
        sums = self.rows.select(self.vector).mapInArrow(
            run, "part long, entry long, position long, limb long, value long, n long").groupBy(
            "part", "entry", "position", "limb").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()
        value, count = {}, {}
        for r in sums:
            at = r["part"], r["entry"], r["position"]
            value[at] = value.get(at, 0) + (r["value"] << LIMB * r["limb"])
            if r["limb"] == 0:
                count[at] = r["n"]
        entries = [e.astype(object) for e in books.entries]
        for (p, e, d), v in value.items():
            entries[p][e, d] = v // count[p, e, d]
        return Codebooks([_narrow(e, width) for e in entries], width)

    def encode(self, vectors: DataFrame | None = None, carried: list[str] | None = None) -> DataFrame:
        """id, the ``carried`` columns, ``code`` (two hex digits per part) and ``error`` (squared distances summed over parts).

        ``vectors``: another table of the same columns; components beyond the learned width are cut off.
        """
        rows = self.rows if vectors is None else _kept(vectors, self.vector).withColumn(
            self.vector, F.slice(self.vector, 1, self.width))
        rows = rows.select(self.key, *(carried or []), self.vector)
        width, scale, books = self.width, self.scale, self.codebooks
        schema = T.StructType([*rows.schema.fields[:-1], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ints = _integers(batch.column(batch.num_columns - 1), width, scale)
                codes, error = np.zeros((len(ints), len(books.entries)), np.uint8), [0] * len(ints)
                for p, part in enumerate(np.split(ints, len(books.entries), axis=1)):
                    codes[:, p], far, _ = nearest(part, books.entries[p])
                    error = [a + b for a, b in zip(error, far.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array([c.tobytes().hex() for c in codes], pa.string()),
                     pa.array([min(e, MOST) for e in error], pa.int64())], names=schema.names)

        return rows.mapInArrow(run, schema) if len(books.entries[0]) else rows.sparkSession.createDataFrame([], schema)


def code_report(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together), codebooks_sha256 of each kept vector.

    Codes are written once below spark.checkpoint.dir; labels are added up from there. Odd rows as in ``VectorCoder``.
    """
    spark = vectors.sparkSession
    coder = VectorCoder(vectors, parts=parts, size=size, rounds=rounds, scale=scale)
    at = work_dir(spark, "codes")
    coder.encode(carried=["label"]).write.parquet(at)
    codes = spark.read.parquet(at)
    most = F.lit(MOST).cast("decimal(38,0)")
    labels = codes.groupBy("label").agg(
        F.least(F.sum(F.col("error").cast("decimal(28,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    labels = labels.withColumnRenamed("label", "of")
    return codes.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error",
        F.lit(coder.codebooks.sha256()).alias("codebooks_sha256"))
