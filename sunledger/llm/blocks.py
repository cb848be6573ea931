"""Blocks of documents that talk to buckets of hashed keys.

A block is a few megabytes of documents, a bucket a share of the key space; both grow in number with the input, not in size.
A block sends each bucket one compressed array of its distinct keys (so a key that a third of all rows hold is sent once a block),
and a bucket answers each block. That moves a few bytes a key instead of a row a key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

BLOCK_BYTES = 4 << 20


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with a column ``_block``, and the number of blocks: by a hash of id and text, so the same in every run."""
    total = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = int(total // block_bytes) + 1
    return docs.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; integers of 8 bytes are stored by byte plane, sorted keys as differences."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head = f"{a.dtype.str},{len(a)};".encode()
        body = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes()
        out.append(len(head).to_bytes(2, "little") + head + body)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(value: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    while at < len(data):
        size = int.from_bytes(data[at:at + 2], "little")
        kind, n = data[at + 2:at + 2 + size].decode().rstrip(";").split(",")
        at, dtype, n = at + 2 + size, np.dtype(kind), int(n)
        body = np.frombuffer(data, np.uint8, n * dtype.itemsize, at)
        at += n * dtype.itemsize
        out.append(np.ascontiguousarray(body.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype) if n else np.empty(0, dtype))
    return out


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.zeros(1, sorted_keys.dtype))


def undeltas(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values, dtype=values.dtype)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each hashed key, from its high bits, so that sorted keys are sorted by bucket as well."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def bucket_bounds(sorted_keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that have keys, and where their runs begin and end (one more bound than buckets)."""
    bucket = bucket_of(sorted_keys, n)
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    return bucket[begin], np.r_[begin, len(bucket)]


def rows(columns: list[str], values: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(values, columns=columns)


def is_in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values
