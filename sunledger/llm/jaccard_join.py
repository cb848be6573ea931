"""N-gram Jaccard join by MinHash banding.

Two texts are linked if the Jaccard similarity of their sets of word n-grams reaches a threshold. The bands and rows of the
MinHash signatures are chosen for a target recall at that threshold. The join runs in five steps, none of which makes a row for
every pair of a group:

1. Signatures: one narrow pass. Equal texts are one class from here on, whatever the number of copies.
2. Band hashes are grouped; every text is tied to the least text of each of its bands, and the ties' connected components are
   the candidates: linked texts that agree in any band are in one component.
3. The texts of a component are cut into tiles of at most ``TILE``; every pair of tiles is a task of its own (small components
   share tasks), so a component of a third of all texts is spread over many.
4. A task verifies its pairs on the full n-gram sets by matrix products, counts links for each text and returns the links'
   components as stars.
5. The stars' components are the classes.

Recall concerns step 2 only; what it proposes is verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import work_dir
from .vocab import BoundedCache

TILE = 256
SHARED = 512            # texts of small components in a task
COLUMNS = 1 << 13       # n-grams in a matrix product
NO_ID = -(1 << 63)


def bands_for(similarity: float, recall: float = 0.9999, hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that reach ``recall`` with so many hashes."""
    for rows in range(16, 0, -1):
        miss = 1 - similarity ** rows
        bands = 1 if miss <= 0 else math.ceil(math.log(1 - recall) / math.log(miss))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no banding reaches that recall with so many hashes")


_HASHES = BoundedCache(xxhash.xxh3_64_intdigest, 500_000)


def ngrams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``n`` words; of all words if there are fewer; empty without words."""
    words = (text or "").encode("utf-8").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        out = (out ^ h[j:j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band."""
    draw = np.random.default_rng(17)    # fixed, so signatures of all tasks agree
    a = draw.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 1 << 63, bands * rows, np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for begin in range(0, len(grams), 4096):
        least = np.minimum(least, (grams[begin:begin + 4096, None] * a + b).min(axis=0))
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for row in least.reshape(bands, rows).T:
        out = (out ^ row) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """_id, _text (hash of the text), bands (array<long>, null without words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch.column(2):
                grams = ngrams(t.as_py(), n)
                made.append(signature(grams, bands, rows) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int64()))],
                                             names=["_id", "_text", "bands"])

    return docs.select(*_row_key(), "text").mapInArrow(run, "_id long, _text long, bands array<long>")


def _row_key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_text")


def _written(df: DataFrame, label: str) -> DataFrame:
    at = work_dir(df.sparkSession, label)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of the undirected edges (a, b): large and small stars.

    Each round is written; nothing of the graph passes through the driver but a checksum.
    """

    def stars(pairs: DataFrame, larger: bool) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(
            F.col("u").bitwiseXOR(F.lit(1)).alias("_u"), "m")
        tied = pairs.withColumn("_u", F.col("u").bitwiseXOR(F.lit(1))).join(least, "_u")
        if larger:
            return tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(tied.select("u", "m"))

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = state(now)   # stars to begin with are done after one round
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        wide = stars(both, True).where("a <> b")
        down = wide.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        now = _written(stars(down, False).where("a <> b").distinct(), "edges")
        seen = state(now)
        if seen == last:
            break
        last = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _linked(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix of the pairs of sets that reach the similarity."""
    same = a is b
    sets = a if same else a + b
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    gram, times = np.unique(np.concatenate(sets), return_counts=True)
    gram = gram[times > 1]                      # others are in no intersection
    row = np.repeat(np.arange(len(sets)), size)
    every = np.concatenate(sets)
    at = np.searchsorted(gram, every)
    there = (at < len(gram)) & (gram[np.minimum(at, max(len(gram) - 1, 0))] == every) if len(gram) else np.zeros(len(every), bool)
    row, at = row[there], at[there]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    common = np.zeros((len(a), len(a if same else b)))
    for begin in range(0, len(gram), COLUMNS):
        x, y = np.searchsorted(at, [begin, begin + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, len(gram) - begin)), np.float32)
        m[row[x:y], at[x:y] - begin] = 1
        common += m[:len(a)] @ (m if same else m[len(a):]).T
    union = size[:len(a), None] + (size[:len(a)] if same else size[len(a):]) - common
    return common >= similarity * union - 1e-9


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id of each row's component in a symmetric boolean matrix."""
    root = ids.copy()
    while True:
        least = np.where(linked, root, np.iinfo(np.int64).max).min(axis=1)
        least = np.minimum(least, root)
        if (least == root).all():
            return root
        root = least


def verified(frame: pd.DataFrame, n: int, similarity: float) -> pd.DataFrame:
    """For each text of a task _text, links, linked (copies of the linked texts), root (least text linked to it here)."""
    out = []
    for _, f in frame.groupby("comp", sort=False):
        first = f[f["tile"] == f["left"]]
        second = first if f["left"].iloc[0] == f["right"].iloc[0] else f[f["tile"] == f["right"]]
        ids, other = first["_text"].to_numpy(), second["_text"].to_numpy()
        a = [ngrams(t, n) for t in first["text"]]
        if second is first:
            linked = _linked(a, a, similarity)
            np.fill_diagonal(linked, False)
            root = _roots(linked, ids)
            out.append(pd.DataFrame({"_text": ids, "links": linked.sum(axis=1), "linked": linked @ first["copies"].to_numpy(),
                                     "root": root}))
            continue
        if not len(ids) or not len(other):
            continue
        linked = _linked(a, [ngrams(t, n) for t in second["text"]], similarity)
        whole = np.zeros((len(ids) + len(other),) * 2, bool)
        whole[:len(ids), len(ids):] = linked
        whole[len(ids):, :len(ids)] = linked.T
        both = np.concatenate([ids, other])
        out.append(pd.DataFrame({"_text": both, "links": whole.sum(axis=1),
                                 "linked": whole @ np.concatenate([first["copies"], second["copies"]]),
                                 "root": _roots(whole, both)}))
    return pd.concat(out) if out else pd.DataFrame(columns=["_text", "links", "linked", "root"])


def jaccard_links(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """For each row _id, _text, text_id, class_id, n_links.

    text_id: least doc_id with the same text; class_id: least doc_id of the texts connected by links; n_links: other rows whose
    text reaches the similarity, copies included. Texts of fewer than ``n`` words are one n-gram; texts without words (null,
    empty, blank) have no links and are their own class. A null doc_id counts as the least. Rows of one doc_id and one text are
    copies like others. An empty table gives an empty result.
    """
    bands, rows = bands_for(similarity, recall)
    made = _written(signatures(docs, n, bands, rows), "signatures")
    texts = made.where("bands IS NOT NULL").groupBy("_text").agg(
        F.min("_id").alias("text_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    texts = _written(texts, "texts")
    banded = texts.select("_text", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("_text").alias("least"), F.max("_text").alias("most")).where("least < most")
    own = F.col("band").bitwiseXOR(F.lit(1)).alias("_band")     # dealt anew, so that a common band can be split
    ties = banded.select(own, F.col("_text").alias("a")).join(least.select(own, F.col("least").alias("b")), "_band")
    candidates = _written(components(ties.select("a", "b")), "candidates")
    found = _written(_verify(docs, texts, candidates, n, similarity), "links")
    links = found.groupBy("_text").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))
    classes = components(found.select(F.col("_text").alias("a"), F.col("root").alias("b"))).select(
        F.col("node").alias("_text"), "root")
    rooted = texts.select("_text", "text_id", "copies").join(links, "_text", "left").join(classes, "_text", "left").withColumn(
        "root", F.coalesce("root", "_text"))
    least_id = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("text_id").alias("class_id"))
    rooted = rooted.join(least_id, rooted["root"] == least_id["_root"])
    # Copies of one text can be many: a key of its own lets Spark split them.
    key = F.col("_text").bitwiseXOR(F.lit(1)).alias("_key")
    rooted = rooted.select(key, "text_id", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return made.select("_id", "_text", key).join(rooted, "_key", "left").select(
        "_id", "_text", F.coalesce("text_id", "_id").alias("text_id"), F.coalesce("class_id", "_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _verify(docs: DataFrame, texts: DataFrame, candidates: DataFrame, n: int, similarity: float) -> DataFrame:
    sizes = candidates.groupBy("root").agg(F.count("*").alias("size"))
    placed = candidates.withColumn("_root", F.col("root").bitwiseXOR(F.lit(1))).join(
        sizes.select(F.col("root").bitwiseXOR(F.lit(1)).alias("_root"), "size"), "_root")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    placed = placed.select(F.col("node").alias("_text"), F.col("root").alias("comp"), tiles.alias("tiles"),
                           F.pmod(F.xxhash64("node", F.lit(3)), tiles).cast("int").alias("tile")).join(
        texts.select("_text", "text_id", "copies"), "_text")
    whole = docs.select(*_row_key(), "text").join(
        placed.withColumnRenamed("_text", "_node"), (F.col("_text") == F.col("_node")) & (F.col("_id") == F.col("text_id")))
    whole = whole.dropDuplicates(["_node", "text_id"])          # repeated rows
    total = candidates.count()
    shares = max(1, total // SHARED)
    pairs = whole.select("_text", "comp", "tile", "copies", "text", "tiles", F.explode(F.sequence(
        F.lit(0), F.col("tiles") - 1)).alias("other")).select(
        "_text", "comp", "tile", "copies", "text", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"),
        F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("comp"), F.lit(shares))).otherwise(F.col("comp")).alias("task"))
    return pairs.groupBy("task", "left", "right").applyInPandas(
        lambda f: verified(f, n, similarity), "_text long, links long, linked long, root long")


def join_report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, text_id (see ``jaccard_links``); class and text ids are null for the null doc_id."""
    out = jaccard_links(docs.select("doc_id", "text"))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return out.select(F.nullif(F.col("_id"), F.lit(NO_ID)).alias("doc_id"), known("class_id"), "n_links", known("text_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of least doc_id of each class, all columns, whatever their names. Of repeated rows one stays; texts without words stay."""
    kept = jaccard_links(docs.select("doc_id", "text")).where("_id = class_id").select("_id", "_text").distinct()
    key = _row_key()
    keyed = docs.select(F.struct("*").alias("_row"), key[0].alias("_k1"), key[1].alias("_k2"))
    return keyed.join(kept, (F.col("_k1") == F.col("_id")) & (F.col("_k2") == F.col("_text")), "left_semi").dropDuplicates(
        ["_k1", "_k2"]).select("_row.*")
