"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum, over all its
segmentations into pieces, of the product of their probabilities: a forward recursion over its characters. Pieces do not cross
white space, so a text's log-probability is the sum over its words.

Training is expectation-maximisation on a bounded sample: at most ``rows_per_language`` labelled texts of each language, those
of the smallest hash of their id. Scoring is one narrow pass over all rows; workers keep the scores of words they have met.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .vocab import FileOnWorkers

UNKNOWN = 1e-7       # probability of a character that no piece holds
SCALED = 40          # longer words are summed in logs
CACHED = 600_000
SLICE = 2 << 20      # characters of text whose new words are scored together


class Pieces:
    """The vocabulary's pieces of text (word start is ``▁``), without control and byte pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor()
        sp.LoadFromSerializedProto(model)
        self.pieces = [p for i in range(len(sp)) if not (sp.IsControl(i) or sp.IsByte(i) or sp.IsUnknown(i))
                       and "▁" not in (p := sp.IdToPiece(i))[1:]]
        # Rows of the model: 0 is an unknown character, pieces count from 1. Beginnings of pieces that are none stand at 0.
        self.row = {p[:i]: 0 for p in self.pieces for i in range(1, len(p))} | {p: i for i, p in enumerate(self.pieces, 1)}

    def edges(self, word: str, shift: int = 6, number: int = 0) -> list[int]:
        """Every piece in ``▁word``, and characters that no piece holds alone, as whole numbers: (end, start) of ``shift`` bits,
        then ``number`` of 24 bits, then the row of 16."""
        text, get, out = "▁" + word, self.row.get, []
        tail, n = number << 16, len(text)
        for i in range(n):
            alone = False
            for j in range(i + 1, n + 1):
                row = get(text[i:j])
                if row is None:
                    break
                if row:
                    out.append((j << shift | i) << 40 | tail | row)
                    alone = alone or j == i + 1
            if not alone:
                out.append((i + 1 << shift | i) << 40 | tail)
        return out

    def steps(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, row) of each edge, for words of any length."""
        shift = (len(word) + 1).bit_length()
        return [(e >> 40 & (1 << shift) - 1, e >> 40 + shift, e & 0xFFFF) for e in self.edges(word, shift)]


def words_of(text: str) -> list[str]:
    return text.lower().split()


def log_sums(begin: np.ndarray, end: np.ndarray, log: np.ndarray, n: int) -> np.ndarray:
    """(n + 1, languages): log of the sum over all ways from 0 to each place; ``log``: (edges, languages)."""
    order = np.argsort(end, kind="stable")
    begin, log, bound = begin[order], log[order], np.searchsorted(end[order], np.arange(n + 2))
    out = np.full((n + 1, log.shape[1]), -np.inf)
    out[0] = 0
    for j in range(1, n + 1):
        a, b = bound[j], bound[j + 1]
        out[j] = np.logaddexp.reduce(out[begin[a:b]] + log[a:b], axis=0)
    return out


def forward(edges: list[tuple[int, int, int]], n: int, p: np.ndarray) -> np.ndarray:
    """Log-probability of a word of ``n`` characters in each language; ``p``: (1 + pieces, languages)."""
    begin, end, row = np.array(edges).T
    return log_sums(begin, end, np.log(p[row]), n)[n]


def expected_counts(edges: list[tuple[int, int, int]], n: int, p: list[float]) -> dict[int, float]:
    """Expected uses of each piece in one word of one language; words above ``SCALED`` characters in logs."""
    out: dict[int, float] = {}
    if n > SCALED:
        begin, end, row = np.array(edges).T
        log = np.log([p[x] for x in row.tolist()])[:, None]
        a, b = log_sums(begin, end, log, n), log_sums(n - end, n - begin, log, n)[::-1]
        for piece, x in zip(row.tolist(), np.exp(a[begin] + log + b[end] - a[n])[:, 0].tolist()):
            if piece:
                out[piece] = out.get(piece, 0.0) + x
        return out
    a, b = [0.0] * (n + 1), [0.0] * (n + 1)
    a[0] = b[n] = 1.0
    for i, j, piece in sorted(edges, key=lambda e: e[1]):
        a[j] += a[i] * p[piece]
    for i, j, piece in sorted(edges, key=lambda e: -e[0]):
        b[i] += b[j] * p[piece]
    for i, j, piece in edges:
        if piece:
            out[piece] = out.get(piece, 0.0) + a[i] * p[piece] * b[j] / a[n]
    return out


@dataclass
class Model:
    languages: list[str]
    p: np.ndarray           # (1 + pieces, languages); row 0 is an unknown character


def crc_part(parts: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def train(spark: SparkSession, labelled: DataFrame, vocabulary: str, rows_per_language: int = 500, rounds: int = 2,
          smoothing: float = 0.02) -> Model:
    """Model from ``labelled`` (doc_id, text, lang); rows without text or lang teach nothing.

    Words of any length teach; in scripts without spaces they are whole sentences. A language is learned if a text of its sample
    has a word. The model's size is bounded: the vocabulary times the number of languages.
    """
    place = F.xxhash64("doc_id", "text")
    sample = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select(
        "doc_id", "text", "lang", place.alias("_place"), F.pmod(place, F.lit(64)).alias("_part"))
    for by in (["lang", "_part"], ["lang"]):    # parts first: a language can have most of the rows
        order = Window.partitionBy(*by).orderBy("_place", "doc_id")
        sample = sample.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= rows_per_language)
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word <> ''").groupBy(
        "lang", "word").count().cache()
    try:
        languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
        file = FileOnWorkers(spark, vocabulary)
        size = len(file.parsed(Pieces).pieces)
        start = 1 / (np.arange(size) + 100.0)       # pieces stand in order of frequency
        p = np.tile(np.insert(start / start.sum(), 0, UNKNOWN)[:, None], (1, max(1, len(languages))))
        for _ in range(rounds if languages else 0):
            held = spark.sparkContext.broadcast(p)

            def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                pieces = file.parsed(Pieces)
                total: dict[tuple[str, int], float] = {}
                columns = {lang: held.value[:, i].tolist() for i, lang in enumerate(languages)}
                for frame in frames:
                    for lang, word, count in zip(frame["lang"], frame["word"], frame["count"], strict=True):
                        for piece, x in expected_counts(pieces.steps(word), len(word) + 1, columns[lang]).items():
                            total[lang, piece] = total.get((lang, piece), 0.0) + count * x
                yield pd.DataFrame([(a, b, x) for (a, b), x in total.items()], columns=["lang", "piece", "n"])

            counts = words.mapInPandas(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(
                F.sum("n").alias("n")).collect()
            n = np.full((size, len(languages)), smoothing)
            for r in counts:
                n[r["piece"] - 1, languages.index(r["lang"])] += r["n"]
            p = np.vstack([np.full((1, len(languages)), UNKNOWN), n / n.sum(axis=0)])
        return Model(languages, p)
    finally:
        words.unpersist()


class Scorer:
    """Word scores of a model, kept in one table of bounded size."""

    def __init__(self, pieces: Pieces, model: Model):
        self.pieces, self.p = pieces, model.p
        self.log = np.zeros((0, model.p.shape[1]))
        self.row: dict[str, int] = {}

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log-probabilities, (words, languages); words of like lengths go through the recursion side by side."""
        out = np.empty((len(words), self.p.shape[1]))
        short = [x for x, w in enumerate(words) if len(w) < SCALED]
        for x in set(range(len(words))) - set(short):
            out[x] = forward(self.pieces.steps(words[x]), len(words[x]) + 1, self.p)
        edges = np.sort(np.fromiter(itertools.chain.from_iterable(
            self.pieces.edges(words[x], 6, y) for y, x in enumerate(short)), np.int64))
        where, word, row = edges >> 40, edges >> 16 & 0xFFFFFF, edges & 0xFFFF
        alpha = np.zeros((SCALED + 1, len(short), self.p.shape[1]))
        alpha[0] = 1
        bounds = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True]) if len(edges) else np.zeros(1, int)
        for a, b in zip(bounds[:-1], bounds[1:]):   # by end, so that a start is complete; a word has one piece from i to j
            i, j, y = where[a] & 63, where[a] >> 6, word[a:b]
            alpha[j, y] += alpha[i, y] * self.p[row[a:b]]
        ends = np.fromiter((len(words[x]) + 1 for x in short), np.int64, len(short))
        out[short] = np.log(alpha[ends, np.arange(len(short))])
        return out

    def add(self, texts: list[list[str]]) -> None:
        new = list({w for t in texts for w in t if w not in self.row})
        if len(self.row) + len(new) > CACHED:
            self.row.clear()
            self.log = self.log[:0]
            new = list({w for t in texts for w in t})
        parts = [self.log]
        for begin in range(0, len(new), 20_000):
            part = new[begin:begin + 20_000]
            self.row.update(zip(part, range(len(self.row), len(self.row) + len(part))))
            parts.append(self.score_words(part))
        self.log = np.concatenate(parts)

    def score(self, words: list[str]) -> np.ndarray:
        return self.log[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0)


_SCORERS: dict = {}


def predict(spark: SparkSession, docs: DataFrame, model: Model, vocabulary: str) -> DataFrame:
    """doc_id, lang_pred, score for each row, from its text alone.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. The score is the posterior probability
    of the predicted language under equal priors; of languages with equal scores the first by name is taken.
    """
    file = FileOnWorkers(spark, vocabulary)
    held, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def judge(text: str | None, words: list[str], scorer: Scorer, languages: list[str]) -> tuple[str, float]:
        if not languages or not any(map(str.isalpha, text or "")):
            return "und", 0.0
        log = scorer.score(words)
        best = int(log.argmax())
        return languages[best], float(1 / np.exp(log - log[best]).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()  # a worker serves one model at a time
            _SCORERS[key] = Scorer(file.parsed(Pieces), held.value)
        scorer, languages = _SCORERS[key], held.value.languages
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            begin, size = 0, 0
            for x, t in enumerate(texts):
                size += len(t or "")
                if size >= SLICE or x == len(texts) - 1:
                    words = [words_of(t or "") for t in texts[begin:x + 1]]
                    scorer.add(words)
                    out += [judge(t, w, scorer, languages) for t, w in zip(texts[begin:x + 1], words, strict=True)]
                    begin, size = x + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in out], pa.string()),
                                              pa.array([b for _, b in out], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr("bigint(doc_id) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def predict_languages(spark: SparkSession, docs: DataFrame, vocabulary: str, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents whose crc32(doc_id) mod ``folds`` is not ``held``.

    A null doc_id is in no fold: not held out, and nothing is learned from it. lang, source and doc_id play no part in a
    prediction.
    """
    part = crc_part(folds)
    model = train(spark, docs.where(part != held), vocabulary)
    out = predict(spark, docs, model, vocabulary)
    return out.select("doc_id", F.coalesce(part == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
