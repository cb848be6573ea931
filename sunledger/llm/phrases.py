"""Phrase collocations by best-first branch and bound.

A phrase grows from its first word to the right. Cutting it behind its first word gives a score of at most scale * n / f(first
word), as the rest is at least as frequent as the phrase: the count of the first word bounds every phrase that grows from it. So
first words are expanded best bound first, in rounds: each round takes the next share of a language's words, rarest first, counts
their extensions word by word (a prefix that is too rare is not extended), and settles the scores of what it found. Once a
language has as many surviving phrases as are asked for, only words whose bound reaches the last of them, ties included, are
left to expand; then the language is settled. With a large corpus that is a small share of its words.

Counting is exact. Texts are split into words twice, to count the words and to write down the runs of frequent ones: no phrase
that is frequent enough has another word in it, nor always the same other word beside it, so any other word is a gap there, like a
break. These runs are scanned again for each level; a scan emits only phrases whose prefix may be wanted, by a bitmap
of hashed prefixes of at most 2^27 bits (16 MB), whatever the number of prefixes; false hits are taken out by a join. Words and
phrases never come to the driver. A word is told apart by a 64-bit hash of language and letters, a phrase by those of its words.

Whether a phrase is part of a longer one that is as frequent shows in its neighbours: exactly then all its occurrences have the
same word before them, or the same word behind them, in the same piece.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sunledger.llm import blocks as B
from sunledger.llm.tokens import Words, chained, text_hash, words_of
from sunledger.session import work_dir

MOST_BITS = 27
CHUNK_BITS = 15     # positions of one bitmap_construct_agg
HELD = 1 << 19      # rows that a task adds up before it sends them
NO_LANGUAGE = "und"
# Parts of a language's frequent occurrences that are expanded before there are enough phrases to bound by.
SHARES = (1 / 16, 1 / 4)


@dataclass(frozen=True)
class PhraseRules:
    """Words of the longest phrase, occurrences of a candidate, phrases of a language, factor of the score."""

    longest: int = 5
    least: int = 100
    top: int = 2000
    scale: int = 1000

    @property
    def keys(self) -> list[str]:
        return [f"w{i}" for i in range(1, self.longest + 1)]


@dataclass(frozen=True)
class Bitmap:
    """Hashed set with false hits."""

    held: np.ndarray
    bits: int

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _combined(columns: list[np.ndarray], kinds: list) -> list[np.ndarray]:
    """One row for each value of the first column: ``kinds`` names what adds up the others, None for what is equal."""
    order = np.argsort(columns[0], kind="stable")
    first = columns[0][order]
    begin = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.empty(0, np.int64)
    return [c[order[begin]] if kind is None or not len(begin) else kind.reduceat(c[order], begin)
            for c, kind in zip(columns, kinds)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """The words of texts (text, lang) slice by slice, with the language of each row of their batch."""
    known: dict[str, np.uint64] = {}
    for batch in batches:
        languages = batch.column(1).to_pylist()
        for x in set(languages) - known.keys():
            known[x] = text_hash(x)
        for words in words_of(batch.column(0), [known[x] for x in languages]):
            if len(words):
                yield words, languages


def _runs(docs: DataFrame, frequent) -> DataFrame:
    """The frequent words of ``docs`` (text, lang): a row a slice, with its different words and their places, 0 for a gap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in _slices(batches):
            kept = np.flatnonzero(frequent.value.has(words.hash))
            if len(kept):
                gap = (np.diff(kept) != 1) | (words.piece[kept[1:]] != words.piece[kept[:-1]])
                dictionary, which = np.unique(words.hash[kept], return_inverse=True)
                places = np.insert(which + 1, np.flatnonzero(gap) + 1, 0)
                payload = B.packed(B.deltas(dictionary), places.astype(np.uint16 if len(dictionary) < 1 << 16 else np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], names=["payload"])

    return docs.mapInArrow(run, "payload binary")


def _kept_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """What ``_runs`` has written, a run as a piece; the words have no spelling and no rows."""
    none = np.empty(0, np.int64)
    for batch in batches:
        for payload in batch.column(0):
            deltas, places = B.unpacked(payload.as_py())
            gap = places == 0
            words = B.undeltas(deltas)[places[~gap].astype(np.int64) - 1]
            yield Words(none, none, none, words, np.cumsum(gap)[~gap], none), []


def _scan(rows_: DataFrame, emit: Callable[[Words, list[str]], list[np.ndarray]], kinds: list, schema: str, slices=_kept_slices) -> DataFrame:
    """What ``emit`` gives for each of the ``slices`` of the rows.

    Its first column groups the rows and is left out of the result; a task adds the rows of its slices up as far as ``HELD`` of
    them go, so that what is common is sent a few times by each task.
    """
    kinds = [None, *kinds]
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype != object else c) for c in columns[1:]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for words, languages in slices(batches):
            held.append(emit(words, languages))
            size += len(held[-1][0])
            if size > HELD:
                held = [_combined([np.concatenate(c) for c in zip(*held)], kinds)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield rows(held[0])
                    held, size = [], 0
        if size:
            yield rows(_combined([np.concatenate(c) for c in zip(*held)], kinds))

    return rows_.mapInArrow(run, schema)


def _word_counts(docs: DataFrame, rules: PhraseRules) -> DataFrame:
    """(lang, w, word, f) of the frequent words; w = 0 has the number of all words of a language."""
    def emit(words: Words, languages: list[str]) -> list[np.ndarray]:
        w, first, n = np.unique(words.hash, return_index=True, return_counts=True)
        rows, all_ = np.unique(words.text, return_counts=True)
        langs = [languages[i] for i in words.text[first].tolist()] + [languages[i] for i in rows.tolist()]
        group = np.r_[w, np.array([text_hash(x) for x in langs[len(w):]], np.uint64)]
        return [group, np.array(langs, object), np.r_[w, np.zeros(len(rows), np.uint64)],
                np.array(words.spelled(first) + [""] * len(rows), object), np.r_[n, all_]]

    counted = _scan(docs, emit, [None, None, None, np.add], "lang string, w long, word string, n long", _slices).groupBy(
        "lang", "w", "word").agg(F.sum("n").alias("f"))
    return counted.where((F.col("f") >= rules.least) | (F.col("w") == 0))


def _bitmap(phrases: DataFrame, keys: list[str], rows: int) -> Bitmap:
    """Of the phrases in ``keys`` (0 behind the last word); its size follows ``rows`` up to 16 MB."""
    bits = min(MOST_BITS, max(CHUNK_BITS + 1, math.ceil(math.log2(16 * max(rows, 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [np.asarray(c).view(np.uint64) for c in batch.columns]
            g = columns[0]
            for w in columns[1:]:
                g = np.where(w == 0, g, chained(g, w))
            yield pa.RecordBatch.from_arrays([pa.array((g >> np.uint64(64 - bits)).view(np.int64))], names=["at"])

    at = phrases.select(*keys).mapInArrow(run, "at long")
    chunk = F.shiftright("at", CHUNK_BITS).alias("chunk")
    found = at.groupBy(chunk).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))).alias("set")).collect()
    held = np.zeros(1 << bits - 3, np.uint8)
    for r in found:     # at most 2^12 of 4 KB
        size = 1 << CHUNK_BITS - 3
        held[r["chunk"] * size:(r["chunk"] + 1) * size] = np.frombuffer(r["set"], np.uint8)[:size]
    return Bitmap(held, bits)


def _extensions(runs: DataFrame, firsts, prefixes, frequent, m: int) -> DataFrame:
    """Occurrences of phrases of ``m`` words that extend a prefix by a frequent word: (w1 .. wm, n), added up in part.

    ``firsts``: the first words of all prefixes, so that little else is hashed.
    """
    names = [f"w{i}" for i in range(1, m + 1)]

    def emit(words: Words, _: list[str]) -> list[np.ndarray]:
        at = words.within(np.flatnonzero(firsts.value.has(words.hash)), m)
        at = at[frequent.value.has(words.hash[at + m - 1])]
        g = words.phrase_hash(at, m - 1)
        if m > 2:
            found = prefixes.value.has(g)
            at, g = at[found], g[found]
        g, first, n = np.unique(chained(g, words.hash[at + m - 1]), return_index=True, return_counts=True)
        return [g, *(words.hash[at[first] + i] for i in range(m)), n]

    return _scan(runs, emit, [None] * m + [np.add], ", ".join(f"{c} long" for c in [*names, "n"]))


def _settled(runs: DataFrame, firsts, wanted, rules: PhraseRules) -> DataFrame:
    """Wanted phrases of 2 words and more: (w1 .., a, least and greatest neighbour before and behind)."""
    names = [*rules.keys, "n", "pmin", "pmax", "nmin", "nmax"]
    kinds = [*[None] * rules.longest, np.add, np.minimum, np.maximum, np.minimum, np.maximum]

    def emit(words: Words, _: list[str]) -> list[np.ndarray]:
        at, parts = np.flatnonzero(firsts.value.has(words.hash)), []
        for m in range(2, rules.longest + 1):
            at = words.within(at, m)
            g = words.phrase_hash(at, m)
            found = wanted.value.has(g)
            here, g = at[found], g[found]
            before, behind = words.neighbour(here, -1).view(np.int64), words.neighbour(here, m).view(np.int64)
            zero = np.zeros(len(here), np.uint64)
            parts.append(_combined([g, *(words.hash[here + i] if i < m else zero for i in range(rules.longest)),
                                    np.ones(len(here), np.int64), before, before, behind, behind], [None, *kinds]))
        return [np.concatenate(c) for c in zip(*parts)]

    rows = _scan(runs, emit, kinds, ", ".join(f"{c} long" for c in names))
    return rows.groupBy(*rules.keys).agg(F.sum("n").alias("a"), *(f(c).alias(c) for c, f in (
        ("pmin", F.min), ("pmax", F.max), ("nmin", F.min), ("nmax", F.max))))


def _bound(n: Column, count: Column, scale: int) -> Column:
    return F.floor(F.lit(scale).cast("decimal(20,0)") * n.cast("decimal(18,0)") / count.cast("decimal(18,0)"))


def _length(keys: list[str]) -> Column:
    return sum(F.when(F.col(k) != 0, 1).otherwise(0) for k in keys)


def _last_word(keys: list[str]) -> Column:
    return F.coalesce(*(F.nullif(F.col(k), F.lit(0).cast("long")) for k in reversed(keys)))


class _Rounds:
    """Tables of one run below the shared folder; every one is written once and read by name."""

    def __init__(self, spark: SparkSession, docs: DataFrame, rules: PhraseRules):
        self.spark, self.rules = spark, rules
        self.folder = work_dir(spark, "phrases")
        self.words = self.kept("words", _word_counts(docs, rules))
        self.totals = self.words.where("w = 0").select("lang", F.col("f").alias("n"))
        self.words = self.words.where("w <> 0")
        self.frequent = self.shared(self.words, ["w"], self.words.count())
        self.runs = self.kept("runs", _runs(docs, self.frequent))

    def kept(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def shared(self, phrases: DataFrame, keys: list[str], rows: int):
        return self.spark.sparkContext.broadcast(_bitmap(phrases, keys, rows))

    def spans(self) -> DataFrame:
        """lang, n, most frequent count, and the counts up to which each of ``SHARES`` goes."""
        binned = self.words.groupBy("lang", F.floor(F.log2("f") * 4).alias("bin")).agg(F.sum("f").alias("all"), F.max("f").alias("to"))
        upto = Window.partitionBy("lang").orderBy("bin")    # a few bins per doubling
        whole = Window.partitionBy("lang")
        part = F.sum("all").over(upto) / F.sum("all").over(whole)
        marked = binned.select("lang", "to", part.alias("part"))
        steps = [F.coalesce(F.max(F.when(F.col("part") <= s, F.col("to"))), F.min("to")).alias(f"to{i}") for i, s in enumerate(SHARES)]
        return marked.groupBy("lang").agg(F.max("to").alias("most"), *steps).join(self.totals, "lang")

    def grown(self, frontier: DataFrame, name: str) -> DataFrame | None:
        """All phrases frequent enough that start with a word of the frontier: (w1 .., a)."""
        keys, prefixes, all_ = self.rules.keys, frontier.select("w1"), None
        firsts = None
        for m in range(2, self.rules.longest + 1):
            rows = prefixes.count()
            if not rows:
                break
            on = keys[:m - 1]
            held = self.shared(prefixes, on, rows)
            firsts = firsts or held
            found = _extensions(self.runs, firsts, held, self.frequent, m)
            found = found.groupBy(*keys[:m]).agg(F.sum("n").alias("a")).where(F.col("a") >= self.rules.least)
            found = self.kept(f"{name}-{m}", found.join(prefixes, on, "left_semi"))
            prefixes = found.select(*keys[:m])
            padded = found.select(*keys[:m], *(F.lit(0).cast("long").alias(k) for k in keys[m:]), "a")
            all_ = padded if all_ is None else all_.unionByName(padded)
        return all_

    def scored(self, found: DataFrame, states: DataFrame, name: str) -> DataFrame:
        """lang, w1 .., a, l, r, n, score of the surviving phrases among ``found`` that can still reach their language's threshold."""
        rules, keys = self.rules, self.rules.keys
        of_word = self.words.select(F.col("w").alias("last"), "lang", F.col("f").alias("last_f"))
        phrases = found.withColumn("last", _last_word(keys)).join(of_word, "last").join(states.select("lang", "n", "theta"), "lang")
        phrases = phrases.where(_bound(F.col("n"), F.col("last_f"), rules.scale) >= F.coalesce("theta", F.lit(0))).drop("last", "last_f", "theta")
        phrases = self.kept(f"{name}-phrases", phrases)
        zero = F.lit(0).cast("long")
        rests = [phrases.where(F.col(keys[k + 1]) != 0).select(
            *(F.col(keys[i + k]).alias(keys[i]) if i + k < len(keys) else zero.alias(keys[i]) for i in range(len(keys))))
            for k in range(1, rules.longest - 1)]
        wanted = phrases.select(*keys)
        for r in rests:
            wanted = wanted.unionByName(r)
        wanted = self.kept(f"{name}-wanted", wanted.distinct())
        rows = wanted.count()
        told = _settled(self.runs, self.shared(wanted, keys[:1], rows), self.shared(wanted, keys, rows), rules)
        told = self.kept(f"{name}-told", told.join(wanted, keys, "left_semi"))

        single = self.words.select(F.col("w").alias("w1"), *(zero.alias(k) for k in keys[1:]), F.col("f").alias("a"))
        counts = single.unionByName(found.select(*keys, "a")).unionByName(told.select(*keys, "a")).groupBy(*keys).agg(F.max("a").alias("f"))
        size = _length(keys)
        cuts = phrases.select(*keys, "lang", "a", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
        words = F.array(*keys)
        left = [F.when(F.lit(i) < F.col("k"), F.col(k)).otherwise(zero).alias(f"l{i}") for i, k in enumerate(keys)]
        right = [F.coalesce(F.get(words, F.col("k") + i), zero).alias(f"r{i}") for i in range(len(keys))]
        cuts = cuts.select("*", *left, *right)
        for side, name_ in (("l", "l"), ("r", "r")):
            cols = [f"{side}{i}" for i in range(len(keys))]
            cuts = cuts.join(counts.toDF(*cols, name_), cols).drop(*cols)
        exact = F.expr(f"CAST({rules.scale} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(18,0)) div "
                       "(CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
        best = cuts.withColumn("score", exact).groupBy("lang", *keys, "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        best = best.select("lang", *keys, "a", "n", "cut.l", "cut.r", "cut.score")
        single_neighbour = ((F.col("pmin") == F.col("pmax")) & (F.col("pmin") != 0)) | ((F.col("nmin") == F.col("nmax")) & (F.col("nmin") != 0))
        inner = told.where((F.col(keys[-1]) == 0) & single_neighbour)
        return self.kept(f"{name}-scored", best.join(inner, keys, "left_anti"))

    def thresholds(self, scored: DataFrame) -> DataFrame:
        """lang, theta: the score of the last phrase that is asked for, where there are so many."""
        by = Window.partitionBy("lang").orderBy(F.col("score").desc())
        return scored.select("lang", "score", F.row_number().over(by).alias("no")).where(
            F.col("no") <= self.rules.top).where(F.col("no") == self.rules.top).select("lang", F.col("score").alias("theta"))


def mine_phrases(docs: DataFrame, rules: PhraseRules = PhraseRules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language.

    Null languages are ``und``, together with those called so. Null and empty texts have no words; repeated rows count each.
    Ties of score go by a, then by phrase in UTF-8 order. A language without a phrase frequent enough has no rows; an empty
    table gives an empty result. Other columns are not read. A text is cut at piece breaks when it is long; one piece of a text
    must fit in a task. Bytes that are no UTF-8 are replaced in the spelling of a phrase only.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    run, keys = _Rounds(spark, docs, rules), rules.keys
    spans = run.kept("spans", run.spans())
    highs = [*(f"to{i}" for i in range(len(SHARES))), "most"]
    states = spans.select("lang", "n", "most", *highs[:-1], F.lit(0).cast("long").alias("low"), F.col(highs[0]).alias("high"), F.lit(None).cast("long").alias("theta"))
    scored = None
    for i in range(len(SHARES) + 2):
        states = run.kept(f"states-{i}", states)
        open_ = states.where("low < high")
        frontier = run.kept(f"frontier-{i}", run.words.join(open_, "lang").where("f > low AND f <= high").select(F.col("w").alias("w1")))
        if not frontier.head(1):
            if not open_.head(1):
                break
        else:
            found = run.grown(frontier, f"round-{i}")
            if found is not None and found.head(1):
                more = run.scored(found, states, f"round-{i}")
                scored = more if scored is None else scored.unionByName(more)
        theta = run.thresholds(scored) if scored is not None else spark.createDataFrame([], "lang string, theta long")
        later = highs[min(i + 1, len(highs) - 1)]
        reached = F.least("most", _bound(F.col("n"), F.col("theta"), rules.scale).cast("long"))
        states = states.drop("theta").join(theta, "lang", "left").withColumn("low", F.col("high")).withColumn(
            "high", F.when(F.col("theta").isNotNull() & (F.col("theta") > 0), reached).otherwise(F.col(later)))
    if scored is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    theta = run.kept("theta", run.thresholds(scored))
    best = run.kept("best", scored.join(theta, "lang", "left").where(F.col("score") >= F.coalesce("theta", F.lit(0))).drop("theta"))
    spelled = best.select(*keys, F.posexplode(F.filter(F.array(*keys), lambda w: w != 0)).alias("at", "w")).join(
        run.words.select("w", "word"), "w").groupBy(*keys).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = best.join(spelled, keys).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rules.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
