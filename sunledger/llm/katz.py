"""Katz backoff language model over words, trained and evaluated where the counts are.

P(w | h) is the Good-Turing discounted share of the pair (h, w) if training has it, else backoff(h) P(w); P(w) is the discounted
share of the word, and what discounting leaves belongs to the unknown word. backoff(h) is exact: what the pairs of h leave, over
the unigram probability of the words that do not follow h.

The count tables are split into buckets by hashed history, and blocks of documents talk to them (see ``blocks``):

1. A block sends the distinct words of its texts with their training counts and learns their corpus counts and numbers: a word's
   number is its bucket and its place among the bucket's words, so it takes as many bits as the vocabulary needs.
2. It sends its distinct pairs with training counts and the word's corpus count. A bucket then has every pair of a history, so it
   sums the counts and, for each history, how many pairs occur once, twice, ... and how many following words do: integers from
   which both sums of the backoff weight follow once the discounts are known. It answers with the pair counts, and with those
   sums for histories that the block has unseen pairs of. A frequent history is dealt over several buckets by the word, and a
   block adds up the answers.
3. Counts of counts of all buckets give the discounts; then each block evaluates its tokens.

All integer sums are exact; the texts are shuffled once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import blocks as B

LARGEST = 5             # counts above are taken as reliable
RELIABLE = 0.999        # their discount; it leaves some mass to unseen pairs in every history
SPREAD = 500_000        # a history of more training tokens is dealt over several buckets
BLOCKS_A_BUCKET = 4
BEGIN, END = b"\n<s>", b"\n</s>"    # no word has a line break
ASKING = np.uint64((1 << 64) - 1)   # a word number that only asks for a history's sums


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Discount of each count, ``[0]`` unused, the last for counts above ``LARGEST``; given the number of items of count 1 to
    ``LARGEST`` + 1. The largest range of counts for which Good-Turing gives discounts between 0 and 1 is discounted."""
    n = np.concatenate([[0.0], counts_of_counts.astype(float)])
    out = np.full(LARGEST + 2, RELIABLE)
    for k in range(LARGEST, 0, -1):
        if not n[1:k + 2].all():
            continue
        r = np.arange(1, k + 1)
        above = (k + 1) * n[k + 1] / n[1]
        d = ((r + 1) * n[2:k + 2] / n[1:k + 1] / r - above) / (1 - above) if above < 1 else np.zeros(k)
        if ((d > 0) & (d < 1)).all():
            out[1:k + 1] = d
            return out
    out[1] = 0.5    # no usable counts of counts
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * d[np.minimum(counts, LARGEST + 1)]


def _by_count(group: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """For each group: sums of the counts of 1, 2, ... ``LARGEST``, and of larger ones."""
    out = np.zeros((groups, LARGEST + 1), np.int64)
    np.add.at(out, (group, np.minimum(counts, LARGEST + 1) - 1), counts)
    return out


class Tokens:
    """Tokens of a block: ``word`` and ``history`` (places in ``keys``) of each, with its document and whether it trains."""

    def __init__(self, frame: pd.DataFrame):
        texts = [t.encode("utf-8").lower().split() if isinstance(t, str) else [] for t in frame["text"]]
        n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        number: dict[bytes, int] = {END: 0, BEGIN: 1}
        for words in texts:
            for w in words:
                if w not in number:
                    number[w] = len(number)
        raw = np.fromiter((number[w] for words in texts for w in (*words, END)), np.int64, int(n.sum()))
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        self.keys, self.word, self.begin = keys[order], rank[raw], rank[1]
        self.doc = np.repeat(np.arange(len(texts)), n)
        self.history = np.r_[self.begin, self.word[:-1]]
        self.history[np.r_[0, np.cumsum(n)[:-1]]] = self.begin
        self.train = np.repeat(frame["_train"].to_numpy(bool), n)
        self.n = n

    def pairs(self) -> None:
        """Distinct pairs: ``pair`` of each token, its ``h`` and ``w``, and training ``count``."""
        code, self.pair = np.unique(self.history * len(self.keys) + self.word, return_inverse=True)
        self.h, self.w = np.divmod(code, len(self.keys))
        self.count = np.bincount(self.pair, self.train, len(code)).astype(np.int64)


class Asked:
    """What a block asks buckets about its pairs: entries sorted by ``part`` (hashed history and share), then word."""

    def __init__(self, t: Tokens, corpus: np.ndarray, number: np.ndarray):
        t.pairs()
        follows = corpus.copy()
        follows[t.begin] = corpus[np.searchsorted(t.keys, xxhash.xxh3_64_intdigest(END))]
        self.follows = follows              # training tokens that follow a history
        shares = follows // SPREAD + 1
        word = number[t.w]
        share = (word % shares[t.h].astype(np.uint64)).astype(np.int64)
        # An unseen pair of a spread history needs the sums of all shares.
        open_ = np.unique(t.h[(t.count == 0) & (shares[t.h] > 1)])
        extra = np.repeat(open_, shares[open_])
        nth = np.arange(len(extra)) - np.repeat(np.cumsum(shares[open_]) - shares[open_], shares[open_])
        h = np.r_[t.h, extra]
        part = t.keys[h] + np.r_[share, nth].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = (part ^ (part >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        word = np.r_[word, np.full(len(extra), ASKING)]
        order = np.lexsort((word, part))
        self.order, self.h, self.part, self.word = order, h[order], part[order], word[order]
        self.count = np.r_[t.count, np.zeros(len(extra), np.int64)][order]
        self.corpus = np.r_[corpus[t.w], np.zeros(len(extra), np.int64)][order]
        self.pairs = len(t.h)


_SENT = "bucket int, block int, payload binary"
_REPLY = "block int, kind int, bucket int, payload binary"
_REPLY_COLUMNS = ["block", "kind", "bucket", "payload"]
_STATS = ", ".join(f"n{r} long" for r in range(1, LARGEST + 2))


def _ask_words(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    t = Tokens(frame)
    count = np.bincount(t.word, t.train, len(t.keys)).astype(np.uint32)
    bucket, bound = B.bucket_bounds(t.keys, buckets)
    block = int(frame["_block"].iloc[0])
    return B.rows(["bucket", "block", "payload"], [
        (b, block, B.packed(B.deltas(t.keys[x:y]), count[x:y])) for b, x, y in zip(bucket, bound[:-1], bound[1:])])


def _count_words(frame: pd.DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each sent array its corpus counts and places, and the counts of all words of the bucket."""
    sent = [B.unpacked(p) for p in frame["payload"]]
    keys = [B.undeltas(s[0]) for s in sent]
    found, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, np.concatenate([s[1] for s in sent]), len(found)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    return list(zip(np.split(total[which], ends), np.split(which, ends))), total


def _tell_words(frame: pd.DataFrame) -> pd.DataFrame:
    answers, _ = _count_words(frame)
    return B.rows(_REPLY_COLUMNS, [
        (block, 0, bucket, B.packed(a.astype(np.uint32 if a.max(initial=0) < 1 << 32 else np.int64), B.deltas(places).astype(np.uint32)))
        for block, bucket, (a, places) in zip(frame["block"], frame["bucket"], answers)])


def _counts_of_counts(total: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(total, LARGEST + 2), minlength=LARGEST + 3)[1:LARGEST + 2].tolist()


def _word_stats(frame: pd.DataFrame) -> pd.DataFrame:
    _, total = _count_words(frame)
    return pd.DataFrame([[0, int((total > 0).sum()), int(total.sum()), *_counts_of_counts(total)]])


def _told_words(replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts and numbers of a block's words."""
    mine = replies[replies["kind"] == 0].sort_values("bucket")
    told = [B.unpacked(p) for p in mine["payload"]]
    return (np.concatenate([counts.astype(np.int64) for counts, _ in told]),
            np.concatenate([B.undeltas(places).astype(np.uint64) + (np.uint64(b) << np.uint64(32)) for b, (_, places) in zip(mine["bucket"], told)]))


def _ask_pairs(frame: pd.DataFrame, replies: pd.DataFrame, buckets: int) -> pd.DataFrame:
    columns = ["bucket", "block", "payload"]
    if frame.empty:
        return B.rows(columns, [])
    a, block = Asked(Tokens(frame), *_told_words(replies)), int(frame["_block"].iloc[0])
    bucket, bound = B.bucket_bounds(a.part, buckets)
    # The corpus count only matters for pairs that train.
    corpus = np.where(a.count > 0, a.corpus, 0)
    return B.rows(columns, [(b, block, B.packed(
        B.deltas(a.part[x:y]), a.word[x:y], a.count[x:y].astype(np.uint32), corpus[x:y].astype(np.int64)))
        for b, x, y in zip(bucket, bound[:-1], bound[1:])])


class Pairs:
    """A bucket's pairs: for each sent entry its corpus count and history part, and the sums of each part."""

    def __init__(self, frame: pd.DataFrame):
        sent = [B.unpacked(p) for p in frame["payload"]]
        part = np.concatenate([B.undeltas(s[0]) for s in sent])
        word = np.concatenate([s[1] for s in sent])
        order = np.lexsort((word, part))
        part, word = part[order], word[order]
        new_part = np.r_[True, part[1:] != part[:-1]]
        new = new_part | np.r_[True, word[1:] != word[:-1]]
        at = np.flatnonzero(new)
        count = np.add.reduceat(np.concatenate([s[2] for s in sent])[order].astype(np.int64), at)
        corpus = np.maximum.reduceat(np.concatenate([s[3] for s in sent])[order], at)
        self.count, self.seen = count, count > 0
        of_pair = np.cumsum(new_part)[at] - 1
        groups = int(of_pair[-1]) + 1
        self.sums = np.hstack([_by_count(of_pair[self.seen], count[self.seen], groups),
                               _by_count(of_pair[self.seen], corpus[self.seen], groups)])
        ends = np.cumsum([len(s[0]) for s in sent])[:-1]
        back = np.empty((2, len(order)), np.int64)
        back[:, order] = count[np.cumsum(new) - 1], np.cumsum(new_part) - 1
        self.answers = list(zip(np.split(back[0], ends), np.split(back[1], ends)))


def _tell_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    p, out = Pairs(frame), []
    for block, bucket, (count, part) in zip(frame["block"], frame["bucket"], p.answers):
        open_ = np.unique(part[count == 0])                       # parts with an unseen pair
        first = np.searchsorted(part, open_)                      # a block's entries are sorted by part
        out.append((block, 1, bucket, B.packed(count.astype(np.uint32 if count.max() < 1 << 32 else np.int64),
                                               first, p.sums[open_].T.reshape(-1))))
    return B.rows(_REPLY_COLUMNS, out)


def _pair_stats(frame: pd.DataFrame) -> pd.DataFrame:
    p = Pairs(frame)
    return pd.DataFrame([[1, int(p.seen.sum()), int(p.count.sum()), *_counts_of_counts(p.count)]])


def _evaluate(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if frame.empty:
        return pd.DataFrame(columns=columns)
    stats = np.frombuffer(replies.loc[replies["kind"] == 2, "payload"].iloc[0], ">i8").reshape(2, -1)
    types, total, word_d, pair_d = stats[0, 0], stats[0, 1], discounts(stats[0, 2:]), discounts(stats[1, 2:])
    t = Tokens(frame)
    corpus, number = _told_words(replies)
    a = Asked(t, corpus, number)
    count, sums = np.zeros(len(a.part), np.int64), np.zeros((len(t.keys), 2 * (LARGEST + 1)), np.int64)
    bucket_replies = dict(zip(*(replies.loc[replies["kind"] == 1, c] for c in ("bucket", "payload"))))
    at = 0
    for b in sorted(bucket_replies):
        counts, first, values = B.unpacked(bucket_replies[b])
        count[at:at + len(counts)] = counts
        # A history has one part in a bucket for each share; what it asked of shares without its own pairs came back too.
        np.add.at(sums, a.h[at + first], values.reshape(2 * (LARGEST + 1), -1).T)
        at += len(counts)
    n = max(int(total), 1)
    known = discounted(corpus, word_d) / n
    unknown = 1 - discounted_mass(stats[0], word_d) / n if total else 1.0
    unigram = np.where(corpus > 0, known, unknown)
    follows = np.maximum(a.follows, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        taken = sums[:, :LARGEST + 1] @ pair_d[1:] / follows
        reached = sums[:, LARGEST + 1:] @ word_d[1:] / n
        backoff = np.where(a.follows > 0, (1 - taken) / (1 - reached), 1.0)
    of_pair = np.empty(a.pairs, np.int64)
    real = a.order < a.pairs
    of_pair[a.order[real]] = count[real]
    p = np.where(of_pair > 0, discounted(of_pair, pair_d) / follows[t.h], backoff[t.h] * unigram[t.w])
    log = np.log10(p)[t.pair]
    base = np.log10((corpus + 1) / (total + types + 1))[t.word]
    docs = len(frame)
    return pd.DataFrame({
        "doc_id": frame["doc_id"].astype("Int64"), "held_out": frame["_held"], "n_tokens": t.n,
        "n_known": np.bincount(t.doc, corpus[t.word] > 0, docs).astype(np.int64), "train_tokens": int(total),
        "base_score": np.bincount(t.doc, base, docs), "score": np.bincount(t.doc, log, docs)})[columns]


def discounted_mass(stats: np.ndarray, d: np.ndarray) -> float:
    """Discounted count of all items, from (types, total, counts of counts)."""
    r = np.arange(1, LARGEST + 1)
    few = stats[2:2 + LARGEST] * r
    return float(few @ d[1:LARGEST + 1] + (stats[1] - few.sum()) * d[LARGEST + 1])


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row's whole text.

    Training texts are those whose crc32(doc_id) mod ``folds`` is not ``held``; a null doc_id is in no fold, is not held out and
    does not train. Null and empty texts have the end token alone. Repeated rows train and count each. Without training tokens
    every token is the unknown word, of probability 1. An empty table gives an empty result.
    """
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return score_with(docs, part != held, part == held)


def score_with(docs: DataFrame, train: Column, held_out: Column) -> DataFrame:
    """``score_documents`` with any condition for training and for the column held_out; null conditions are false."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("_train"),
                       F.coalesce(held_out, F.lit(False)).alias("_held"))
    texts, n = B.in_blocks(rows)
    buckets = (n + BLOCKS_A_BUCKET - 1) // BLOCKS_A_BUCKET
    own = texts.groupBy("_block")
    stats = f"kind int, types long, total long, {_STATS}"
    asked = own.applyInPandas(lambda f: _ask_words(f, buckets), _SENT).groupBy("bucket")
    words = asked.applyInPandas(_tell_words, _REPLY)
    pairs = own.cogroup(words.groupBy("block")).applyInPandas(lambda f, r: _ask_pairs(f, r, buckets), _SENT).groupBy("bucket")
    told = pairs.applyInPandas(_tell_pairs, _REPLY)

    def totals(stated: DataFrame) -> DataFrame:
        columns = [F.coalesce(F.sum(c), F.lit(0)) for c in stated.columns[1:]]
        return stated.agg(F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in columns]).alias("s"))

    both = F.concat(totals(asked.applyInPandas(_word_stats, stats)).scalar(), totals(pairs.applyInPandas(_pair_stats, stats)).scalar())
    each = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("block"), F.lit(2).alias("kind"), F.lit(0).alias("bucket"),
                                             both.alias("payload"))
    replies = words.unionByName(told).unionByName(each)
    return own.cogroup(replies.groupBy("block")).applyInPandas(
        _evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
