"""Quality rules, line first.

Each line with a word is judged by line rules; failing lines are removed; a document that loses too large a part of its
words' characters that way is rejected, as is one that fails the base rules. Rows are independent: one narrow pass, no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

# Usual phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "enable javascript", "javascript is disabled", "log in",
    "lorem ipsum", "powered by", "privacy policy", "read more", "sign in", "sign up", "skip to content", "subscribe to our",
    "terms of service", "terms of use",
)
TERMINAL = ".!?…。！？"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; ``most_lost`` is the part of the characters a document may lose."""

    separators_per_word: float = 0.25    # navigation: "Home | News | Contact"
    symbols_per_word: float = 0.5
    upper_part: float = 0.9              # of the letters of a line that shouts
    bangs_per_word: float = 0.5
    unended_words: int = 40              # a longer line must have the end of a sentence
    repeats_per_word: float = 0.4        # words equal to the one before: "this this this that that"
    most_lost: float = 0.5


_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)))


def line_fails(line: str, words: int, rules: LineRules = LineRules()) -> str:
    """Name of the first rule that a line with a word fails, or nothing."""
    if line.count("|") + line.count("»") > rules.separators_per_word * words and words > 1:
        return "navigation"
    if sum(map(line.count, SYMBOLS)) > rules.symbols_per_word * words:
        return "symbols"
    if line.count("!") > rules.bangs_per_word * words and words > 2:
        letters = [c for c in line if c.isalpha()]
        if sum(map(str.isupper, letters)) >= rules.upper_part * len(letters):
            return "shouting"
    if words > rules.unended_words and not any(c in line for c in TERMINAL):
        return "punctuation"
    if words <= 20 and _BOILER.search(line.lower()):
        return "boilerplate"
    if words > 9:
        split = line.split()
        if sum(map(str.__eq__, split, split[1:])) > rules.repeats_per_word * words:
            return "repeats"
    return ""


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for j in range(width):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + h[j:n + j]
    order = np.sort(keys)
    if not (order[1:] == order[:-1]).any():
        return 0
    windows = [tuple(words[i:i + width]) for i in range(n)]  # only now, and exactly
    found = Counter(windows)
    covered, until = 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            covered += i + width - max(i, until)
            until = i + width
    return covered


def judge(text: str | None, rules: LineRules = LineRules()) -> dict:
    """All counts and the verdict of one text (null: empty), with the text that is left as ``clean``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, dup, clean, lost, bad = set(), 0, [], 0, 0
    chars = len(text) - sum(map(text.count, SPACES))
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            clean.append(line)
            continue
        dup += line in seen
        seen.add(line)
        if line_fails(line, n, rules):
            bad += 1
            lost += len(line) - sum(map(line.count, SPACES))
        else:
            clean.append(line)
    repeat = repeated_window_words(words)
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    return {"n_words": len(words), "word_chars": chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": dup,
            "n_repeat_words": repeat, "base_failed": failed, "kept": not failed and lost <= rules.most_lost * chars,
            "n_lines_removed": bad, "chars_removed": lost, "clean": "\n".join(clean) if bad else text}


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed",
          "chars_removed")


def quality_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """doc_id and the columns of ``REPORT`` for each row; a null text has no words and fails the base rules."""
    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [
        T.StructField(c, T.BooleanType() if c in ("base_failed", "kept") else T.LongType()) for c in REPORT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t.as_py(), rules) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(
                [r[f.name] for r in rows], pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64())
                for f in schema.fields[1:])], names=schema.names)

    return docs.selectExpr("bigint(doc_id) doc_id", "text").mapInArrow(run, schema)


def quality_filter(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The rows of documents that are kept, all columns, with failing lines taken out of ``text``.

    Repeated rows are judged alike, each on its own. ``text`` must be a string column; others are carried as they are.
    """
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t.as_py(), rules) for t in batch.column(at)]
            kept = pa.array([r["kept"] for r in rows], pa.bool_())
            clean = pa.array([r["clean"] for r in rows], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [clean if i == at else c for i, c in enumerate(batch.columns)], names=names).filter(kept)

    return docs.mapInArrow(run, docs.schema)
