"""Line dedup over a deletion neighbourhood, in DataFrame functions only.

A line goes when an earlier line of the corpus (smaller doc_id, then smaller line number) is the same or, from ``NEAR_WORDS``
words on, differs by one word put in, taken out or exchanged. Lines are judged on the input, not on what is left.

Every line emits hashed keys of all its variants with one word taken out; lines within one edit share a key:

- an exchanged word at place i: the same key of "all but place i" (with i and the word count in the key);
- a word put in: the shorter line's key of the whole line equals the longer one's key without that word.

Members of a key differ by one word by construction, so a key only needs its earliest member: keys are reduced to minima with
map-side combine and no pair is emitted, however many lines share a key. The edit is then verified on the words themselves.

Keys are the exclusive-or of (word, place) hashes, so a line of n words gets its n variants in n steps. Before that, exact
copies are reduced to one, and lines that share neither their first nor their last half with a different line are left out: of
two lines within one edit, the words on one side of it hold a half. Those that
remain are looked at again with one of eight blocks of words left out, and only words of such a block are taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import work_dir

NEAR_WORDS = 8
NO_ID = -(1 << 63)
BLOCKS = 8      # of words, for the second look at candidates


def words_of(line: Column) -> Column:
    """Words between the six ASCII spaces; splitting at one character is several times faster than at a pattern."""
    plain = F.when(line.rlike(r"[\x09-\x0D]"), F.translate(line, "\t\n\x0b\x0c\r", "     ")).otherwise(line)
    return F.array_remove(F.split(plain, " "), "")


def _document() -> list[Column]:
    """What tells documents apart and orders them: the id (null as the least long) and a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_hash")]


def _half(m: Column) -> Column:
    """Words in a half: the largest power of two that is at most half of ``m``, so that lines of like length agree on it."""
    return F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.floor(m / 2), F.lit(1))))).cast("int")


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line with a word: _id, _hash, _no, line hashes _h1 and _h2, _n words; from ``NEAR_WORDS`` words on hashes of
    the first and last half, for this count of words (f1, l1; null if the same) and for one word less (f0, l0)."""
    lines = docs.select(*_document(), F.posexplode(F.split("text", "\n")).alias("_no", "line"))
    lines = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("words", words_of(F.col("line"))).withColumn(
        "_n", F.size("words"))
    n, words = F.col("_n"), F.col("words")

    def first(half: Column) -> Column:
        return F.xxhash64(half, F.slice(words, F.lit(1), half))

    def last(half: Column) -> Column:
        return F.xxhash64(F.slice(words, n - half + 1, half), half)

    near, more = n >= NEAR_WORDS, (n >= NEAR_WORDS) & (_half(n) != _half(n - 1))
    return lines.select(
        "_id", "_hash", "_no", F.xxhash64("line").alias("_h1"), F.xxhash64("line", F.lit(7)).alias("_h2"), "_n",
        F.when(near, first(_half(n - 1))).alias("f0"), F.when(near, last(_half(n - 1))).alias("l0"),
        F.when(more, first(_half(n))).alias("f1"), F.when(more, last(_half(n))).alias("l1"))


def _written(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written below spark.checkpoint.dir and read again, so that what follows is planned without their making."""
    at = work_dir(rows.sparkSession, label)
    rows.write.parquet(at)
    return rows.sparkSession.read.parquet(at)


def _distinct(lines: DataFrame) -> DataFrame:
    """Different lines, with their earliest place ``first`` and number of ``copies``; written once below spark.checkpoint.dir."""
    return _written(lines.groupBy("_h1", "_h2", "_n", "f0", "l0", "f1", "l1").agg(
        F.min(F.struct("_id", "_hash", "_no")).alias("first"), F.count("*").alias("copies")), "lines")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` a different line (by ``first``, its earliest place) has as well."""
    line = F.xxhash64("first")
    shared = rows.groupBy(key).agg(F.min(line).alias("_a"), F.max(line).alias("_b")).where("_a < _b")
    # A column of its own for the join, so that both sides are dealt anew and a common key can be split.
    own = F.col(key).bitwiseXOR(F.lit(1)).alias("_key")
    return rows.withColumn("_key", own).join(shared.select(own), "_key", "left_semi").drop("_key")


def _candidates(distinct: DataFrame) -> DataFrame:
    """``first`` of lines that share a half with a different line."""
    near = distinct.where(F.col("_n") >= NEAR_WORDS).select("first", F.explode(F.array(
        "f0", "l0", "f1", "l1")).alias("key")).where("key IS NOT NULL")
    return _shared(near, "key").select("first").distinct()


def _spans(lines: DataFrame) -> DataFrame:
    """Of lines (first, words) those that agree with a different line but for one of ``BLOCKS`` blocks of words; ``spans``:
    where their edit can be. Blocks are those of the smaller count of words, so each line takes its own count and one less."""
    words, n = F.col("words"), F.size("words")

    def cut(m: Column, k: int) -> Column:
        return (m * k / BLOCKS).cast("int")

    def hashed(m: Column, k: int, shift: int) -> Column:
        return F.xxhash64(F.slice(words, cut(m, k) + 1 + shift, cut(m, k + 1) - cut(m, k)))

    # Each block is hashed once; a key puts the hashes of the other blocks together. With one word less, the blocks behind the
    # edit lie one word further on.
    parts = [hashed(n, k, 0).alias(f"own{k}") for k in range(BLOCKS)]
    parts += [hashed(n - 1, k, 0).alias(f"before{k}") for k in range(BLOCKS - 1)]
    parts += [hashed(n - 1, k, 1).alias(f"after{k}") for k in range(1, BLOCKS)]
    blocks, m = [], F.col("n")
    for g in range(BLOCKS):
        ahead, behind = range(g), range(g + 1, BLOCKS)
        blocks.append(F.struct(
            F.xxhash64(F.lit(g), m, *(f"own{k}" for k in (*ahead, *behind))).alias("key"),
            cut(m, g).alias("low"), cut(m, g + 1).alias("end")))
        blocks.append(F.struct(
            F.xxhash64(F.lit(g), m - 1, *(f"before{k}" for k in ahead), *(f"after{k}" for k in behind)).alias("key"),
            cut(m - 1, g).alias("low"), (cut(m - 1, g + 1) + 1).alias("end")))
    lines = lines.select("first", n.alias("n"), *parts)
    rows = lines.select("first", F.explode(F.array(*blocks)).alias("x")).select("first", "x.*")
    return _shared(rows, "key").groupBy("first").agg(F.collect_set(F.struct("low", "end")).alias("spans"))


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``first`` of the different lines that have an earlier line one word away. ``docs``: _id, _hash, text."""
    wanted = _written(_candidates(distinct).groupBy(F.col("first._id").alias("_id"), F.col("first._hash").alias("_hash")).agg(
        F.collect_list(F.struct("first", F.col("first._no").alias("no"))).alias("wanted")), "wanted")  # lines of one document
    lines = docs.join(wanted, ["_id", "_hash"]).select(
        F.split("text", "\n").alias("all"), F.explode("wanted").alias("x")).select(
        F.col("x.first").alias("first"), words_of(F.get("all", "x.no")).alias("words"))
    # Dealt once for all that follows; the conditions are those that joins add, so that every use has the same plan.
    lines = lines.where("first IS NOT NULL AND words IS NOT NULL").repartition("first")
    near = lines.join(_spans(lines), "first")
    each = near.select("first", "spans", F.size("words").alias("n"), F.posexplode("words").alias("i", "w"))
    each = each.select("first", "spans", "n", "i", F.xxhash64("w", "i").alias("here"),
                       F.xxhash64("w", F.col("i") - 1).alias("left"))
    line = Window.partitionBy("first")
    before = F.bit_xor("here").over(line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    after = F.bit_xor("left").over(line.orderBy("i").rowsBetween(1, Window.unboundedFollowing))
    zero = F.lit(0).cast("long")
    variants = each.select("first", "spans", "n", "i", "here", F.coalesce(before, zero).alias("before"),
                           F.coalesce(after, zero).alias("after"), F.bit_xor("here").over(line).alias("whole"))
    inside = F.exists("spans", lambda x: (F.col("i") >= x["low"]) & (F.col("i") < x["end"]))
    # kind 0: one place masked; kind 1: one word taken out; kind 2: the whole line, which meets kind 1
    keyed = variants.select("first", F.explode(F.array(
        F.when(inside, F.struct(F.lit(0).alias("kind"), F.xxhash64(
            F.col("whole").bitwiseXOR(F.col("here")), "n", "i").alias("key"))),
        F.when(inside, F.struct(F.lit(1).alias("kind"), F.xxhash64(
            F.col("before").bitwiseXOR(F.col("after")), F.col("n") - 1).alias("key"))),
        F.when(F.col("i") == 0, F.struct(F.lit(2).alias("kind"), F.xxhash64("whole", "n").alias("key"))))).alias("v"))
    keyed = keyed.where("v IS NOT NULL").select("first", F.col("v.kind").alias("kind"), F.col("v.key").alias("key"))
    least = keyed.groupBy("kind", "key").agg(F.min("first").alias("earliest"))
    least = least.select(F.when(F.col("kind") == 0, 0).otherwise(3 - F.col("kind")).alias("kind"), "key", "earliest")
    hits = keyed.join(least, ["kind", "key"]).where("earliest < first").groupBy("first").agg(
        F.collect_set("earliest").alias("against"))  # at most two for each word of the line
    pairs = hits.select("first", F.explode("against").alias("other"))
    both = pairs.join(lines.select("first", F.col("words").alias("a")), "first").join(
        lines.select(F.col("first").alias("other"), F.col("words").alias("b")), "other")
    return both.where(one_edit(F.col("a"), F.col("b"))).select("first").distinct()


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one word put in, taken out or exchanged."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first_off = F.array_position(same, F.lit(False)).cast("int")
    rest = lambda words, skip: F.slice(words, first_off + skip, F.size(words))
    return (F.when(first_off == 0, True)
            .when(F.size(a) == F.size(b), rest(a, 1) == rest(b, 1))
            .when(F.size(a) == F.size(b) + 1, rest(a, 1) == rest(b, 0))
            .when(F.size(a) + 1 == F.size(b), rest(a, 0) == rest(b, 1))
            .otherwise(False))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, plus _n_lines (long), _n_exact, _n_near: lines removed.

    Lines without a word stay. A null text stays null and has no lines. Rows of null doc_id sort first. Rows of one doc_id
    and different texts are different documents, in order of a hash; rows equal in both are one document. Extra columns may
    have any names; those of the names of added columns are replaced. An empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # Extra columns travel in a struct, where their names cannot meet those used here.
    keyed = docs.select(*_document(), "text", *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row")] if rest else []))
    docs, names, id_type = docs.select("doc_id", "text"), docs.columns, docs.schema["doc_id"].dataType
    lines = _lines(docs)
    distinct = _distinct(lines)
    near = near_lines(keyed.select("_id", "_hash", "text"), distinct).select("first", F.lit(True).alias("near"))
    judged = distinct.select("_h1", "_h2", "first", "copies").join(near, "first", "left").where("near OR copies > 1")
    # Joined by a key of their own, so that both sides are dealt anew and a common line can be split.
    own = F.col("_h1").bitwiseXOR(F.lit(1)).alias("_k1"), F.col("_h2").alias("_k2")
    later = F.struct("_id", "_hash", "_no") > F.col("first")
    gone = lines.select("_id", "_hash", "_no", *own).join(judged.select("first", "near", *own), ["_k1", "_k2"]).where(
        F.col("near") | later)
    gone = gone.groupBy("_id", "_hash").agg(F.collect_set(F.when(later, F.col("_no"))).alias("_exact"),
                                    F.collect_set(F.when(~later, F.col("_no"))).alias("_near"))
    split = F.split("text", "\n")
    none = F.array().cast("array<int>")
    kept = F.array_join(F.filter(split, lambda line, i: ~F.array_contains("_exact", i) & ~F.array_contains("_near", i)), "\n")
    # The id comes back from the key: texts are dealt once, for this join and that of near_lines.
    joined = keyed.join(gone, ["_id", "_hash"], "left").withColumns({
        "_exact": F.coalesce("_exact", none), "_near": F.coalesce("_near", none)})
    made = {
        "doc_id": F.nullif(F.col("_id"), F.lit(NO_ID)).cast(id_type),
        "text": F.when(F.size("_exact") + F.size("_near") == 0, F.col("text")).otherwise(kept)}
    added = {
        "_n_lines": F.coalesce(F.size(F.filter(split, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long"),
        "_n_exact": F.size("_exact").cast("long"), "_n_near": F.size("_near").cast("long")}
    out = [made.get(c, F.col("_row").getField(c) if c in rest else None).alias(c) for c in names if c.lower() not in added]
    return joined.select(*out, *(x.alias(c) for c, x in added.items()))


def line_report(docs: DataFrame) -> DataFrame:
    """For each row doc_id, n_lines (with a word), n_exact, n_near (removed), kept_md5 of the text that is left (null: empty)."""
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_exact").alias("n_exact"),
                      F.col("_n_near").alias("n_near"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))
