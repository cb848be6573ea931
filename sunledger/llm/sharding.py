"""Sharding along a Hilbert curve, in DataFrame functions only.

Several metadata columns are quantised to a small grid, each grid cell gets its place on the Hilbert curve, rows are put in
curve order and cut into runs of equal row counts. A run then covers a compact region of the metadata space, so the minima and
maxima of a shard's files prune on every dimension at once.

No global sort: ranks come from cell counts. A cell is split by a hash of the id, so that one busy cell (a source with a third
of all rows, say) is ranked by many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SPLITS = 32     # parts of a cell that are ranked independently
COARSE = 6      # bits of the curve index that are summed in the second level


def hashed(column: Column | str, bits: int) -> Column:
    """A category as a grid coordinate; null is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary"))
                             if isinstance(column, str) else F.crc32(column.cast("string").cast("binary")),
                             F.lit(1 << bits)), F.lit(0)).cast("int")


def log_scaled(value: Column, bits: int) -> Column:
    """A size as a grid coordinate: two steps per doubling, cut at the last; null and 0 are 0."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.coalesce(value, F.lit(0)) + 1))).cast("int")


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Place of a grid cell (``axes``: ints of ``bits`` bits) on the Hilbert curve, as long.

    Skilling's transformation: undo the rotations from the top bit down, Gray-encode, interleave.
    """
    dims = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << q).alias("q"), F.lit(i).alias("i"))
                      for q in range(bits - 1, 0, -1) for i in range(dims)])

    def rotate(x: Column, step: Column) -> Column:
        low = step["q"] - 1
        at = F.element_at(x, step["i"] + 1)
        first = F.element_at(x, F.lit(1))
        swap = first.bitwiseXOR(at).bitwiseAND(low)
        invert = at.bitwiseAND(step["q"]) != 0
        return F.transform(x, lambda v, j: F.when(invert, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
                           .when((j == 0) | (j == step["i"]), v.bitwiseXOR(F.when(step["i"] == 0, 0).otherwise(swap)))
                           .otherwise(v))

    def interleave(x: Column) -> Column:
        gray = [reduce(lambda a, b: a.bitwiseXOR(b), [x[j] for j in range(i + 1)]) for i in range(dims)]
        last = gray[-1]
        flip = reduce(lambda a, b: a.bitwiseXOR(b), [
            F.when(last.bitwiseAND(F.lit(1 << q)) != 0, (1 << q) - 1).otherwise(0) for q in range(bits - 1, 0, -1)], F.lit(0))
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for g in gray:
                bit = F.shiftright(g.bitwiseXOR(flip), b).bitwiseAND(F.lit(1)).cast("long")
                out = F.shiftleft(out, 1).bitwiseOR(bit)
        return out

    turned = F.aggregate(steps, F.array(*[a.cast("int") for a in axes]), rotate) if bits > 1 else F.array(*axes)
    # One lambda argument, so the turned axes are computed once for all their bits.
    return F.transform(F.array(turned), interleave)[0]


def curve_shards(rows: DataFrame, axes: list[Column], bits: int, shards: int, order: list[Column]) -> DataFrame:
    """``rows`` plus ``curve`` (long), ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    Rows are ranked by curve index, then by a hash of ``order``, then by ``order``; shard sizes differ by one row at most.
    ``order`` must tell rows apart that differ: equal rows may swap places. Nulls are grid coordinate 0 and sort first.
    An empty table gives an empty result; with fewer rows than shards some shards stay empty.
    """
    placed = rows.withColumn("curve", hilbert_index(axes, bits)).withColumn(
        "_part", F.pmod(F.xxhash64(*order), F.lit(SPLITS)).cast("int"))
    coarse = F.shiftright("curve", COARSE)
    counts = placed.groupBy("curve", "_part").agg(F.count("*").alias("_n")).withColumn("_coarse", coarse)
    # Two levels, so no task reads more than the cells of one coarse cell or the coarse cells themselves.
    above = counts.groupBy("_coarse").agg(F.sum("_n").alias("_m"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    above = above.select("_coarse", F.coalesce(F.sum("_m").over(
        Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"),
        F.sum("_m").over(Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("_total"))
    within = Window.partitionBy("_coarse").orderBy("curve", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_within", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(above, "_coarse").select(
        "curve", "_part", (F.col("_above") + F.col("_within")).alias("_start"), "_total")
    ranked = placed.withColumn("_row", F.row_number().over(Window.partitionBy("curve", "_part").orderBy(*order)) - 1)
    rank = F.col("_start") + F.col("_row")
    return (ranked.join(starts, ["curve", "_part"])
            .withColumn("_rank", rank)
            .withColumn("shard", F.expr(f"int(_rank * {shards} div _total)"))
            .withColumn("slot", F.expr(f"_rank - (shard * _total + {shards - 1}) div {shards}"))
            .drop("_part", "_start", "_total", "_row", "_rank"))


def shard_documents(docs: DataFrame, shards: int = 24, bits: int = 4) -> DataFrame:
    """Documents in ``shards`` runs of the curve over (source, language, size): law ``rows``.

    Returns doc_id, size (UTF-8 bytes plus 8; null text has none), text_crc32, law, shard, slot, grown_shard (null: only the
    law ``key`` has one), curve.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), hashed("source", bits).alias("_x"), hashed("lang", bits).alias("_y"))
    axes = [F.col("_x"), F.col("_y"), log_scaled(F.col("size"), bits)]
    out = curve_shards(rows, axes, bits, shards, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")
