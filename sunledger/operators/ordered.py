"""Ordered per-key operators that do not put a whole key into one task.

A message topic or a device can hold a third of all rows, so a window over the
key alone is unsafe.  The rows of a key that has more than ``chunk_rows`` are
cut into chunks at quantiles of their sequence numbers, so outliers and bursts
do not matter; windows run per (key, chunk).  A chunk ends at a number that
rows have, so the row before the next chunk is known by its number and is sent
there too, as a guest.  The quantiles come from a sketch; a key has at most
``MOST_CHUNKS`` chunks, beyond that they grow.  Rows of one number stay
together.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK_ROWS = 1_000_000
MOST_CHUNKS = 1024
SKETCH = 8192           # rank error of about 0.03 %
BROADCAST_BOUNDS = 1_000_000    # numbers, 8 MB
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def _number(df: DataFrame, order: str) -> Column:
    """The order column as a long that sorts alike."""
    instant = isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType))
    return F.unix_micros(F.col(order).cast("timestamp")) if instant else F.col(order).cast("long")


def _same(keys: list[str], other: str) -> Column:
    return reduce(and_, (F.col(k).eqNullSafe(F.col(f"{other}{i}")) for i, k in enumerate(keys)))


def chunk_bounds(df: DataFrame, keys: list[str], order: str, chunk_rows: int) -> DataFrame | None:
    """(_key0 .., _bounds) of the keys with more than ``chunk_rows`` rows: ascending numbers, each the last of its chunk.

    None if there is no such key.  There are at most rows / chunk_rows such keys and twice as many numbers; only these come to
    the driver.
    """
    spark, narrow = df.sparkSession, df.select(*keys, _number(df, order).alias("_at"))
    hot = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk_rows).collect()
    if not hot:
        return None
    names = [f"_key{i}" for i in range(len(keys))]
    kinds = T.StructType([T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys)])
    known = _small(spark, [(*(r[k] for k in keys), r["_n"]) for r in hot], T.StructType([*kinds, T.StructField("_n", T.LongType())]), len(hot))
    grid = min(MOST_CHUNKS, 4 * math.ceil(max(r["_n"] for r in hot) / chunk_rows))
    sketched = narrow.join(known, _same(keys, "_key")).groupBy(*names, "_n").agg(F.kll_sketch_agg_bigint("_at", F.lit(SKETCH)).alias("_s"))
    quantiles = F.kll_sketch_get_quantile_bigint("_s", F.array(*(F.lit(i / grid) for i in range(1, grid + 1))))
    chunks = F.least(F.lit(grid), F.ceil(F.col("_n") / F.lit(chunk_rows))).cast("int")
    ends = F.transform(F.sequence(F.lit(1), chunks - 1), lambda j: F.element_at("_q", F.ceil(j * grid / F.col("_c")).cast("int")))
    rows = sketched.withColumn("_q", quantiles).withColumn("_c", chunks).where("_c > 1").select(
        *names, F.array_sort(F.array_distinct(ends)).alias("_bounds")).collect()
    return _small(spark, rows, T.StructType([*kinds, T.StructField("_bounds", T.ArrayType(T.LongType()))]),
                  sum(len(r["_bounds"]) for r in rows))


def _small(spark: SparkSession, rows: list, schema: T.StructType, size: int) -> DataFrame:
    """Rows of the driver as a local relation; a broadcast where the counted size allows it."""
    columns = list(zip(*rows)) or [()] * len(schema)
    df = spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema))], to_arrow_schema(schema)))
    return F.broadcast(df) if size <= BROADCAST_BOUNDS else df


def _in_chunk(number: Column) -> Column:
    """How many bounds are below a number: its chunk, by halving."""
    steps = F.array(*(F.lit(MOST_CHUNKS >> i) for i in range(MOST_CHUNKS.bit_length())))
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        F.get("_bounds", low + step - 1) < number, low + step).otherwise(low))


def _chunked(df: DataFrame, keys: list[str], order: str, bounds: DataFrame) -> DataFrame:
    """Add ``_chunk`` and ``_last``: whether a row has the last number of its chunk."""
    number = _number(df, order)
    placed = df.join(bounds, _same(keys, "_key"), "left").drop(*(f"_key{i}" for i in range(len(keys))))
    chunk = F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(_in_chunk(number))
    placed = placed.withColumn("_chunk", chunk)
    return placed.withColumn("_last", F.coalesce(F.get("_bounds", F.col("_chunk")) == number, F.lit(False))).drop("_bounds")


def with_previous(df: DataFrame, keys: list[str], order: str, cols: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_previous``: struct of ``cols`` of the row before, NULL on a key's first row."""
    bounds, value = chunk_bounds(df, keys, order, chunk_rows), F.struct(*cols)
    # Rows of one number have one order, whichever chunk they are looked at from.
    by = [F.col(order), F.xxhash64(value)]
    if bounds is None:
        return df.withColumn("_previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(*by)))
    here = F.struct(F.col("_chunk").alias("_chunk"), F.lit(False).alias("_guest"))
    ahead = F.struct((F.col("_chunk") + 1).alias("_chunk"), F.lit(True).alias("_guest"))
    sent = _chunked(df, keys, order, bounds).select(
        *df.columns, F.inline(F.when(F.col("_last"), F.array(here, ahead)).otherwise(F.array(here))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*by)
    return sent.withColumn("_previous", F.lag(value).over(w)).where("NOT _guest").drop("_chunk", "_guest")


def suppress_repeats(messages: DataFrame, keys: list[str] | None = None, order: str = "seq",
                     payload: str = "payload", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Drop a message equal to the previous one on its topic."""
    return change_gate(messages, keys or ["topic"], order, [payload], chunk_rows)


def change_gate(df: DataFrame, keys: list[str], order: str, cols: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Keep snapshots that differ from the one before; a key's first is always kept.

    The last accepted value always equals the previous value, so comparing with
    the row before is enough.
    """
    marked = with_previous(df, keys, order, cols, chunk_rows)
    same = F.col("_previous").isNotNull() & F.col("_previous").eqNullSafe(F.struct(*cols))
    return marked.where(~same).drop("_previous")


def device_asof(readings: DataFrame, descriptors: DataFrame, keys: list[str], order: str, cols: list[str],
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Attach the latest descriptor at or before each reading as ``descriptor``.

    It is NULL on readings that precede every descriptor of their device: the
    caller drops and reports them.  A chunk's guests are the descriptor that was
    last before it, so only descriptors are looked up again.
    """
    known = descriptors.select(*keys, order, F.struct(*cols).alias("_d"))
    both = readings.withColumn("_d", F.lit(None)).withColumn("_reading", F.lit(True)).unionByName(
        known.withColumn("_reading", F.lit(False)), allowMissingColumns=True)
    bounds, parts = chunk_bounds(both, keys, order, chunk_rows), list(keys)
    if bounds is not None:
        both = _chunked(both, keys, order, bounds).drop("_last")
        parts = [*keys, "_chunk"]
        both = both.unionByName(_carried(known, keys, order, bounds).withColumn("_reading", F.lit(False)), allowMissingColumns=True)
    # A descriptor with the sequence number of a reading counts as seen before it; a carried one before all.
    w = Window.partitionBy(*parts).orderBy(F.col(order).asc_nulls_first(), "_reading", F.xxhash64("_d")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("descriptor", F.last("_d", ignorenulls=True).over(w)).where("_reading").drop("_chunk", "_d", "_reading")


def _carried(known: DataFrame, keys: list[str], order: str, bounds: DataFrame) -> DataFrame:
    """(keys, _chunk, _d): the last descriptor before each chunk but the first; one row a chunk."""
    names = [f"_key{i}" for i in range(len(keys))]
    placed = _chunked(known.join(bounds, _same(keys, "_key"), "left_semi"), keys, order, bounds)
    newest = Window.partitionBy(*keys, "_chunk").orderBy(F.col(order).desc(), F.xxhash64("_d").desc())
    tails = placed.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").select(
        *(F.col(k).alias(f"_tail{i}") for i, k in enumerate(keys)), F.col("_chunk").alias("_of"), "_d")
    chunks = bounds.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), F.explode(F.sequence(F.lit(0), F.size("_bounds"))).alias("_chunk"))
    told = chunks.join(tails, _same(keys, "_tail") & (F.col("_of") == F.col("_chunk")), "left")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = told.select(*keys, "_chunk", F.last("_d", ignorenulls=True).over(before).alias("_d"))
    return carried.where(F.col("_d").isNotNull())


def first_wins(readings: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first reading per key; later duplicates are dropped with all they carry.

    ``row_number = 1`` plans a group limit before the shuffle, so copies of one
    reading are cut down to one per task map-side.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return readings.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key, cut down to one row per key and task before the shuffle.

    Columns of fixed width take one ``max_by`` each, a hash aggregation; others a group limit, as ``max_by`` of a string sorts
    all rows.
    """
    values = [c for c in df.columns if c not in keys]
    if all(isinstance(df.schema[c].dataType, FIXED_WIDTH) for c in values):
        return df.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in values)).select(df.columns)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
