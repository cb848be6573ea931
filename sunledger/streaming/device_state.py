"""Latest descriptor per device carried across micro-batches.

The state is a small table (one row per device), versioned by batch, next to
the query's checkpoint.  Each batch is processed with the chunked batch
operators, so a device that sends most of a batch is still split over tasks,
and a repeated batch starts from the same version and rewrites its own.

A query that starts from a fresh checkpoint is a new run with a number of its own: its versions come after those of all earlier
runs, so it goes on from their newest state and overwrites nothing.

A reading ahead of every descriptor of its device waits for some batches: should a descriptor come that was announced at or
before it, the reading gets it; else it is reported with a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sunledger import KEY
from sunledger.operators.ordered import CHUNK_ROWS, change_gate, device_asof, latest
from sunledger.sources.files import create_new, drop_folder, list_versions, names_in, read_small

BEFORE_ALL = -1
KEPT_VERSIONS = 10
RUN = 10 ** 12      # versions of one run
WAIT_BATCHES = 3    # for a descriptor that comes late
NO_DESCRIPTOR = "no descriptor"


def _state(spark: SparkSession, path: str, batch_id: int, schema) -> DataFrame:
    earlier = [v for v in list_versions(spark, path) if v < batch_id]
    if not earlier:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={max(earlier)}")


def run_of(spark: SparkSession, out: str, checkpoint: str) -> int:
    """Number of the run that a checkpoint belongs to, noted next to it; taken below ``out`` before anything is written."""
    noted = f"{checkpoint}_run"
    while read_small(spark, noted) is None:
        stored = max(list_versions(spark, f"{out}/readings"), default=-1) // RUN
        number = max([stored, *map(int, names_in(spark, f"{out}/_runs"))]) + 1
        if create_new(spark, f"{out}/_runs/{number}", checkpoint):
            create_new(spark, noted, str(number))
    return int(read_small(spark, noted))


def process_batch(batch: DataFrame, batch_id: int, out: str, cols: list[str], chunk_rows: int = CHUNK_ROWS) -> None:
    """One batch of ``is_device`` rows (descriptors) and readings.

    Writes under ``out``: ``readings`` with their descriptor, ``changes`` with
    the descriptors that differ from the one before, ``state``, ``waiting`` with
    the readings before any descriptor, and ``dropped`` with those that waited
    for ``WAIT_BATCHES`` batches in vain.
    """
    batch = batch.persist()
    try:
        _process(batch, batch_id, out, cols, chunk_rows)
    finally:
        batch.unpersist()


def _process(batch: DataFrame, batch_id: int, out: str, cols: list[str], chunk_rows: int) -> None:
    spark = batch.sparkSession
    fields = [*KEY, "seq", *cols]
    state_path = f"{out}/state"
    announced = batch.where("is_device").select(*fields)
    state = _state(spark, state_path, batch_id, announced.schema)
    known = state.withColumn("seq", F.lit(BEFORE_ALL).cast("long")).unionByName(announced)

    readings = device_asof(batch.where("NOT is_device"), known, KEY, "seq", cols, chunk_rows)
    fresh = readings.where(F.col("descriptor").isNull()).drop("descriptor").withColumn("waited", F.lit(0))
    # None of the descriptors known so far is as old as those that wait, so only the announced ones count.
    late = device_asof(_state(spark, f"{out}/waiting", batch_id, fresh.schema), announced, KEY, "seq", cols, chunk_rows)
    found = late.where(F.col("descriptor").isNotNull()).select(readings.columns)
    readings.where(F.col("descriptor").isNotNull()).unionByName(found).write.mode("overwrite").parquet(f"{out}/readings/version={batch_id}")
    still = late.where(F.col("descriptor").isNull()).drop("descriptor").withColumn("waited", F.col("waited") + 1)
    still.where(F.col("waited") > WAIT_BATCHES).withColumn("reason", F.lit(NO_DESCRIPTOR)).write.mode("overwrite").parquet(
        f"{out}/dropped/version={batch_id}")
    fresh.unionByName(still.where(F.col("waited") <= WAIT_BATCHES)).write.mode("overwrite").parquet(f"{out}/waiting/version={batch_id}")
    changes = change_gate(known, KEY, "seq", cols, chunk_rows).where(F.col("seq") > BEFORE_ALL)
    changes.write.mode("overwrite").parquet(f"{out}/changes/version={batch_id}")
    latest(known, KEY, "seq").write.mode("overwrite").parquet(f"{state_path}/version={batch_id}")
    for path in (state_path, f"{out}/waiting"):
        for version in [v for v in list_versions(spark, path) if v < batch_id][:-KEPT_VERSIONS]:
            drop_folder(spark, f"{path}/version={version}")


def start_device_state(rows: DataFrame, out: str, checkpoint: str, cols: list[str], available_now: bool = False,
                       every: str = "1 minute", chunk_rows: int = CHUNK_ROWS) -> StreamingQuery:
    """``rows`` mixes descriptors and readings in arrival order (``seq``)."""
    base = RUN * run_of(rows.sparkSession, out, checkpoint)
    writer = rows.writeStream.foreachBatch(lambda b, i: process_batch(b, base + i, out, cols, chunk_rows)).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
