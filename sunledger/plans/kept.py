"""Stores that keep day buckets next to their samples.

Once a store keeps them, every ingested batch adds its share in the commit that stores its samples, and rollups of the store read
the buckets alone: a late sample costs its bucket, not a second read of its raw day.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sunledger.operators.partials import BUCKET_TABLES, partial_buckets
from sunledger.schemas import TABLES
from sunledger.sources import tables as T
from sunledger.sources.files import drop_folder, exists, fs_of
from sunledger.sources.store import append_days


def start_buckets(spark: SparkSession, store: str) -> list[str]:
    """Keep day buckets from now on; samples that are stored already are read once. Returns the tables that were begun.

    No ingest may run meanwhile. The buckets appear by one rename, so a run that dies leaves nothing and can be repeated.
    """
    begun = []
    for kind, table in BUCKET_TABLES.items():
        path, samples = T.table_path(store, table), f"{kind}_samples"
        if exists(spark, path):
            continue
        df = T.read_table(spark, store, samples) if exists(spark, T.table_path(store, samples)) else spark.createDataFrame([], TABLES[samples])
        staged = f"{store.rstrip('/')}/_begun-{uuid.uuid4().hex}"
        append_days(partial_buckets(df, kind), staged)
        if not fs_of(spark, staged)[0].rename(fs_of(spark, staged)[1], fs_of(spark, path)[1]):
            drop_folder(spark, staged)
            raise OSError(f"{path} could not be begun")
        begun.append(table)
    return begun


def kept_rows(spark: SparkSession, store: str, kind: str, samples: DataFrame) -> dict[str, DataFrame]:
    """What samples that are about to be stored add to the kept buckets, by table; nothing if the store keeps none."""
    table = BUCKET_TABLES[kind]
    return {table: partial_buckets(samples, kind)} if exists(spark, T.table_path(store, table)) else {}
