"""One batch into several tables: all of its rows become visible, or none, and a repeated batch adds nothing.

A batch is staged below ``_batches/<source>`` of the store, table by table, and committed by one rename. Publishing moves its
files into the tables, in the order in which they were staged, and may stop anywhere: the next batch of the source finishes it
first. A small record of the last batch tells a retry from a new batch, so no stored row is looked up for that. A source runs one
batch at a time, as a streaming query does.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sunledger.sources.files import create_new, drop_folder, fs_of, names_in, read_small
from sunledger.sources.store import append_days, move_days
from sunledger.sources.tables import table_path

STAGED, COMMITTED, DONE, ORDER = "staged-", "committed-", "done-", "_order"


def _root(store: str, source: str) -> str:
    return f"{store.rstrip('/')}/_batches/{source}"


def source_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint: a fresh checkpoint is a new source."""
    return json.loads(read_small(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def last_batch(spark: SparkSession, store: str, source: str) -> int:
    """Number of the last batch that is wholly stored, -1 before the first."""
    return max((int(n.removeprefix(DONE)) for n in names_in(spark, _root(store, source)) if n.startswith(DONE)), default=-1)


def finish_batches(spark: SparkSession, store: str, source: str) -> None:
    """Publish what a dead run committed; drop what it only staged."""
    root = _root(store, source)
    for name in names_in(spark, root):
        if name.startswith(STAGED):
            drop_folder(spark, f"{root}/{name}")
        elif name.startswith(COMMITTED):
            for table in read_small(spark, f"{root}/{name}/{ORDER}").split():
                move_days(spark, f"{root}/{name}/{table}", table_path(store, table))
            number = int(name.removeprefix(COMMITTED))
            create_new(spark, f"{root}/{DONE}{number}", "")
            drop_folder(spark, f"{root}/{name}")
    fs, last = fs_of(spark, root)[0], last_batch(spark, store, source)
    for name in names_in(spark, root):
        if name.startswith(DONE) and name != f"{DONE}{last}":
            fs.delete(fs_of(spark, f"{root}/{name}")[1], False)


def commit_batch(spark: SparkSession, store: str, source: str, batch: int, rows: Callable[[], dict[str, DataFrame]]) -> bool:
    """Append ``rows()`` (a frame with ``day`` for each table) as batch ``batch`` of ``source``; False if it is stored already.

    ``rows`` is called after what an earlier run left has been published, so it may look up stored keys.
    """
    root = _root(store, source)
    finish_batches(spark, store, source)
    if batch <= last_batch(spark, store, source):
        return False
    staging = f"{root}/{STAGED}{batch}"
    tables = rows()
    for table, df in tables.items():
        append_days(df, f"{staging}/{table}")
    create_new(spark, f"{staging}/{ORDER}", " ".join(tables))
    fs, _ = fs_of(spark, root)
    if not fs.rename(fs_of(spark, staging)[1], fs_of(spark, f"{root}/{COMMITTED}{batch}")[1]):
        raise OSError(f"cannot commit {staging}")
    finish_batches(spark, store, source)
    return True
