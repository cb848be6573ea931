"""One rewriting job at a time on a table.

A lease is a file next to the table, taken by atomic create, with its owner's id; the owner renews its modification time. A lease
that was not renewed for ``ttl`` seconds belongs to a dead run and is taken over. An owner that was away for longer finds out
before it commits, as it looks at the id again. ``ttl`` must be far above the clocks' differences.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from sunledger.sources.files import create_new, fs_of, read_small

TTL = 600.0
WAIT = 900.0    # as long as a rewriter waits for another one
POLL = 0.2


class TableBusy(RuntimeError):
    """Another run is rewriting the table."""


class LeaseLost(RuntimeError):
    """This run was away for so long that another one took over."""


class Lease:
    def __init__(self, spark: SparkSession, path: str, owner: str):
        self._spark, self._path, self.owner = spark, path, owner

    def check(self) -> None:
        if read_small(self._spark, self._path) != self.owner:
            raise LeaseLost(self._path)

    def renew(self) -> None:
        fs, hpath = fs_of(self._spark, self._path)
        self.check()
        fs.setTimes(hpath, int(time.time() * 1000), -1)


def lease_file(path: str) -> str:
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_lease-{name}"


def _take_over(spark: SparkSession, file: str, ttl: float) -> None:
    """Move an expired lease away."""
    fs, hpath = fs_of(spark, file)
    owner = read_small(spark, file)
    if owner is None or time.time() * 1000 - fs.getFileStatus(hpath).getModificationTime() <= ttl * 1000:
        return
    away = f"{file}.{uuid.uuid4().hex}"
    if fs.rename(hpath, fs_of(spark, away)[1]):
        if read_small(spark, away) != owner:    # another run was faster; its fresh lease goes back
            fs.rename(fs_of(spark, away)[1], hpath)
        else:
            fs.delete(fs_of(spark, away)[1], False)


@contextmanager
def rewriting(spark: SparkSession, path: str, wait: float | None = None, ttl: float | None = None) -> Iterator[Lease]:
    """Hold the lease of the table at ``path``; raises ``TableBusy`` after ``wait`` seconds."""
    ttl, until = TTL if ttl is None else ttl, time.monotonic() + (WAIT if wait is None else wait)
    file, owner = lease_file(path), uuid.uuid4().hex
    while not create_new(spark, file, owner):
        try:
            _take_over(spark, file, ttl)
        except Exception as err:    # released in between
            if fs_of(spark, file)[0].exists(fs_of(spark, file)[1]):
                raise err
            continue
        if time.monotonic() > until:
            raise TableBusy(path)
        time.sleep(POLL)
    lease, stop = Lease(spark, file, owner), threading.Event()

    def keep() -> None:
        while not stop.wait(ttl / 3):
            try:
                lease.renew()
            except Exception:   # lost, or the session has ended; the commit looks again
                return

    threading.Thread(target=keep, daemon=True).start()
    try:
        yield lease
    finally:
        stop.set()
        if read_small(spark, file) == owner:
            fs, hpath = fs_of(spark, file)
            fs.delete(hpath, False)
