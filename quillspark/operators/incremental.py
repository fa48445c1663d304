"""Processing only new or changed records.

A run rereads from the oldest transaction that was open at the last successful
run and removes the overlap by an anti-join of (key, version) pairs against the
ledger of what successful runs processed. A version is (size_bytes, hash_blake3).
Records that lie before this window and still are not in the ledger came late;
they are found by keys and versions alone, and only these few are read in full.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import broadcast_if_small, cut

DAY_MS = 86_400_000
MAX_BROADCAST = 50_000


def current_files(files: DataFrame) -> DataFrame:
    """One row per file_id: of several, the one with the greatest indexed_at (ties: greatest time, size, hash)."""
    version = F.struct("indexed_at", "modified_unix_ms", "size_bytes", "hash_blake3")
    return files.filter("file_id is not null").groupBy("file_id").agg(F.max(version).alias("v")).select("file_id", "v.indexed_at", "v.modified_unix_ms", "v.size_bytes", "v.hash_blake3")


def reread_from(runs: DataFrame) -> int | None:
    """Start of the oldest run that was still open when the last successful run started; None if nothing succeeded.

    A run is open at a time if it began before and had not finished; a crashed run never finished.
    """
    last = runs.filter("status = 'succeeded'").agg(F.max("started_unix_ms")).first()[0]
    if last is None:
        return None
    return runs.filter((F.col("started_unix_ms") <= last) & (F.coalesce("finished_unix_ms", F.lit(2**62)) > last)).agg(F.min("started_unix_ms")).first()[0] or last


def processed_ledger(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """The version of each file that the latest successful run recorded: file_id, size_bytes, hash_blake3.

    Rows under runs that failed, crashed or are unknown do not count. Of several rows of one run the one recorded last
    counts.
    """
    ok = runs.filter("status = 'succeeded'").groupBy("run_id").agg(F.max("started_unix_ms").alias("started"))
    rows = ledger.filter("file_id is not null").join(ok, "run_id")
    version = F.struct("started", "run_id", "recorded_at", "size_bytes", "hash_blake3")
    return rows.groupBy("file_id").agg(F.max(version).alias("v")).select("file_id", "v.size_bytes", "v.hash_blake3")


def _indexed_ms(indexed_at: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(indexed_at))


def _in_window(low: int) -> Column:
    """The bound of the text is a day lower, whatever its time zone, and reaches the scan, which skips what is older."""
    bound = dt.datetime.fromtimestamp((low - DAY_MS) / 1000, dt.timezone.utc).strftime("%Y-%m-%d")
    when = _indexed_ms(F.col("indexed_at"))
    return (F.col("indexed_at").isNull() | (F.col("indexed_at") >= bound)) & (when.isNull() | (when >= low))


def window(files: DataFrame, low: int) -> DataFrame:
    """Rows indexed at `low` (epoch milliseconds) or later, or at a time that can't be read and does not sort before it."""
    return files.filter(_in_window(low))


def _unprocessed(now: DataFrame, done: DataFrame) -> DataFrame:
    on = [now["file_id"] == done["file_id"], now["size_bytes"].eqNullSafe(done["size_bytes"]), now["hash_blake3"].eqNullSafe(done["hash_blake3"])]
    return now.join(done, on, "left_anti")


def reread_and_late(files: DataFrame, done: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows reread, keys of late files). The first are the current rows of files within the window; the second the
    file_id of files outside of it whose current version no successful run recorded (done, of processed_ledger).

    With no successful run the window holds everything. A file with rows on both sides is current within the window.
    """
    low = reread_from(runs)
    if low is None:
        return current_files(files), files.select("file_id").limit(0)
    inside = cut(current_files(window(files, low)))
    # of what lies before the window only keys, order and versions are read; Parquet skips the other columns
    keys = files.filter("file_id is not null").filter(~F.coalesce(_in_window(low), F.lit(True))).select("file_id", "indexed_at", "modified_unix_ms", "size_bytes", "hash_blake3")
    before = current_files(keys).join(broadcast_if_small(inside.select("file_id"), MAX_BROADCAST), "file_id", "left_anti")
    return inside, _unprocessed(before, done).select("file_id")


def to_process(files: DataFrame, ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """Files that the next run must process: file_id, size_bytes, hash_blake3, modified_unix_ms, indexed_at, in_reread.

    in_reread tells whether the file lies in the window that is read again; the others came late. Null sizes and hashes are versions like any other. With an empty ledger or no
    successful run all files are returned.
    """
    done = cut(processed_ledger(ledger, runs))
    inside, late = reread_and_late(files, done, runs)
    again = _unprocessed(inside, done).withColumn("in_reread", F.lit(True))
    late = cut(late)
    rest = current_files(files.join(broadcast_if_small(late, MAX_BROADCAST), "file_id", "left_semi")).withColumn("in_reread", F.lit(False))
    return again.unionByName(rest)


def commit(processed: DataFrame, run_id: int, recorded_at: str) -> DataFrame:
    """Ledger rows of a run. They count once the run's status is `succeeded`, so a failed run skips and repeats nothing."""
    return processed.select("file_id", F.lit(run_id).cast("long").alias("run_id"), "size_bytes", "modified_unix_ms", "hash_blake3", F.lit(recorded_at).alias("recorded_at"))
