"""Session-level helpers: table access, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; only where it is unset, as in tests, take a local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001, S110 - the session has ended before
        pass


class Files:
    """Small files on any file system that Spark reaches. A path without scheme is on the default one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = str(root).rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if "://" in self.root else self._fs.getUri(), self._conf)

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def make(self) -> None:
        self._fs.mkdirs(self._path(""))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _temp(self, text: str) -> str:
        name = f".new-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()
        return name

    def replace(self, name: str, text: str) -> None:
        """Write a file, or put a new one in its place by one atomic rename."""
        self._context.rename(self._path(self._temp(text)), self._path(name), _options(self._jvm, self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE))

    def claim(self, name: str, text: str) -> bool:
        """Write a file that must not be there yet; of two writers one gets False."""
        temp = self._temp(text)
        try:
            self._context.rename(self._path(temp), self._path(name), _options(self._jvm, self._jvm.org.apache.hadoop.fs.Options.Rename.NONE))
        except Exception as e:  # noqa: BLE001
            self._fs.delete(self._path(temp), False)
            if "exist" in str(e):
                return False
            raise
        return True

    def names(self, pattern: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.globStatus(self._path(pattern)) or [])


def _options(jvm, option):  # noqa: ANN001, ANN202
    from pyspark import SparkContext

    out = SparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    out[0] = option
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


_made: dict[tuple, object] = {}


def once(spark: SparkSession, key: tuple, make: Callable[[], object]) -> object:
    """What make() gave for the key in this session; it runs when first asked for."""
    at = (spark.sparkContext.applicationId, *key)
    if at not in _made:
        _made[at] = make()
    return _made[at]


def cut_table(df: DataFrame) -> DataFrame:
    """As cut, but as a table in the shared folder: scans of it are alike to the planner, so a self-join shuffles once.
    The table is deleted when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting that df has at most max_rows rows; otherwise leave the choice to AQE."""
    return F.broadcast(df) if df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows else df


SMALL_SPLIT = 4 << 20  # a scan's splits are no smaller than this, Spark's cost of opening a file


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores, where a small table lies in so few splits that most cores would have nothing to do. Goes by the
    planner's estimate of the size, so nothing runs for it, and nothing large is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if 2 * size <= cores * SMALL_SPLIT else df


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def build_session(app: str = "quillspark", cpus: int | None = None) -> SparkSession:
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("QUILLSPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
