"""Session construction, table loading and the shared folder for intermediate tables.

Intermediate results that cut lineage are written as Parquet below the folder
that the cluster names in ``spark.checkpoint.dir``, which every executor can
read.  The files therefore survive the loss of an executor.  Only on a plain
``local`` master, where no such folder is configured, a temporary one is made.
"""

from __future__ import annotations

import atexit
import pathlib
import shutil
import sys
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: str | None = None
_WRITTEN: list[str] = []
_TABLES: list[str] = []
_SHIPPED: set[str] = set()
_CODE: list[str] = []


def get_session(app: str = "wayfold", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings that the engine relies on (UTC, AQE)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors of the session, once, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = pathlib.Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="wayfold-code-")  # served to the executors from here, deleted at the end
    _CODE.append(folder)
    target = pathlib.Path(folder, "wayfold_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else a local one for tests.

    Raises ValueError on a cluster without the setting, as a machine-local
    folder would be lost with its executor.
    """
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        _WRITTEN.append(_LOCAL_ROOT)
    return _LOCAL_ROOT


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it.

    Cuts the lineage: later stages read the files and never repeat the work
    above them, also after the loss of an executor.
    """
    path = f"{shared_root(df.sparkSession).rstrip('/')}/wayfold-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, before ``release``; nothing may depend on it any more."""
    if (path := getattr(df, "written_to", None)) in _WRITTEN:
        _WRITTEN.remove(path)
        Files(df.sparkSession, path).delete(path)


def materialize_buckets(df: DataFrame, label: str, part: str, by: str, buckets: int) -> DataFrame:
    """Write ``df`` into the shared folder, a folder for each value of ``part``, each bucketed and sorted by ``by``; return a scan of it.

    A filter on ``part`` reads its folder only; grouping and joining by ``by``
    need no shuffle.  The table has a name in the session's catalogue until
    ``release``.
    """
    spark = df.sparkSession
    name = f"wayfold_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, by).write.option("compression", "zstd").option("path", scratch(spark, label))
    writer.partitionBy(part).bucketBy(buckets, by).sortBy(by).saveAsTable(name)
    _TABLES.append(name)
    return spark.table(name)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, deleted by ``release``; it isn't created yet."""
    path = f"{shared_root(spark).rstrip('/')}/wayfold-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


class Files:
    """Small files and folders of any file system that the session knows, by its own client."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        """The names in a folder, in order; none if there is no folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def size(self, path: str) -> int:
        """Bytes of a file or of all files below a folder."""
        return self._fs.getContentSummary(self._path(path)).getLength()

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The whole file or none: it is written under another name and then renamed."""
        aside = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        if not self._fs.rename(aside, self._path(path)):
            raise OSError(f"{path} can't be written")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; returns how many were found.

    To be called when no result that depends on them is still to be read.
    """
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    n = 0
    while _WRITTEN:
        p = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n


@atexit.register
def _release_at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            release(spark)
    except (Py4JError, OSError):  # the JVM is gone; the shared folder's owner clears what is left
        print("intermediate tables were left in the shared folder", file=sys.stderr)
    for folder in _CODE:
        shutil.rmtree(folder, ignore_errors=True)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
