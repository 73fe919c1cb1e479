"""Written tables between the tiers.

Facts are reduced once to monthly cells, and the metric tables are written once per grain and
period; signals, findings and insights then read small, partition-pruned tables instead of
re-scanning the order lines. Tables are plain parquet in the shared folder of the cluster, so
a lost executor costs a re-read, not a re-computation. Their place depends on the source's files, so
a source that has changed gets new tables.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierwise.sources.files import for_partitions, read_if_exists

_LOCAL_BASE: dict[str, str] = {}
_REBUILD = ""  # marks a store whose written tables must not be taken over
TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, as in tests, a single process gets a folder that goes with it; a cluster is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_BASE:
        folder = tempfile.mkdtemp(prefix="tierwise-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_BASE[app] = f"file://{folder}"
    return _LOCAL_BASE[app]


def fingerprint(spark: SparkSession, source: str) -> str:
    """A digest of the paths, lengths and times of the source's files; only their listing is read."""
    paths = [f"{source}/{t}.parquet" for t in TABLES]
    try:
        files = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
        n, total = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        n, total = 0, 0
    return hashlib.sha256(f"{source} {n} {total}".encode()).hexdigest()[:12]


class Store:
    """Tables derived from one source folder.

    Without a folder they live under the shared folder and are written once per Spark application.
    A named folder is kept: later applications read the tables that were written completely.
    """

    _written: dict[str, set[str]] = {}
    _lock = threading.RLock()  # one writer per application; a build may ask for other tables
    _schemas: dict[str, StructType] = {}  # of written tables, so reading one needs no footer scan

    def __init__(self, spark: SparkSession, source: str, folder: str | None = None):
        self.spark = spark
        self.source = source.rstrip("/")
        self.kept = folder is not None
        if folder is None:
            folder = f"{shared_dir(spark)}/tierwise/{spark.sparkContext.applicationId}"
        self.base = f"{folder.rstrip('/')}/{fingerprint(spark, self.source)}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _complete(self, name: str) -> bool:
        return read_if_exists(self.spark, self.path(f"done/{name}"), "n int") is not None

    def table(self, name: str, build: Callable[[], DataFrame], sort: str | None = None, by: str | None = None) -> DataFrame:
        """The written table, building it on first use.

        Files sorted by month let readers of a few months skip row groups by their statistics. `by` is a column to partition by; it
        comes last.
        """
        path = self.path(name)
        with Store._lock:
            done = Store._written.setdefault(self.base, set())
            if self.kept and not {name, _REBUILD} & done and self._complete(name):
                return self.spark.read.parquet(path)
            if name not in done:
                df = build()
                columns = [by] if by else []
                if by:
                    df = for_partitions(df.select(*[c for c in df.columns if c != by], by), columns)
                if sort:
                    df = df.sortWithinPartitions(*columns, sort)
                df.write.mode("overwrite").partitionBy(*columns).parquet(path)
                Store._schemas[path] = df.schema
                done.add(name)
                if self.kept:
                    self.spark.createDataFrame([(1,)], "n int").write.mode("overwrite").parquet(self.path(f"done/{name}"))
            return self.spark.read.schema(Store._schemas[path]).parquet(path)

    def forget(self) -> None:
        """Rebuild every table on next use."""
        Store._written[self.base] = {_REBUILD}
