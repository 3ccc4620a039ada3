"""Session services shared by all operators: durable intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    Only where that setting is absent (local tests) a temporary folder of this machine is used. The
    folder is removed when the driver's interpreter exits.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="siftmark-")
        root = f"{base.rstrip('/')}/siftmark-{app}-{os.getpid()}"
        _ROOTS[app] = root
        atexit.register(_remove, spark, root)
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone already
        pass


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Actions in it remove their shuffle files as soon as they end, instead of when the driver's garbage is collected.
    Only for actions whose plan is not run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and a lost executor costs nothing.

    ``keep`` writes a table and reads it back; ``drop`` deletes one that no later step reads. ``kept`` has the last
    table of each name.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        self.kept: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame, name: str, dictionary_mb: int = 1) -> DataFrame:
        """``dictionary_mb`` is how large a column's dictionary may grow before its values are written out."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        with swept(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").option("parquet.dictionary.page.size", dictionary_mb << 20).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.kept[name] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                _remove(self.spark, path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint only if ``df`` has at most ``max_rows`` rows (counted, reading at most one more)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of ``counts`` with the largest counts ``n``, at most ``most`` of them: whole classes of about equal
    counts (an eighth of a doubling), so that neither a sort nor a limit gathers rows."""
    step = F.floor(F.log2(n) * 8)
    sizes = sorted(((r.step, r.rows) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, total = None, 0
    for at, rows in sizes:
        if (total := total + rows) > most:
            break
        least = at
    return counts.where(step >= least) if least is not None else counts.limit(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="siftmark-code-")
    path = os.path.join(folder, "siftmark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)  # the driver serves the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    _SHIPPED.add(app)
