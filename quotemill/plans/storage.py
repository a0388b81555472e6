"""Tables that a plan writes on its way: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this application's own under ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        top = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not top:
            if not (spark.sparkContext.master or "").startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="quotemill-")
        _roots[app] = f"{top.rstrip('/')}/quotemill-{uuid.uuid4().hex}"
        atexit.register(_quietly, lambda: drop_path(spark, _roots[app]))
    return _roots[app]


def _quietly(f: Callable[[], None]) -> None:
    try:
        f()
    except Exception:  # the session may have ended
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path by Hadoop's file system, so that any store will do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet into the shared folder and reads them again."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path  # type: ignore[attr-defined]
    return out


def unshare(df: DataFrame) -> None:
    """Deletes what ``shared`` wrote for this very DataFrame."""
    drop_path(df.sparkSession, df.shared_path)  # type: ignore[attr-defined]


_shipped: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package: by the driver's own path where they run beside it, else as a zip in the shared folder that Spark hands to executors."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in (os.environ.get("PYTHONPATH", "") + os.pathsep + env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    app = spark.sparkContext.applicationId
    if app not in _shipped and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master or ""):
        _shipped.add(app)
        spark.sparkContext.addPyFile(_zipped(spark, root))


def _zipped(spark: SparkSession, root: str) -> str:
    """This package as a zip in the shared folder."""
    data = io.BytesIO()
    name = __name__.split(".")[0]
    with zipfile.ZipFile(data, "w") as out:
        for folder, _, files in sorted(os.walk(os.path.join(root, name))):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    out.write(path, os.path.relpath(path, root))
    place = f"{shared_root(spark)}/{name}.zip"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        stream.write(bytearray(data.getvalue()))
    finally:
        stream.close()
    return place


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores before it until no column has that name (compared without case)."""
    low = {x.lower() for x in taken}
    while base.lower() in low:
        base = "_" + base
    return base
