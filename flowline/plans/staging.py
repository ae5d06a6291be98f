"""Staged tables: the place to cut lineage and to keep results that must not be computed twice."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STAGED: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``. Set it before the first staged table."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        found = getattr(spark.sparkContext, "_flowline_dir", None)  # one machine: driver and executors are one process
        if not found:
            found = spark.sparkContext._flowline_dir = tempfile.mkdtemp(prefix="flowline-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not found:
        raise RuntimeError("staged tables need a folder that all executors share: set spark.checkpoint.dir")
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back with the same schema.

    A lost executor costs the reading tasks only, and expensive stages run once: unlike ``checkpoint()`` this computes
    the rows a single time. The tables are removed at the end of a ``scope``, by ``release`` and when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/flowline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((weakref.ref(spark.sparkContext), path))
    return spark.read.schema(df.schema).parquet(path)


def release(since: int = 0) -> None:
    """Remove staged tables, all or those made after the first ``since``."""
    while len(_STAGED) > since:
        ref, path = _STAGED.pop()
        sc = ref()
        if sc is None or sc._jsc is None:
            continue
        try:
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be ending already
            return


@contextmanager
def scope():
    """For long programs: what is staged inside goes with the block, once its results are written. Earlier tables stay."""
    before = len(_STAGED)
    try:
        yield
    finally:
        release(before)


atexit.register(release)
