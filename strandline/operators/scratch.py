"""Places for intermediate tables that every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Folders of the blocks that are open, the innermost last.
_open: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one that ``spark.checkpoint.dir`` names.
    Where that is unset, a temporary folder of this machine, for a local master only: on a
    cluster each executor would write to its own disk, so RuntimeError is raised."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or _own_dir()}/strandline-{spark.sparkContext.applicationId}"


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="strandline-")


def stored(df: DataFrame, tag: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: the lineage ends
    there, and a lost executor costs no recomputation of it.  ``lasting`` tables outlive the
    block of ``scratch_of_its_own`` in which they are written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark) if lasting or not _open else _open[-1]}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = StructType.fromJson(df.schema.jsonValue())
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_of_its_own(spark: SparkSession) -> Iterator[None]:
    """Tables stored within the block are deleted when it ends; tables made from them must be
    written by then."""
    path = f"{scratch_dir(spark)}/block-{uuid.uuid4().hex}"
    _open.append(path)
    try:
        yield
    finally:
        _open.remove(path)
        _delete(spark, path)


def delete_scratch(spark: SparkSession) -> None:
    """Delete all that this application has stored, when its results are written."""
    _delete(spark, scratch_dir(spark))
