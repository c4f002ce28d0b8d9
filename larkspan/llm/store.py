"""Tables written to the folder that driver and executors share.

Lineage is cut by writing a Parquet table there and reading it again, so that a lost executor costs
a re-read, never a recomputation from the source.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders of this process that are still there, by session-independent path.
_SCRATCH: list[str] = []

#: Rows of one Arrow batch handed to Python; the slices in ``text.slices`` bound the bytes further.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset (tests) a temporary folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
    own = tempfile.mkdtemp(prefix="larkspan-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, remembered for ``drop_scratch``."""
    path = f"{shared_dir(spark)}/larkspan/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """The scratch paths that are made inside, for whoever knows when they are done with."""
    start, paths = len(_SCRATCH), []
    try:
        yield paths
    finally:
        paths += _SCRATCH[start:]
        del _SCRATCH[start:]


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, read again, and its path, for who can delete it early."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    return kept(df, name)[0]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this process. Frames that read them must be done with."""
    while _SCRATCH:
        delete(spark, _SCRATCH.pop())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        made, k = f"__{name}", 0
        while made in taken:
            k += 1
            made = f"__{name}_{k}"
        taken.add(made)
        out.append(made)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts: at most ``ARROW_ROWS`` rows each."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
