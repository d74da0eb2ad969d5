"""Tables that a job writes once and reads several times.

They lie in the folder that ``spark.checkpoint.dir`` names, which all executors
and the driver share, so that a lost executor takes no result with it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from railbird.llm import bundles


BATCH_BYTES = "8388608"  # a task may have several Python steps, each with a batch on either side


def bound_batches(spark: SparkSession) -> None:
    """Ends Arrow batches by bytes too, so that ten thousand long texts don't meet in one; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def typed(df: DataFrame, *columns: str) -> str:
    """The DDL of some columns of ``df``."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def find_package(spark: SparkSession) -> None:
    """Lets Python workers on machines that have this repository import it, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs on this machine."""
    bound_batches(spark)
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def _made() -> list[str]:
    """Places of the tables that this call, or this thread, has written."""
    made = _tables.get()
    if made is None:
        _tables.set(made := [])
    return made


def materialize(
    df: DataFrame, label: str, compression: str = "zstd", level: int = 3, group_bytes: int = 128 << 20, page_bytes: int = 1 << 20, bundled: tuple[str, str, tuple[str, ...]] | None = None,
    then: tuple[bundles.Step, str] | None = None,
) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back; row groups of about ``group_bytes`` bound what a reader holds, pages of ``page_bytes`` are compressed at once.

    ``bundled`` (column, kind, quick kinds, see ``bundles.pack``) has one binary column of many rows compressed together; the rows that come back are the same,
    or what ``then`` (see ``bundles.unpack``) makes of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    options = {"compression": compression, "parquet.compression.codec.zstd.level": level, "parquet.block.size": group_bytes, "parquet.page.size": page_bytes}
    kept = df
    if bundled:
        kept = bundles.pack(df, *bundled)
        options |= {"parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}  # a row is a megabyte or more
    kept.write.options(**options).parquet(path)
    _made().append(path)
    back = spark.read.schema(kept.schema).parquet(path)
    return bundles.unpack(back, bundled[0], df.schema, then) if bundled else back


@contextmanager
def only_last_stays(spark: SparkSession) -> Iterator[None]:
    """Of the tables that ``materialize`` writes inside, all but the last one are removed at the end; nothing may read them after that.  Tables of other calls and threads are left alone."""
    own: list[str] = []
    outer = _made()
    token = _tables.set(own)
    try:
        yield
    finally:
        _tables.reset(token)
    for path in own[:-1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    outer += own[-1:]


def tables_written() -> int:
    """Tables of this thread that stay."""
    return len(_made())
