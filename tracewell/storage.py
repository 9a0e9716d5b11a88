"""Tables written to the folder that driver and executors share.

A table written and read again cuts the lineage of a plan and survives the loss of
executors.  The folder is the cluster's ``spark.checkpoint.dir``; where that is unset a
folder of this machine is taken if Spark runs in this one process, as in tests, and an error
raised if it doesn't.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 16 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="tracewell-"))
    return found.rstrip("/")


def home(spark: SparkSession) -> str:
    """Where this application keeps its tables."""
    return f"{shared_dir(spark)}/tracewell/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application; frames that still read them fail afterwards."""
    _file_system(spark, home(spark), lambda fs, p: fs.delete(p, True))


def materialize(df: DataFrame, *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder, with a folder for each value of ``folders``, and return a frame that reads it."""
    path = f"{home(df.sparkSession)}/{uuid.uuid4().hex}"
    return _read(df, path, _write(df, path, folders))


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table that several passes may read: itself if ``materialize`` returned it."""
    return df if hasattr(df, "_tracewell_rows") else materialize(df)


def materialize_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Write frames with one schema, one after the other, and return one frame that reads them all."""
    path, rows, df = None, 0, None
    for i, df in enumerate(frames):
        path = path or f"{home(df.sparkSession)}/{uuid.uuid4().hex}"
        rows += _write(df, f"{path}/{i}", ())
    return _read(df, path, rows, recursiveFileLookup=True)


def _write(df: DataFrame, path: str, folders: Sequence[str]) -> int:
    """Write ``df`` and return its number of rows, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*folders).parquet(path)
    return seen.get["rows"]


def _read(df: DataFrame, path: str, rows: int, **options) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).options(**options).parquet(path)
    out._tracewell_path, out._tracewell_rows = path, rows
    return out


def rows_of(df: DataFrame) -> int:
    """Rows of a frame that ``materialize`` returned."""
    return df._tracewell_rows


def named_as(df: DataFrame, columns: list) -> DataFrame:
    """Some columns of a frame that ``materialize`` returned, whose size is still known."""
    out = df.select(*columns)
    out._tracewell_path, out._tracewell_rows = df._tracewell_path, df._tracewell_rows
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``materialize`` returned and nothing reads any more."""
    _file_system(df.sparkSession, df._tracewell_path, lambda fs, p: fs.delete(p, True))


def bytes_of(df: DataFrame) -> int:
    """Bytes on disk of a frame that ``materialize`` returned."""
    return _file_system(df.sparkSession, df._tracewell_path, lambda fs, p: fs.getContentSummary(p).getLength())


def _file_system(spark, path, act):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return act(p.getFileSystem(spark._jsc.hadoopConfiguration()), p)


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a materialized ``right``: broadcast while it is small, shuffled beyond."""
    return left.join(F.broadcast(right) if is_small(right) else right, on, how)


def is_small(df: DataFrame) -> bool:
    """Whether a materialized frame may be broadcast: by its files' bytes, and by rows times width, as files are compressed."""
    if bytes_of(df) > BROADCAST_BYTES:
        return False
    if any(isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType) for f in df.schema.fields):
        return bytes_of(df) * 8 <= BROADCAST_BYTES
    return rows_of(df) * sum(64 if isinstance(f.dataType, T.StringType) else 8 for f in df.schema.fields) <= BROADCAST_BYTES


def follow(rows: DataFrame, on: str, step: DataFrame) -> DataFrame:
    """``rows`` with each value of column ``on`` replaced by what the materialized ``step`` (``node, to``) has for it, if anything.

    Beyond the size of a broadcast the rows of values with over a thousandth of all rows
    (so at most a thousand values) stay where they are, and only the others are shuffled.
    """
    names = rows.columns
    renamed = step.select(F.col("node").alias(on), F.col("to").alias("_to"))

    def moved(some: DataFrame, by: DataFrame) -> DataFrame:
        return some.join(by, on, "left").select(*(F.coalesce("_to", on).alias(c) if c == on else c for c in names))

    if is_small(step):
        return moved(rows, F.broadcast(renamed))
    many = rows.count()
    hot = F.broadcast(rows.groupBy(on).count().filter(F.col("count") * 1000 > many).select(on))
    return moved(rows.join(hot, on, "left_semi"), F.broadcast(renamed.join(hot, on, "left_semi"))).unionByName(moved(rows.join(hot, on, "left_anti"), renamed))


def join_groups(left: DataFrame, groups: DataFrame, on: str | list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key (one column or several), whose ``size`` column counts the key's rows in ``left``.

    The materialized ``groups`` are broadcast while they are small.  Beyond that keys with over a
    thousandth of ``total`` rows (so at most a thousand of them) are broadcast, and their
    rows stay where they are; only the others are shuffled.
    """
    if is_small(groups):
        return left.join(F.broadcast(groups), on, how)
    hot = F.broadcast(groups.filter(F.col(size) * 1000 > total))
    cold = groups.filter(F.col(size) * 1000 <= total)
    return left.join(hot, on).unionByName(left.join(hot.select(*([on] if isinstance(on, str) else on)), on, "left_anti").join(cold, on, how), allowMissingColumns=True)
