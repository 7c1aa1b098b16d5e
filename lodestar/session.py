"""What operators share: the shared folder, materialised tables, size-checked broadcasts.

Nothing here keeps state on one machine: tables cut from their lineage go to the folder named by
``spark.checkpoint.dir``, which every executor can read, so a lost executor costs only a re-read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Most rows and most bytes of values of a side that is broadcast; above either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def ship(spark: SparkSession) -> None:
    """Give executors the package where they can't import it themselves (it is neither on PYTHONPATH nor in the working folder)."""
    root = Path(__file__).resolve().parents[1]
    known = [Path(p).resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p]
    sc = spark.sparkContext
    if root in known or getattr(sc, "_lodestar_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="lodestar-"), "lodestar.zip")  # on the driver, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "lodestar").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    sc._lodestar_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a folder of this machine on a local master, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder, which is removed when the application ends."""
    base = f"{shared_dir(spark)}/lodestar-{spark.sparkContext.applicationId}"
    fs, p = file_system(spark, base)
    fs.deleteOnExit(p)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application; results not yet written elsewhere are lost."""
    drop_path(spark, f"{shared_dir(spark)}/lodestar-{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path (used between iterations, so that only the last table stays)."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """Content of a small text file."""
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file whole: under another name first, then renamed."""
    fs, p = file_system(spark, path)
    _, draft = file_system(spark, path + ".tmp")
    stream = fs.create(draft, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    fs.delete(p, False)
    fs.rename(draft, p)


def _value_bytes(name: str, kind: DataType) -> Column:
    """Bytes of one column's value in a row, about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        return F.coalesce(F.size(name), F.lit(0)) * 8 + 16 if not isinstance(kind.elementType, StringType) else F.coalesce(F.octet_length(F.array_join(name, "")), F.lit(0)) + 16
    if isinstance(kind, (MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(name)), F.lit(0)) + 16
    return F.lit(8)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` keeps to both bounds; stops reading at the first row too many."""
    size = F.lit(0)
    for f in df.schema.fields:
        size = size + _value_bytes(f"`{f.name}`", f.dataType)
    rows, total = df.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    return rows <= max_rows and (total or 0) <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its checked size allows, else unchanged (a shuffle join)."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a table that must be small by its nature (a vocabulary); raises beyond ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows
