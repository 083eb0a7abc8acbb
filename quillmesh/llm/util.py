"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text: runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where it is unset."""
    sc = spark.sparkContext
    got = sc.getCheckpointDir()
    if got is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "quillmesh-ck"))
        got = sc.getCheckpointDir()
    return got


_tables: dict[str, SparkSession] = {}


def cut(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the folder that all executors share.

    Tables go with `forget`, or when the driver's Python ends. A reader holds one row group at a time;
    `row_group` bounds its bytes where rows are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmesh-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.size", row_group) if row_group else out).parquet(path)
    _tables[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmesh_path = path
    return out


def forget(*dfs: DataFrame) -> None:
    """Delete tables that `cut` wrote, once nothing lazy reads them any more."""
    for df in dfs:
        path = getattr(df, "_quillmesh_path", None)
        if path in _tables:
            delete(_tables.pop(path), path)


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_tables.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before
            return


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application: workers may not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def mapped(df: DataFrame, fn, schema) -> DataFrame:
    """df.mapInArrow where the workers can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)
