"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
#: Of each application whose settings name a folder, that folder: reading settings takes as long as planning a query.
_named: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's part of ``spark.checkpoint.dir``.

    A machine-local folder stands in only where driver and executors are one process (``local[...]``).
    """
    app = spark.sparkContext.applicationId
    if app in _named:
        return f"{_named[app].rstrip('/')}/{app}"
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        _named[app] = found
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="gasframe-"))
        found = _own[0]
    return f"{found.rstrip('/')}/{app}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, sizes are known, and a lost
    executor costs a re-read at most."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``written`` or ``bucketed`` wrote for ``df``; for tables that no returned plan reads."""
    if name := getattr(df, "_scratch_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS `{name}`")
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bucketed(df: DataFrame, label: str, buckets: int, *keys: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets by ``keys`` and read it back: joins and groupings by these keys read
    it without a shuffle."""
    return _as_table(df.repartition(buckets, *keys), label, buckets, keys, keys)


def in_ranges(df: DataFrame, label: str, buckets: int, key: str, home: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets that are ranges of ``key``, of about as many rows each, and read it
    back with the column ``home``, by which it is bucketed: all rows of a key have one. Each range gets a home whose
    hash is in a bucket of its own."""
    ids = df.sparkSession.range(64 * buckets)
    seats = ids.groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("$seat")).agg(F.min("id").alias("$key"))
    rows = df.repartitionByRange(buckets, key).withColumn("$range", F.spark_partition_id())
    rows = rows.join(F.broadcast(seats), F.col("`$range`") == F.col("`$seat`"), "left").withColumn(home, F.coalesce("`$key`", F.col("`$range`").cast("bigint")))
    return _as_table(rows.drop("$range", "$seat", "$key"), label, buckets, (home,), (key,))


def _as_table(df: DataFrame, label: str, buckets: int, keys: tuple, order: tuple) -> DataFrame:
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*order).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._scratch_path, out._scratch_table = path, name
    return out
