"""Column access by exact name, and durable intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Up to so many host names (253 bytes each at most: 26 MB) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 100_000
SALTS = 32


def flag(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """df with the boolean name: whether key is among keys (one column, distinct).

    Many keys are joined by (key, salt), so that a key with a third of all rows is no single task.
    """
    keys = keys.toDF("_key").withColumn(name, F.lit(True))
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        out = df.join(F.broadcast(keys), key == F.col("_key"), "left")
    else:
        keys = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = df.withColumn("_at", F.floor(F.rand(7) * SALTS).cast("int"))
        out = out.join(keys, (key == F.col("_key")) & (F.col("_at") == F.col("_salt")), "left").drop("_salt", "_at")
    return out.withColumn(name, F.coalesce(name, F.lit(False))).drop("_key")


#: Rows and bytes that go to a Python worker at once; tables of texts need less than the usual 10,000 rows.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to these sizes; smaller ones stay.

    They stay so: plans are lazy, so what is built here may run at any later time.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key), re.IGNORECASE)
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def flat(df: DataFrame) -> DataFrame:
    """The same rows under the names _0, _1, ...; no name can then clash. What follows runs in small batches."""
    small_batches(df.sparkSession)
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Select columns by their exact names (the first of equals), as new names.

    Names that differ from others by case only, or hold dots, are no trouble.
    """
    columns = df.columns
    return flat(df).select(*[F.col(f"_{columns.index(old)}").alias(new) for new, old in names.items()])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset and all runs in one process (tests), one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='ordina-')}"
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    return spark.read.schema(schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of durable() that nothing will read again."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
