"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# AQE re-plans joins from measured sizes, splits skewed join partitions and
# merges small shuffle partitions; partition counts stay the cluster's choice.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call sites of every column are only of use in a notebook and slow down planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "gavel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checked_broadcast(small: DataFrame, rows: int = 100_000) -> DataFrame:
    """`small` to be broadcast if it has at most so many rows; else as it is, for a shuffle join.

    Counts up to the bound while the plan is built.
    """
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's `spark.checkpoint.dir`, removed when the application ends.

    Only a local session without that setting (tests, a laptop) falls back to a
    temporary folder, which is then remembered as the session's setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="gavel-scratch-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    # Kept as long as the session may read it, gone with the application.
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of `materialize` that have been read for the last time, and what the driver no longer refers to.

    Spark removes shuffle files and broadcasts once the driver's garbage
    collection finds their owners gone, by itself only every half hour.
    """
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small in-plan table (configuration rows) whose size Catalyst knows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [()] * len(struct.fields)
    table = pa.Table.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow
    )
    return spark.createDataFrame(table, schema=struct)
