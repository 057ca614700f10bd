"""Session settings and the folder shared by all executors."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that let Spark split oversized join partitions by itself.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def local_session(cpus: int | str = "*", **conf) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("matchlens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**ADAPTIVE, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators count on.

    Shuffles start with enough partitions for the cluster's cores, whatever
    ``spark.sql.shuffle.partitions`` says; Spark merges them when data is small.
    """
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = 4 * spark.sparkContext.defaultParallelism
    if not spark.sparkContext.master.startswith("local") and wanted > configured:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="matchlens-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts lineage: a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
