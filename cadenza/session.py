"""Session settings and the shared folder every staged table goes to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FILTER_OF_EXPLODE = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"

_RUN_FOLDERS: dict[str, str] = {}


def local_session(cores: str = "8", memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cadenza")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; leave sizing to the cluster.

    Skewed joins are split at run time even when that costs one more shuffle,
    because a single track or text may hold a large share of all rows.  The small
    minimum partition size only matters for little data with costly expressions.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256KB")
    # a union that claims its children's partitioning loses rows when a reused exchange
    # is coalesced differently (seen with Spark 4.1.2); tests/test_alignment.py shows it
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    # a filter on the size of what explode takes apart would compute that array twice
    excluded = [r for r in spark.conf.get("spark.sql.optimizer.excludedRules", "").split(",") if r]
    if FILTER_OF_EXPLODE not in excluded:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join([*excluded, FILTER_OF_EXPLODE]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for staged tables, inside the one that ``spark.checkpoint.dir`` names.

    Only a session whose executors are threads of its own process may do without the
    setting; it takes a temporary folder.  Anywhere else a missing setting is an error,
    because executors would write to disks of their own.
    """
    app = spark.sparkContext.applicationId
    if app not in _RUN_FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if not base and master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = base or tempfile.mkdtemp(prefix="cadenza-")
        _RUN_FOLDERS[app] = f"{base.rstrip('/')}/cadenza-{app}"
    return _RUN_FOLDERS[app]


def stage_files(df: DataFrame, label: str) -> str:
    """Write ``df`` to a new folder of the shared folder and return its path."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing), and lets
    the two passes of an ordered scan read the same rows with column pruning.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stage_files(df, label))


def spread(df: DataFrame) -> DataFrame:
    """Spread a table scan that has fewer partitions than there are cores.

    Meant for small files with costly expressions behind them; large tables already have
    enough partitions and are left alone, without any shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
