"""Session helpers: size checks before a broadcast, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("monthloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Spares a look at the Python call stack for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Rows that already lie together by series need no second shuffle to join by series and month.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .getOrCreate()
    )


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the optimizer's own size estimate of ``df`` is within the session's broadcast limit."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return limit >= 0 and int(str(estimate)) <= limit


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written_by_series(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder in buckets of whole series and go on from the written table.

    What was computed outlives the executors that computed it, readers take only the columns and rows they need,
    and steps by series need no further shuffle. Buckets also fix the number of tasks of such steps.
    """
    spark = df.sparkSession
    name = f"monthloom_{uuid.uuid4().hex}"
    buckets = shuffle_partitions(spark)
    order = [c for c in ("series_id", "ds") if c in df.columns]
    writer = df.repartition(buckets, "series_id").write.bucketBy(buckets, "series_id").sortBy(*order)
    writer.option("path", f"{checkpoint_folder(spark)}/{name}").saveAsTable(name)
    written = spark.table(name)
    # Only the name is taken out of the catalog; the files belong to the folder.
    spark.sql(f"DROP TABLE {name}")
    return written


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder with its partitions and their order as they are."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only on a local master without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="monthloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()
