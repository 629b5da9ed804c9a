"""Session set-up, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "doclake", partitions: int | None = None) -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own."""
    n = partitions or (8 if cpus == "*" else int(cpus))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Scratch folders of local sessions that name none themselves, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster shares (``spark.checkpoint.dir``).

    Only a local master may run without that setting; it then gets a folder of its own, once per application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        name = context.applicationId
        if name not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[name] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        root = _LOCAL_ROOTS[name]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back; cuts the lineage."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all task slots when a small input has fewer splits than that; otherwise ``df`` itself.

    For steps that are heavy on the CPU. A large input has more splits than slots and is never shuffled by this.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
