"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "folioscope", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """From now on rows cross between the session's executors and Python in batches of at most ``most`` bytes, not of 10,000 rows:
    a batch of long texts is held several times on its way."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Where the cluster names none, a local-mode session gets a folder of its own under the
    warehouse, which is set in the session from then on; any other session is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for ``purpose`` in the shared folder, removed when the session's JVM ends."""
    jvm = spark.sparkContext._jvm
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    path = jvm.org.apache.hadoop.fs.Path(own)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: it outlives lost executors, and its size is known
    to the planner when it picks a join. What was shuffled for it goes with its writing."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_in = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``kept`` that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.kept_in)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
