"""Session set-up and the shared folder for tables that cut lineage."""

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"
_written: list[str] = []
_own: set[str] = set()


def local_session(cores="*", shuffle_partitions=8, memory="8g", work_folder=None) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("leadloom")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # Call-site capture costs several JVM round trips per column expression.
               .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    if work_folder:
        builder = builder.config(_FOLDER, work_folder)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a folder of this application in the warehouse, which is shared too; it goes when the
    driver ends.
    """
    folder = spark.conf.get(_FOLDER, None)
    if folder:
        return folder.rstrip("/")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_leadloom-{spark.sparkContext.applicationId}"
    if folder not in _own:
        _own.add(folder)
        atexit.register(delete, spark, folder)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session was stopped before the driver ends
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several later steps read a table that is dear to compute; the
    files outlive lost executors.  ``release`` deletes them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_so_far() -> int:
    """A mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, mark: int = 0) -> None:
    """Delete the stored tables written since ``mark``: once the results that read them are written."""
    while len(_written) > mark:
        delete(spark, _written.pop())
