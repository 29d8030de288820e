"""Sessions, and the shared folder in which lineage is cut.

Long or iterative plans are cut by writing a Parquet table into the folder that the
cluster names in ``spark.checkpoint.dir``. All executors can read such a table, so
the loss of any one of them costs nothing, and a reader prunes its columns as with
any other table. A folder of our own is made only where the setting is absent, as in
tests on one machine.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def local_session(cpus: str = "8", **conf: str) -> SparkSession:
    """A session on this machine, as tests and the bench use it."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("cutlight").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage: the cluster's if it names one, else a temporary one.

    Raises ValueError on a cluster that names none, since executors on other machines
    could not read a folder of this one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="cutlight-")
    return _FOLDERS[app]


def cut(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder and read back: same rows, no lineage.

    The table is removed when the driver's Python ends; until then it may be read any
    number of times.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cutlight-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    atexit.register(remove_folder, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut_and_release(df: DataFrame) -> DataFrame:
    """cut(), after which the driver lets go of what the finished plans held.

    For a query of very many stages: else its plans, broadcasts and shuffle files stay, and the driver's
    heap grows to its limit, until the driver happens to collect its garbage.
    """
    table = cut(df)
    gc.collect()  # Python's references keep objects of the JVM alive
    df.sparkSession.sparkContext._jvm.System.gc()
    return table


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder through the file system that holds it, if it is there."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone by then
        pass


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
