"""Tables that cut lineage: written once to the folder every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset and all tasks run in this process' machine.

    On a cluster an unset folder is an error: executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        master = spark.conf.get("spark.master", "local")
        # the executors of a local cluster are processes of their own
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _OWN.get("root") or _OWN.setdefault("root", tempfile.mkdtemp(prefix="spark-shared-"))
    return root.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """The folder of this application's tables and streams."""
    return f"{shared_root(spark)}/tables/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    The result does not depend on any executor's memory or local disk, so a
    lost executor costs a re-read and never a recomputation of ``df``.
    """
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialise`` that nothing reads any more; what was not written by it is left alone."""
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path is not None:
            _delete(table.sparkSession, path.rsplit("/", 1)[0])


def discard_all(spark: SparkSession) -> None:
    """Remove all tables that this application has written and not removed: to be called once nothing reads results any more.

    Results are plans that run later, so tables that they read cannot go before.
    """
    _delete(spark, application_folder(spark))
