"""Tables written between the passes of a job, and checks of their size."""

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """A folder of its own under ``spark.checkpoint.dir`` for the tables of one job.

    A written table cuts lineage, survives the loss of executors and is read back column by
    column, with a size the optimizer knows. Only a local session without that setting gets a
    temporary folder; on a cluster the setting is required.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="maskwright-")
        self.path = f"{shared.rstrip('/')}/maskwright-{uuid.uuid4().hex}"

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        """Computes ``rows`` once, into a table."""
        target = f"{self.path}/{name}"
        rows.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(rows.schema).parquet(target)

    def release(self) -> None:
        """Deletes the job's tables, once nothing reads them any more."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def input_bytes(rows: DataFrame) -> int:
    """The size of the files and tables that a plan reads."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


# Bytes of input files per task of a shuffle that carries texts.
TASK_BYTES = 8 << 20


def in_tasks(rows: DataFrame, keys: list[str], source: DataFrame | None = None) -> DataFrame:
    """``rows`` dealt by ``keys`` to more tasks than the session's shuffles have, if the input of ``source`` calls for it.

    So what one task sorts does not grow with the input. Smaller input, and input of unknown size, is left to Spark.
    """
    spark = rows.sparkSession
    size = input_bytes(rows if source is None else source)
    tasks = math.ceil(size / TASK_BYTES)
    known = size < 1 << 60
    return rows.repartition(tasks, *keys) if known and tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows
