"""Session settings and lineage cutting shared by the iterative operators."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", app: str = "spatialqa", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false"))
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster other
    executors could not read it, and it would vanish with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative operators, survives the loss of an executor, and
    gives the next join exact file sizes, so AQE and the planner choose well.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark).rstrip('/')}/spatialqa-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def unfolded(df: DataFrame) -> DataFrame:
    """``df``, rows that an ``explode`` made of shorter ones, kept from being broadcast.

    The planner takes them for as many as there were before: a hundred rows of every box would
    count as one, and go through the driver whole. A merge join has no such limit.
    """
    return df.hint("merge")


def packed_rows(df: DataFrame) -> DataFrame:
    """``df``, rows of objects that a file holds, kept from being broadcast.

    The planner takes the bytes of a file for its size. Ids and names in order shrink to a tenth or less there,
    so ten megabytes of them are a table of hundreds on the driver. A merge join has no such limit.
    """
    return df.hint("merge")


#: Rows in a task before each of them becomes many.
FOLDED_ROWS = 20_000


def dealt(df: DataFrame, keys: list[str], rows: int = FOLDED_ROWS) -> DataFrame:
    """``df`` in partitions of about ``rows`` rows, neighbours by ``keys``, before an ``explode``.

    Splits of a file go by its bytes, so a few tasks would unfold most rows, with memory that grows with the file.
    Ranges are even however many rows a scene has, and what lies together is aggregated before it is shuffled.
    Counts the rows and takes a sample of the keys, so ``df`` should be near a table.
    """
    return df.repartitionByRange(max(1, -(-df.count() // rows)), *keys)


def dealt_whole(df: DataFrame, keys: list[str], rows: int = FOLDED_ROWS) -> DataFrame:
    """``df`` in partitions by ``keys`` of about ``rows`` rows, before an ``explode``.

    What it unfolds into is grouped by these keys, and by any more, where it lies. There are more partitions than a shuffle
    has: with as many, the planner would keep those of a join before, and join them to few by the bytes of folded rows.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least + 1, -(-df.count() // rows)), *keys)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing reads any more; other frames are left alone.

    For loops: a round's tables go once the tables that follow from them are written.
    """
    for table in tables:
        name = vars(table).get("stored_at")
        if name:
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
