"""Spark session settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI and UTC fix results; adaptive execution splits skewed joins and sizes shuffles at run time.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(name: str) -> SparkSession.Builder:
    made = SparkSession.builder.appName(name)
    for key, value in CONF.items():
        made = made.config(key, value)
    return made


def local_session(name: str = "linkrisk", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests, the bench and the command line."""
    spark = (
        builder(name)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where a single-machine session names none, it is in a temporary folder of the machine.
    """
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.gettempdir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
