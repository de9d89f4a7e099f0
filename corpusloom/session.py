"""Session builder for local work and tests; on a cluster the caller's own session is used as it is."""

from pyspark.sql import SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one all executors share (spark.checkpoint.dir); a temporary one only where that is unset."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_work_folder", None)
    if not base:
        base = spark._work_folder = "file://" + tempfile.mkdtemp(prefix="spark-work-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
