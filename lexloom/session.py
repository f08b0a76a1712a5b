"""Session helper for local runs; on a cluster the caller brings its own session."""

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", name: str = "lexloom") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Lists per norm: rows that come sorted by norm are aggregated in that order; others keep more groups before they sort.
        .config("spark.sql.execution.replaceHashWithSortAgg", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, else one set by setCheckpointDir, else, where they
    are one process, a new local one."""
    import tempfile

    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="lexloom-")).rstrip("/")
