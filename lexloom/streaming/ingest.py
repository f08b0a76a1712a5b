"""Incremental ingestion: file stream, deduplication, status state, upsert per batch."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files: str = "events*.parquet", files_per_batch: int = 1) -> DataFrame:
    """Files of a folder whose names match, some a batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", files).parquet(folder)


def deduplicated(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Repeated deliveries of an id within the watermark count once."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n_events"))


def upsert_batch(batch: DataFrame, n: int, path: str, key: str = "event_id", order: str = "ts") -> None:
    """Writes version n of a table of the latest row a key: version n - 1 and the batch, whatever the order in which rows arrive.

    A rerun of a batch writes its version again, so every delivery counts once. Rows behind any watermark still count.
    Tables with a merge of their own would rewrite fewer files.
    """
    rest = [c for c in batch.columns if c not in (key, order)]
    whole = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/v={n - 1}").unionByName(batch) if n else batch
    last = whole.groupBy(key).agg(F.max(order).alias(order), F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_r"))
    last.select(key, order, "_r.*").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v={n}")


def latest_version(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest version of such a table."""
    versions = spark.read.schema(schema).option("basePath", path).parquet(path)
    newest = versions.agg(F.max("v")).first()[0]
    return versions.filter(F.col("v") == newest).drop("v")


STATE_OUT = "entity_id long, n_events long, last_status string"


def track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, ts, last = state.get if state.exists else (0, 0, "")
    for b in batches:
        n += len(b)
        b = b.sort_values("ts")
        if len(b) and b["ts"].iloc[-1].value >= ts:
            ts, last = b["ts"].iloc[-1].value, b["status"].iloc[-1]
    state.update((n, ts, last))
    yield pd.DataFrame({"entity_id": [key[0]], "n_events": [n], "last_status": [last]})


def status_tracker(stream: DataFrame) -> DataFrame:
    """Custom state per entity: how many changes it saw and its latest status."""
    return stream.groupBy("entity_id").applyInPandasWithState(track, STATE_OUT, "n long, ts long, last string", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, each_batch, checkpoint: str) -> None:
    """Runs what is there now, batch by batch, then stops; a rerun goes on from the checkpoint."""
    stream.writeStream.outputMode("update").foreachBatch(each_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
