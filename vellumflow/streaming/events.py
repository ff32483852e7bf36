"""Staged events as streams: absorbing redelivery, an idempotent sink, stale suppression, run states, rate limits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.functions import model as M

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: What makes an event the same one when it is delivered again.
KEY = ("document_id", "event_type", "event_time")
REDELIVERED = 10**12  # added to the id of an event that comes a second time


def read_events(spark: SparkSession, sf_dir: str, repeat_every: int | None = 7) -> DataFrame:
    """The events table as a stream of staged events; every seventh one comes twice, under another id, as a broker may deliver."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/[e]vents.parquet")
    rows = raw.select("event_id", F.col("user_id").alias("document_id"), "event_type", F.col("ts").cast("timestamp").alias("event_time"), "value")
    if repeat_every is None:
        return rows
    copies = F.when(F.col("event_id") % repeat_every == 0, F.array("event_id", F.col("event_id") + REDELIVERED)).otherwise(F.array("event_id"))
    return rows.withColumn("event_id", F.explode(copies))


def absorb(events: DataFrame, within: str = "40 days", keys: tuple[str, ...] = KEY) -> DataFrame:
    """Each event once, however often and under whatever id it is delivered within the watermark; state is dropped behind it."""
    return events.withWatermark("event_time", within).dropDuplicatesWithinWatermark(list(keys))


def current_only(events: DataFrame, state: DataFrame, event_type: str, status: int) -> DataFrame:
    """Events of a type whose document still has the status (a static table) and is no container; stale ones fall away."""
    live = state.where((F.col("lifecycle_status") == status) & ~F.col("is_container")).select(F.col("id").alias("document_id"))
    return events.where(F.col("event_type") == event_type).join(live, "document_id", "left_semi")


def rate(events: DataFrame, limit: int = M.RATE_LIMIT, width: str = M.RATE_WINDOW, watermark: str = "1 minute") -> DataFrame:
    """Requests and rejected requests per client and fixed window. State of windows behind the watermark is dropped, so it stays bounded."""
    counts = events.withWatermark("event_time", watermark).groupBy(F.window("event_time", width).alias("w"), "document_id").agg(F.count(F.lit(1)).alias("requests"))
    return counts.select("document_id", F.col("w.start").alias("window_start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"))


RUN_MEMORY = "attempts long, attempt long, run_id long, status long, failed long, collisions long, stale long"


def run_states(changes: DataFrame) -> DataFrame:
    """The state of the latest pipeline run of each (document, pipeline), kept by Spark between batches.

    changes: document_id, pipeline, attempt, run_id, status, event_time, event_id. A run has an attempt number and goes
    from pending over running to succeeded, failed or skipped; a failed run may be started again in place. A higher attempt
    number is a new run. A change of another run with the number of the current one is a collision and is refused; one of
    an earlier attempt is stale and is left out. Within a batch changes count by time, ties by event_id. failed counts the
    changes to failed. Memory per key is one row, whatever the number of runs.
    """

    counts = [c.split()[0] for c in RUN_MEMORY.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        attempts, attempt, run, status, failed, collisions, stale = state.get if state.exists else (0, 0, -1, 0, 0, 0, 0)
        rows = sorted(tuple(map(int, change.split(","))) for batch in batches for change in batch["change"].tolist())
        for _, _, number, of, to in rows:
            if number < attempt:
                stale += 1
            elif number == attempt and of != run:
                collisions += 1
            else:
                attempts += number > attempt
                attempt, run, status = number, of, to
                failed += to == M.RUN_FAILED
        memory = tuple(int(v) for v in (attempts, attempt, run, status, failed, collisions, stale))
        state.update(memory)
        yield pd.DataFrame({"document_id": [key[0]], "pipeline": [key[1]], "memory": [",".join(map(str, memory))]})

    # Spark turns each column of each group into a Series of its own, and groups are small: a change is one text on its way
    last = F.lit(2**63 - 1)
    when = F.coalesce(F.unix_micros(F.col("event_time").cast("timestamp")), last)
    change = F.concat_ws(",", when, F.coalesce("event_id", last), "attempt", "run_id", "status")
    packed = changes.select("document_id", "pipeline", change.alias("change"))
    states = packed.groupBy("document_id", "pipeline").applyInPandasWithState(step, "document_id long, pipeline string, memory string", RUN_MEMORY, "update", "NoTimeout")
    return states.select("document_id", "pipeline", *[F.split("memory", ",")[k].cast("long").alias(name) for k, name in enumerate(counts)])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without and gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return "file://" + tempfile.mkdtemp(prefix="vellumflow-stream-")


def collect_stream(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there and give its table, with the number of its batch. The rows go to a Parquet table in the shared folder.

    A batch that is run again overwrites what it wrote. In update mode latest() picks the last row of each key.
    """
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch_no={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").drop("batch_no")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of what a stream in update mode gave, the last row of each key."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("row")).select(*keys, "row.*")


def deliver(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = KEY, day: Column | None = None) -> None:
    """Append what is there of a stream to the event table at path, each event once, however often a broker or a restart repeats it.

    The table is partitioned by day and batch. A batch leaves out events that the table has under their key, looking only
    at its own days, and overwrites what an earlier run of the same batch wrote.
    """
    spark, writer = stream.sparkSession, uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
    day = F.to_date("event_time") if day is None else day

    def write(batch: DataFrame, number: int) -> None:
        name = f"{writer}-{number}"
        rows = batch.dropDuplicates(list(keys)).withColumn("day", day).withColumn("delivery", F.lit(name))
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):  # something was delivered before
            there = spark.read.schema(rows.schema).parquet(path).where(F.col("delivery") != name)
            days = rows.select("day").distinct()
            there = there.join(F.broadcast(days), "day", "left_semi")  # the days of one batch
            rows = rows.join(there.select(*keys), list(keys), "left_anti")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "delivery").parquet(path)

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
