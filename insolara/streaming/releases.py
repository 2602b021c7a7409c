"""New release files in, line protocol out.

Each micro-batch parses the files that arrived, drops hours already seen for a
release, predicts, and appends the text lines. The checkpoint folder carries
the state across restarts. :func:`first_run` keeps the hours of each release as
state instead, and tells those from the start to the first gap as it closes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from insolara.functions.columns import PARITY_KELVIN_OFFSET, kelvin_to_celsius
from insolara.functions.timecol import LOCAL_ZONE, epoch_micros_utc
from insolara.sinks.text import line_protocol
from insolara.sources.releases import VALUE_LINE, release_columns


def release_stream(spark: SparkSession, folder: str, value_line: int = VALUE_LINE, late: str = "2 days",
                   offset: float = PARITY_KELVIN_OFFSET, files_per_batch: int = 1000) -> DataFrame:
    """``release, valid, dt, temp`` of every file that arrives, once per release and hour."""
    files = (spark.readStream.format("text").option("wholetext", True)
             .option("maxFilesPerTrigger", files_per_batch).load(folder)
             .select(F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_modification_time").alias("modified"),
                     F.col("value").alias("content")))
    parsed = release_columns(files, value_line).where(F.col("kelvin").isNotNull())
    timed = parsed.withColumn("valid", F.col("dt").cast("timestamp"))
    fresh = timed.withWatermark("valid", late).dropDuplicatesWithinWatermark(["release", "dt"])
    return fresh.select("release", "valid", "dt", kelvin_to_celsius(F.col("kelvin"), offset).alias("temp"))


def stream_forecast(stream: DataFrame, predict: Callable[[DataFrame], DataFrame], column: str, measurement: str,
                    path: str, checkpoint: str, zone: str = LOCAL_ZONE, **trigger: object) -> StreamingQuery:
    """Predict on every micro-batch and write its lines to a folder of its own, so a replay overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        lines = line_protocol(predict(batch), measurement, column, zone=zone)
        lines.write.mode("overwrite").text(f"{path.rstrip('/')}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


_STATE = "hour array<int>, modified array<bigint>, kelvin array<double>, told array<double>, version bigint"


def first_run(stream: DataFrame, start: str, hours: int = 24, late: str = "2 days", keep_ms: int = 172_800_000) -> DataFrame:
    """``release, hour, kelvin, version`` of a stream of (release, dt, kelvin, modified), in update mode.

    The state of a release is the newest value of each of its ``hours`` hours from ``start`` (naive UTC). A
    batch tells the hours from the start to the first gap that are new or have changed; of one hour the row
    with the largest ``version`` holds. A later file replaces an earlier one, the larger value wins a tie. The
    state of a release is dropped ``keep_ms`` after its last hour, by the watermark over valid hours.
    """
    origin = epoch_micros_utc(F.lit(start).cast("timestamp_ntz"))
    hour = F.floor((epoch_micros_utc(F.col("dt")) - origin) / F.lit(3_600_000_000)).cast("int")
    timed = (stream.where(F.col("kelvin").isNotNull() & F.col("release").isNotNull())
             .select("release", hour.alias("hour"), F.col("kelvin").cast("double").alias("kelvin"),
                     F.unix_micros(F.col("modified").cast("timestamp")).alias("modified"),
                     F.col("dt").cast("timestamp").alias("valid"))
             .where(F.col("hour").between(0, hours - 1)).withWatermark("valid", late))
    end_ms = int(pd.Timestamp(start).timestamp() * 1000) + hours * 3_600_000 + keep_ms

    def tell(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: dict[int, tuple[int, float]] = {}
        told: list[float] = []
        version = 0
        if state.exists:
            known, modified, kelvin, told, version = state.get
            held = {h: (m, v) for h, m, v in zip(known, modified, kelvin)}
        for rows in batches:
            newest = rows.sort_values(["hour", "modified", "kelvin"]).drop_duplicates("hour", keep="last")
            for h, m, v in zip(newest["hour"].tolist(), newest["modified"].tolist(), newest["kelvin"].tolist()):
                held[h] = max(held.get(h, (m, v)), (m, v))
        run = next(h for h in range(hours + 1) if h not in held)
        fresh = [h for h in range(run) if h >= len(told) or told[h] != held[h][1]]
        state.update((list(held), [m for m, _ in held.values()], [v for _, v in held.values()],
                      [held[h][1] for h in range(run)], version + 1))
        state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))
        if fresh:
            yield pd.DataFrame({"release": key[0], "hour": fresh, "kelvin": [held[h][1] for h in fresh], "version": version + 1})

    return timed.groupBy("release").applyInPandasWithState(
        tell, "release bigint, hour int, kelvin double, version bigint", _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def stream_first_runs(told: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Writes every batch of :func:`first_run` to a folder of its own, so a replay overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return (told.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def told_hours(spark: SparkSession, path: str, start: str, offset: float = PARITY_KELVIN_OFFSET) -> DataFrame:
    """``release, dt, temp`` of what a stream of first runs has told so far."""
    rows = spark.read.schema("release bigint, hour int, kelvin double, version bigint").parquet(f"{path.rstrip('/')}/batch=*")
    last = rows.groupBy("release", "hour").agg(F.max_by("kelvin", "version").alias("kelvin"))
    at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour"))
    return last.select("release", at.alias("dt"), kelvin_to_celsius(F.col("kelvin"), offset).alias("temp"))
