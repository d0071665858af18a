"""The operational metrics as Structured Streaming queries over event files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, glob: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_latency(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum and maximum of each type in tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total_ms"), F.max("value").alias("max_ms"))


def sliding_error_ratio(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    n, bad = F.count("*"), F.count_if(F.col("event_type") == "error")
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(n.alias("requests"), bad.alias("errors"), (bad / n).alias("ratio"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and value of each user's sessions."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there to Parquet files and stop; a rerun goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def last_costs(events: DataFrame, keep: int = 1000) -> DataFrame:
    """Count, total, mean and last of the newest ``keep`` values of each type, anew for each
    type that a batch holds rows of. The state of a type is its ``keep`` newest rows, so late
    rows take the place that is theirs."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(("ts", "event_id", "value"), state.get))) if state.exists else None
        for pdf in batches:
            rows = pdf[["ts", "event_id", "value"]].assign(ts=pdf["ts"].astype("datetime64[us]").astype("int64"))
            held = rows if held is None else pd.concat([held, rows])
            held = held.sort_values(["ts", "event_id"]).tail(keep)
        state.update((held["ts"].tolist(), held["event_id"].tolist(), held["value"].tolist()))
        value = held["value"]
        yield pd.DataFrame({"event_type": [key[0]], "n": [len(value)], "total": [value.sum()], "avg": [value.mean()], "last": [value.iloc[-1]]})

    return events.select("event_type", "ts", "event_id", "value").groupBy("event_type").applyInPandasWithState(update, "event_type string, n long, total double, avg double, last double", "ts array<long>, event_id array<long>, value array<double>", "update", GroupStateTimeout.NoTimeout)
