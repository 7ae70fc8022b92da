"""Streams of evidence that move ratings, and of actions that use up limits."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kgeo.operators.reasoning import act, orient


def evidence_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files of events as a stream of evidence."""
    ts = F.col("ts").cast("timestamp")
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.select(F.col("user_id").alias("relation_id"), (F.col("event_type") != "error").alias("is_valid"), F.least(F.lit(1.0), F.col("value") / 500).alias("signal"), ts.alias("validated_at"))


def windowed_signal(evidence: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Signed mean signal and count per relation and tumbling window; rows later than ``late`` are left out by the watermark."""
    signed = F.when(F.col("is_valid"), F.col("signal")).otherwise(-F.col("signal"))
    return evidence.withWatermark("validated_at", late).groupBy(F.window("validated_at", length), "relation_id").agg(F.count("*").alias("n"), F.avg(signed).alias("mean_signal"))


def feedback_loop(evidence: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, now, interval: str | None = None):
    """Orient on each micro-batch and act on the stored ratings: ``read`` gives them, ``write`` gets the new ones with the
    batch's number, by which a repeated batch can be told. Without ``interval`` all that is there is taken once."""

    def batch(rows: DataFrame, number: int) -> None:
        write(act(read(), orient(rows, now)), number)

    writer = evidence.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


LIMIT_STATE = "hour_start double, hour_n long, day_start double, day_n long"
DECISION = "user_id long, event_id long, allowed boolean"


def exact_limits(events: DataFrame, per_hour: int, per_day: int) -> DataFrame:
    """Per event whether its user may act. The hour and the day begin with the user's first action after the last ones ended."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hour, in_hour, day, in_day = state.get if state.exists else (float("-inf"), 0, float("-inf"), 0)
        rows = pd.concat([*batches]).sort_values(["ts", "event_id"])
        out = []
        for event, at in zip(rows["event_id"], rows["ts"].astype("int64") / 1e9 if rows["ts"].dtype != "float64" else rows["ts"], strict=True):
            if at >= hour + 3600:
                hour, in_hour = at, 0
            if at >= day + 86400:
                day, in_day = at, 0
            ok = in_hour < per_hour and in_day < per_day
            in_hour, in_day = in_hour + ok, in_day + ok
            out.append((key[0], event, ok))
        state.update((hour, in_hour, day, in_day))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    one = events.select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("ts"))
    return one.groupBy("user_id").applyInPandasWithState(decide, DECISION, LIMIT_STATE, "append", GroupStateTimeout.NoTimeout)
