"""Incidents kept up by a stream: each micro-batch is a run of operators.incidents.

Two versions of the state stand in the folder and take turns: batch k reads one and replaces the other, so a
batch that is repeated after a failure finds the state it started from. Incidents that expire are
written under the number of the batch, which a repeat replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import incidents
from ..operators.incidents import MATCH_HOURS, SCHEMAS, WINDOW_HOURS, State


def stored(spark: SparkSession, folder: str, batch: int) -> State:
    """The state that batch starts from; the one after the last batch is stored(spark, folder, last + 1)."""
    if batch == 0:
        return incidents.empty(spark)
    return State(*(spark.read.schema(schema).parquet(f"{folder}/version={batch % 2}/{name}") for name, schema in SCHEMAS.items()))


def fold_batch(rows: DataFrame, batch: int, folder: str, window_hours: int = WINDOW_HOURS, match_hours: int = MATCH_HOURS) -> None:
    """One run over a micro-batch, as of its newest row; a batch without any only carries the state on."""
    spark = rows.sparkSession
    newest = rows.agg(F.max("at").alias("m")).first()["m"]
    state, gone = stored(spark, folder, batch), None
    if newest is not None:
        state, gone = incidents.extend(state, rows, F.lit(newest).cast("timestamp"), window_hours, match_hours)
    for name, table in zip(SCHEMAS, state):
        table.write.mode("overwrite").parquet(f"{folder}/version={(batch + 1) % 2}/{name}")
    if gone is not None:
        incidents.told(gone).write.mode("overwrite").parquet(f"{folder}/expired/batch={batch}")


def start(stream: DataFrame, folder: str, checkpoint: str, **hours: int) -> StreamingQuery:
    """A stream of detections (id, at, lat, lng, power, tier) folded into the state in folder, which all executors share."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, batch: fold_batch(rows, batch, folder, **hours)).start()
