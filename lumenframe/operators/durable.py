"""Lineage cuts that survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a few longs that one task may as well take; more tasks only make more files.
ROWS_A_TASK = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a temporary one only in local mode, where all tasks share the machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lumenframe-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder; later failures restart from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_TASK))


def gathered(df: DataFrame) -> DataFrame:
    """cut(df), read by no more tasks than its rows need: each shuffle after it writes files for each of them, however few its rows."""
    made = cut(df)
    return made.coalesce(tasks_for(made.count()))


def keep(df: DataFrame, distinct: tuple[str, ...] = ()) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read from there: more compact than a checkpoint, columns can be pruned.

    distinct: columns whose values hardly repeat, as digests; no dictionary is tried for them.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in distinct}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
