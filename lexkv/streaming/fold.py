"""Continuous state of a log, and feeds of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexkv.operators import log as log_ops

#: Chunks of a level that are merged into one of the next.
MERGE = 10
LOG = "seq long, op string, key string, value string, number long"


def read_log_stream(spark: SparkSession, path: str, schema: str = LOG, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def fold_stream(log: DataFrame, root: str, checkpoint: str, every: int = MERGE):
    """Keep the state of a log of sets, deletes, adds, sequence commands and truncates below root, tombstones included.

    Each micro-batch writes the fold of its own rows as a chunk of level 0; every
    so many chunks of a level are merged into one of the next. So a row is
    written again once a level, not each time that the state is merged. A batch
    that runs again overwrites its own files, so each command counts once.
    Returns the query's starter.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        done = epoch + 1
        log_ops.carried(batch.filter("op is not null")).write.mode("overwrite").parquet(_chunk(root, 0, done))
        level = 1
        while done % every**level == 0:
            parts = [_chunk(root, level - 1, done - k * every ** (level - 1)) for k in range(every)]
            log_ops.carried(batch.sparkSession.read.parquet(*parts)).write.mode("overwrite").parquet(_chunk(root, level, done))
            level += 1

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _chunk(root: str, level: int, upto: int) -> str:
    """The fold of the last every^level micro-batches of the first `upto`."""
    return f"{root}/level={level}/upto={upto}"


def chunks(root: str, version: int, every: int = MERGE) -> list[str]:
    """The fewest chunks that make up the micro-batches 0 to version: under `every` a level."""
    done, level, paths = version + 1, 0, []
    while done:
        size = every**level
        over = done % (size * every)
        paths += [_chunk(root, level, done - k * size) for k in range(over // size)]
        done, level = done - over, level + 1
    return paths


def folded(spark: SparkSession, root: str, version: int, every: int = MERGE) -> DataFrame:
    """Live (key, value) at a version (micro-batch) that fold_stream wrote with the same `every`."""
    return log_ops.folded_state(log_ops.carried(spark.read.parquet(*chunks(root, version, every))))


def change_feed(versions: DataFrame, seen: int) -> DataFrame:
    """Changes newer than the version a reader has seen; works on tables and streams."""
    return versions.filter(F.col("version") > seen)
