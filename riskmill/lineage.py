"""Reliable checkpoints for data that later steps read many times, and jobs that run at the same time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Their stored rows share the executors' memory, so only a few pieces of work run at once.
AT_ONCE = 3
Item, Result = TypeVar("Item"), TypeVar("Result")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by the session; a single process without one gets a folder in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.split("[")[0] == "local":
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and read them from there from now on; survives lost executors."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def side_by_side(work: Callable[[Item], Result], items: Sequence[Item]) -> list[Result]:
    """What ``work`` gives for each item, in their order. Up to three run at once, so that the jobs of one fill the cores
    that the others leave idle; they must not write to the same place."""
    if len(items) < 2:
        return [work(item) for item in items]
    passing_on = inheritable_thread_target(SparkSession.active())
    calls = [passing_on(lambda item=item: work(item)) for item in items]
    with ThreadPool(min(AT_ONCE, len(calls))) as pool:
        return pool.map(lambda call: call(), calls, chunksize=1)
