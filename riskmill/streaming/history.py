"""Destination history carried across micro-batches in Spark's state store, one state per destination.

A destination's state is what its rows so far add up to, and the totals of its latest steps, from which the 24-hour
values come. A batch touches the state of its own destinations only; nothing that earlier batches wrote is read again. The
state store is RocksDB: states live on the executors' disks, their changes in the checkpoint folder, from which a lost
executor's part is restored. A batch that is retried starts from the states before it.

Rows are processed on arrival: inside a batch in the order of (step, row_id), and a row that comes late sees what had
arrived by then. Steps stay in the state for ``late_hours`` beyond the 24 hours; a row that is later still finds
fewer 24-hour totals, while its prior counts stay complete.

Destinations are dealt into ``BUCKETS`` groups by a hash: a call of the processor takes the batch's rows of a bucket, as
frames and answers for every single destination would cost far more than its rows. Rows of one bucket in one batch meet in
one task, so a batch, which ``maxFilesPerTrigger`` bounds, bounds what a hot destination brings at once. A destination's state
is two numbers and a list of steps, however many rows it has. A checkpoint belongs to its number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from riskmill.functions.numeric import exact
from riskmill.operators.history import history_features
from riskmill.params import VELOCITY_HOURS

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
# Steps that stay beyond the window, for rows that come late.
LATE_HOURS = 7 * 24

STATE_DDL = "seen_rows long, seen_total decimal(38,6), steps array<long>, step_rows array<long>, step_totals array<decimal(38,6)>"
OUTPUT_DDL = ("row_id long, step long, nameDest string, amount double, prior_rows long, prior_total decimal(38,6), "
              "recent_rows long, recent_total decimal(38,6)")
OUTPUT_COLUMNS = [field.split()[0] for field in OUTPUT_DDL.split(", ")]
NONE = Decimal(0)
# Also the most tasks that can share a batch.
BUCKETS = 512


class Past:
    """What a destination's rows so far add up to."""

    def __init__(self, seen_rows: int = 0, seen_total: Decimal = NONE, steps: dict[int, tuple[int, Decimal]] | None = None):
        self.seen_rows, self.seen_total, self.steps = seen_rows, seen_total, dict(steps or {})

    @classmethod
    def stored(cls, value: tuple | None) -> Past:
        if value is None:
            return cls()
        rows, total, steps, step_rows, step_totals = value
        return cls(rows, total, dict(zip(steps, zip(step_rows, step_totals))))

    def value(self) -> tuple:
        steps = sorted(self.steps)
        return self.seen_rows, self.seen_total, steps, [self.steps[s][0] for s in steps], [self.steps[s][1] for s in steps]

    def recent(self, step: int) -> tuple[int, Decimal]:
        """Rows and total of the 24 steps before this one."""
        found = [self.steps[s] for s in range(step - VELOCITY_HOURS, step) if s in self.steps]
        return sum(n for n, _ in found), sum((t for _, t in found), NONE)

    def take(self, rows: Iterator[tuple[int, int, float, Decimal]]) -> Iterator[tuple]:
        """Each row (step, row_id, amount, exact amount) in order with what came before it; it is added then."""
        # Rows of a step don't see each other in the 24-hour values, so one look back serves the whole step.
        step, back = None, (0, NONE)
        for at, row_id, amount, value in rows:
            if at != step:
                step, back = at, self.recent(at)
            yield row_id, at, amount, self.seen_rows, self.seen_total, *back
            n, total = self.steps.get(at, (0, NONE))
            self.steps[at] = (n + 1, total + value)
            self.seen_rows += 1
            self.seen_total += value

    def forget(self, late_hours: int) -> None:
        if self.steps:
            oldest = max(self.steps) - VELOCITY_HOURS - late_hours
            self.steps = {step: sums for step, sums in self.steps.items() if step >= oldest}


class DestinationHistory(StatefulProcessor):
    """The destinations of one bucket; each has its own entry in the bucket's map."""

    def __init__(self, late_hours: int):
        self.late_hours = late_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("pasts", "nameDest string", STATE_DDL)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """One look at the state and one update for all rows of a destination in the batch."""
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["nameDest", "step", "row_id"])
        names = batch["nameDest"].astype(object).where(batch["nameDest"].notna(), None).tolist()
        values = zip(names, *(batch[column].tolist() for column in ("step", "row_id", "amount", "value")))
        made = []
        for name, its_rows in groupby(values, itemgetter(0)):
            entry = (name,)
            past = Past.stored(self.state.getValue(entry))
            made.extend((*row, name) for row in past.take(row[1:] for row in its_rows))
            past.forget(self.late_hours)
            self.state.updateValue(entry, past.value())
        yield pd.DataFrame(made, columns=["row_id", "step", "amount", "prior_rows", "prior_total", "recent_rows", "recent_total",
                                          "nameDest"])[OUTPUT_COLUMNS]

    def close(self) -> None:
        pass


def with_carried_history(transactions: DataFrame, late_hours: int = LATE_HOURS) -> DataFrame:
    """A stream of (row_id, step, nameDest, amount) rows with the four history values of each."""
    rows = transactions.select("row_id", "step", "nameDest", "amount", exact("amount").alias("value"),
                               F.pmod(F.xxhash64("nameDest"), F.lit(BUCKETS)).alias("bucket"))
    carried = rows.groupBy("bucket").transformWithStateInPandas(DestinationHistory(late_hours), OUTPUT_DDL, "Append", "None")
    made = history_features()
    return carried.select("row_id", "step", "nameDest", "amount", *[made[name].alias(name) for name in (
        "dest_prior_txn_count", "dest_prior_avg_amount", "dest_txn_count_24h", "dest_amount_sum_24h")])


def start_history(transactions: DataFrame, root: str, late_hours: int = LATE_HOURS) -> StreamingQuery:
    """Append the history of all rows that have arrived to ``root/history``; the state is kept in ``root/checkpoint``.

    Starting again with the same folder goes on where the last run stopped.
    """
    conf = transactions.sparkSession.conf
    before = conf.get(STORE_SETTING)
    conf.set(STORE_SETTING, ROCKS_DB)
    try:
        return with_carried_history(transactions, late_hours).writeStream.format("parquet").outputMode("append") \
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/history")
    finally:
        conf.set(STORE_SETTING, before)
