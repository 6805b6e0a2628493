"""The event-time prefix over a stream: for each impression what was known of its key when it came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pit import CELL_MS, prefix_sums

STATE = "k {kind}, n long, pos long"


def batch_prefix(batch: DataFrame, state: DataFrame | None) -> DataFrame:
    """row_id, prior_n, prior_pos of a batch (k, row_id, y, t): counts of the state and of the batch's rows before it by (t, row_id).

    A hot key of the batch is ordered in cells of time; a null key is a key, a null label counts as 0.
    """
    minute = F.floor((F.unix_millis("t") if dict(batch.dtypes)["t"] == "timestamp" else F.col("t").cast("long")) / CELL_MS).cast("long")
    rows = prefix_sums(batch, ["k"], {"prior_n": F.lit(1).cast("long"), "prior_pos": F.coalesce("y", F.lit(0)).cast("long")}, ("t", "row_id"), minute)
    if state is None:
        return rows.select("row_id", "prior_n", "prior_pos")
    held = state.select(F.col("k").alias("_k"), "n", "pos")
    both = rows.join(held, F.col("k").eqNullSafe(F.col("_k")), "left")
    return both.select("row_id", *[(F.col(f"prior_{c}") + F.coalesce(c, F.lit(0))).cast("long").alias(f"prior_{c}") for c in ("n", "pos")])


def next_state(batch: DataFrame, state: DataFrame | None) -> DataFrame:
    """k, n, pos of all rows so far."""
    new = batch.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.coalesce("y", F.lit(0))).cast("long").alias("pos"))
    return new if state is None else new.unionByName(state).groupBy("k").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def start_prefix(stream: DataFrame, key: str, label: str, time_column: str, path: str, **trigger) -> StreamingQuery:
    """Starts a query that writes row_id, prior_n, prior_pos of each row of a stream to ``path``/rows, a folder for each batch.

    The state, two numbers for each key, is a table for each batch, ``path``/state. A batch that is run
    again after a failure reads the state before it and replaces what it wrote, so each row is counted
    once. Rows of a batch are taken in order of (event time, row_id); a row that comes in a later batch
    than one it precedes sees that one as earlier.
    """
    rows = stream.select(F.col(key).alias("k"), "row_id", F.col(label).cast("long").alias("y"), F.col(time_column).alias("t"))
    schema = STATE.format(kind=rows.schema["k"].dataType.simpleString())

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(schema).parquet(f"{path}/state/v{number - 1}") if number else None
        batch_prefix(batch, state).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        next_state(batch, state).write.mode("overwrite").parquet(f"{path}/state/v{number}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
