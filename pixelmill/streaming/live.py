"""The corpus report over results that keep arriving."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_report(results: DataFrame, event_time: str = "made_at", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Totals by window and category of a stream (or a table) of results: made_at, category, status, score.

    The watermark bounds the state: a window is final once it is ``late`` behind.
    """
    rows = results.withWatermark(event_time, late) if results.isStreaming else results
    grouped = rows.groupBy(F.window(event_time, window).alias("w"), "category")
    totals = grouped.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("passed"), F.avg("score").alias("mean_score"))
    return totals.select("w.start", "w.end", "category", "total", "passed", "mean_score")


_ATTEMPT = ["attempt", "expected", "found", "n_errors"]


def _rank(row: tuple) -> tuple:
    """The larger the better: a pass, the earlier one of passes; else found * 100 - errors * 10, the earlier one of equals."""
    attempt, expected, found, errors = row
    passed = found == expected and errors == 0
    return (passed, 0 if passed else found * 100 - errors * 10, -attempt)


def best_so_far(attempts: DataFrame, key: str = "state", late: str | None = None, event_time: str = "made_at") -> DataFrame:
    """(key, attempt, expected, found, n_errors, closed) whenever a state's best attempt changes, or without ``late`` may have: an ``update`` stream.

    The state kept for a key is one attempt, however many arrive and in whatever order. With ``late`` a key is closed, and its
    state dropped, once the watermark has passed its last attempt: a last row says so; what comes later begins anew. Without it keys stay.
    """
    if not late:  # nothing is timed out, so Spark's own streaming aggregation keeps the best row of a key
        passed = F.expr("found = expected AND n_errors = 0")
        rank = F.struct(passed.alias("p"), F.when(passed, 0).otherwise(F.expr("found * 100 - n_errors * 10")).alias("s"), (-F.col("attempt")).alias("a"))
        return attempts.groupBy(key).agg(F.max_by(F.struct(*_ATTEMPT), rank).alias("v")).select(key, "v.*", F.lit(False).alias("closed"))
    kinds = dict(attempts.dtypes)
    columns = ", ".join(f"{c} {kinds[c]}" for c in _ATTEMPT)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*group, *before, True)], columns=[key, *_ATTEMPT, "closed"])
            return
        best, last = before, None
        for batch in batches:
            for row in batch[_ATTEMPT].itertuples(index=False, name=None):
                row = tuple(int(v) for v in row)
                if best is None or _rank(row) > _rank(best):
                    best = row
            newest = batch[event_time].max()
            last = newest if last is None else max(last, newest)
        if best != before:
            state.update(best)
            yield pd.DataFrame([(*group, *best, False)], columns=[key, *_ATTEMPT, "closed"])
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    rows = attempts.withWatermark(event_time, late)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {columns}, closed boolean", columns, "update", GroupStateTimeout.EventTimeTimeout)


def run_to_table(updates: DataFrame, path: str) -> DataFrame:
    """An ``update`` stream run over all that is there, and its last row of each first column.

    Each batch is a folder under ``path`` that a repeated batch writes again, so a restart changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    key = updates.columns[0]
    updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    spark = updates.sparkSession
    written = spark.read.schema(T.StructType([*updates.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    last = written.groupBy(key).agg(F.max_by(F.struct(*updates.columns[1:]), "batch").alias("v"))
    return last.select(key, "v.*")
