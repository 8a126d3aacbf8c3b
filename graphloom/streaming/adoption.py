"""Verdicts on result records as they arrive, with what was adopted kept as state of the stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

#: The state store that arbitrary state needs; set it on the session before the stream starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstOfKey(StatefulProcessor):
    """Of a key's records the first is adopted and all others are skipped, in this batch and those to come."""

    def __init__(self, order: list[str]) -> None:
        self._order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._adopted = handle.getValueState("adopted", "adopted boolean")

    def _before(self, row: Row) -> tuple:
        return tuple((row[c] is not None, row[c]) if row[c] is not None else (False,) for c in self._order)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        adopted, first = self._adopted.exists(), None
        for row in rows:  # one record is held, however many the key has
            if not adopted and (first is None or self._before(row) < self._before(first)):
                row, first = first, row
            if row is not None:
                yield Row(**row.asDict(), verdict="skip")
        if first is not None:
            self._adopted.update((True,))
            yield Row(**first.asDict(), verdict="adopt")

    def close(self) -> None:
        pass


def verdicts(records: DataFrame, n_nulls: int, order: list[str]) -> DataFrame:
    """The stream ``records`` (null_id, ok and others) with ``verdict``: bad_id, reject, adopt or skip.

    Of a key's good records the first to arrive is adopted, within a batch the first by ``order`` (nulls first); later
    ones are skipped, whether repeated, late or out of order.  A record that fails leaves its key open.  The state is a flag
    for each adopted key; the table of what was adopted is never read.  Records without a valid id and failed ones need no
    state and aren't shuffled, so many of them under one key meet in no task.
    """
    bad = F.col("null_id").isNull() | (F.col("null_id") < 0) | (F.col("null_id") >= n_nulls)
    good = ~bad & F.coalesce("ok", F.lit(False))
    schema = StructType([*records.schema.fields, StructField("verdict", StringType())])
    kept = records.where(good).groupBy("null_id").transformWithState(_FirstOfKey(order), schema, "Append", "None")
    return kept.unionByName(records.where(~good).withColumn("verdict", F.when(bad, "bad_id").otherwise("reject")))


def adopt(records: DataFrame, path: str, checkpoint: str, n_nulls: int, order: list[str]) -> StreamingQuery:
    """Write all available ``records`` with their ``verdicts`` to a Parquet table by verdict; a rerun takes only what is new."""
    out = verdicts(records, n_nulls, order).writeStream.format("parquet").partitionBy("verdict").outputMode("append")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
