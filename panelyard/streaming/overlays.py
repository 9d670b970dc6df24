"""The drawdown overlay on a stream of months: each series carries its state from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from panelyard.plans.overlay import METHODS, MONTH, ROW, Path, Series, row_schema


class _Follow(StatefulProcessor):
    """One value a series: what plans.overlay.Series needs of the months so far."""

    def __init__(self, keys: list[str], methods: tuple[str, ...], cost: float, threshold: float):
        self.keys, self.methods, self.cost, self.threshold = keys, methods, cost, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002  Spark's names
        series = Series.from_json(self.state.get()[0]) if self.state.exists() else Series({m: Path() for m in self.methods})
        months = pd.concat(list(rows))[MONTH].drop_duplicates("month_id").sort_values("month_id")
        made = []
        for month in months.to_dict("records"):
            if series.month is None or month["month_id"] > series.month:  # months that come again are known already
                made += series.follow(month | {"month_id": int(month["month_id"])}, self.cost, self.threshold)
        self.state.update((series.to_json(),))
        if made:
            out = pd.DataFrame(made, columns=[name for name, _ in ROW])
            for name, value in reversed(list(zip(self.keys, key, strict=True))):
                out.insert(0, name, value)
            yield out

    def close(self) -> None:
        pass


def overlays(stream: DataFrame, keys: list[str], methods: tuple[str, ...] = tuple(METHODS), cost_bps: float = 25.0, threshold: float = 0.02) -> DataFrame:
    """plans.overlay.overlays() of a stream, month by month as they come.

    Months of a series must come in order over the batches; inside a batch they may come in any order. A month that
    is not after the last one of its series is left out, so a batch that is sent again changes nothing. The rows are
    those of the whole table at once. Needs the RocksDB state store.
    """
    rows = stream.select(*keys, F.col("month_id").cast("int").alias("month_id"), *[F.col(c).cast("double").alias(c) for c in MONTH[1:]])
    follow = _Follow(keys, methods, cost_bps / 10_000, threshold)
    return rows.groupBy(*keys).transformWithStateInPandas(follow, row_schema(rows, keys), outputMode="Append", timeMode="None")
