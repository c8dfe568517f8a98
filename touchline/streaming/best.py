"""The best detection of each key on a stream, once no better one can come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def best_seen(det: DataFrame, keys: list[str], at: str, conf: str, line: str, late: str = "10 seconds") -> DataFrame:
    """Of each key's rows the one of the highest confidence, the first by `line` on ties. On a batch that is one group-by; on a stream a row is given when the watermark passes its key's time.

    `at` is a key's time: rows of a key share it, or are at most `late` apart. The state holds one row for each key that is still open; its timer gives the row and clears the state.
    A null confidence loses to any other.
    """
    worth = F.coalesce(F.col(conf), F.lit(float("-inf")))
    rows = det.withColumn(at, F.col(at).cast("timestamp"))
    if not rows.isStreaming:
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(worth, -F.col(line))).alias("_m")).select(*keys, "_m.*").select(*rows.columns)
    schema = rows.schema
    names = schema.names

    class Best(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.best = handle.getValueState("best", schema)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            kept = self.best.get() if self.best.exists() else None
            open_ = kept is not None
            place = lambda r: (-(r[names.index(conf)] if r[names.index(conf)] is not None and r[names.index(conf)] == r[names.index(conf)] else float("-inf")), r[names.index(line)])
            for pdf in rows:
                for r in pdf[names].astype(object).where(pdf[names].notna(), None).itertuples(index=False, name=None):
                    if kept is None or place(r) < place(kept):
                        kept = r
            self.best.update(tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in kept))
            if not open_:
                when = pd.Timestamp(kept[names.index(at)])
                self.handle.registerTimer(int(when.tz_localize("UTC").timestamp() * 1000) if when.tzinfo is None else int(when.timestamp() * 1000))
            yield pd.DataFrame(columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            r = self.best.get()
            self.best.clear()
            yield pd.DataFrame([r], columns=names)

        def close(self) -> None:
            pass

    out = rows.withWatermark(at, late).groupBy(*keys)
    return out.transformWithStateInPandas(Best(), schema, "append", "EventTime")
