"""Event-time ordered command fold on a stream, with late rows accounted for.

Commands may arrive in any order.  Each is buffered in the state of its bucket of keys and folded when the
watermark says that nothing older is to come:

* the buffer is cut into time slots; a slot's rows lie in parts of at most ``CHUNK`` rows, so adding rows never
  rewrites what is stored;
* an event-time timer at the end of a slot fires once the watermark has passed it; the bucket's slots that are due are
  then sorted by ``(ts, event_id)``, one or a few small ones at a time, and folded in chunks of ``CHUNK`` rows with
  carried state, by the rules of the batch fold;
* a row that arrives when the watermark has passed its slot is late: it is not folded but comes out at once,
  marked ``late``.  Every input row comes out exactly once, folded or late.

Spark's own filter would drop late rows unseen.  It looks at the watermark column of the operator's input, so the
watermark is set on a copy of the time column that is dropped again: the watermark still advances and timers
still fire, and late rows reach the operator.

State: live entities and the buffered rows of the last ``delay`` + one slot.  A bucket's slot must fit a task: choose
``slot`` and ``buckets`` for the busiest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commands import _BUCKET, BUCKETS, _schema, bucketed, fold_bucket, keyed_again, pack, unpack

# Worker functions are pickled by value, as in ``commands``: workers need numpy, pandas and pyarrow only.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):
    pass

#: Rows of one stored part and of one folding step.
CHUNK = 50_000


def with_event_clock(rows: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Advance the stream's watermark by ``ts`` without letting Spark drop rows behind it."""
    return rows.withColumn("_wm", F.col(ts).cast("timestamp")).withWatermark("_wm", delay).drop("_wm")


def ordered_commands(cmds: DataFrame, fields: dict[str, str], key: str = "id", delay: str = "1 hour", slot_ms: int = 3_600_000,
                     chunk: int = CHUNK, buckets: int = BUCKETS) -> DataFrame:
    """Fold a command stream in event time.

    ``cmds``: ``(event_id, ts, <key>, op, has_<f>..., <f>...)`` in any order.  One row a command: ``<key>, event_id, ts, op,
    code, accepted, live_after, <f>..., created_at, updated_at, late``; of late rows only key, id, time and op are set.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    names = list(fields)
    out_schema = _schema(fields, ", late boolean")
    columns = [f.name for f in T._parse_datatype_string(out_schema).fields]

    class OrderedFold(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.entities = handle.getValueState("entities", "live binary")
            self.slots = handle.getMapState("slots", "slot bigint", "parts int, filled int")
            self.parts = handle.getMapState("parts", "slot bigint, part int", "rows binary")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            for pdf in rows:
                ms = pdf["ts"].to_numpy().astype("datetime64[ms]").astype("int64")
                slot = ms // slot_ms
                late = (slot + 1) * slot_ms <= now
                if late.any():
                    yield self._late(pdf[late])
                for s, part in pdf[~late].groupby(slot[~late]):
                    self._keep(int(s), part)

        def _keep(self, slot: int, pdf: pd.DataFrame) -> None:
            """Add rows to the slot: to its last part while that has room, else as new parts."""
            parts, filled = self.slots.getValue((slot,)) if self.slots.containsKey((slot,)) else (0, chunk)
            if filled + len(pdf) <= chunk and parts:
                pdf = pd.concat([unpack(self.parts.getValue((slot, parts - 1))[0]), pdf], ignore_index=True)
                parts -= 1
            elif not parts:
                self.handle.registerTimer((slot + 1) * slot_ms)
            for a in range(0, len(pdf), chunk):
                piece = pdf.iloc[a: a + chunk]
                self.parts.updateValue((slot, parts), (pack(piece),))
                parts, filled = parts + 1, len(piece)
            self.slots.updateValue((slot,), (parts, filled))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            """Fold all slots that the watermark has passed, small ones together; their own timers then find nothing."""
            slot = expiredTimerInfo.getExpiryTimeInMs() // slot_ms - 1
            if not self.slots.containsKey((slot,)):
                return
            now = timerValues.getCurrentWatermarkInMs()
            due = sorted((int(k[0]), int(v[0])) for k, v in self.slots.iterator() if (int(k[0]) + 1) * slot_ms <= now)
            live = unpack(self.entities.get()[0]) if self.entities.exists() else None
            held, rows = [], 0
            for i, (s, parts) in enumerate(due):
                for p in range(parts):
                    held.append(unpack(self.parts.getValue((s, p))[0]))
                    rows += len(held[-1])
                    self.parts.removeKey((s, p))
                self.slots.removeKey((s,))
                if rows >= chunk or i == len(due) - 1:
                    pdf = pd.concat(held, ignore_index=True).sort_values(["ts", "event_id"], kind="mergesort")
                    for a in range(0, len(pdf), chunk):
                        res, live = fold_bucket(pdf.iloc[a: a + chunk], names, live)
                        res["late"] = False
                        yield res[columns]
                    held, rows = [], 0
            if live is not None:
                self.entities.update((pack(live),))
            else:
                self.entities.clear()

        def _late(self, pdf: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame({c: pd.Series([None] * len(pdf), dtype=object) for c in columns})
            for c in (columns[0], "event_id", "ts", "op"):
                out[c] = pdf[c].to_numpy()
            out["late"] = True
            return out

        def close(self) -> None:
            pass

    out = with_event_clock(bucketed(cmds, key, buckets), "ts", delay).groupBy(_BUCKET).transformWithStateInPandas(OrderedFold(), out_schema, "Append", "EventTime")
    return keyed_again(out, key, cmds.schema[key].dataType)


def split_sink(applied_root: str, late_root: str):
    """``foreachBatch`` writer: folded rows to one table, late rows to another; idempotent by batch (a batch run again
    overwrites its own directories only)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            batch.filter(~F.col("late")).drop("late").write.mode("overwrite").parquet(f"{applied_root.rstrip('/')}/batch={batch_id}")
            batch.filter("late").select("event_id", "ts", "op", batch.columns[0]).write.mode("overwrite").parquet(f"{late_root.rstrip('/')}/batch={batch_id}")
        finally:
            batch.unpersist()
    return write
