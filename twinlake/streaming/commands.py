"""Stateful command application on a stream.

The state of one entity is its current row (fields, created/updated times).  The
rows of all live entities in one bucket of keys are the keyed state of
``applyInPandasWithState``, so a task folds a bucket's commands of a micro-batch at
once: in ``(key, ts, event_id)`` order with vectorised pandas operations (a running
"last setter" index per field, no per-row or per-key Python loop),
using the same rules as the batch ``operators.commands.fold``.  Output is one row
per command: its code and the entity state after it, from which the reply table
and the domain events are projected.

Skew: keyed state means one task per bucket per batch, which Structured Streaming
requires for any stateful operator (a key is never in two); batch replays of the whole log use the
skew-safe batch fold instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.commands import CREATE, DELETE, UPDATE

# The per-key functions below run in Python workers.  Pickle this module's
# functions by value so workers need numpy/pandas only, not this package on
# their path (executors of a cluster, or a driver started outside the repo).
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # older cloudpickle: ship the package instead
    pass


def _fold_pandas(pdf: pd.DataFrame, fields: list[str], st: tuple | None) -> tuple[pd.DataFrame, tuple]:
    pdf = pdf.sort_values(["ts", "event_id"], kind="mergesort").reset_index(drop=True)
    n = len(pdf)
    op = pdf["op"].to_numpy()
    live0 = bool(st[0]) if st is not None else False
    # liveness before each row: last create/delete strictly before, else the carried state
    cd = np.where(np.isin(op, [CREATE, DELETE]), np.arange(n), -1)
    last_cd = np.maximum.accumulate(cd)
    prev_cd = np.concatenate([[-1], last_cd[:-1]])
    live_before = np.where(prev_cd >= 0, op[np.clip(prev_cd, 0, None)] == CREATE, live0)
    code = np.where(op == CREATE, np.where(live_before, 400, 200), np.where(live_before, 200, 404))
    accepted = (code == 200) & np.isin(op, [CREATE, UPDATE, DELETE])
    live_after = np.where(op == CREATE, True, np.where(op == DELETE, False, live_before))
    out = {"event_id": pdf["event_id"].to_numpy(), "ts": pdf["ts"].to_numpy(dtype=object), "op": op, "code": code.astype("int32"),
           "accepted": accepted, "live_after": live_after}
    show = live_after | (accepted & (op == DELETE))
    carried = list(st[1:]) if st is not None else [None] * (len(fields) + 2)
    has_any = np.zeros(n, dtype=bool)
    new_state = [bool(live_after[-1]) if n else live0]
    for i, f in enumerate(fields):
        has = pdf[f"has_{f}"].to_numpy(dtype=bool)
        has_any |= has
        setter = accepted & ((op == CREATE) | ((op == UPDATE) & has))
        idx = np.maximum.accumulate(np.where(setter, np.arange(n), -1))
        vals = pdf[f].astype(object).where(pd.Series(has), None).to_numpy(dtype=object)
        cur = np.where(idx >= 0, vals[np.clip(idx, 0, None)], carried[i])
        out[f] = np.where(show, cur, None)
        new_state.append(cur[-1] if n else carried[i])
    ts = pdf["ts"].to_numpy(dtype=object)
    for j, (name, mask) in enumerate((("created_at", accepted & (op == CREATE)),
                                      ("updated_at", accepted & ((op == CREATE) | ((op == UPDATE) & has_any))))):
        idx = np.maximum.accumulate(np.where(mask, np.arange(n), -1))
        cur = np.where(idx >= 0, ts[np.clip(idx, 0, None)], carried[len(fields) + j])
        out[name] = np.where(show, cur, None)
        new_state.append(cur[-1] if n else carried[len(fields) + j])
    res = pd.DataFrame(out)
    for f in fields:
        res[f] = res[f].where(pd.notna(res[f]), None)
    return res, tuple(new_state)


#: Buckets of keys; fixed in a query's checkpoint.  A bucket's commands of a micro-batch and its live entities fit a task.
BUCKETS = 256
_KEY, _BUCKET = "key_text", "key_bucket"  # Spark renames columns with a leading underscore on their way to a processor


def bucketed(cmds: DataFrame, key: str, buckets: int) -> DataFrame:
    """The commands with their key as text behind "=" (a null key is the empty text) and its bucket."""
    return cmds.withColumn(_KEY, F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))).withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def pack(pdf: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(blob)).read_all().to_pandas(integer_object_nulls=True)


def fold_bucket(pdf: pd.DataFrame, fields: list[str], live: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame | None]:
    """``_fold_pandas`` over the commands of many keys (``_key``) and the table of their live entities (``_key``, fields, times);
    the judged commands and the live entities after them (``None``: no entity is live)."""
    codes, keys = pd.factorize(pdf[_KEY], use_na_sentinel=False)
    order = pdf.assign(_g=codes).sort_values(["_g", "ts", "event_id"], kind="mergesort")
    g, n = order["_g"].to_numpy(), len(order)
    op, at = order["op"].to_numpy(), np.arange(n)
    first = np.searchsorted(g, np.arange(len(keys)))  # where each key begins
    start = first[g]
    held = np.full(len(keys), -1)  # each key's row among the live entities
    if live is not None:
        held = pd.Index(live[_KEY], dtype=object).get_indexer(pd.Index(keys, dtype=object))

    def last(mask: np.ndarray) -> np.ndarray:
        """The last row of the same key up to each row where ``mask`` holds, or -1."""
        idx = np.maximum.accumulate(np.where(mask, at, -1))
        return np.where(idx >= start, idx, -1)

    last_cd = last(np.isin(op, [CREATE, DELETE]))
    prev = np.where(at > start, np.concatenate([[-1], last_cd[:-1]]), -1)
    live_before = np.where(prev >= 0, op[np.clip(prev, 0, None)] == CREATE, (held >= 0)[g])
    code = np.where(op == CREATE, np.where(live_before, 400, 200), np.where(live_before, 200, 404))
    accepted = (code == 200) & np.isin(op, [CREATE, UPDATE, DELETE])
    live_after = np.where(op == CREATE, True, np.where(op == DELETE, False, live_before))
    show = live_after | (accepted & (op == DELETE))
    out = {_KEY: order[_KEY].to_numpy(dtype=object), "event_id": order["event_id"].to_numpy(), "ts": order["ts"].to_numpy(), "op": op,
           "code": code.astype("int32"), "accepted": accepted, "live_after": live_after}
    end = np.concatenate([first[1:], [n]]) - 1
    left = live_after[end]
    state = {_KEY: np.asarray(keys, dtype=object)[left]}

    def carry(name: str, mask: np.ndarray, vals: np.ndarray, none) -> None:
        idx = last(mask)
        before = np.full(len(keys), none, dtype=vals.dtype)
        if live is not None:
            before[held >= 0] = live[name].to_numpy(dtype=vals.dtype)[held[held >= 0]]
        cur = np.where(idx >= 0, vals[np.clip(idx, 0, None)], before[g])
        out[name] = np.where(show, cur, none)
        state[name] = cur[end][left]

    has_any = np.zeros(n, dtype=bool)
    for f in fields:
        has = order[f"has_{f}"].to_numpy(dtype=bool)
        has_any |= has
        vals = order[f].astype(object)
        carry(f, accepted & ((op == CREATE) | ((op == UPDATE) & has)), vals.where(vals.notna() & has, None).to_numpy(dtype=object), None)
    ts = order["ts"].to_numpy(dtype="datetime64[ns]")
    carry("created_at", accepted & (op == CREATE), ts, np.datetime64("NaT", "ns"))
    carry("updated_at", accepted & ((op == CREATE) | ((op == UPDATE) & has_any)), ts, np.datetime64("NaT", "ns"))
    after = pd.DataFrame(state)
    if live is not None:
        after = pd.concat([live.drop(index=held[held >= 0]), after], ignore_index=True) if len(held[held >= 0]) < len(live) else after
    for f in fields:  # an Arrow null column becomes NaN
        after[f] = after[f].astype(object).where(after[f].notna(), None)
    return pd.DataFrame(out), (after if len(after) else None)


def _schema(fields: dict[str, str], late: str = "") -> str:
    return (f"{_KEY} string, event_id bigint, ts timestamp_ntz, op string, code int, accepted boolean, live_after boolean, "
            + "".join(f"{f} {t}, " for f, t in fields.items()) + "created_at timestamp_ntz, updated_at timestamp_ntz" + late)


def keyed_again(out: DataFrame, key: str, key_type: T.DataType) -> DataFrame:
    """The folded rows with the key itself in the place of its text."""
    return out.withColumn(_KEY, F.when(F.col(_KEY) != "", F.substr(F.col(_KEY), F.lit(2))).cast(key_type)).withColumnRenamed(_KEY, key)


def apply_commands(cmds: DataFrame, fields: dict[str, str], key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """Fold a command stream into per-entity state.

    ``cmds``: ``(event_id, ts, <key>, op, has_<f>..., <f>...)``.  Returns one row
    per command: ``<key>, event_id, ts, op, code, accepted, live_after, <f>..., created_at, updated_at``.
    """
    names = list(fields)

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        res, live = fold_bucket(pdf, names, unpack(state.get[0]) if state.exists else None)
        if live is not None:
            state.update((pack(live),))
        elif state.exists:
            # a deleted (or never created) entity carries nothing forward: absence from the
            # state already means "not live" and the next accepted command must be a create
            # that sets every field, so state stays bounded by the live entities
            state.remove()
        yield res

    out = bucketed(cmds, key, buckets).groupBy(_BUCKET).applyInPandasWithState(step, _schema(fields), "live binary", "append", "NoTimeout")
    return keyed_again(out, key, cmds.schema[key].dataType)


def apply_commands_tws(cmds: DataFrame, fields: dict[str, str], key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """T3 on the newer arbitrary-state API (``transformWithStateInPandas``): the same
    fold, with the live entity rows of a bucket kept in a ``ValueState``.  Needs the RocksDB
    state store provider (``spark.sql.streaming.stateStore.providerClass``)."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    names = list(fields)

    class EntityProcessor(StatefulProcessor):
        def init(self, handle) -> None:
            self.entities = handle.getValueState("entities", "live binary")

        def handleInputRows(self, k, rows, timerValues) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(list(rows), ignore_index=True)
            res, live = fold_bucket(pdf, names, unpack(self.entities.get()[0]) if self.entities.exists() else None)
            if live is not None:
                self.entities.update((pack(live),))
            else:
                self.entities.clear()  # only live entities keep state (see apply_commands)
            yield res

        def close(self) -> None:
            pass

    out = bucketed(cmds, key, buckets).groupBy(_BUCKET).transformWithStateInPandas(EntityProcessor(), _schema(fields), "Append", "None")
    return keyed_again(out, key, cmds.schema[key].dataType)


def dedupe_messages(records: DataFrame, id_col: str = "event_id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop replayed messages; state is kept only within the watermark delay.

    Watermarks need an instant type, so a TIMESTAMP_NTZ event time is watermarked
    through a UTC ``timestamp`` twin column that is dropped afterwards."""
    wm = "_wm_" + ts
    out = (records.withColumn(wm, F.col(ts).cast("timestamp")).withWatermark(wm, delay)
           .dropDuplicatesWithinWatermark([id_col]))
    return out.drop(wm)


def events_from_applied(applied: DataFrame, entity: str = "author", key: str = "id",
                        fields: tuple[str, ...] = ("value", "props")) -> DataFrame:
    """T4: domain events of the accepted writes (same shape as the batch K12)."""
    op = F.col("op")
    etype = F.concat(F.lit(entity + "."), F.when(op == CREATE, "created").when(op == UPDATE, "updated")
                     .otherwise("deleted"))
    is_del = op == DELETE
    return applied.filter("accepted").select(
        "event_id", etype.alias("event_type"), key, *[F.when(~is_del, F.col(f)).alias(f) for f in fields],
        F.when(~is_del, F.col("updated_at")).alias("updated_at"), F.col("ts").alias("occurred_at"))


def reply_sink(root: str):
    """``foreachBatch`` writer of reply rows, idempotent per batch id (a replayed
    batch overwrites its own directory and nothing else)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch_id}")
    return write
