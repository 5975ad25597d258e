"""The event-time fold: any arrival order gives the batch fold; late rows are counted, not lost."""

import datetime as dt
import random

from pyspark.sql import functions as F

from twinlake.operators import commands as K
from twinlake.streaming import twins

CMD = "event_id bigint, ts timestamp_ntz, id bigint, op string, has_value boolean, has_props boolean, value double, props string, arrived timestamp_ntz"
BASE = dt.datetime(2024, 1, 1)
STATE = ("event_id", "id", "op", "code", "value", "props", "created_at", "updated_at")


def commands(seed, n, arrives):
    rng, rows = random.Random(seed), []
    for i in range(n):
        ts = BASE + dt.timedelta(minutes=rng.randint(0, 600))  # many equal times
        key = rng.choice([1, 1, 1, 2, 3])  # a hot key
        rows.append((i, ts, key, rng.choice(["create", "update", "delete", "get"]), rng.random() < 0.6, rng.random() < 0.6, rng.choice([None, float(i)]),
                     rng.choice([None, f"p{i}"]), arrives(rng, ts)))
    return rows


def as_set(df):
    return {tuple(r[c] for c in STATE) for r in df.collect()}


def test_random_order_equals_the_batch_fold(spark):
    cmd = spark.createDataFrame(commands(3, 240, lambda rng, ts: BASE + dt.timedelta(minutes=rng.randint(0, 900))), CMD)
    applied, late = twins.ordered_run(spark, cmd, "arrived", delay="20 hours", slot_ms=3_600_000, chunks=3, files=3, chunk=7)
    assert late.count() == 0
    assert as_set(applied) == as_set(K.fold(cmd.drop("arrived")))


def test_late_rows_come_out_and_the_rest_is_folded_without_them(spark):
    def arrives(rng, ts):
        return ts + dt.timedelta(days=30) if ts < BASE + dt.timedelta(hours=3) and rng.random() < 0.3 else ts

    rows = commands(5, 200, arrives)
    cmd = spark.createDataFrame(rows, CMD).coalesce(1)  # one file a chunk
    applied, late = twins.ordered_run(spark, cmd, "arrived", delay="4 hours", slot_ms=1_800_000, chunks=6)
    behind = {r[0] for r in rows if r[8] - r[1] > dt.timedelta(days=1)}
    assert behind and {r["event_id"] for r in late.collect()} == behind
    assert applied.count() + late.count() == len(rows)
    assert as_set(applied) == as_set(K.fold(cmd.filter(~F.col("event_id").isin(list(behind))).drop("arrived")))


def test_bucket_fold_equals_the_fold_of_each_key_with_carried_state(spark):
    import numpy as np
    import pandas as pd

    from twinlake.streaming import commands as C
    rows = commands(9, 400, lambda rng, ts: ts)
    pdf = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in CMD.split(", ")]).drop(columns="arrived")
    pdf["id"] = pdf["id"] * 7 + pdf["event_id"] % 5
    halves, live, got, state, want = np.array_split(pdf.sort_values(["ts", "event_id"]), 3), None, [], {}, []
    for part in halves:
        res, live = C.fold_bucket(part.assign(**{C._KEY: part["id"].astype(str)}).sample(frac=1, random_state=1), ["value", "props"], live)
        live = None if live is None else C.unpack(C.pack(live))
        got.append(res)
        for k, g in part.groupby("id"):
            res, state[k] = C._fold_pandas(g, ["value", "props"], state.get(k))
            want.append(res)
    plain = lambda d: {tuple(None if pd.isna(v) else v for v in r) for r in pd.concat(d)[["event_id", "code", "accepted", "live_after", "value", "props", "created_at", "updated_at"]].itertuples(index=False)}
    assert len(pd.concat(got)) == len(rows) and plain(got) == plain(want)
    assert set(live[C._KEY]) == {str(k) for k, s in state.items() if s[0]}


def test_micro_batches_do_not_grow_with_the_number_of_files(spark, tmp_root):
    spark.range(400).repartition(40).write.parquet(f"{tmp_root}/in")
    assert twins.files_per_batch(spark, f"{tmp_root}/in") == 5 and twins.files_per_batch(spark, f"{tmp_root}/in", batches=2) == 20
    assert twins.files_per_batch(spark, f"{tmp_root}/none") == twins.FILES_PER_BATCH


def test_commands_without_key_are_one_entity(spark):
    rows = [(i, BASE + dt.timedelta(minutes=7 * i), None if i % 3 else 1, ["create", "update", "delete", "update"][i % 4], True, True, float(i), None,
             BASE + dt.timedelta(minutes=7 * i)) for i in range(60)]
    cmd = spark.createDataFrame(rows, CMD)
    applied, late = twins.ordered_run(spark, cmd, "arrived", delay="20 minutes", slot_ms=600_000, chunks=3, chunk=9)
    one = K.fold(cmd.drop("arrived").na.fill({"id": -1}))  # null as one key of its own
    assert late.count() == 0 and applied.filter("id IS NULL").count() == 40
    assert as_set(applied.na.fill({"id": -1})) == as_set(one)
