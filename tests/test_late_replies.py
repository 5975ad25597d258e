"""Every request is answered or timed out, every reply answers or is late."""

import datetime as dt
import random

from twinlake.streaming import replies, twins

BASE = dt.datetime(2024, 1, 1)


def logs(spark, n=120):
    rng = random.Random(4)
    req = [(i, BASE + dt.timedelta(seconds=rng.randint(0, 5000))) for i in range(n)]
    rep = [(i, t + dt.timedelta(seconds=rng.choice([0, 3, 10, 11, 40]))) for i, t in req if i % 5] + [(1000 + i, BASE) for i in range(3)]
    return (spark.createDataFrame(req, "event_id long, ts timestamp_ntz"), spark.createDataFrame(rep, "event_id long, rts timestamp_ntz"),
            {i for i, t in req for j, u in rep if i == j and u - t <= dt.timedelta(seconds=10)})


def test_batch_and_stream_account_for_every_row(spark):
    req, rep, quick = logs(spark)
    want = {tuple(r) for r in replies.account(req, rep, 10).collect()}
    assert {r[0] for r in want if r[1] == 200} == quick
    assert len([r for r in want if r[1] == 200]) + len([r for r in want if r[1] == 503]) == req.count()
    assert len([r for r in want if r[1] == 200]) + len([r for r in want if r[4]]) == rep.count()
    rows, dropped = twins.accounted_run(spark, req, rep, 10, lateness="2 hours", chunks=2)
    assert {tuple(r) for r in rows.collect()} == want and dropped == 0
