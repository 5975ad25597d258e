"""The three command-fold implementations agree on random logs: the skew-safe
segmented scan (any segment count), the plain per-key window, and the pandas
fold the streaming operator runs per key."""

from datetime import datetime, timedelta

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from twinlake.operators import commands as K
from twinlake.streaming.commands import _fold_pandas

SCHEMA = ("event_id long, ts timestamp_ntz, id long, op string, has_value boolean, has_props boolean, "
          "value double, props string")
OUT = ["event_id", "id", "code", "accepted", "live_after", "value", "props", "created_at", "updated_at"]

command = st.tuples(
    st.integers(0, 3),                                        # entity id (few ids: long per-key runs)
    st.sampled_from(["create", "update", "delete", "get"]),
    st.booleans(), st.booleans(),
    st.one_of(st.none(), st.floats(0, 100, allow_nan=False).map(lambda x: round(x, 2))),
    st.one_of(st.none(), st.sampled_from(["a", "b", "c"])),
    st.integers(0, 3),                                        # timestamp bucket: ties broken by event_id
)


def norm(rows):
    def n(v):
        return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v
    return sorted(tuple(n(x) for x in r) for r in rows)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(command, min_size=1, max_size=40), st.integers(1, 9))
def test_fold_implementations_agree(spark, log, segments):
    base = datetime(2024, 1, 1)
    data = [(i, base + timedelta(minutes=b), k, op, hv, hp, v, p) for i, (k, op, hv, hp, v, p, b) in enumerate(log)]
    df = spark.createDataFrame(data, SCHEMA)
    a = K.fold(df, skew_safe=True, segments=segments).select(*OUT).collect()
    b = K.fold(df, skew_safe=False).select(*OUT).collect()
    assert norm(a) == norm(b)
    pdf = pd.DataFrame(data, columns=["event_id", "ts", "id", "op", "has_value", "has_props", "value", "props"])
    rows = []
    for k, g in pdf.groupby("id"):
        res, _ = _fold_pandas(g, ["value", "props"], None)
        res.insert(0, "id", k)
        for r in res.itertuples(index=False):
            d = r._asdict()
            rows.append(tuple(d[c].to_pydatetime() if hasattr(d[c], "to_pydatetime") else
                              (d[c].item() if hasattr(d[c], "item") else d[c]) for c in OUT))
    assert norm(a) == norm(rows)
