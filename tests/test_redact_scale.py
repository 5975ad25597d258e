"""Deep redaction: records are dealt to all cores, and nested secrets are cut out at any depth."""

import json

from pyspark.sql import functions as F

from twinlake.functions import redact as G
from twinlake.plans.queries import QUERIES

from .conftest import SF_SMALL


def test_records_are_dealt_to_all_cores(spark):
    assert QUERIES["redact_deep"](spark, SF_SMALL).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(x, top=True):
    if isinstance(x, list):
        return [without(e, False) for e in x]
    if isinstance(x, dict):
        return {k: G.CENSOR if v is not None and (k in G.ANY_DEPTH or (top and k in G.TOP_LEVEL_ONLY)) else without(v, False) for k, v in x.items()}
    return x


def test_many_nested_secrets_at_many_depths(spark):
    deep = {"z": 1}
    for i in range(40):
        deep = {"a": [deep, {"token": {"password": [{"q": "]}"}]}}], "buffer": [i] if i % 3 else None, "n": "x\"{[\\"}
    texts = [json.dumps(deep), json.dumps([deep, {"password": {}}, {"token": []}]), json.dumps({"imageBase64": [[], {}], "tail": {"token": 1}}), "no json {"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    got = [r["r"] for r in rows.select("n", G.redact_json(F.col("t")).alias("r")).orderBy("n").collect()]
    assert [json.loads(r) for r in got[:3]] == [without(json.loads(t)) for t in texts[:3]] and got[3] == texts[3]
