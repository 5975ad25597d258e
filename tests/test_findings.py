"""Cases that an earlier release got wrong: file layouts of streams, late changes, stored rows, typed envelopes."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.functions import envelope as E
from twinlake.operators import commands as K
from twinlake.operators import drift, integrity
from twinlake.plans.queries import QUERIES, REPLY_TIMEOUT_SECONDS
from twinlake.sources import fixtures as fx
from twinlake.sources.tables import ForeignKey, Tables, publish_snapshot, read_snapshot
from twinlake.streaming import cdc, replies, twins

from .conftest import SF_SMALL


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


LAYOUTS = {"one": lambda df, ts: df.repartition(1), "spread": lambda df, ts: df.repartition(8), "ranged": lambda df, ts: df.repartitionByRange(8, ts)}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_streams_do_not_depend_on_the_file_layout(spark, layout):
    t, deal = Tables(spark, SF_SMALL), LAYOUTS[layout]
    got = twins.applied_run(spark, deal(fx.commands(t), "ts")).select("event_id", "id", "op", "code")
    assert rows(got) == rows(QUERIES["cmd_status"](spark, SF_SMALL).select(*got.columns))
    got = twins.timeout_run(spark, deal(fx.requests(t), "ts"), deal(fx.replies(t), "rts"), REPLY_TIMEOUT_SECONDS)
    assert rows(got) == rows(replies.correlate(fx.requests(t), fx.replies(t), REPLY_TIMEOUT_SECONDS))
    events = QUERIES["domain_events"](spark, SF_SMALL)
    got = twins.dedupe_run(spark, deal(events.unionByName(events), "occurred_at"))
    assert rows(got.select("event_id")) == rows(events.select("event_id").distinct())


def test_late_change_in_a_later_batch_does_not_win(spark, tmp_root):
    row = "struct<id:int,v:string>"
    publish_snapshot(spark.createDataFrame([(1, "first"), (2, "x")], "id int, v string"), tmp_root, "t")
    apply = cdc.cdc_sink(tmp_root, "t", ["id"])
    for n, (seq, v) in enumerate([(5, "new"), (3, "old"), (5, "new")]):
        apply(spark.createDataFrame([(1, seq, "upsert", (1, v))], f"id int, seq int, op string, row {row}"), n)
        assert rows(read_snapshot(spark, tmp_root, "t").select("id", "v")) == [(1, "new"), (2, "x")]
    apply(spark.createDataFrame([(1, 6, "delete", None)], f"id int, seq int, op string, row {row}"), 9)
    apply(spark.createDataFrame([(1, 4, "upsert", (1, "older"))], f"id int, seq int, op string, row {row}"), 10)
    assert rows(read_snapshot(spark, tmp_root, "t").select("id", "v")) == [(2, "x")]


def test_commands_see_stored_rows(spark):
    people, books = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(7,), (8,)], "id int")
    cmds = spark.createDataFrame([(1, 1, 7), (2, 1, 8), (3, 1, 8)], "ts int, author_id int, book_id int")
    links = spark.createDataFrame([(1, 7), (1, 7)], "author_id int, book_id int")
    out = K.assign(cmds, people, books, ["ts"], existing_links=links)
    assert rows(out.select("ts", "code")) == [(1, 409), (2, 200), (3, 409)]
    creates = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "ts int, isbn string")
    stored = spark.createDataFrame([("a",), (None,)], "isbn string")
    assert rows(K.create_unique(creates, "isbn", ["ts"], existing=stored).select("ts", "code")) == [(1, 400), (2, 200), (3, 400), (4, 200)]


def test_uncastable_column_is_left_to_the_copy(spark):
    df = spark.createDataFrame([(True, 1)], "a boolean, b int")
    target = T.StructType([T.StructField("a", T.DateType()), T.StructField("b", T.IntegerType())])
    assert rows(drift.align(df, target, strict=False)) == [(None, 1)]


def test_tables_that_reference_each_other_are_cleaned_to_a_fixpoint(spark):
    a = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, b int")
    b = spark.createDataFrame([(10, 1), (20, 99), (30, 2)], "id int, a int")
    fks = {"a": [ForeignKey("fa", ("b",), "b", ("id",))], "b": [ForeignKey("fb", ("a",), "a", ("id",))]}
    out = integrity.fk_cleanup_chain({"a": a, "b": b}, fks, materialize=False, keys={"a": "id", "b": "id"})
    assert rows(out["a"]) == sorted([(1, 10), (3, None)], key=str) and rows(out["b"]) == [(10, 1)]


def test_composite_reference_is_reported_whole(spark):
    child = spark.createDataFrame([(1, 5, 6)], "id int, x int, y int")
    parent = spark.createDataFrame([(5, 7)], "p int, q int")
    out = integrity.fk_orphan_report(child, {"p": parent}, [ForeignKey("f", ("x", "y"), "p", ("p", "q"))], ["id"])
    assert rows(out) == [("f", 1, '{"x":5,"y":6}')]


def test_inbound_replies_of_odd_shapes(spark):
    cases = [('{"success":true,"data":null}', (True, None, None, None)),
             ('{"success":false,"error":{"code":{"a":1},"message":"0"}}', (False, 400, "0", None)),
             ('{"success":false,"error":{"code":99999999999}}', (False, 400, E.DEFAULT_MESSAGE, None)),
             ('{"success":false,"error":{"code":0,"message":""},"statusCode":409,"message":"m"}', (False, 409, "m", None)),
             ('{"success":false,"error":{"code":"0"}}', (False, 400, E.DEFAULT_MESSAGE, None))]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, t string")
    got = [tuple(r["d"]) for r in df.select("i", E.decode_inbound(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_error_details_keep_their_types(spark):
    df = spark.createDataFrame([('{"message":"m","statusCode":400,"retry":3,"fields":["a"]}',), ('{"message":"m"}',)], "t string")
    got = [r[0] for r in df.select(E.error_details(F.col("t"))).collect()]
    assert got == ['{"retry":3,"fields":["a"]}', None]


def one(spark, text, *cols):
    return tuple(spark.createDataFrame([(text,)], "t string").select(*cols).first())


def test_redaction_keeps_undeclared_and_null_fields(spark):
    from twinlake.functions import redact as G
    cases = {'{"a":1,"level":null,"password":"x","other":{"z":1}}': '{"a":1,"level":null,"other":{"z":1},"password":"[REDACTED]"}',
             '{"password":null,"image":{"x":1},"deep":{"image":1,"l":[{"token":{"a":1}},[{"buffer":2}],"s"]}}':
                 '{"deep":{"image":1,"l":[{"token":"[REDACTED]"},[{"buffer":"[REDACTED]"}],"s"]},"image":"[REDACTED]","password":null}',
             '{"req":{"headers":{"authorization":"b","host":"h"}},"headers":{"authorization":"k"}}':
                 '{"headers":{"authorization":"k"},"req":{"headers":{"authorization":"[REDACTED]","host":"h"}}}',
             "plain text": "plain text", "[]": "[]", "{}": "{}"}
    for text, want in cases.items():
        assert one(spark, text, G.redact_json(F.col("t")))[0] == want
    for depth in (12, 100):
        deep = '{"a":[' * depth + '{"kept":1,"token":%s}' + "]}" * depth
        for secret in ('"hidden"', "12", "true", '{"x":[{"hidden":"]}"}],"y":"{"}', '[[],{"token":{}}]', "[]"):
            assert one(spark, deep % secret, G.redact_json(F.col("t")))[0] == deep % '"[REDACTED]"'
        assert one(spark, deep % "null", G.redact_json(F.col("t")))[0] == deep % "null"
    quoted = r'{"msg":"say {\"token\":\"x\"} and ,\"password\":[1","path":"c:\\","token":"a\"b\\"}'
    assert one(spark, quoted, G.redact_json(F.col("t")))[0] == quoted.replace(r'"a\"b\\"', '"[REDACTED]"')
    rest = '"list":["password","token"],%s"text":"' + r'\\\"{' * 50_000 + '"}'
    long = '"buffer":"' + r'ab\n\"' * 50_000 + '",' + rest % ""
    assert one(spark, "{" + long, G.redact_json(F.col("t")))[0] == '{"buffer":"[REDACTED]",' + rest % ""
    assert one(spark, '{"password":{},' + long, G.redact_json(F.col("t")))[0] == '{"buffer":"[REDACTED]",' + rest % '"password":"[REDACTED]",'
    assert one(spark, None, G.redact_json(F.col("t")))[0] is None


def test_replies_keep_json_types_and_wrapped_errors(spark):
    at = F.lit("2024-01-01").cast("timestamp_ntz")

    def result(text):
        r = one(spark, text, E.normalise_result(F.col("t"), at).alias("r"))[0]
        return r["kind"], r["success"], r["data"], r["meta"], r["error"]

    stamp = '"timestamp":"2024-01-01T00:00:00.000Z"'
    assert result('{"data":"abc","meta":{"page":2}}') == ("unwrapped", True, '"abc"', '{"page":2,' + stamp + "}", None)
    assert result('{"success":false,"error":{"code":409}}') == ("wrapped", False, None, None, '{"code":409}')
    assert result('{"data":1,"meta":{"timestamp":"own"}}')[3] == '{"timestamp":"own"}'
    assert result(None) == ("empty", True, "true", "{" + stamp + "}", None)
    message = E.normalise_error_message(F.col("t"), F.lit("own"))
    for text, want in {'{"message":["a","b"]}': "a; b", '{"message":{"x":1}}': '{"x":1}', '{"message":""}': "",
                       '{"message":null}': "own", "{}": "own", '{"message":5}': "5", "no json": "own"}.items():
        assert one(spark, text, message)[0] == want
    assert one(spark, '{"success":false,"error":{"details":{"b":[1],"a":"x"}}}', E.inbound_details(F.col("t")))[0] == '{"a":"x","b":[1]}'
    assert one(spark, '{"success":false,"error":{"details":{}}}', E.inbound_details(F.col("t")))[0] is None


def test_messages_are_judged_by_json_type(spark):
    from twinlake.functions import validate as V
    cases = [("book.create", '{"title":5}', ["title must be a string", "title must be longer than or equal to 3 characters"]),
             ("book.getAll", '{"page":"2","limit":100}', ["page must be an integer number", "page must not be less than 1"]),
             ("author.getAll", '{"page":"2","limit":"101"}', ["limit must not be greater than 100"]),
             ("authorBook.unassign", "{}", ["id must be a UUID", "id should not be empty"]),
             ("author.delete", "no json", ["id must be a UUID"]), ("author.delete", None, ["id must be a UUID"]),
             ("unknown", "{}", [])]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, topic string, payload string")
    df = df.select("i", "topic", F.try_parse_json("payload").alias("m"))
    got = [list(r["v"]) for r in df.select("i", V.topic_violations(F.col("topic"), F.col("m")).alias("v")).orderBy("i").collect()]
    assert got == [w for _, _, w in cases]


def test_pair_may_be_assigned_again_after_unassign(spark):
    ops = ["assign", "assign", "unassign", "unassign", "assign"]
    cmds = spark.createDataFrame([(i, 1, 1, op) for i, op in enumerate(ops)] + [(9, 2, 1, "unassign"), (10, 2, 1, "assign"), (11, 7, 1, "assign")],
                                 "n int, author_id int, book_id int, op string")
    authors, books = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1,)], "id int")
    stored = spark.createDataFrame([(2, 1), (2, 1)], "author_id int, book_id int")
    out = K.assignment_log(cmds, authors, books, ["n"], existing_links=stored)
    assert [r["code"] for r in out.orderBy("n").collect()] == [200, 409, 200, 404, 200, 200, 200, 404]
    assert K.assignment_events(out, at="n").filter("event_type = 'authorBook.deleted'").count() == 2


def test_segments_grow_with_the_input(spark, monkeypatch):
    from twinlake.operators import scan
    cmd, least = fx.commands(Tables(spark, SF_SMALL)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scan.segment_count(cmd) == least
    monkeypatch.setattr(scan, "SEGMENT_BYTES", max(1, scan.input_bytes(cmd) // 50))
    assert 50 <= scan.segment_count(cmd) <= 52
    assert scan.segment_count(spark.createDataFrame([(1,)], "i int")) == least  # size unknown


def test_tables_are_found_by_listing(spark):
    from twinlake.sources.inventory import table_names
    assert table_names(spark, SF_SMALL) == sorted(Tables(spark, SF_SMALL).names())
    assert "pages" not in table_names(spark, SF_SMALL, exclude=("pages",))
