"""What one row or one key could stop: nested escapes, repeated notice lines, a hot labelled id, long words."""

import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from twinlake.llm import licenses, secret_scan, token_count, toxicity

from .helpers import frame


@pytest.mark.parametrize("text,depth", [("%" + "25" * 3000 + "41", 3001), ("\\u005c" + "u005c" * 1500, 1501), ("&#38;" + "#38;" * 1500, 1501)])
def test_a_chain_of_escapes_takes_little_time_and_memory(text, depth):
    tracemalloc.start()
    begin = time.perf_counter()
    *_, layers, refused = secret_scan.scan(text + " token=abcdefgh")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert layers >= depth - 1 and refused == 0
    assert time.perf_counter() - begin < 60 and peak < 30 << 20


def test_spans_through_nested_escapes_map_to_the_text():
    text = 'say "pass%2577ord" : "h\\u0075nter22xyz" ok'
    assert (5, 0, 39) not in secret_scan.base_scan(text)
    _, spans, _, _ = secret_scan.scan(text)
    whole = [(a, b) for a, k, b in spans if k == 0]
    assert any(text[a:b].startswith("pass%2577ord") and text[a:b].endswith("nter22xyz") for a, b in whole)


def test_repeated_notice_lines_are_linear():
    table = licenses.Templates(licenses.TEMPLATES, licenses.DICE)
    for unit in ("All rights reserved.\n", "the software\n", "All rights reserved.\nthe foo software is\n"):
        begin = time.perf_counter()
        table.scan(unit * 4000)
        assert time.perf_counter() - begin < 20
    assert [m[:3] for m in table.scan("All rights reserved.\n" * 3)] == [(a, a + 20, "all-rights-reserved") for a in (0, 21, 42)]


def test_a_hot_labelled_id_gives_one_training_row(spark):
    docs = frame(spark, [(1, f"text {i}", "en", "s", 1) for i in range(300)] + [(i, f"own {i}", "en", "s", 1) for i in range(2, 400)])
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 400)], "doc_id long, toxic int")
    assert not toxicity.training_rows(docs, marks, 1000).filter(F.col("text").isNull()).count()
    rows = [r["text"] for r in toxicity.training_rows(docs, marks, 50).collect()]
    assert len(rows) == 50
    every = [r["text"] for r in toxicity.training_rows(docs, marks, 1000).collect()]
    assert sum(t.startswith("text") for t in every) <= 1


def test_long_words_are_not_remembered():
    known = token_count.Counts(token_count.Automaton([bytes([c]) for c in range(256)] + [b" a", b"bc"]))
    n = known[b"x" * 5000]
    assert n == known[b"x" * 5000] and b"x" * 5000 not in known
    assert known[b"ab"] and b"ab" in known
    words = toxicity.Matcher(["idiot"])
    assert not words["y" * 100] and "y" * 100 not in words and words["idiot"] == (0,)
