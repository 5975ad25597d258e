"""Parents as of the request, and unique values over their holders' lives, against a loop over the log."""

import random

import pytest
from pyspark.sql import functions as F

from twinlake.operators import asof as A
from twinlake.operators import unique as U


def links_by_loop(events, authors, books, links):
    """events: (n, kind, op, a, b) in order; the code of each request and the links left."""
    live = {"author": set(authors), "book": set(books)}
    have = {(a, b): None for a, b in links if a in live["author"] and b in live["book"]}
    codes = {}
    for n, kind, op, a, b in sorted(events):
        if kind != "link":
            ref, side = (a, 0) if kind == "author" else (b, 1)
            (live[kind].add if op == "create" else live[kind].discard)(ref)
            if op == "delete":
                have = {p: at for p, at in have.items() if p[side] != ref}
        elif op == "unassign":
            codes[n] = 200 if (a, b) in have else 404
            have.pop((a, b), None)
        elif a not in live["author"] or b not in live["book"]:
            codes[n] = 404
        elif (a, b) in have:
            codes[n] = 409
        else:
            codes[n] = 200
            have[a, b] = n
    return codes, have


@pytest.mark.parametrize("seed", [1, 2])
def test_assignments_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    events = []
    for n in range(400):
        a, b = rng.choice([1, 1, 1, 2, 3, None]), rng.choice([7, 7, 8, 9])  # one author has half of all rows
        kind = rng.choice(["link", "link", "link", "author", "book"])
        events.append((n, kind, rng.choice(["assign", "assign", "unassign"] if kind == "link" else ["create", "delete", "create"]), a, b))
    events = [e for e in events if not (e[1] != "link" and e[3] is None)]
    authors, books, links = [1, 3], [7, 8], [(1, 7), (2, 8), (3, 9), (3, 8)]
    want, left = links_by_loop(events, authors, books, links)
    requests = spark.createDataFrame([(op, a, b, n) for n, k, op, a, b in events if k == "link"], "op string, author_id long, book_id long, n long")
    lives = [spark.createDataFrame([(e[i], e[2], e[0]) for e in events if e[1] == k], f"{c} long, op string, n long")
             for k, i, c in (("author", 3, "author_id"), ("book", 4, "book_id"))]
    stored = {"authors": spark.createDataFrame([(a,) for a in authors], "author_id long"), "books": spark.createDataFrame([(b,) for b in books], "book_id long"),
              "links": spark.createDataFrame(links, "author_id long, book_id long")}
    judged = A.assignments_asof(requests, *lives, ["n"], **stored, segments=5)
    assert {r["n"]: r["code"] for r in judged.collect()} == want
    after = A.links_after(judged, *lives, ["n"], **stored).collect()
    assert {(r["author_id"], r["book_id"]): r["at"] and r["at"]["n"] for r in after} == left


def test_requests_without_stored_rows_or_lives(spark):
    none = [spark.createDataFrame([], f"{c} long, op string, n long") for c in ("author_id", "book_id")]
    requests = spark.createDataFrame([("assign", 1, 2, 0), ("unassign", 1, 2, 1)], "op string, author_id long, book_id long, n long")
    got = A.assignments_asof(requests, *none, ["n"]).orderBy("n").collect()
    assert [r["code"] for r in got] == [404, 404]
    assert got[0]["message"] == "Author with ID 1 not found."


def unique_by_loop(log, stored):
    held, codes = dict(stored), {}  # id -> value
    for n, op, i, has, v in sorted(log):
        taken = v is not None and any(x == v and j != i for j, x in held.items())
        if op == "create":
            codes[n] = 400 if i in held or taken else 200
            if codes[n] == 200:
                held[i] = v if has else None
        elif i not in held:
            codes[n] = 404
        elif op == "delete":
            codes[n] = 200
            del held[i]
        elif op == "update":
            codes[n] = 400 if has and taken else 200
            if codes[n] == 200 and has:
                held[i] = v
        else:
            codes[n] = 200
    return codes


@pytest.mark.parametrize("seed,values", [(1, 4), (3, 40)])
def test_unique_values_equal_a_loop(spark, seed, values):
    rng = random.Random(seed)
    log = [(n, rng.choice(["create", "create", "update", "delete", "get"]), rng.choice([0, 0, 0, *range(15)]), True, rng.choice([None, *[f"v{k}" for k in range(values)]])) for n in range(300)]
    log = [(n, op, i, op == "create" or rng.random() < 0.6, v) for n, op, i, _, v in log]
    stored = [(3, "v0"), (4, None), (99, "v1")]
    want = unique_by_loop(log, stored)
    cmds = spark.createDataFrame(log, "n long, op string, id long, has boolean, v string")
    got, rounds = U.judge_unique(cmds, "v", ["n"], has="has", stored=spark.createDataFrame(stored, "id long, v string"), segments=4)
    assert {r["n"]: r["code"] for r in got.collect()} == want
    assert 1 <= rounds < 60


def test_one_value_wanted_by_all_settles_in_few_rounds(spark):
    cmds = spark.createDataFrame([(n, "create", n, "same") for n in range(200)] + [(500, "delete", 0, None), (501, "create", 900, "same")], "n long, op string, id long, v string")
    got, rounds = U.judge_unique(cmds, "v", ["n"], segments=4)
    rows = {r["n"]: (r["code"], r["message"]) for r in got.collect()}
    assert rows[0] == (200, None) and rows[501] == (200, None) and rows[500] == (200, None)
    assert all(rows[n] == (400, "Book with ISBN same already exists") for n in range(1, 200)) and rounds <= 4


def test_scarce_values_take_few_rounds_and_equal_a_loop(spark):
    rng = random.Random(5)
    log = [(n, rng.choice(["create", "create", "update", "delete", "get"]), rng.randrange(40), True, rng.choice([None, *range(8)])) for n in range(900)]
    log = [(n, op, i, op == "create" or rng.random() < 0.7, v) for n, op, i, _, v in log]
    log += [(n + 900, op, i + 100, has, None if v is None else v + 100) for n, op, i, has, v in log[:300]]  # ids and values of their own
    stored = [(3, 0), (4, None), (20, 7), (99, 1)]
    cmds = spark.createDataFrame(log, "n long, op string, id long, has boolean, v long")
    holders = spark.createDataFrame(stored, "id long, v long")
    want = unique_by_loop(log, stored)
    for id_type, value_type in (("long", "long"), ("string", "decimal(9,2)")):  # the second goes by JSON
        typed = [d.withColumn("id", F.col("id").cast(id_type)).withColumn("v", F.col("v").cast(value_type)) for d in (cmds, holders)]
        got, rounds = U.judge_unique(typed[0], "v", ["n"], has="has", stored=typed[1], segments=4)
        assert {r["n"]: r["code"] for r in got.collect()} == want
        assert rounds <= 6
    got, rounds = U.judge_unique(cmds, "v", ["n"], has="has", segments=4)
    assert {r["n"]: r["code"] for r in got.collect()} == unique_by_loop(log, []) and rounds <= 6


def test_no_commands(spark):
    got, rounds = U.judge_unique(spark.createDataFrame([], "n long, op string, id long, v string"), "v", ["n"])
    assert got.collect() == [] and rounds == 1


def test_rows_are_shuffled_once_a_scan_and_judged_once(spark, tmp_root):
    from twinlake.operators import scan
    pinned, kept = [], scan.pinned
    scan.pinned = lambda df: pinned.append(1) or kept(df)
    try:
        req = spark.range(400).selectExpr("id AS n", "'assign' AS op", "id % 50 AS author_id", "id % 70 AS book_id")
        lives = [spark.range(400, 500).selectExpr("id AS n", "'create' AS op", f"id % 50 AS {c}") for c in ("author_id", "book_id")]
        ids = [spark.range(70).selectExpr(f"id AS {c}") for c in ("author_id", "book_id")]
        links = req.select("author_id", "book_id").limit(5)
        judged = A.assignments_asof(req, *lives, ["n"], authors=ids[0], books=ids[1], links=links, segments=8)
        out = A.links_after(judged, *lives, ["n"], authors=ids[0], books=ids[1], links=links)
        assert out.count() == req.select("author_id", "book_id").distinct().count()
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        scan.pinned = kept
    assert not pinned and plan.count("Window") == 3  # no key holds too many rows: no copy of the log, one window a scan
