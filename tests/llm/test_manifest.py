"""Merkle manifest against a plain recursive tree, and against its SQL (test_oracle)."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from twinlake.llm import merkle

from .helpers import awkward_rows, frame

FIELD_AT = {"doc_id": 0, "text": 1, "lang": 2, "source": 3, "n_chars": 4}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(row):
    return h(*[field(row[FIELD_AT[f]]) for f in merkle.FIELDS])


def plain_tree(leaves):
    """Root and, for each leaf, the (side, sibling) list from below."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            j = i ^ 1
            paths[k].append("-" if j >= len(level) else ("R" if j > i else "L") + level[j])
        level = [h(*level[i: i + 2]) for i in range(0, len(level), 2)]
        at = [i >> 1 for i in at]
    return level[0], paths


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0], plain_leaf(r)))
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        trees[g].sort(key=lambda t: (t[0], t[1] or 0, t[2]))
    own = {g: plain_tree([t[2] for t in trees[g]]) for g in names}
    root, tops = plain_tree([own[g][0] for g in names])
    return [(g, i, t[1], t[2], own[g][0], root, tuple(own[g][1][i] + tops[k])) for k, g in enumerate(names) for i, t in enumerate(trees[g])]


def got(df):
    return [(r["tree"], r["place"], r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(r["proof"])) for r in df.collect()]


@pytest.mark.parametrize("bits", [1, 3, 9])
def test_manifest_equals_plain_tree(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    rng = random.Random(bits)
    rows = awkward_rows() + [(1000 + i, f"t{i}", rng.choice(["a", "a", "é", "z"]), "s", i) for i in range(41)] + [(7777, "same", "a", "s", 1)] * 25
    want = plain_manifest(rows)
    assert sorted(got(merkle.manifest(frame(spark, rows).repartition(5))), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 64, 65])
def test_block_levels_and_reversed_sweep(n):
    leaves = [h(str(i)) for i in range(n)]
    root, paths = plain_tree(leaves)
    levels = merkle.sweep(leaves, (n - 1).bit_length())
    assert levels[-1] == [root] and merkle.suffixes(levels, []) == paths
    taller = merkle.sweep(leaves, (n - 1).bit_length() + 2)  # a lone root goes on alone
    assert taller[-1] == [h(h(root))] and merkle.suffixes(taller, ["x"])[0] == paths[0] + ["-", "-", "x"]


def test_changed_rows_are_found_and_no_others(spark):
    rows = awkward_rows()
    docs = frame(spark, rows, extra={"g": 1, "i": 2, "digest": "x", "row": "y", "_tie": 3, "leaf": 4}).repartition(3)
    other = merkle.leaf([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS])
    done = merkle.manifest(docs, carry={"touched": other, "n_chars": F.col("n_chars")})
    seen = done.select("n_chars", "root", (merkle.folded(F.col("touched"), F.col("proof")) == F.col("root")).alias("same"),
                       (merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).collect()
    assert len(seen) == len(rows) and all(r["ok"] for r in seen)
    assert all(r["same"] == (r["n_chars"] is None) for r in seen)


def test_tampering_rule_of_the_query(spark, tmp_path):
    rows = [(i, f"text {i}", "en" if i % 3 else None, "s", None if i % 10 == 0 else i) for i in range(200)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for r in merkle.op11(spark, str(tmp_path)).collect():
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["doc_id"] % 10 != 0
        assert r["verified"] == (not tampered) == (r["folded_root"] == r["root"])


def test_empty_table_and_single_row(spark):
    assert merkle.manifest(frame(spark, [])).collect() == []
    only = merkle.manifest(frame(spark, [(None, None, None, None, None)])).first()
    assert only["leaf"] == only["subroot"] == only["root"] == h("-----") and only["proof"] == []


def test_half_of_the_rows_equal(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANK_ROWS", 100)
    rows = [(5, "copy", "en", "s", 4)] * 1000 + [(i, "x", "en", "s", 1) for i in range(1000)]
    ranked = merkle.ranked(frame(spark, rows).repartition(4).select(F.lit("g").alias("g"), F.col("doc_id").alias("o"), merkle.leaf([F.col("text")]).alias("digest")), ["o", "digest"])
    assert sorted(r["i"] for r in ranked.collect()) == list(range(2000))
    assert {r["n"] for r in ranked.select("n").collect()} == {2000}
