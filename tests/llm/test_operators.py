"""The ten operators against brute force, on awkward rows and on random ones."""

import base64
import bz2
import collections
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinlake.llm import exact_dedup, graph, licenses, mixing, ngram_join, packing, quality, secret_scan, sharding, textkit, token_count, toxicity

from ..conftest import SF_SMALL
from .helpers import awkward_rows, frame, prose

WS = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in WS.split(text or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward_rows()).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# -- helpers ----------------------------------------------------------------

def test_word_hashes_are_those_of_the_words():
    rng = random.Random(2)
    texts = ["", " ", "a", "A b", "é ü\t漢字", *["".join(rng.choice("ab \n\té🙂") for _ in range(rng.randint(0, 30))) for _ in range(300)]]
    data, at = textkit.utf8(pa.array([*texts, None]))
    h, bounds = textkit.word_hashes(data, at, fold_case=False)
    seen = {}
    for i, t in enumerate(texts):
        own = words(t)
        assert bounds[i + 1] - bounds[i] == len(own)
        for w, x in zip(own, h[bounds[i]: bounds[i + 1]], strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(map(int, seen.values()))) == len(seen)
    sliced = [textkit.word_hashes(data, at[a: b + 1], False)[0] for a, b in textkit.slices(at, 20)]
    assert (np.concatenate(sliced) == h).all()


def test_words_split_at_document_ends():
    data, at = textkit.utf8(pa.array(["ab", "cd", "", "ab"]))
    h, bounds = textkit.word_hashes(data, at, fold_case=True)
    assert bounds.tolist() == [0, 1, 2, 2, 3] and h[0] == h[2] != h[1]


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(7, 7), (None, 3)]
    edges += [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 mixing ---------------------------------------------------------------

def schedule_by_hand(quota: list[int], cycle: int) -> list[int]:
    done, out = [0] * len(quota), []
    for t in range(cycle):
        ready = [(-(-(k + 1) * cycle // a), i) for i, (k, a) in enumerate(zip(done, quota, strict=True)) if k * cycle // a <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


def within_one_block(got, weights: dict):
    """Every block lies in its window, and until a source runs out each has its target's share within one block."""
    total = sum(weights.values())
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got if weights[r["source"]])
    slots = {r["mix_slot"]: r["source"] for r in got if weights[r["source"]]}
    last = min(max(t for t, s in slots.items() if s == x) for x in weights if weights[x])
    count = collections.Counter()
    for t in range(last + 1):
        count[slots[t]] += 1
        assert all(abs(count[x] - weights[x] * (t + 1) / total) < 1 for x in weights)


def test_mixing_keeps_every_block_between_release_and_deadline(spark):
    rows = [(i, None, None, "abc"[min(i % 10, 2)], None) for i in range(4000)]
    got = mixing.schedule(frame(spark, rows), targets={"a": 1, "b": 2, "c": 5}, block_docs=3).collect()
    assert len(got) == 4000
    quota = {r["source"]: r["mix_quota"] for r in got}
    assert quota == {"a": 1, "b": 2, "c": 5}
    pattern = schedule_by_hand([1, 2, 5], 8)
    assert all("abc"[pattern[r["mix_slot"] % 8]] == r["source"] for r in got)
    within_one_block(got, quota)


def test_mixing_meets_small_and_odd_targets(spark):
    assert mixing.whole_weights({"a": 0.9995, "b": 0.0005, "c": 0}) == {"a": 1999, "b": 1, "c": 0}
    rows = [(i, None, None, "a" if i < 5000 else "bc"[i % 2], None) for i in range(5010)]
    got = mixing.schedule(frame(spark, rows), targets={"a": 0.9995, "b": 0.0005, "c": 0}, block_docs=1).collect()
    assert len(got) == 5010
    within_one_block(got, {"a": 1999, "b": 1, "c": 0})
    tail = sorted(r["mix_slot"] for r in got if r["source"] == "c")  # weight 0: after all others, one block after the other
    assert len(tail) == 5 and tail == list(range(tail[0], tail[0] + 5)) and tail[0] > max(r["mix_slot"] for r in got if r["source"] != "c")
    for wrong in (-1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.whole_weights({"a": wrong})


def test_mixing_has_no_limit_on_sources(spark):
    rows = [(i, None, None, f"s{i % 1500}" if i % 3 else "big", None) for i in range(9000)]
    docs = frame(spark, rows)
    counts = collections.Counter(r[3] for r in rows)
    got = mixing.schedule(docs, block_docs=1).collect()
    assert len({r["doc_id"] for r in got}) == len(got) == len({r["mix_slot"] for r in got}) == 9000
    within_one_block(got, {s: round(n ** 0.5) for s, n in counts.items()})
    rounded = mixing.schedule(docs, block_docs=1, max_cycle=500).collect()
    within_one_block(rounded, {r["source"]: r["mix_quota"] for r in rounded})


def test_mixing_splits_a_range_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 50)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, None, None, "ab"[i % 2], None) for i in range(6000)]
    for stable in (True, False):
        got = mixing.schedule(frame(spark, rows), block_docs=4, stable=stable).collect()
        assert collections.Counter((r["doc_id"], r["source"]) for r in got) == collections.Counter((r[0], r[3]) for r in rows)
        places = sorted((r["source"], r["mix_block"], r["mix_place"]) for r in got)
        assert places == sorted((s, i // 4, i % 4) for s in "ab" for i in range(3000))


def test_mixing_awkward_rows_and_columns(docs, empty):
    wide = docs.withColumn("_key", F.lit(1)).withColumn("mix_slot", F.lit("mine")).withColumn("_row", F.lit(2))
    out = mixing.mixed(wide)
    assert out.columns == wide.columns and sorted(map(str, out.collect())) == sorted(map(str, wide.collect()))
    assert mixing.schedule(docs).filter(F.col("source").isNull()).count() == docs.filter("source is null").count()
    assert mixing.schedule(empty).count() == 0 and mixing.mixed(empty).count() == 0
    alone = mixing.schedule(docs, targets={"nowhere": 1})  # no source has a weight: source by source
    assert alone.count() == docs.count() and alone.filter("mix_release is not null").count() == 0


# -- 2 toxicity -------------------------------------------------------------

def toxic_rows(n=1500, rng=random.Random(8)):
    rows, marks = [], []
    for i in range(n):
        text, bad = prose(rng, rng.randint(5, 120)), rng.random() < 0.15
        if bad:
            own = text.split()
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["grumf" + prose(rng, 1), "snarlo" + prose(rng, 1), "idiot"]))
            text = " ".join(own)
        rows.append((i, text, "en", "a", len(text)))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_toxicity_finds_learned_and_seed_words_in_held_out_rows(spark):
    rows, marks = toxic_rows()
    docs, marks = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    out = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h"), toxicity.score_column(model, F.col("text")).alias("s")).join(marks, "doc_id").filter("h").collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    caught = sum(r["s"] >= 0.7 for r in out if r["toxic"])
    assert caught >= 0.9 * sum(r["toxic"] for r in out)
    assert sum(r["s"] >= 0.7 for r in out if not r["toxic"]) <= 2
    kept = toxicity.without_toxic(docs.withColumn("score", F.lit("mine")), marks)
    assert kept.columns == [*docs.columns, "score"] and 0 < kept.count() < len(rows)


def test_toxicity_reads_no_held_out_label(spark):
    rows, marks = toxic_rows(600, random.Random(3))
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in marks]
    scores = []
    for m in (marks, flipped):
        model = toxicity.fit(frame(spark, rows), spark.createDataFrame(m, "doc_id long, quality int, toxic int"))
        scores.append([model.score(t) for _, t, *_ in rows])
    assert scores[0] == scores[1]


def test_toxicity_awkward_rows_and_no_labels(spark, docs, empty):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    assert model.score(None) == model.score("") == model.score(" ") < model.score("you idiot")
    assert docs.select(toxicity.score_column(model, F.col("text")).alias("s")).filter("s between 0 and 1").count() == docs.count()
    assert toxicity.without_toxic(empty, marks).count() == 0
    odd = spark.createDataFrame([(None, None, 1), (1, None, None), (2, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.without_toxic(docs, odd).count() <= docs.count()


def test_label_model_recovers_rates_and_clusters():
    rng = np.random.default_rng(4)
    n, prior = 200_000, 0.1
    y = rng.random(n) < prior
    a, b = np.array([0.6, 0.5, 0.4, 0.3, 0.55]), np.array([0.01, 0.02, 0.005, 0.03, 0.01])
    votes = rng.random((n, 5)) < np.where(y[:, None], a, b)
    votes = np.concatenate([votes, votes[:, :1]], 1)  # the last copies the first
    both = votes.astype(float).T @ votes
    model = toxicity.fit_label_model(both, n, prior, np.full(6, 0.45), np.full(6, 0.015))
    assert np.abs(model.a[1:5] - a[1:]).max() < 0.12
    assert model.cluster[0] == model.cluster[5] and len(set(model.cluster[:5].tolist())) == 5
    assert model.posterior({0, 1}) > 0.9 > model.posterior({0, 5}) == model.posterior({0}) > 10 * model.posterior(set())


# -- 3 sharding -------------------------------------------------------------

def table_by_hand(names, size):
    orders = []
    for name in names:
        offset, skip = sharding.preference(name, size)
        orders.append([(offset + j * skip) % size for j in range(size)])
    owner, at = {}, [0] * len(names)
    while len(owner) < size:
        for i, order in enumerate(orders):
            if len(owner) == size:
                break
            while order[at[i]] in owner:
                at[i] += 1
            owner[order[at[i]]] = i
    return [owner[s] for s in range(size)]


def test_sharding_table(spark, docs, empty):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(dict.fromkeys(names, 1), 499)
    assert table == table_by_hand(names, 499)
    count = collections.Counter(table)
    assert max(count.values()) - min(count.values()) <= 1
    fewer = sharding.lookup_table(dict.fromkeys(names[:-1], 1), 499)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.25 * 499
    heavy = collections.Counter(sharding.lookup_table({"a": 3, "b": 1}, 499))
    assert 370 < heavy[0] < 378
    for bad in ({}, {"a": 0}, dict.fromkeys(map(str, range(600)), 1)):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 499)
    with pytest.raises(ValueError):
        sharding.lookup_table({"a": 1}, 500)
    shards = dict.fromkeys(names, 1)
    out = sharding.assign(docs.withColumn("slot", F.lit("x")), shards, size=499).collect()
    assert len(out) == docs.count()
    for r in out:
        key = "\0null" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 499
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert sharding.assign(empty, shards, size=499).count() == 0


def test_write_shards_round_trip(spark, docs, tmp_root):
    shards = {"x": 1, "y": 2}
    sharding.write_shards(docs, shards, f"{tmp_root}/out", size=499)
    back = spark.read.parquet(f"{tmp_root}/out")
    want = sharding.assign(docs, shards, size=499).drop("slot")
    assert sorted(map(str, back.select(*want.columns).collect())) == sorted(map(str, want.collect()))


# -- 4 quality --------------------------------------------------------------

def quality_by_hand(text):
    t = text or ""
    ws = words(t)
    windows = [tuple(ws[i: i + 5]) for i in range(len(ws) - 4)]
    count, cover = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            cover.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if words(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))


def test_quality_against_brute_force(spark, docs, empty):
    rng = random.Random(6)
    texts = [r[1] for r in awkward_rows()]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["\n".join(rng.choice(["a b", "", " ", "c # d|", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit("mine"))
    got = {r["doc_id"]: r for r in quality.measured(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == quality_by_hand(t), t
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and r["kept"] == (not r["failed_rules"])
    assert quality.measured(empty).count() == 0


def test_helper_names_may_be_columns_of_the_documents(docs):
    names = ("_slot", "_shard", "_row", "_quality", "_quality_", "SLOT")
    wide = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    placed = sharding.assign(wide, {"a": 1, "b": 2}, size=499, slot_as="place", shard_as="home")
    assert placed.columns == [*wide.columns, "place", "home"] and placed.select("_slot", "_shard").distinct().collect() == [(0, 1)]
    judged = quality.measured(wide)
    assert judged.count() == docs.count() and judged.select("_quality", "_quality_").distinct().collect() == [(3, 4)]


def test_quality_is_one_projection(spark):
    plan = quality.measured(textkit.documents(spark, SF_SMALL).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Generate" not in plan


# -- 5 licences -------------------------------------------------------------

def test_licenses(spark, docs, empty):
    t = licenses.Templates(licenses.TEMPLATES, licenses.DICE)
    notice = licenses.TEMPLATES["MIT"][-1]
    half = notice.split()
    text = "Some words here.\n" + " ".join(half[:60]) + "\n" + " ".join(half[60:]) + "\nmore words\nLicensed under CC BY-NC 4.0.\nend"
    found = t.scan(text)
    assert [(n, text[a:b][:8]) for a, b, n, _ in found] == [("MIT", "Permissi"), ("CC-BY-NC-4.0", "Licensed")]
    assert t.scan("nothing to see") == [] == t.scan("")
    for name, texts in licenses.TEMPLATES.items():
        for x in texts:
            assert t.scan("intro line\n" + x + "\nlast line")[0][3] == 1.0, name
    rng = random.Random(3)
    for _ in range(60):  # pruning by size loses no template
        unit = licenses.bigrams([rng.choice(["licensed", "under", "the", "mit", "license", "apache", "version", "2", "0"]) for _ in range(rng.randint(2, 9))])
        every = [(-licenses.dice(unit, b), name) for _, name, b in t.all if licenses.dice(unit, b) >= t.threshold]
        assert t.best(unit) == ((-min(every)[0], min(every)[1]) if every else None)
    out = licenses.scan_licenses(docs.withColumn("license", F.lit("mine"))).collect()
    assert len(out) == docs.count() and all(r["n_matches"] == 0 and r["license"] is None for r in out)
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_inside_lines():
    t = licenses.Templates(licenses.TEMPLATES, licenses.DICE)
    rng = random.Random(4)
    for name, texts in licenses.TEMPLATES.items():
        for x in texts:
            x = x.rstrip(".")
            around = ["".join(f" zq{w}" for w in prose(rng, n).split()) for n in (0, 40, 900)]
            for before in around:
                for after in around:
                    text = f"{before} {x} {after}"
                    (a, b, found, d), *more = t.scan(text)
                    assert (licenses.words(text[a:b]), found, d, more) == (licenses.words(x), name, 1.0, []), text
    text = "Project Foo. Licensed under the Apache License, Version 2.0. See the docs for how to build and run it."
    assert [(text[a:b], n, d) for a, b, n, d in t.scan(text)] == [("Licensed under the Apache License, Version 2.0", "Apache-2.0", 1.0)]
    both = "Code: licensed under the MIT license, docs: licensed under CC BY-SA 4.0, as\nthe rest of it is"
    assert [n for _, _, n, _ in t.scan(both)] == ["MIT", "CC-BY-SA-4.0"]


def test_licence_headers_are_told_apart():
    t = licenses.Templates(licenses.TEMPLATES, licenses.DICE)
    head = """    This {p} is free software{c} you can redistribute it and/or modify
    it under the terms of the GNU {k}General Public License as published by
    the Free Software Foundation{d} either version {v} of the License, or
    (at your option) any later version.

    This {p} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {k}General Public License for more details.

    You should have received a copy of the GNU {k}General Public License
    along with this {p}{e}"""
    url = ".  If not, see <https://www.gnu.org/licenses/>."
    post = "; if not, write to the Free Software\nFoundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    for want, p, k, v, ends in (("GPL-3.0", "program", "", "3", [url]), ("GPL-2.0", "program", "", "2", [url, post]), ("AGPL-3.0", "program", "Affero ", "3", [url]),
                                ("LGPL-2.1", "library", "Lesser ", "2.1", [url, post]), ("LGPL-3.0", "program", "Lesser ", "3", [url]), ("LGPL-3.0", "library", "Lesser ", "3", [url])):
        for e in ends:
            for c, d in ((":", ","), (";", ";")):
                text = "/* Project Foo\n" + head.format(p=p, c=c, k=k, d=d, v=v, e=e) + " */\nint main"
                for own in (text, " ".join(text.split())):
                    assert [n for _, _, n, _ in t.scan(own)] == [want], own
    two, three = (next(x for x in licenses.TEMPLATES[n] if "LIABLE" in x) for n in ("BSD-2-Clause", "BSD-3-Clause"))
    assert "Neither" not in two and "Neither" in three
    for want, text in (("BSD-2-Clause", two), ("BSD-3-Clause", three)):
        for holder in ("COPYRIGHT HOLDER", "REGENTS", "AUTHOR"):
            own = "Copyright (c) 2001 Someone\n" + text.replace("COPYRIGHT HOLDER", holder).replace("the copyright holder nor", "Foo Inc nor")
            assert [n for _, _, n, _ in t.scan(own)] == [want], own


# -- 6 exact dedup ----------------------------------------------------------

def test_cuckoo_filter_and_index():
    rng = random.Random(1)
    digests = [rng.randbytes(32) for _ in range(20_000)]
    index = exact_dedup.DigestIndex(16)
    for d in digests:
        assert index.insert(d, 1, (1, 1))
    assert index.resizes > 0 and all(index.filter.may_contain(d) for d in digests)
    assert not any(index.insert(d, 1, (0, 0)) for d in digests) and all(index.stored[d] == [2, (0, 0)] for d in digests)
    others = [rng.randbytes(32) for _ in range(20_000)]
    assert sum(index.filter.may_contain(d) for d in others) < 60
    assert not any(index.delete(d) for d in others)
    for d in digests[:10_000]:
        assert index.delete(d) and index.delete(d) and not index.delete(d)
    assert all(index.filter.may_contain(d) for d in digests[10_000:]) and len(index.stored) == 10_000
    assert sum(index.filter.may_contain(d) for d in digests[:10_000]) < 60


def test_exact_dedup_against_brute_force(docs, empty):
    rows = docs.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[exact_dedup.normal_digest(r["text"])].append(r["doc_id"])
    for per_bucket in (3, 100_000):
        out = exact_dedup.grouped(docs, digests_per_bucket=per_bucket).collect()
        assert len(out) == len(rows) and sum(r["_kept"] for r in out) == len(groups)
        for r in out:
            own = groups[bytes(r["_digest"]).hex()]
            ids = [i for i in own if i is not None]
            assert r["_copies"] == len(own) and r["_keep_id"] == (min(ids) if ids else None)
            assert not r["_kept"] or r["_id"] == r["_keep_id"]
    wide = docs.withColumn("_digest", F.lit(1)).withColumn("_gone", F.lit(1))
    kept = exact_dedup.deduplicated(wide)
    assert kept.columns == wide.columns
    left = collections.Counter(exact_dedup.normal_digest(r["text"]) for r in kept.collect())
    assert left == dict.fromkeys(groups, 1)
    assert exact_dedup.grouped(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0


def test_live_digests_after_a_log(spark):
    rng = random.Random(7)
    log, live = [], collections.Counter()
    for seq in range(600):
        text, op = f"text {rng.randint(0, 40)}", rng.choice(["insert", "insert", "delete"])
        log.append((seq, text, op, seq))
        if op == "insert":
            live[text] += 1
        elif live[text]:
            live[text] -= 1
    got = {r["text_sha256"]: r["copies"] for r in exact_dedup.live_digests(spark.createDataFrame(log, "doc_id long, text string, op string, seq long").repartition(6), digests_per_bucket=50).collect()}
    assert got == {exact_dedup.normal_digest(t): n for t, n in live.items() if n}


# -- 7 packing --------------------------------------------------------------

def test_best_two_fit():
    rng = random.Random(9)
    for capacity, n in ((50, 400), (100, 1000), (4096, 2000)):
        lengths = [rng.randint(1, capacity - 1) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 5)) for _ in range(n)]
        counts = np.bincount(lengths, minlength=capacity).tolist()
        bins = list(packing.best_two_fit(counts, capacity))
        assert sorted(x for b in bins for x in b) == sorted(lengths) and max(map(sum, bins)) <= capacity
        assert len(bins) <= 1.03 * sum(lengths) / capacity + 1
    assert list(packing.best_two_fit([0] * 10, 10)) == []
    # greedy takes 6 and 3 of 10; 2 and 2 fill the gap that 3 leaves better
    assert sorted(map(sorted, packing.best_two_fit(np.bincount([6, 3, 2, 2], minlength=10).tolist(), 10))) == [[2, 2, 6], [3]]


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    out = packing.packed(docs).collect()
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    want = collections.defaultdict(list)
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            own = ids[a: a + 4096]
            want[r["doc_id"]].append((k, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.packed(empty).count() == 0


def test_word_ids_equal_the_tokenizers():
    rng = random.Random(3)
    tok = packing.WordTokenizer(packing.tokenizer_path())
    alphabet = "aAbBzZ'sStT mMdD..,!?%$ 0123²½\t\n\r\x0béÉßÀÿŸžŽñÑªµº×÷°   ſKİı\x1c\x1fǅ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["x <|endoftext|> y", "it's I'LL o'clock"]
    assert all(tok.ids(t) == tok._encode(t) for t in texts)
    long = prose(rng, 4000)
    assert b"".join(map(tok.ids, packing.parts(long, 100))) == tok._encode(long)


# -- 8 token counts ---------------------------------------------------------

def greedy(word: bytes, vocab: set, longest: int) -> int:
    n = at = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at: at + k] in vocab)
        n += 1
    return n


def test_token_counts_against_greedy_matching(docs, empty):
    rng = random.Random(4)
    small = [bytes([b]) for b in range(256)] + [bytes(rng.choice(b"ab ") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    automaton, vocab = token_count.Automaton(small), set(small)
    for _ in range(4000):
        w = bytes(rng.choice(b"ab c") for _ in range(rng.randint(0, 25)))
        assert automaton.count(w) == greedy(w, vocab, 6)
    with pytest.raises(ValueError):
        token_count.Automaton(small[1:])
    pieces = token_count.vocabulary(token_count.vocabulary_path())
    vocab, longest = set(pieces), max(map(len, pieces))
    wide = docs.withColumn("n_tokens", F.lit("mine"))
    got = token_count.token_counts(wide, pieces).collect()
    want = [(r["doc_id"], len(words(r["text"])), sum(greedy(b" " + w.encode(), vocab, longest) for w in words(r["text"]))) for r in docs.filter("length(text) < 5000 or text is null").collect()]
    assert not collections.Counter(want) - collections.Counter(map(tuple, got)) and len(got) == docs.count()
    assert token_count.token_counts(empty, pieces).count() == 0


# -- 9 n-gram join ----------------------------------------------------------

def components_by_hand(rows, n, percent):
    sets = []
    for _, text in rows:
        ws = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(ws[i: i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set()))
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    return [(rows[i][0], len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i in range(len(rows))]


def family_rows(seed, size=260):
    """Families of copies with few and many changed words, and passages that unrelated texts share."""
    rng = random.Random(seed)
    bases, passage = [prose(rng, rng.choice([6, 9, 20, 60, 200])).split() for _ in range(12)], prose(rng, 15).split()
    rows = []
    for i in range(size):
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            k = rng.randrange(len(own))
            own[k: k + rng.randint(0, 1)] = [prose(rng, 1)]
        if rng.random() < 0.2:
            own = prose(rng, rng.randint(10, 80)).split()
            own[3:3] = passage
        rows.append((i, " ".join(own) if rng.random() < 0.9 else "  ".join(own).upper()))
    return rows


@pytest.mark.parametrize(("n", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (2, 60, 3), (4, 100, 4)])
def test_ngram_join_against_brute_force(spark, n, percent, seed):
    rows = family_rows(seed)
    out = ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), n, percent)
    assert sorted(map(tuple, out.collect())) == sorted(components_by_hand(rows, n, percent))


def test_ngram_join_lists_alone_find_all_links(spark, monkeypatch):
    """Without the min-hash step every link must come from the occurrence counts and the short lists."""
    monkeypatch.setattr(ngram_join.Join, "star_pairs", lambda self, some: some.select(F.col("node").alias("x"), F.col("node").alias("y")).limit(0))
    monkeypatch.setattr(ngram_join, "STEPPED", 4)
    rows = family_rows(21, 200)
    out = ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert sorted(map(tuple, out.collect())) == sorted(components_by_hand(rows, 4, 85))


def test_ngram_join_awkward_rows(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    got = sorted(map(tuple, ngram_join.near_components(docs.withColumn("n", F.lit(1)), 4, 85).collect()), key=key)
    assert got == sorted(components_by_hand(rows, 4, 85), key=key)
    assert ngram_join.near_components(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0
    kept = ngram_join.one_of_each(docs.withColumn("_gone", F.lit(1)))
    assert kept.columns == [*docs.columns, "_gone"]
    want = components_by_hand(rows, 5, 80)
    assert kept.count() == sum(d is None or d == c for d, _, c in want)


def test_one_of_each_with_repeated_and_null_ids(spark):
    rng = random.Random(12)

    def near(text, k):
        own = text.split()
        own[k] = "changed"
        return " ".join(own)

    family, clean, nameless = [[prose(rng, 80) for _ in range(n)] for n in (3, 4, 1)]
    rows = [(1, family[0]), (5, near(family[0], 10)), (5, clean[0]), (5, clean[1]),  # 5 goes once only
            (2, family[1]), (2, near(family[1], 30)), (2, clean[2]), (None, near(family[1], 60)),  # copies with one id
            (3, family[2]), (3, family[2]), (3, family[2].upper()), (None, clean[3]),
            (None, nameless[0]), (None, near(nameless[0], 5)), (None, nameless[0]), (9, ""), (9, ""), (None, None)]
    group = [0, 0, 1, 2, 3, 3, 4, 3, 5, 5, 5, 6, 7, 7, 7, 8, 9, 10]
    docs = frame(spark, [(i, t, "en", f"{g}", k) for k, ((i, t), g) in enumerate(zip(rows, group, strict=True))]).repartition(4)
    for some in (docs, docs.withColumn("tag", F.lit(1)).withColumn("_own_id", F.lit(2))):
        out = ngram_join.one_of_each(some, spare_null_ids=False)
        assert out.columns == some.columns
        out = out.collect()
        assert sorted(int(r["source"]) for r in out) == sorted(set(group))
        assert {r["source"]: r["doc_id"] for r in out if r["source"] in "0357"} == {"0": 1, "3": 2, "5": 3, "7": None}
    spared = [r for r in ngram_join.one_of_each(docs).collect() if r["doc_id"] is not None]
    assert sorted(int(r["source"]) for r in spared) == [0, 1, 2, 3, 4, 5, 8, 9]


# -- 10 secrets -------------------------------------------------------------

SECRET = "token=abcdef123456"


def base_by_hand(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24])


def layered(rng, text):
    out = text
    for _ in range(rng.randint(1, 4)):
        out = rng.choice([
            lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
            lambda s: "".join(f"%{b:02X}" for b in s.encode()), lambda s: urllib.parse.quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
            lambda s: "".join(f"&#{ord(c)};" for c in s), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
            lambda s: base64.b64encode(zlib.compress(s.encode())).decode(), lambda s: base64.b64encode(bz2.compress(s.encode())).decode()])(out)
    return out


def test_base_scan_against_brute_force():
    rng = random.Random(1)
    parts = ["token", "Secret", "API_KEY", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH", "0123456789", "abcdef", "deadbeef", "%41", "\\u0041", "zz", ";", "ſecret", "toKen"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert secret_scan.base_scan(t) == base_by_hand(t)


def test_secrets_in_nested_layers_map_to_their_place():
    rng = random.Random(2)
    for _ in range(300):
        word = layered(rng, SECRET)
        text = f"héllo wörld {word} end"
        base, spans, layers, refused = secret_scan.scan(text)
        assert layers >= 1 and not refused and set(base) <= set(spans)
        a = text.index(word)
        assert any(a <= s and e <= a + len(word) for s, k, e in spans if k == 0), word
        assert all(0 <= s < e <= len(text) for s, _, e in spans)


def test_spans_are_exact_in_partly_encoded_text():
    text = "é url?q=%C3%A9token%3Dabcdef%3B next"
    spans = secret_scan.scan(text)[1]
    assert [text[a:b] for a, k, b in spans] == ["token%3Dabcdef"]
    inner = "prefix " + SECRET + " suffix of some length"
    word = base64.b64encode(inner.encode()).decode()
    (a, _, b), = secret_scan.scan(word)[1]
    assert SECRET in base64.b64decode(word[a - a % 4: b + -b % 4]).decode() and b - a < len(word) - 20


def test_cycles_bombs_and_junk():
    bomb = base64.b64encode(zlib.compress(b"a" * 2_000_000)).decode()
    assert secret_scan.scan(bomb, limit=1_000_000)[2:] == (0, 1)
    assert secret_scan.scan("%25" * 50 + "41")[0] == []  # unwraps until nothing is left
    assert secret_scan.scan("%")[1] == secret_scan.scan("\\u12")[1] == secret_scan.scan("A" * 17)[1] == []


@pytest.mark.parametrize(("text", "found"), [
    ('a password = "%68unter2xyz" b', 'password = "%68unter2xyz'), ("a %70assword = hunter22 b", "%70assword = hunter22"),
    ('token: "\\u0061bcdefg"', 'token: "\\u0061bcdefg'), ("x &#x74;oken  :  abcdefg y", "&#x74;oken  :  abcdefg"),
    ("\\x73ecret = %61bcdef&#103;", "\\x73ecret = %61bcdef&#103;"), ("passwd %3D %FF%61bcdefg, passwd %3D abcdefg", "passwd %3D abcdefg")])
def test_spaced_assignments_with_escapes(text, found):
    for shape in (str, lambda s: "é " + s.replace("%", "%25").replace("\\", "%5C") + " z"):
        spans = secret_scan.scan(shape(text))[1]
        assert any(shape(text)[a:b] == (found if shape is str else found.replace("%", "%25").replace("\\", "%5C")) for a, k, b in spans if k == 0)


def test_alternating_escapes_stay_few_layers():
    text = "".join("%25" * 6 + "41" + "\\u005c" * 6 + "u0041 " for _ in range(20))
    assert secret_scan.scan(text)[2] < 200


def found_in(data, **options):
    """Whether the secret of some bytes is found inside their base64, with nothing refused."""
    text = "é " + (data if isinstance(data, str) else base64.b64encode(data).decode()) + " end"
    _, spans, _, refused = secret_scan.scan(text, **options)
    assert not refused and all(0 <= a < b <= len(text) for a, _, b in spans)
    return any(k == 0 for _, k, _ in spans)


def test_compressed_data_to_a_fixpoint():
    import lzma

    import zstandard

    one, other = SECRET.encode(), b"nothing to see here"
    packs = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress]
    for f in packs:
        assert found_in(f(one)) and found_in(f(other) + f(one)) and found_in(f(b"") + f(one)) and found_in(f(other) + one)
        assert found_in(f(other) + b"x" + one) and found_in(f(other) + b"\0" * 100 + f(one)) and not found_in(f(other) * 3)
        assert found_in(b"\1\2" + f(other) + f(one)) or f is zlib.compress  # zlib has no signature to look for
        assert found_in(f(other) + f(gzip.compress(one)))
        for g in packs:
            assert found_in(f(g(one))) and found_in(f(g(f(other) + f(one))))
    assert found_in(gzip.compress(one[:8]) + gzip.compress(one[8:]))
    assert found_in(gzip.compress(base64.b64encode(gzip.compress(one))))


def test_text_in_mixed_data():
    import io
    import tarfile

    assert found_in(b"\0\1\xff" + SECRET.encode() + b"\xfe\0") and found_in("é ü".encode() + b"\xff " + SECRET.encode())
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as out:
        for name, data in (("a.conf", b"password = hunter22\n"), ("b.bin", bytes(range(256)))):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))
    assert found_in(tar.getvalue())
    data = b"\xff\x80" + "é".encode() + b" " + SECRET.encode() + b"\0" * 30
    word = base64.b64encode(data).decode()
    (a, _, b), = secret_scan.scan(word)[1]
    assert SECRET in base64.b64decode(word[a - a % 4: b + -b % 4]).decode("latin-1") and b - a <= 28


def test_base64_over_lines():
    rng = random.Random(5)
    noise = "".join(rng.choice("ghijklmnop ") for _ in range(400))
    for data in ((noise[:50] + SECRET + noise).encode(), gzip.compress((noise + SECRET + noise).encode())):
        for width in (64, 76):
            flat = base64.b64encode(data).decode()
            lines = [flat[i: i + width] for i in range(0, len(flat), width)]
            for end in ("\n", "\r\n", "\n    ", " \n"):
                body = end.join(lines)
                for shape in (body, f"-----BEGIN PRIVATE KEY-----{end}{body}{end}-----END PRIVATE KEY-----", f"key: {body}", f'"{body}"', f"{flat[:20]}{end}" + end.join(flat[i: i + width] for i in range(20, len(flat), width))):
                    assert found_in(shape), shape
    flat = base64.b64encode(("x" * 50 + SECRET + " " + "y" * 90).encode()).decode()
    text = "\n".join(flat[i: i + 76] for i in range(0, len(flat), 76))
    (a, _, b), = secret_scan.scan(text)[1]
    assert 64 <= a < 76 < b < 104


def test_large_layers_are_scanned_in_pieces():
    rng = random.Random(6)
    noise = " ".join("".join(rng.choice("ghijklmnop") for _ in range(6)) for _ in range(200_000)).encode()
    hidden = base64.b64encode(gzip.compress(SECRET.encode()))
    for own in (SECRET.encode(), b"password" + b" " * 50_000 + b"= hunter22", hidden, b"%74oken = hunter22"):
        for _ in range(2):
            at = noise.index(b" ", rng.randrange(len(noise) - 10))
            data = gzip.compress(noise[:at] + b" " + own + noise[at:])
            assert found_in(data, size=100_000) and found_in(data)
    assert secret_scan.scan(base64.b64encode(gzip.compress(b"a" * 1_000_000)).decode(), size=100_000)[3] > 0


def test_secret_scan_awkward_rows(docs, empty):
    out = secret_scan.scan_secrets(docs.withColumn("spans", F.lit("mine"))).collect()
    assert len(out) == docs.count()
    by_text = {r["doc_id"]: r["text"] for r in docs.filter("doc_id is not null").collect()}
    for r in out:
        if r["doc_id"] is not None:
            base = base_by_hand(by_text[r["doc_id"]] or "")
            joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
            assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
    assert secret_scan.scan_secrets(empty).count() == 0


def test_small_tables_have_no_surprises(spark):
    """Every query runs on the smallest tables, with as many rows as its contract says."""
    from twinlake.llm.registry import QUERIES

    n = textkit.documents(spark, SF_SMALL).count()
    vectors, pages = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet").count() for t in ("embeddings", "pages"))
    own = {"op12_whitening": 32 * vectors, "op13_html_extraction": pages}  # 32 components a vector; the other queries have a row a document
    for name, query in QUERIES.items():
        rows = query(spark, SF_SMALL).count()
        assert rows >= n if name == "op7_packing" else rows == own.get(name, n), name
