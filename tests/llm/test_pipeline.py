"""The pipeline's stages against plain Python over the same rows."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinlake.llm import exact_dedup, mixing, packing, textkit, toxicity

from ..conftest import SF_SMALL
from .helpers import awkward_rows, frame
from .test_operators import components_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(rows):
    return sorted(map(str, rows))


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_run_equals_brute_force(spark):
    docs = textkit.documents(spark, SF_SMALL)
    model = toxicity.fit(docs, textkit.labels(spark, SF_SMALL))
    rows = [r for r in docs.collect() if model.score(r["text"]) < toxicity.REJECT]
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(exact_dedup.normal_digest(r["text"]), r)
    rows = list(first.values())
    kept = {d for d, _, c in components_by_hand([(r["doc_id"], r["text"]) for r in rows], 5, 80) if d == c}
    tok = packing.WordTokenizer(packing.tokenizer_path())
    want = collections.Counter()
    for r in rows:
        if r["doc_id"] in kept:
            n = len(tok.ids(r["text"])) // 4 + 1
            want.update((r["doc_id"], k, a, min(4096, n - a)) for k, a in enumerate(range(0, n, 4096)))
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got.collect()) == want


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_stand_awkward_and_empty_tables(spark, stage):
    docs = frame(spark, awkward_rows())
    out = stage(spark, docs, SF_SMALL)
    if stage is not corpus_pipeline.packing_stage:
        assert out.columns == COLUMNS
        left = collections.Counter(map(str, docs.collect()))
        assert not collections.Counter(map(str, out.collect())) - left
    else:
        assert out.count() >= docs.count()
    assert stage(spark, frame(spark, []), SF_SMALL).count() == 0


def test_mixing_stage_keeps_every_row_and_writes_them_in_order(spark, tmp_root):
    docs = textkit.documents(spark, SF_SMALL)
    out = corpus_pipeline.mixing_stage(spark, docs, SF_SMALL)
    assert key(out.collect()) == key(docs.collect())
    from twinlake.llm import mixing

    slots = {r["doc_id"]: (r["mix_slot"], r["mix_place"]) for r in mixing.schedule(docs).collect()}
    order = [slots[r["doc_id"]] for r in out.collect()]
    assert order == sorted(order)
    extra = docs.withColumn("mix_slot", F.lit(1)).withColumn("_key", F.lit(2))
    assert corpus_pipeline.mixing_stage(spark, extra, SF_SMALL).columns == extra.columns


def test_packing_follows_the_order_of_mixing(spark, tmp_root):
    rng = random.Random(3)
    sources = ["a"] * 1600 + ["b"] * 400 + ["c"] * 100
    rows = [(i, " ".join(["word"] * rng.randint(1, 60)), "en", s, 1) for i, s in enumerate(sources)]
    stored = f"{tmp_root}/mixed"
    corpus_pipeline.mixing_stage(spark, frame(spark, rows), SF_SMALL).write.parquet(stored)
    docs = spark.read.parquet(stored)
    places = {r["doc_id"]: r["_place"] for r in packing.with_places(docs).collect()}
    assert sorted(places.values()) == list(range(len(rows)))
    slots = {r["doc_id"]: (r["mix_slot"], r["mix_place"]) for r in mixing.schedule(frame(spark, rows)).collect()}
    order = sorted(places, key=places.get)
    assert [slots[i] for i in order] == sorted(slots.values())

    out = packing.packed_in_order(docs, sequence=64, pieces_per_group=120).collect()
    assert collections.Counter((r["doc_id"], r["piece"]) for r in out) == collections.Counter({(i, 0): 1 for i in range(len(rows))})
    by_sequence = collections.defaultdict(list)
    for r in out:
        by_sequence[r["sequence_id"]].append(r)
    assert all(sum(r["length"] for r in own) <= 64 and sorted(r["offset"] for r in own)[0] == 0 for own in by_sequence.values())
    assert len(by_sequence) < 1.1 * sum(r["length"] for r in out) / 64
    # a sequence's pieces are of one range of the order, and ranges follow one another
    ranges = [{places[r["doc_id"]] // 120 for r in by_sequence[s]} for s in sorted(by_sequence)]
    assert all(len(r) == 1 for r in ranges) and [min(r) for r in ranges] == sorted(min(r) for r in ranges)
    # source shares over sequence ids are those of the order
    packed_order = [r["doc_id"] for s in sorted(by_sequence) for r in by_sequence[s]]
    for n in (240, 480, 960):
        got, want = (collections.Counter(sources[i] for i in ids[:n]) for ids in (packed_order, order))
        assert got == want
    assert collections.Counter(sources[i] for i in packed_order[:480])["b"] > 1.3 * 480 * 400 / len(rows)


def test_packing_of_long_and_repeated_rows_in_order(spark):
    rows = [(1, "word " * 500, "en", "a", 1)] * 2 + [(None, "word " * 500, "en", "a", 1), (2, None, None, None, None)]
    out = packing.packed_in_order(frame(spark, rows), sequence=64).collect()
    by_sequence = collections.defaultdict(int)
    for r in out:
        by_sequence[r["sequence_id"]] += r["length"]
    assert sum(by_sequence.values()) == 3 * 501 + 1 and max(by_sequence.values()) == 64
    assert sum(n == 64 for n in by_sequence.values()) >= 3 * (501 // 64)
    assert packing.packed_in_order(frame(spark, [])).count() == 0
