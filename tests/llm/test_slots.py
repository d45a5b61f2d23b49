"""Virtual slots: checksums and places against plain Python, versions of the map, crowded rows and edge cases."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import slots

DOCS = "doc_id long, text string, shard string, size int, slot int, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in rows], DOCS)


def corpus(n=600):
    rng = random.Random(2)
    return [(i, "é" * rng.randint(0, 40) + "x" * rng.randint(0, 300)) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "long " * 30000), (5, "same"), (5, "same"), (None, "a"), (None, None)]


def test_places_are_gapless_and_sizes_even(spark):
    rows = corpus()
    got = slots.placed(frame(spark, rows)).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    places, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        places[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.virtual_slot < slots.SLOTS
    assert sorted(places) == list(range(24)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    usual = sorted(sizes.values())[:-1]  # one document is longer than a shard
    assert usual[-1] - usual[0] <= 0.05 * usual[-1]
    assert slots.placed(frame(spark, [])).collect() == []
    one = slots.placed(frame(spark, [(1, None)])).first()
    assert (one["size"], one.text_crc32, one.shard, one.slot) == (8, 0, 0, 0)


def test_reruns_and_other_partitions_agree(spark):
    docs = frame(spark, corpus())
    a, b = (sorted(map(str, slots.placed(d).collect())) for d in (docs, docs.repartition(7, "text")))
    assert a == b


def test_equal_rows_beyond_a_slot_are_spread(spark):
    docs = spark.range(40000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("x").alias("text"))
    got = slots.placed(docs)
    sizes = got.groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("places")).collect()
    assert len(sizes) == 24 and all(r.n == r.places == r.last + 1 for r in sizes)
    assert max(r.s for r in sizes) < 1.02 * min(r.s for r in sizes)
    assert got.where("doc_id = 7").groupBy("virtual_slot").count().agg(F.max("count")).first()[0] < 100


def test_slotted_keeps_columns_and_sharded_adds_the_shard(spark):
    docs = frame(spark, corpus(50))
    rows = slots.slotted(docs)
    assert set(docs.columns) < set(rows.columns) and rows.count() == docs.count()
    at = slots.first_map(slots.sums_by_slot(rows), 5)
    out = slots.sharded(rows, spark.createDataFrame(list(enumerate(at)), "virtual_slot long, shard int"))
    assert out.count() == docs.count() and {r.shard for r in out.select("shard").distinct().collect()} == set(range(5))


def sums_of(seed, n=slots.SLOTS):
    rng = random.Random(seed)
    return {slot: (rng.randint(1, 1000), rng.randint(1, 9)) for slot in rng.sample(range(slots.SLOTS), n)}


@pytest.mark.parametrize("n", [0, 1, 30, 4096])
def test_growing_moves_slots_into_the_new_shard_only(n):
    sums = sums_of(n, n)
    at = slots.first_map(sums, 24)
    more = slots.grown(at, sums, 24)
    moved = [slot for slot in range(slots.SLOTS) if at[slot] != more[slot]]
    assert all(more[slot] == 24 for slot in moved) and all(0 <= x < 24 for x in at)
    loads = slots._loads(more, sums, 25)
    if n == 4096:
        assert max(loads) <= 1.03 * sum(loads) / 25 and min(loads) >= 0.97 * sum(loads) / 25
        assert sum(sums[slot][0] for slot in moved) <= sum(loads) / 25


def test_rebalancing_moves_little(spark):
    sums = sums_of(9)
    at = slots.first_map(sums, 24)
    rng = random.Random(1)
    later = {slot: (size * (3 if at[slot] == 4 else 1) + rng.randint(0, 5), n) for slot, (size, n) in sums.items()}
    edited = slots.rebalanced(at, later, 24)
    loads = slots._loads(edited, later, 24)
    assert max(loads) <= 1.02 * sum(loads) / 24
    moved = [slot for slot in range(slots.SLOTS) if at[slot] != edited[slot]]
    assert {at[slot] for slot in moved} == {4} and sum(later[slot][0] for slot in moved) < 0.09 * sum(loads)
    assert slots.rebalanced(edited, later, 24) == edited
    assert slots.rebalanced(at, {3: (100, 1)}, 24) == at


def test_versions_of_the_map_stay(spark, tmp_path):
    sums, path = sums_of(3), str(tmp_path / "map")
    at = slots.first_map(sums, 24)
    slots.write_map(spark, path, at, 1)
    more = slots.grown(at, sums, 24)
    slots.write_map(spark, path, more, 2)
    of = lambda version: [r.shard for r in slots.read_map(spark, path, version).orderBy("virtual_slot").collect()]
    assert of(1) == at and of(2) == of(None) == more
    with pytest.raises(Exception, match="(?i)exists"):
        slots.write_map(spark, path, at, 2)
