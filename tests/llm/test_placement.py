"""Sharding and mixing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewright.llm import mixing, sharding

from conftest import SF
from llm.conftest import CLASH  # noqa: I001


def jump(key, n):
    """The jump hash in Python's integers."""
    key, b, j = key % 2**64, 0, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 8, 9, 100])
def test_jump_hash(spark, n):
    keys = [0, 1, -1, 5, 2**63 - 1, -(2**63), 123456789012345] + list(range(1000, 1300))
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == {k: jump(k, n) for k in keys}


def test_growth_moves_rows_only_to_the_new_shard(spark):
    rows = sharding.shard(spark.range(20_000).withColumnRenamed("id", "doc_id"), 8).collect()
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert 0.09 < sum(r["grown_shard"] == 8 for r in rows) / len(rows) < 0.13
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) < 1.1 * len(rows) / 8


def test_slots_do_not_depend_on_ranges(spark, docs_of):
    docs = docs_of([(i % 400, f"t{i % 7}") for i in range(1000)] + [(7, "hot")] * 900)
    found = []
    for width in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        found.append(Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.shard(docs, 3).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1]
    for shard in range(3):
        slots = sorted(k[3] for k in found[0] if k[2] == shard)
        assert slots == list(range(len(slots)))


def test_sharding_of_odd_rows(odd_docs, no_docs):
    out = sharding.shard(odd_docs, 4)
    rows = out.collect()
    assert len(rows) == 13
    assert {r["shard"] for r in rows if r["doc_id"] is None} == {jump(-1, 4)}
    assert set(CLASH) - {"shard", "slot", "grown_shard"} <= set(out.columns)
    assert sharding.shard(no_docs, 4).count() == 0
    with pytest.raises(ValueError, match="positive"):
        sharding.shard(no_docs, 0)


def water_levels(sizes, cycle, limit):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > limit * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: limit * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 1000, None: 5}, {"a": 1}, {"b": 10, "a": 10, "c": 10}, {str(i): 7**i for i in range(8)}, {"a": 0, "b": 50}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = water_levels(sizes, mixing.CYCLE, mixing.LIMIT)
    assert all(np.isclose(got[s], want[s]) for s in sizes)


def test_splitting_tree_is_exact_and_fair():
    quota, capacity = np.array([7, 0, 40, 13]), [10, 20, 5, 25]
    tables = np.array([mixing.split_quotas(quota, capacity, seed) for seed in range(3000)])
    assert (tables.sum(1) == quota).all()
    assert (tables.sum(2) == capacity).all()
    # A shard's share of a source follows the hypergeometric law of mean and variance.
    n, total = tables[:, 1, 2], quota.sum()
    p = quota[2] / total
    assert abs(n.mean() - 20 * p) < 0.2
    assert abs(n.var() - 20 * p * (1 - p) * (total - 20) / (total - 1)) < 0.3


def test_mix_meets_targets_and_limits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    rows = mixing.mix(docs, 8, block_docs=16).collect()
    again = mixing.mix(docs.repartition(5), 8, block_docs=16).collect()
    key = lambda r: (r["doc_id"], r["copies"], sorted((p["shard"], p["rank"]) for p in r["places"]))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r["copies"] <= 3
        assert len(r["places"]) == r["copies"]
        taken[r["source"]] += r["copies"] * r["size"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    want = water_levels(size, mixing.CYCLE, mixing.LIMIT)
    for s in size:
        assert np.isclose(target[s], want[s])
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 5
    shards = Counter(p["shard"] for r in rows for p in r["places"])
    assert set(shards) == set(range(8))
    assert max(shards.values()) < 2 * min(shards.values())  # equal numbers of blocks, of 16 documents on average


def test_the_tree_places_what_is_taken(spark, monkeypatch):
    """Every (source, block, pass) goes where the tree's quotas say, and another tree gives other rows."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    drawn = []
    tree = mixing.split_quotas

    def watched(quota, capacity, seed):
        drawn.append(tree(quota, capacity, seed))
        return drawn[-1]

    monkeypatch.setattr(mixing, "split_quotas", watched)
    rows = mixing.mix(docs, 4, block_docs=50).collect()
    # A block is known by its documents: those of a source with the same hash range share all their shards.
    blocks = {s: -(-1000 // 50) for s in ("s0", "s1", "s2")}
    key = {r["doc_id"]: r["k"] for r in docs.select("doc_id", F.shiftright(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), 20).alias("k")).collect()}
    places = defaultdict(set)
    for r in rows:
        for turn, p in enumerate(r["places"]):
            places[r["source"], key[r["doc_id"]] % blocks[r["source"]], turn].add(p["shard"])
    assert all(len(v) == 1 for v in places.values())
    got = Counter((next(iter(v)), k[0]) for k, v in places.items())
    want = {(shard, f"s{i}"): int(n) for shard, line in enumerate(drawn[0]) for i, n in enumerate(line) if n}
    short = {k: want[k] - got.get(k, 0) for k in want}  # a block that is taken in part may give nothing
    assert set(short.values()) <= {0, 1}
    assert sum(short.values()) <= 3
    monkeypatch.setattr(mixing, "split_quotas", lambda quota, capacity, seed: tree(quota, capacity, seed + 1))
    other = mixing.mix(docs, 4, block_docs=50).collect()
    shards = lambda rows: sorted((r["doc_id"], [p["shard"] for p in r["places"]]) for r in rows)
    assert shards(rows) != shards(other)
    out = mixing.draw(mixing.mix(docs, 4, block_docs=50), docs.columns)
    assert out.columns == docs.columns
    assert out.count() == sum(len(r["places"]) for r in other)


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs, 3).collect()
    assert len(rows) == 13
    assert all(0 <= r["copies"] <= 3 for r in rows)
    assert {r["size"] for r in rows if r["text"] is None} == {0}
    assert mixing.mix(no_docs, 3).count() == 0


def test_hot_key_stays_together(docs_of):
    docs = docs_of([(1, "a b c", "x")] * 50 + [(i, "a b c d", "y") for i in range(2, 52)])
    rows = mixing.mix(docs, 2, block_docs=8).collect()
    assert len({r["copies"] for r in rows if r["doc_id"] == 1}) == 1
    assert zlib.crc32(b"1") == 2212294583
