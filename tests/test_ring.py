"""Placement: known shard counts, stability, and what moves."""

import bisect
import hashlib

import pytest

from larkspur.operators import ring as rg
from larkspur.plans import registry


def owner(ring, key):
    tokens = [p[0] for p in ring.places]
    return ring.places[bisect.bisect_left(tokens, hashlib.md5(key.encode()).hexdigest()) % len(tokens)][1]


def test_routing_matches_bisection(spark):
    ring = rg.Ring(("a", "b", "c"), 16)
    keys = spark.createDataFrame([(f"user:{k}",) for k in range(500)], "key string")
    assert all(r.shard_id == owner(ring, r.key) for r in rg.routed(keys, ring).collect())


def test_rebalance_moves_only_to_the_new_shard(spark):
    old = rg.Ring(("a",), 16)
    new = old.with_shard("b")
    keys = spark.createDataFrame([(f"user:{k}",) for k in range(40)], "key string")
    moved = rg.rebalance_plan(keys, old, new).collect()
    assert moved and all((r.from_shard, r.to_shard) == ("a", "b") for r in moved)
    assert {r.key for r in moved} == {f"user:{k}" for k in range(40) if owner(new, f"user:{k}") == "b"}
    assert new.without_shard("b").places == old.places


def test_guards():
    with pytest.raises(ValueError):
        rg.Ring(("a", "a"))
    with pytest.raises(ValueError):
        rg.Ring(("a",), 0)
    with pytest.raises(ValueError):
        rg.Ring(("a",)).without_shard("b")


def test_known_shard_counts(spark, data):
    got = {(r.events, r.shard_id): r["keys"] for r in registry.queries()["scaling_workload"](spark, data).collect()}
    assert got == {(250, "shard-a"): 167, (250, "shard-b"): 179, (1000, "shard-a"): 948, (1000, "shard-b"): 1031, (2500, "shard-a"): 2671, (2500, "shard-b"): 2962}


def test_known_hotspots(spark, data):
    got = {(r.workload, r.shard_id): (r.events, r["keys"], r.requests) for r in registry.queries()["hotspot_workload"](spark, data).collect()}
    assert got == {("balanced", "shard-a"): (477, 960, 1920), ("balanced", "shard-b"): (523, 1040, 2080), ("skewed", "shard-a"): (379, 218, 436), ("skewed", "shard-b"): (621, 216, 432)}
