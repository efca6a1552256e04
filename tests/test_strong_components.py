"""Strong components against reachability by brute force, and the number of their rounds."""

import random

import pytest

from tessera.operators import graph


def brute(arcs):
    nodes = {x for a in arcs for x in a}
    reach = {x: {x} for x in nodes}
    while True:
        grown = {x: r.union(*[reach[b] for a, b in arcs if a in r]) for x, r in reach.items()}
        if grown == reach:
            return {x: min(y for y in reach[x] if x in reach[y]) for x in nodes}
        reach = grown


def several(rng):
    """Graphs side by side: rings with tails, chains with an arc back, two-way streets, one-way random arcs."""
    arcs, at = [], 0
    for _ in range(6):
        size = rng.randint(3, 12)
        ids = rng.sample(range(at, at + size), size)
        at += size
        arcs += list(zip(ids, ids[1:], strict=False))
        if rng.random() < 0.7:
            arcs.append((ids[rng.randrange(1, size)], ids[rng.randrange(size - 1)]))
        arcs += [(b, a) for a, b in zip(ids, ids[1:], strict=False) if rng.random() < 0.2]
    arcs += [(rng.randrange(at), rng.randrange(at)) for _ in range(rng.choice([0, 5, 15]))]
    ids = rng.sample(range(at, at + 12), 12)
    arcs += [(rng.choice(ids), rng.choice(ids)) for _ in range(26)]
    return arcs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components_against_reachability(spark, seed):
    arcs = several(random.Random(seed))
    got = graph.strong_components(spark.createDataFrame(arcs, "u int, v int")).collect()
    assert {r.node: r.component for r in got} == brute(arcs) and len(got) == len({x for a in arcs for x in a})


@pytest.mark.parametrize("ring", [False, True])
def test_rounds_do_not_grow_with_the_diameter(spark, monkeypatch, ring):
    n, rounds = 10_000, []
    kept = graph._kept
    monkeypatch.setattr(graph, "_kept", lambda df: rounds.append(1) or kept(df))
    ids = random.Random(5).sample(range(n), n)
    arcs = list(zip(ids, [*ids[1:], ids[0]], strict=True))[: n if ring else n - 1]
    got = graph.strong_components(spark.createDataFrame(arcs, "u int, v int"))
    assert got.count() == n and got.select("component").distinct().count() == (1 if ring else n)
    assert len(rounds) < 50
