"""Install order against a plain search, with cycles, self-needs, nulls and long chains."""

import random

import pytest

from basin.operators.installorder import install_order


def plain(edges, items):
    nodes = set(items) | {x for e in edges for x in e}
    needs = {n: {b for a, b in edges if a == n} for n in nodes}

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for m in needs[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    ahead = {n: reach(n) for n in nodes}
    loops = {n for n in nodes if n in ahead[n]}
    level, out = {}, []

    def depth(n):
        if n not in level:
            level[n] = 1 + max((depth(m) for m in needs[n]), default=-1)
        return level[n]

    for n in nodes:
        if n not in loops and not ahead[n] & loops:
            out.append((n, depth(n), "ordered"))
        else:
            from_loop = n in loops or any(n in ahead[m] for m in loops)
            out.append((n, None, "cycle" if from_loop else "waits"))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_levels_and_cycles_equal_a_search(spark, seed):
    rng = random.Random(seed)
    edges = {(a, rng.randrange(a)) for a in (rng.randrange(1, 60) for _ in range(90))}
    edges |= {(rng.randrange(60), rng.randrange(60)) for _ in range(seed * 2)} | ({(7, 7)} if seed else set())
    needs = spark.createDataFrame([*edges, *list(edges)[:5], (61, None), (None, 3)], "item long, needs long")
    items = spark.createDataFrame([(100,), (3,), (None,)], "item long")
    got = sorted(map(tuple, install_order(needs, items).collect()))
    assert got == plain(edges, [100, 3, 61])


def test_chain_names_and_empty(spark):
    chain = spark.createDataFrame([(f"s{i:02d}", f"s{i - 1:02d}") for i in range(1, 12)], "service string, after string")
    got = install_order(chain, item="service", need="after")
    assert [(r.item, r.level) for r in got.orderBy("level").collect()] == [(f"s{i:02d}", i) for i in range(12)]
    assert install_order(chain.filter("false"), item="service", need="after").collect() == []
