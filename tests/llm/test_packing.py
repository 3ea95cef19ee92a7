import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeflow.llm.packing import best_fit, fill_report, pack, plan, reduce


def unpacked(fillings):
    n = Counter()
    for content, k in fillings:
        for s, q in content.items():
            n[s] += q * k
    return {s: c for s, c in n.items() if c}


def optimum(sizes, capacity):
    """Fewest bins, by search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= sizes[i]:
                place(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(30, 40))
def test_all_items_once_and_within_capacity(sizes, capacity):
    counts = dict(Counter(sizes))
    fixed, left = reduce(counts, capacity)
    fillings = fixed + best_fit(left, capacity)
    assert unpacked(fillings) == counts
    assert all(sum(s * q for s, q in c.items()) <= capacity for c, _ in fillings)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(3, 20), max_size=9))
def test_reduction_keeps_an_optimum(sizes):
    fixed, left = reduce(dict(Counter(sizes)), 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(k for _, k in fixed) + optimum(rest, 20) == optimum(sizes, 20)


def test_plan_gives_each_rank_one_bin():
    rng = random.Random(4)
    counts = {s: rng.randrange(1, 400) for s in rng.sample(range(1, 513), 200)}
    p, load = plan(counts, 512), defaultdict(int)
    import numpy as np

    for s, n in counts.items():
        for b in p.find(np.full(n, s), np.arange(n)):
            load[int(b)] += s
    assert len(load) == p.n_bins and max(load) == p.n_bins - 1 and max(load.values()) <= 512
    assert p.n_bins <= 1.02 * sum(s * n for s, n in counts.items()) / 512 + 1


CONTAINERS = [("short", 10), ("long", 64), ("none", None), ("zero", 0)]


def run(spark, items):
    kinds = spark.createDataFrame(CONTAINERS, "container string, capacity_tokens int")
    df = spark.createDataFrame(items, "doc_id bigint, n_tokens bigint").selectExpr("*", "1 as k", "2 as _part")
    return pack(df, kinds), kinds


def test_documents_are_whole_unless_too_long(spark):
    rng = random.Random(1)
    items = [(i, rng.choice([0, 1, 3, 3, 3, rng.randrange(150)])) for i in range(600)]
    out, kinds = run(spark, items)
    rows = out.collect()
    for kind, cap in CONTAINERS[:2]:
        mine = [r for r in rows if r.container == kind]
        pieces, load = defaultdict(list), Counter()
        for r in mine:
            pieces[r.doc_id].append((r.piece_no, r.first_token, r.n_tokens))
            load[r.bin_no] += r.n_tokens
        assert max(load.values()) <= cap and sorted(load) == list(range(len(load)))
        for i, n in items:
            p = sorted(pieces[i])
            assert sum(x for _, _, x in p) == n and [a for a, _, _ in p] == list(range(len(p)))
            assert len(p) == (1 if n <= cap else -(-n // cap)) and all(f == sum(x for _, _, x in p[:k]) for k, (_, f, _) in enumerate(p))
    for r in fill_report(out, kinds).collect():
        assert r.least_bins <= r.n_bins <= r.least_bins * 1.05 + 2
    assert {r.container for r in rows} == {"short", "long"}


@pytest.mark.parametrize("items", [[], [(1, None)], [(1, 0)], [(1, 1000)], [(i, 10) for i in range(300)]])
def test_extremes(spark, items):
    rows = run(spark, items)[0].collect()
    assert sum(r.n_tokens for r in rows) == 2 * sum(n or 0 for _, n in items)


def test_pairs_by_hand():
    assert sum(k for _, k in reduce({6: 3, 4: 3}, 10)[0]) == 3
    assert reduce({9: 2}, 10) == ([({9: 1}, 2)], {})
