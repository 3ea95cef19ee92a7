import random

import pytest

from lodeflow.llm import mixing
from lodeflow.llm.mixing import fly, land, mix, report, shares

TARGETS = [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 4), ("absent", 0.0, 2), ("nothing", 0.1, 2), (None, 0.3, 2)]


def items(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choices(["big", "mid", "small", None, "other"], [60, 25, 5, 5, 5])[0], int(rng.lognormvariate(5, 1.3))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").selectExpr("*", "'x' as _p")


def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_flight_keeps_both_balances():
    rng = random.Random(2)
    sizes, p = [rng.randrange(1, 500) for _ in range(2000)], [0.37] * 2000
    q = fly(sizes, p, "seed")
    assert sum(q) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(q, sizes)) == pytest.approx(sum(a * b for a, b in zip(p, sizes)))
    assert sum(0 < x < 1 for x in q) <= 2 and q == fly(sizes, p, "seed") and q != fly(sizes, p, "another")
    done = land(sizes, q)
    assert set(done) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(done, sizes)) - sum(a * b for a, b in zip(p, sizes))) < 2


def test_flight_gives_equal_chances():
    sizes, hits = [5, 5, 7, 9, 11, 11, 30, 2], [0] * 8
    for s in range(3000):
        for i, x in enumerate(fly(sizes, [0.5] * 8, s)):
            hits[i] += x
    assert all(abs(h / 3000 - 0.5) < 0.04 for h in hits)


@pytest.mark.parametrize("block,fan_in", [(4096, 64), (100, 2)])
def test_shares_and_caps(spark, monkeypatch, block, fan_in):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "FAN_IN", fan_in)
    rows, df = items(spark)
    out = mix(df, targets(spark))
    got = out.collect()
    size = {i: (s, n) for i, s, n in rows}
    assert len({r.doc_id for r in got}) == len(got) and all((r.source, r.n_tokens) == size[r.doc_id] for r in got)
    caps = {"big": 1, "mid": 3, "small": 4}
    assert all(1 <= r.copies <= caps[r.source] for r in got)
    rep = {r.source: r for r in report(out, df, targets(spark)).collect()}
    known = {s: w for s, w, _ in TARGETS[:3]}
    for s, w in known.items():
        assert rep[s].actual_share == pytest.approx(w / sum(known.values()), abs=2e-3) and rep[s].n_tokens == sum(r.n_tokens * r.copies for r in got if r.source == s)
    assert rep["nothing"].actual_share == rep["other"].actual_share == rep["absent"].actual_share == 0.0
    assert {(r.doc_id, r.copies) for r in mix(df.repartition(7), targets(spark)).collect()} == {(r.doc_id, r.copies) for r in got}


def test_total_is_the_largest_possible():
    total, copies = shares({"a": (10, 1000), "b": (10, 100)}, {"a": (0.5, 1), "b": (0.5, 2)})
    assert total == 400 and copies == {"a": 0.2 * 1.0, "b": 2.0}
    assert shares({}, {"a": (1.0, 1)}) == (0.0, {}) and shares({"a": (3, 0)}, {"a": (1.0, 1)}) == (0.0, {})


def test_empty_tables(spark):
    _, df = items(spark, 20)
    assert mix(df.limit(0), targets(spark)).count() == 0 and mix(df, targets(spark).limit(0)).count() == 0
    assert report(mix(df.limit(0), targets(spark)), df.limit(0), targets(spark)).count() == len(TARGETS)
