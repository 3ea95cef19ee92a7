import random
from collections import defaultdict

from lodeflow.operators.tree_aggregate import account_totals, heavy_keys

ROLES = {"spender": ("s", "r"), "receiver": ("r", "s")}


def brute(rows):
    out = {}
    for role, (a, b) in (("spender", (0, 1)), ("receiver", (1, 0))):
        g = defaultdict(list)
        for r in rows:
            g[r[a]].append((r[b], r[2]))
        for k, v in g.items():
            nums = [int(x) for _, x in v if x is not None and x.strip().isdigit()]
            out[role, k] = (len(v), len(nums), str(sum(nums)) if nums else None, len({o for o, _ in v if o is not None}))
    return out


def result(df):
    return {(r.role, r.account_sid): (r.n_rows, r.n_amounts, r.total_amount, r.n_counterparties) for r in df.collect()}


def test_skewed_accounts_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), f"r{rng.randrange(300)}" if rng.random() < 0.9 else None, rng.choice([str(rng.randrange(10**30)), "", None, " 7 ", str(2**255)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "s string, r string, amount string").selectExpr("*", "'x' as role", "1 as n_rows")
    for leaves, fan_in in ((64, 8), (1, 2), (10, 3)):
        assert result(account_totals(df, ROLES, "amount", leaves, fan_in)) == brute(rows)


def test_heavy_keys_and_empty(spark):
    df = spark.createDataFrame([("hot", "x", "1")] * 3 + [(None, "y", "1")] * 97, "s string, r string, amount string")
    t = account_totals(df, ROLES, "amount")
    assert sorted((r.role, r.account_sid) for r in heavy_keys(t, 100, 0.02).collect()) == [("receiver", "x"), ("receiver", "y"), ("spender", "hot")]
    assert account_totals(df.limit(0), ROLES, "amount").count() == 0
