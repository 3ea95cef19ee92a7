from lodeflow.operators import clean, edgelist, quality
from lodeflow.schemas import BLACKLIST, RAW_TRANSFER_COLUMNS

H, A, V = "0x" + "a" * 64, "0x" + "b" * 40, "0x" + "0" * 63 + "5"
GOOD = dict(block_number="16308189", transfer_index="0", transaction_hash=H, from_address=A, to_address=A, value_binary=V, chain_id="1")


def transfers(spark, changes):
    return spark.createDataFrame([tuple((GOOD | c)[k] for k in RAW_TRANSFER_COLUMNS) + ("clash",) for c in changes], ", ".join(f"{c} string" for c in (*RAW_TRANSFER_COLUMNS, "reject_reason")))


REASONS = [
    ({}, None), ({"chain_id": None}, None), ({"chain_id": "NA"}, None), ({"block_number": " 16308189.0\t"}, None), ({"transaction_hash": "0x" + "Z" * 64}, None), ({"value_binary": "0x" + "F" * 64}, None), ({"block_number": "1.63e7"}, None), ({"transfer_index": " 0012345678901 ", "chain_id": " 001"}, None),
    ({"from_address": None}, "missing_value"), ({"to_address": "nan"}, "missing_value"), ({"value_binary": ""}, "missing_value"), ({"block_number": "<NA>", "to_address": "x"}, "missing_value"),
    ({"block_number": "16308189d"}, "block_number"), ({"block_number": "0xf8d8fd"}, "block_number"), ({"block_number": "9999"}, "block_number"), ({"block_number": "1000000000"}, "block_number"), ({"block_number": "inf"}, "block_number"), ({"block_number": "0" * 20 + "1"}, "block_number"),
    ({"transaction_hash": "0xab"}, "transaction_hash"), ({"from_address": "0x12"}, "from_address"), ({"to_address": A + "0"}, "to_address"), ({"value_binary": "0x5"}, "value_binary"), ({"transfer_index": "-1"}, "transfer_index"), ({"transfer_index": "1.0"}, "transfer_index"), ({"transfer_index": "9" * 19}, "transfer_index"), ({"chain_id": "2147483648"}, "chain_id"), ({"chain_id": "."}, "chain_id"), ({"chain_id": "x"}, "chain_id"),
]


def test_first_reasons_and_valid_rows_agree(spark):
    df = transfers(spark, [c for c, _ in REASONS])
    got = [r.reject_reason for r in clean.checked_transfers(df).collect()]
    assert got == [r for _, r in REASONS]
    kept = clean.clean_transfers(df)
    assert kept.count() == sum(r is None for _, r in REASONS) and {r.chain_id for r in kept.collect()} == {1}
    assert {r.reject_reason: r.n_rows for r in clean.reject_counts(clean.checked_transfers(df)).collect()}["kept"] == 8


def test_blocks(spark):
    rows = [(H.upper().replace("0X", "0x"), None, "16308189", "1672531199.9", None), (H, "0x1", "16308190", "soon", "1"), (None, H, "16308190", "1", "1"), (H, H, "5", "1", "1"), (H, H, "16308191", "inf", "1")]
    got = clean.clean_blocks(spark.createDataFrame(rows, "block_hash string, parent_hash string, block_number string, timestamp string, chain_id string")).collect()
    assert [tuple(r) for r in got] == [(H, None, 16308189, 1672531199, 1)]


def test_every_dropped_block_is_counted(spark):
    rows = [(H, None, "16308189.7", "1672531199", None), (H, "0x1", "16308190", "soon", "1"), (None, H, "16308190", "1", "1"), (H, H, "5", "1", "1"), ("0x1", H, "16308191", "1", "1"), (H, H, "16308191", "1", "x")]
    raw = spark.createDataFrame(rows, "block_hash string, parent_hash string, block_number string, timestamp string, chain_id string")
    got = {r.what: r.n_rows for r in clean.drop_report(clean.checked_blocks(raw), "blocks").collect()}
    assert got == {"read": 6, "kept": 1, "fraction_cut_off": 1, "timestamp": 1, "missing_value": 1, "block_number": 1, "block_hash": 1, "chain_id": 1}


def test_first_copy_and_overflow(spark):
    rows = [{}, {"from_address": "0x" + "c" * 40}, {"value_binary": "0x" + "0" * 64}, {"transfer_index": "1", "value_binary": "0x" + "f" * 64}, {"transfer_index": "2", "value_binary": "0x" + "0" * 64}]
    got = {r.transfer_sid: r for r in clean.abstract_transfer(clean.clean_transfers(transfers(spark, rows))).collect()}
    assert set(got) == {f"1_{H}_0", f"1_{H}_1"}
    assert got[f"1_{H}_0"].amount == "5" and got[f"1_{H}_0"].spender_address_sid == "1_" + A
    assert got[f"1_{H}_1"].amount == str(2**256 - 1)
    assert clean.abstract_account(clean.clean_transfers(transfers(spark, rows))).count() == 2
    assert clean.abstract_token(spark).first().token_sid == "1_native"


def test_edges_keep_unmatched_rows_and_null_accounts(spark):
    t = spark.createDataFrame([("t1", "x1", "a", "b", str(10**12), "k"), ("t2", "none", None, "b", str(10**13), "k"), ("t3", "x2", "a", BLACKLIST[0], str(10**13), "k"), ("t4", None, "a", "b", "999999999999", "k"), ("t5", "x2", "a", "b", "bad", "k")], "transfer_sid string, tx_sid string, spender_address_sid string, receiver_address_sid string, amount string, token_sid string")
    x = spark.createDataFrame([("x1", "b1"), ("x2", "b9")], "tx_sid string, block_sid string")
    b = spark.createDataFrame([("b1", 7), ("b1", 8)], "block_sid string, timestamp bigint")
    e = edgelist.edgelist(t, x, b)
    assert e.count() == 6 and sorted(r.timestamp for r in e.where("transfer_sid = 't1'").collect()) == [7, 8]
    assert tuple(edgelist.unmatched(t, x, b).first()) == (6, 2, 2)
    assert sorted((r.transfer_sid, r.amount) for r in edgelist.filter_edges(e).collect()) == [("t1", str(10**12))] * 2 + [("t2", str(10**13))]


def test_quality_checks(spark):
    df = spark.createDataFrame([("a", 1, "5"), ("a", None, "0"), (None, 3 * 10**9, "x"), ("b", 1_500_000_000, None)], "k string, t bigint, amount string")
    bad = lambda f: f.first().n_bad
    assert bad(quality.key_check(df, "x", "k")) == 2 and bad(quality.range_check(df, "x", "t")) == 3 and bad(quality.amount_check(df, "x", "amount")) == 3
    assert bad(quality.domain_check(df, "x", "k", ["a"])) == 2 and bad(quality.reference_check(df, "x", "k", df.where("k = 'a'"), "k")) == 1
    assert {r.column_name: r.n_bad for r in quality.null_checks(df, "x", ["k", "t"]).collect()} == {"k": 1, "t": 1}
    assert [r.ok for r in quality.type_check(df, "x", "k string, t int, z int").collect()] == [True, False, False]
    assert bad(quality.key_check(df.limit(0), "x", "k")) == 0
