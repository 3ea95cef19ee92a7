import json
from collections import Counter

from lodeflow.operators.schema_drift import BLOCK_FIELDS, FORMS, changes, consolidate, form_of, parse, target_script


def brute(rows):
    files = {}
    for feed, seq, rec in rows:
        files.setdefault((feed, seq), []).append(parse(rec) or {})
    out, state = set(), {}
    for feed, seq in sorted(files):
        recs = files[feed, seq]
        keys = {k for r in recs for k in r}
        shapes = {}
        for k in keys:
            vs = [r[k] for r in recs if r.get(k) is not None]
            adr = sum(isinstance(v, str) and v.startswith("0x") and len(v) == 42 for v in vs)
            w8 = sum(isinstance(v, str) and v.startswith("0x") and len(v) == 18 for v in vs)
            shapes[k] = "address" if vs and adr * 2 > len(vs) else "word8" if vs and w8 * 2 > len(vs) else "other"
        script = target_script(tuple(sorted((k, shapes[k]) for k in keys)))
        now = {}
        for k in keys:
            c = Counter(f for r in recs if (f := form_of(r.get(k))))
            now[script.get(k, k)] = (k, min(c, key=lambda f: (-c[f], FORMS.index(f))) if c else None)
        if feed in state:
            before = state[feed]
            out |= {(seq, f, "added") for f in now.keys() - before.keys()} | {(seq, f, "removed") for f in before.keys() - now.keys()}
            for f in now.keys() & before.keys():
                if now[f][0] != before[f][0]:
                    out.add((seq, f, "renamed"))
                if now[f][1] and before[f][1] and now[f][1] != before[f][1]:
                    out.add((seq, f, "retyped"))
                now[f] = (now[f][0], now[f][1] or before[f][1])
        state[feed] = now
    return out


def test_changes_against_brute_force(spark, data_dir):
    r = spark.read.parquet(data_dir.replace("sf0.001", "sf0.01") + "/raw_block_files.parquet")
    want = brute([(x.feed, x.file_seq, x.record) for x in r.collect()])
    got = [(x.file_seq, x.field, x.change) for x in changes(r).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def frame(spark, files):
    rows = [("f", seq, f"n{seq}", i, json.dumps(x) if not isinstance(x, (str, type(None))) else x, "extra") for seq, recs in files for i, x in enumerate(recs)]
    return spark.createDataFrame(rows, "feed string, file_seq bigint, file_name string, record_no int, record string, field string")


def test_rename_retype_null_and_absence(spark):
    files = [
        (1, [{"gas_used": 1, "note": "x"}]),
        (2, [{"gasUsed": "12", "note": None}]),
        (3, [{"gasUsed": None}]),
        (4, [{"gas_used": 7.0, "note": 3}]),
        (5, ["not json", None]),
    ]
    got = {(x.file_seq, x.field, x.change) for x in changes(frame(spark, files)).collect()}
    assert got == {
        (2, "gas_used", "renamed"), (2, "gas_used", "retyped"), (3, "note", "removed"), (4, "gas_used", "renamed"),
        (4, "gas_used", "retyped"), (4, "note", "added"), (5, "gas_used", "removed"), (5, "note", "removed"),
    }


def test_consolidated_table(spark):
    files = [(1, [{"gasUsed": "0x10", "wd_root": ["0xab", "cd"], "block_time": "1970-01-01T00:01:00Z", "tag": 1}, "broken"]), (2, [{"gas_used": 16.0, "header": {"miner": "0x" + "a" * 40}}])]
    rows = {(r.file_seq, r.record_no): r for r in consolidate(frame(spark, files)).collect()}
    assert len(rows) == 3
    assert (rows[1, 0].gas_used, rows[1, 0].withdrawals_root, rows[1, 0].timestamp, rows[1, 0].other) == (16, "0xabcd", 60, {"tag": "1"})
    assert rows[1, 1].gas_used is None
    assert (rows[2, 0].gas_used, rows[2, 0].author) == (16, "0x" + "a" * 40)


def test_empty_table(spark):
    e = frame(spark, [])
    assert changes(e).count() == 0 and consolidate(e).count() == 0


def test_names_of_other_quantities_stay():
    nodes = tuple((k, "other") for k in ("blob_gas_used", "excess_blob_gas", "requests_hash", "parent_beacon_root", "shard_hint"))
    assert target_script(nodes) == {}
    assert target_script((("td_binary", "other"), ("prev_randao", "other"), ("fee_recipient", "address"))) == {"td_binary": "total_difficulty_binary", "prev_randao": "mix_hash", "fee_recipient": "author"}
    assert len(BLOCK_FIELDS) == 23


def test_a_key_outside_the_header_is_renamed(spark):
    files = [
        (1, [{"excess_blob_gas": 1, "blob_gas_used": 2}]),
        (2, [{"excessBlobGas": None, "blob_gas_used": 2}]),
        (3, [{"ExcessBlobGas": "0x1", "blobTag": 1}]),
        (4, [{"blobTag": 1, "shardHint": 1, "shard_hint": 2}]),
        (5, [{"blobTag": 1, "shard_hint": 2}]),
    ]
    got = {(x.file_seq, x.field, x.change) for x in changes(frame(spark, files)).collect()}
    assert got == {
        (2, "excessBlobGas", "renamed"), (3, "ExcessBlobGas", "renamed"), (3, "ExcessBlobGas", "retyped"), (3, "blob_gas_used", "removed"), (3, "blobTag", "added"),
        (4, "ExcessBlobGas", "removed"), (4, "shardHint", "added"), (4, "shard_hint", "added"), (5, "shardHint", "removed"),
    }


def test_keys_that_move_below_a_parent_are_renamed(spark):
    files = [
        (1, [{"gas_used": 1, "miner": "0x" + "a" * 40, "tag": 1}]),
        (2, [{"gas_used": 1, "header": {"miner": "0x" + "a" * 40}, "tag": 1}]),
        (3, [{"header": {"miner": "0x" + "a" * 40, "gasUsed": 1, "tag": 1}}]),
    ]
    got = {(x.file_seq, x.field, x.change) for x in changes(frame(spark, files)).collect()}
    assert got == {(2, "author", "renamed"), (3, "gas_used", "renamed"), (3, "tag", "renamed")} or got == {(2, "author", "renamed"), (3, "gas_used", "renamed"), (3, "header.tag", "renamed")}


def test_one_form_for_each_field(spark):
    """The number 41200987654398842488283 as hexadecimal, digits, whole number, bytes in base 64; a rounded one is kept aside."""
    n = 41200987654398842488283
    import base64

    b64 = base64.b64encode(n.to_bytes(16, "big")).decode()
    values = [f"0x{n:x}", f"0x{n:064X}", str(n), n, b64, 4.120098765439884e22]
    rows = consolidate(frame(spark, [(i, [{"total_difficulty_binary": v, "block_number": 20000 + i, "size": "0x10", "total_difficulty_f64": 4.12e22}]) for i, v in enumerate(values)])).orderBy("file_seq").collect()
    assert [r.total_difficulty_binary for r in rows] == [f"0x{n:x}"] * 5 + [None]
    assert rows[5].other == {"total_difficulty_binary!": "4.120098765439884E22"} or rows[5].other == {"total_difficulty_binary!": "4.120098765439884e+22"}
    assert rows[0].block_number == 20000 and rows[0].size == 16 and rows[0].total_difficulty_f64 == 4.12e22 and not rows[0].other
