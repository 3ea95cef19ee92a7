import csv

from lodeflow import cli
from lodeflow.schemas import RESULT_COLUMNS
from lodeflow.sources.layout import month_or_none, month_path

H, A = "0x{:064x}", "0x{:040x}"


def test_a_month_from_csv_to_result(spark, tmp_path, capsys):
    blocks, transfers = tmp_path / "raw/ethereum/blocks/2023/01", tmp_path / "raw/ethereum/native_transfers/2023/01"
    blocks.mkdir(parents=True)
    transfers.mkdir(parents=True)
    with open(blocks / "b.csv", "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(["block_hash", "parent_hash", "extra", "block_number", "timestamp", "chain_id"])
        w.writerows([[H.format(i), H.format(i - 1), 'a"b\nc', 20000 + i, 1672531199 + i, ""] for i in range(1, 6)] + [["0x1", "", "", 20009, 1, 1]])
    with open(transfers / "t.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["block_number", "transfer_index", "transaction_hash", "from_address", "to_address", "value_binary", "chain_id"])
        for i in range(40):
            w.writerow([20001 + i % 5, i % 3, H.format(i), A.format(1 + i % 7).upper().replace("0X", "0x"), A.format(1 + i * 3 % 11), H.format(10**15 + i), 1])
        w.writerow([20001, 0, H.format(0), A.format(90), A.format(91), H.format(5), 1])  # a copy of the first transfer
        w.writerow(["nan", 0, H.format(0), A.format(90), A.format(91), H.format(5), 1])
    (tmp_path / "w.csv").write_text(f"address\n{A.format(3)}\n")
    cli.main(["--year", "2023", "--month", "1", "--root", str(tmp_path), "--whitelist", str(tmp_path / "w.csv"), "--csv"])
    result = month_or_none(spark, month_path(str(tmp_path), "result", "ethereum", 2023, 1))
    rows = result.collect()
    assert result.columns == list(RESULT_COLUMNS) and len(rows) == 11
    assert [r.is_infra for r in rows].count(1) == 1 and next(r for r in rows if r.is_infra).in_degree is None
    kept = spark.read.parquet(month_path(str(tmp_path), "clean/transfers", "ethereum", 2023, 1)).count()
    assert kept == 41 and spark.read.parquet(month_path(str(tmp_path), "abstract/token_transfer", "ethereum", 2023, 1)).count() == 40
    assert month_or_none(spark, month_path(str(tmp_path), "result", "ethereum", 1999, 1)) is None
    assert list((tmp_path / "result/ethereum/2023/01_csv").glob("*.csv"))
