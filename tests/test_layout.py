import pytest

from lodeflow.sources.layout import read_csv_text

COLUMNS = ("block_number", "chain_id")


def test_columns_by_name_in_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffblock_number,extra,chain_id\n1,x,7\n2,,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('chain_id,"block_number"\n0xbb,3\n')
    (tmp_path / "c.csv").write_text('note,chain_id,block_number\n"two\nlines, ""quoted""",8,4\n"odd "" one",9,5\n')
    (tmp_path / "d.txt").write_text("nothing\n")
    rows = read_csv_text(spark, str(tmp_path), COLUMNS).collect()
    assert sorted((r.block_number, r.chain_id) for r in rows) == [("1", "7"), ("2", None), ("3", "0xbb"), ("4", "8"), ("5", "9")]
    at = {r.block_number: (r.source_file.rsplit("/", 1)[1], r.source_block, r.source_row) for r in rows}
    assert at["1"] < at["2"] and at["4"] < at["5"] and at["3"][0] == "b.csv"


def test_a_missing_column_or_folder_without_files_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_csv_text(spark, str(tmp_path), COLUMNS)
    (tmp_path / "a.csv").write_text("block_number,chain_id\n1,1\n")
    (tmp_path / "b.csv").write_text("block_number\n1\n")
    with pytest.raises(ValueError, match="b.csv has no column chain_id"):
        read_csv_text(spark, str(tmp_path), COLUMNS)


def test_a_file_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("chain_id,block_number\n")
    assert read_csv_text(spark, str(tmp_path), COLUMNS).count() == 0
