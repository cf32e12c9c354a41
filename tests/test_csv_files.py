"""Typed CSV reading: good rows, quarantined rows, missing and empty files."""

import pytest

from vigilo.sources.csv_files import EmptyFileError, read_csv


def write(tmp_path, text):
    path = tmp_path / "rows.csv"
    path.write_text(text)
    return str(path)


def test_types_and_quarantine(spark, tmp_path):
    lines = [f'{i},{i / 2},true,2024-01-02T03:04:05,"a,{i}"' for i in range(50)]
    text = "id,x,ok,at,name\n" + "\n".join([*lines, "50,n/a,true,2024-01-02T03:04:05,b", "51,1.0", "52,1,true,2024-01-02T03:04:05,c,extra", ",,,,"]) + "\n"
    good, bad = read_csv(spark, write(tmp_path, text))
    assert good.dtypes == [("id", "bigint"), ("x", "double"), ("ok", "boolean"), ("at", "timestamp"), ("name", "string")]
    rows = sorted(good.collect(), key=lambda r: -1 if r.id is None else r.id)
    assert len(rows) == 51 and rows[0] == (None,) * 5 and rows[4].name == "a,3" and rows[4].x == 1.5
    assert sorted((r.record, r.reason) for r in bad.collect()) == [
        ("50,n/a,true,2024-01-02T03:04:05,b", "x is no double"), ("51,1.0", "number of fields"), ("52,1,true,2024-01-02T03:04:05,c,extra", "number of fields")]
    # columns read alone still leave broken records out
    assert good.select("id").count() == 51


def test_given_types_and_mixed_columns(spark, tmp_path):
    path = write(tmp_path, "a b,_record\n1,x\nq,y\n2,z\n")
    good, bad = read_csv(spark, path)
    assert good.dtypes == [("a b", "string"), ("_record", "string")] and good.count() == 3 and bad.count() == 0
    good, bad = read_csv(spark, path, {"a b": "int", "_record": "string"})
    assert sorted(r[0] for r in good.collect()) == [1, 2] and [r.reason for r in bad.collect()] == ["a b is no int"]


def test_missing_empty_and_header_only(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(EmptyFileError):
        read_csv(spark, write(tmp_path, ""))
    good, bad = read_csv(spark, write(tmp_path, "a,b\n"))
    assert good.columns == ["a", "b"] and good.count() == bad.count() == 0
