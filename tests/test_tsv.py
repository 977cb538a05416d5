"""Records, types and conversion of tab-separated files."""

import pytest

from granary.api import load_tsv
from granary.sources.tables import describe, table_name
from granary.sources.tsv import infer, read_fields, read_tsv


@pytest.fixture()
def file(tmp_path):
    def make(text, name="t.tsv"):
        (tmp_path / name).write_bytes(text.encode())
        return str(tmp_path / name)

    return make


@pytest.mark.parametrize(
    "text, records",
    [
        ("a\tb\nc\td\n", [["a", "b"], ["c", "d"]]),
        ("a\tb", [["a", "b"]]),
        ("a\tb\r\nc\td\r\n", [["a", "b"], ["c", "d"]]),
        ("\t\t\n", [["", "", ""]]),
        ("a\n\nb\n", [["a"], [""], ["b"]]),
        ('"q\t\\t\n', [['"q', "\\t"]]),
    ],
)
def test_records(spark, file, text, records):
    assert [list(r[0]) for r in read_fields(spark, file(text)).collect()] == records


@pytest.mark.parametrize(
    "text, types",
    [
        ("1\n-2\n+3\n", ["int"]),
        ("1\n2147483648\n", ["bigint"]),
        ("1\n1.5\n", ["double"]),
        (".5\n1.\n-1e10\n", ["double"]),
        ("1\nabc\n", ["string"]),
        ("1\n9223372036854775808\n", ["string"]),
        ("-9223372036854775808\n", ["bigint"]),
        ("9223372036854775808\n1.5\n", ["string"]),
        ("\\N\n1\n", ["int"]),
        ("\\N\n\n", ["string"]),
        ("NaN\n", ["string"]),
        (" 7\n", ["string"]),
        ("0x10\n", ["string"]),
        ("1\ta\n2\n", ["int", "string"]),
        ("1.5e\n", ["string"]),
    ],
)
def test_types(spark, file, text, types):
    assert infer(read_fields(spark, file(text))) == types


def test_nulls_and_short_records(spark, file):
    df = read_tsv(spark, file("1\ta\t\n\\N\t\\N\t2\n3\n"))
    assert df.columns == ["col0", "col1", "col2"]
    assert [tuple(r) for r in df.collect()] == [(1, "a", None), (None, None, 2), (3, None, None)]
    assert read_tsv(spark, file("\tx\n", "u.tsv")).collect()[0][0] == ""


def test_header_and_names(spark, file):
    path = file("id\tcity\n1\tBern\n1\tid\n", "h.tsv")
    assert [tuple(r) for r in read_tsv(spark, path, header=True).collect()] == [(1, "Bern"), (1, "id")]
    assert read_tsv(spark, path, header=True, names=["x", "y"]).columns == ["id", "city"]
    assert read_tsv(spark, file("1\t2\n"), names=["x", "y"]).columns == ["x", "y"]


def test_convert_overwrites(spark, file, tmp_path):
    out = str(tmp_path / "hits.table")
    load_tsv(spark, file("1\n2\n"), out)
    table = load_tsv(spark, file("a\tb\n"), out, names=["x", "y"], dict_threshold=100)
    assert [tuple(r) for r in table.collect()] == [("a", "b")]
    assert describe(table, table_name(out)) == {"name": "hits", "rowCount": 1, "columns": [{"name": n, "type": "STRING", "nullable": True, "encoding": "PARQUET"} for n in ("x", "y")]}


def test_empty_file(spark, file):
    assert read_tsv(spark, file("")).columns == []


def test_header_of_each_file(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(50):
        (folder / f"{k}.tsv").write_bytes(f"id\tcity\n{k}\tBern\n".encode() if k % 7 else b"id\tcity\r\n")
    table = read_tsv(spark, str(folder), header=True)
    assert table.schema.simpleString() == "struct<id:int,city:string>"
    assert sorted(tuple(r) for r in table.collect()) == [(k, "Bern") for k in range(50) if k % 7]
    assert table.rdd.getNumPartitions() < 50  # several files share a partition


def test_header_text_inside_a_file_is_data(spark, tmp_path):
    folder = tmp_path / "few"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.tsv").write_bytes(f"id\tcity\n{k}\tBern\nid\tcity\n".encode())
    got = sorted(tuple(r) for r in read_tsv(spark, str(folder), header=True).collect())
    assert got == sorted([("0", "Bern"), ("1", "Bern"), ("2", "Bern"), *[("id", "city")] * 3])
