"""Loading and writing text files."""

import os

import pytest
from pyspark.sql import functions as F

from paritas import sources
from paritas.sources.heads import head_lines
from paritas.session import scratch_path


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        for name, content in files.items():
            data = content if isinstance(content, bytes) else content.encode()
            (tmp_path / f"{name}.csv").write_bytes(data)
        return str(tmp_path)

    return write


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lenient_scan(spark, folder):
    path = folder(a='id,v\n1,2\n2\n3,4,5\n4,"a,b"\n5,6,\n\n7,8\n9,9,,9\n10,"x""y"\n  \n13,,,\n14,ab"c,d"e\n16,\n')
    df = sources.scan_csv(spark, path)
    kept = [("1", "2"), ("10", 'x"y'), ("16", None), ("2", None), ("4", "a,b"), ("7", "8")]
    assert rows(df) == sorted(kept, key=str)
    assert rows(df.select("id")) == sorted([(k,) for k, _ in kept], key=str)
    assert df.count() == len(kept)
    assert rows(df.select("v").where("v = '8'")) == [("8",)]


def test_bad_bytes_are_replaced(spark, folder):
    assert rows(sources.scan_csv(spark, folder(a=b"id,v\n1,a\xff\n"))) == [("1", "a�")]


def test_line_breaks_inside_quotes(spark, folder):
    path = folder(a='id,v\n1,"a\nb"\n2,c\n3\n4,5,6\n')
    assert rows(sources.scan_csv(spark, path, multiline=True)) == [("1", "a\nb"), ("2", "c"), ("3", None)]


def test_headers(spark, folder):
    assert sources.unique_headers(["a", "a", "", "b"]) == ["a", "a.1", "Unnamed: 2", "b"]
    path = folder(a="﻿id ;  v\n1;2\n", b="﻿id ;  v\n3;4\n")
    df = sources.scan_csv(spark, path)
    assert df.columns == ["id", "v"] and rows(df) == [("1", "2"), ("3", "4")]


def test_delimiter_per_file(spark, folder):
    path = folder(comma="a,b\n1,2\n", tie="a;b,c\n", none="x\ny\n", tab="a\tb\tc,d\n",
                  late="a|b\n1|2\n1|2\n1|2\n1|2\n,,,,,,,,,,,,,,,,,,,\n")
    found = {os.path.basename(r.file)[:-4]: r.delimiter for r in sources.detect_delimiters(spark, path).collect()}
    assert found == {"comma": ",", "tie": ",", "none": ",", "tab": "\t", "late": "|"}


def test_admission(spark, folder, tmp_path):
    path = folder(small="a\n", large="a\n" + "1\n" * 100)
    (tmp_path / "note.txt").write_text("x")
    got = {os.path.basename(r.path): (r.accepted, r.reason)
           for r in sources.admit_files(spark, path, max_bytes=50).collect()}
    assert got == {
        "small.csv": (True, None),
        "large.csv": (False, "file is larger than the limit"),
        "note.txt": (False, "file type is not supported"),
    }


def test_types_from_text(spark, folder):
    path = folder(a=(
        "i,w,d,b,s,n,m,big,huge\n007,1.0,1.5,True,x,,1,9007199254740993,9223372036854775808\n"
        " 8,1e3,inf,false,2020-01-01,NA,True,1,1\n-1,,NaN,,,null,,,\n"))
    df = sources.read_csv(spark, path, delimiter=",")
    assert dict(df.dtypes) == {
        "i": "bigint", "w": "bigint", "d": "double", "b": "boolean", "s": "string", "n": "bigint",
        "m": "string", "big": "bigint", "huge": "double"}
    assert rows(df.select("i", "w", "b", "big")) == sorted(
        [(7, 1, True, 9007199254740993), (8, 1000, False, 1), (-1, None, None, None)], key=str)


def test_typed_round_trip(spark):
    df = spark.sql("SELECT id, id / 4 AS q, id % 2 = 0 AS even, concat(' a\"', id, ',\\n') AS s, "
                   "CASE WHEN id % 3 = 0 THEN id END AS gap FROM range(20)")
    path = scratch_path(spark, "trip")
    sources.export_csv(df, path, ";")
    back = sources.read_csv(spark, path, delimiter=";", multiline=True)
    assert back.dtypes == df.dtypes
    assert rows(back) == rows(df)


def test_export_cast(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    out = sources.export_cast(df)
    assert dict(out.dtypes)["embedding"] == "string"
    back = out.select("vec_id", F.from_json("embedding", "array<float>").alias("e"))
    joined = back.join(df, "vec_id").where(F.col("e") == F.col("embedding"))
    assert joined.count() == df.count()


def test_union_all(spark):
    parts = [spark.createDataFrame([(1, "a")], "i int, s string"), spark.createDataFrame([("b", 2)], "s string, i int")]
    assert rows(sources.union_all(parts)) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        sources.union_all([])


def test_empty_file(spark, folder):
    df = sources.read_csv(spark, folder(a=""), delimiter=",")
    assert df.count() == 0


def test_a_field_that_goes_on_behind_its_line(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,note,n\n1,"one\ntwo",5\n2,x"y,6\n')
    with pytest.raises(Exception, match="multiline=True"):
        sources.scan_csv(spark, str(tmp_path / "t.csv")).collect()
    rows = [tuple(r) for r in sources.scan_csv(spark, str(tmp_path / "t.csv"), multiline=True).collect()]
    assert rows == [("1", "one\ntwo", "5"), ("2", 'x"y', "6")]


class Counting:
    """An open file that counts what is read of it."""

    def __init__(self, data: bytes):
        self.data, self.read_bytes = data, 0

    def read(self, n: int) -> bytes:
        part = self.data[self.read_bytes:self.read_bytes + n]
        self.read_bytes += len(part)
        return part


def test_bytes_read_of_a_head_do_not_grow_with_the_file():
    line = b"a;b;" + b"x" * 60 + b"\n"
    read = []
    for n in (10 ** 3, 10 ** 5):
        source = Counting(line * n)
        assert head_lines(source, 5) == [line[:-1].decode()] * 5
        read.append(source.read_bytes)
    assert read[0] == read[1] <= 1 << 15
    long = Counting(b"x" * (1 << 22))
    assert [len(x) for x in head_lines(long, 5, 1 << 20)] == [1 << 20] and long.read_bytes == 1 << 20
    assert head_lines(Counting(b"a\r\nb\rc\n\n"), 5) == ["a", "b", "c", ""] and head_lines(Counting(b""), 5) == []


def test_delimiter_of_a_file_too_large_to_read(spark, tmp_path):
    with open(tmp_path / "huge.csv", "wb") as out:
        out.write(b"a|b,c|d\n" * 6)
        out.truncate(1 << 42)  # without blocks on disk behind the first
    (tmp_path / "none.csv").write_text("\n")
    (tmp_path / "empty.csv").write_text("")
    found = {os.path.basename(r.file): r.delimiter for r in sources.detect_delimiters(spark, str(tmp_path)).collect()}
    assert found == {"huge.csv": "|", "none.csv": ","}


def test_files_of_other_headers(spark, folder):
    path = folder(one="id,v,only\n1,2,x\n3,4,y\n", two="v,id\n2.5,7\n", three="\n id ,v\nNA,\n", four="", five="id,v,only\n9,8,7\n")
    with pytest.raises(ValueError, match="read_parts"):
        sources.scan_csv(spark, path, delimiter=",")
    assert [names for names, _ in sources.header_catalogue(spark, path, ",")] == [["id", "v", "only"], [" id ", "v"], ["v", "id"]]
    df = sources.read_parts(spark, path, delimiter=",")
    assert dict(df.dtypes) == {"id": "bigint", "v": "double", "only": "string"}
    assert rows(df) == sorted([(1, 2.0, "x"), (3, 4.0, "y"), (7, 2.5, None), (None, None, None), (9, 8.0, "7")], key=str)


def test_types_of_unlike_parts(spark, folder):
    path = folder(a="i,b,n,f\n007,True,,1.5\n", b="b,i,n,f\n1,x,,2\n", c="f,n,i,b\nfalse,,,\n")
    df = sources.read_parts(spark, path, delimiter=",")
    assert dict(df.dtypes) == {"i": "string", "b": "string", "n": "bigint", "f": "string"}
    assert rows(df.select("i", "b", "n", "f")) == sorted([("7", "True", None, "1.5"), ("x", "1", None, "2"), (None, None, None, "False")], key=str)
    assert sources.common_types([{"a": "void"}, {"a": "bigint", "b": "void"}, {"a": "double"}]) == {"a": "double", "b": "bigint"}


def quoted_file(n: int) -> str:
    """Records with breaks, quotes, delimiters and lines that look like records inside quotes."""
    out = ["id,note,n"]
    for i in range(n):
        note = ["plain", f'"one\ntwo {i}"', f'"a ""b""\n\n{i},x,y\n"', f'x"y{i}', '"\n"', f'"q"",""\n{i}"', ""][i % 7]
        out.append(f"{i},{note},{i % 5}" + ("\n" if i % 11 == 0 else ""))
    out.insert(n // 2, f'{n},"' + "long\n" * 400 + '",0')
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("split_bytes", [300, 2000, 1 << 20])
def test_line_breaks_inside_quotes_over_splits(spark, tmp_path, split_bytes):
    (tmp_path / "a.csv").write_text(quoted_file(200))
    (tmp_path / "b.csv").write_text("\n" + quoted_file(30) + '500,"open at the end\nof the file",1')
    expected = rows(sources.scan_csv(spark, str(tmp_path), delimiter=",", multiline=True))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        scan = spark.read.text(str(tmp_path))
        assert split_bytes > 2000 or scan.rdd.getNumPartitions() > 2
        found = rows(sources.scan_csv(spark, str(tmp_path), delimiter=",", multiline="split"))
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert len(expected) == 233 and found == expected
